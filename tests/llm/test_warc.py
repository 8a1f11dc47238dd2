import base64
import hashlib
import time

from helixbin.llm import warc
from helixbin.llm.common import table


def test_plain_text():
    page = "<!DOCTYPE html><html lang='de'><head><title>T &amp; U</title><style>p{}</style></head><body><nav><a href=\"/x\">x</a></nav><!-- <p>no</p> --><p>One  two<br>three &lt;4&gt;</p><script>var a='</p>';</script><p>fünf</body>"
    assert warc.plain_text(page) == "x\nOne two\nthree <4>\nfünf"
    assert warc.plain_text("") == "" and warc.plain_text("no tags") == "no tags"


def test_unclosed_tags_take_linear_time():
    for part in ("<svg>", "<script", "<script>", "<!--", "<p ", "<title>", "<a href=", "</script  ", "<html lang", "<a x"):
        began = time.time()
        page = part * 200_000
        assert "tail" in warc.plain_text(page + " tail</b>") or "<" in part
        warc.title(page)
        list(warc._derived({"page_id": 1, "record_id": "r", "target_uri": None, "date": "d", "http": "", "payload": page, "payload_digest": "", "block_digest": ""}))
        assert time.time() - began < 10, part


def test_openings_without_end_hide_nothing():
    assert warc.plain_text("a<script>b<style>c</style>d") == "ab d"
    assert warc.plain_text("a<!-- b <p>c</p> <!-- d --> e") == "a e"
    assert warc.plain_text("a<SCRIPT x>1</Script >b<scripty>c</scripty>") == "a bc"


def test_control_characters_and_ids(spark):
    """No header is injected; equal (page, url) with other content, and null pages, have ids of their own."""
    data = [(1, "http://a/\r\nX-Evil: 1 2", "<p>x"), (1, "http://a/\r\nX-Evil: 1 2", "<p>y"), (None, None, "one"), (None, None, "two"), (2, "  http://b ", "z")]
    rows = warc.derive(warc.responses(spark.createDataFrame(data, "page_id long, url string, html string"))).collect()
    assert len({r["record_id"] for r in rows}) == 10 and len({r["refers_to"] for r in rows}) == 5
    back = list(warc.parse(b"".join(warc.serialize([h.asDict() for h in r["headers"]], r["block"]) for r in rows)))
    assert len(back) == 10 and all("X-Evil" not in head for head, _ in back)
    assert back[0][0]["WARC-Target-URI"] == "http://a/%0D%0AX-Evil:%201%202"
    odd = [{"name": "WARC-Type", "value": "metadata\r\nX: 1"}, {"name": "Content-Length", "value": "2"}]
    assert list(warc.parse(warc.serialize(odd, "ab"))) == [({"WARC-Type": "metadata%0D%0AX: 1", "Content-Length": "2"}, b"ab")]


def test_links_and_digests(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    source = {r["page_id"]: r for r in warc.responses(pages).collect()}
    rows = warc.derive(warc.responses(pages)).collect()
    assert len(rows) == 2 * len(source)
    for r in rows:
        s, head = source[r["page_id"]], {h["name"]: h["value"] for h in r["headers"]}
        sha = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
        assert head["WARC-Refers-To"] == r["refers_to"] == s["record_id"] != r["record_id"]
        assert head["WARC-Source-Payload-Digest"] == s["payload_digest"] == sha(s["payload"].encode())
        assert head["WARC-Target-URI"] == s["target_uri"] and head["WARC-Date"] == s["date"]
        assert head["WARC-Block-Digest"] == sha(r["block"].encode()) and int(head["Content-Length"]) == len(r["block"].encode())
        if r["warc_type"] == "conversion":
            assert r["block"] == warc.plain_text(s["payload"]) and "<p>" not in r["block"]
        else:
            assert f"source-payload-digest: {s['payload_digest']}\r\n" in r["block"] and "source-header: Content-Type: text/html" in r["block"]
    assert len({r["record_id"] for r in rows}) == len(rows)


def test_files_round_trip(spark, sf_dir, tmp_path):
    records = warc.derive(warc.responses(table(spark, sf_dir, "pages"))).repartition(3)
    manifest = warc.write(records, f"file://{tmp_path}/w").cache()
    back = {(r["record_id"], r["refers_to"], r["block"]) for r in warc.read(spark, manifest).collect()}
    assert back == {(r["record_id"], r["refers_to"], r["block"]) for r in records.collect()}


def test_edges(spark):
    df = spark.createDataFrame([(None, None, None), (1, "http://a/", ""), (1, "http://a/", ""), (2, None, "<a href=x y>" * 3), (3, "u", "<p>" + "long " * 50000)], "page_id long, url string, html string").selectExpr("*", "html AS record_id", "1 AS date")
    rows = warc.report(df).collect()
    assert len(rows) == 10 and sum(r["page_id"] is None for r in rows) == 2
    assert {r["content_length"] for r in rows if r["page_id"] == 1 and r["warc_type"] == "conversion"} == {0}
    assert all(r["target_uri"] is None for r in rows if r["page_id"] in (None, 2))
    assert warc.report(df.where("false")).count() == 0
