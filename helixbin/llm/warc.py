"""WARC derivatives: metadata and plain-text conversion records for response records.

``responses`` makes response records of a table of pages, ``derive`` makes two linked records of each:

* ``metadata`` (application/warc-fields): title, language, outlinks, the source's HTTP status and headers, its
  digests, and the digest and length of its text;
* ``conversion`` (text/plain): the visible text, one line a block.

Both carry WARC-Refers-To (the response's id), its target URI and date, and their own digests. Ids are UUIDs
of version 5: a response's is made from its page, URL and payload digest, a derived record's from the response's, so a repeated
task makes the same records and different content never shares an id. ``write`` stores records as
gzip members in files of the shared file system, ``read`` parses such files again.

A null html counts as empty, a null url leaves the target header out, blanks and control characters of a url are percent-encoded.
Equal pages give equal records; null page ids stay null. Texts of any length and with any unclosed tags take time in proportion to their length. An empty table gives no records. Other columns of the pages are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches

DATE = "2024-01-01T00:00:00Z"
RESPONSE = "page_id long, record_id string, target_uri string, date string, http string, payload string, payload_digest string, block_digest string"
RECORD = "page_id long, warc_type string, record_id string, refers_to string, headers array<struct<name:string,value:string>>, block string"

#: White space of HTML, which both regex dialects in use read alike.
_WS = r"[ \t\n\r\f]"
#: Elements without visible text, and elements that end a line.
_HIDDEN = ("script", "style", "noscript", "template", "svg", "head")
_BLOCKS = "p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|main|aside|blockquote|pre|hr|form|dl|dt|dd|body|html"
# No pattern runs past the next angle bracket, so that unclosed tags cost no more than their own length.
_REST = rf"(?:{_WS[:-1]}/][^<>]*)?>"
_OPEN = re.compile(rf"<!--|<!doctype[^<>]*>|<({'|'.join(_HIDDEN)}){_REST}", re.I)
_CLOSE = {"<!--": re.compile("-->"), **{k: re.compile(rf"</{k}{_WS}*>", re.I) for k in (*_HIDDEN, "title")}}
_TITLE = re.compile(rf"<title{_REST}", re.I)
_LANG = re.compile(rf"<html{_WS}(?:[^<>]*?{_WS})??lang{_WS}*={_WS}*[\"']?([A-Za-z-]+)", re.I)
_LINK = re.compile(rf"<a{_WS[:-1]}/](?:[^<>]*?{_WS[:-1]}/])??href{_WS}*={_WS}*(\"[^\"<>]*\"|'[^'<>]*'|[^ \t\n\r\f<>\"']+)", re.I)
_BREAK = re.compile(rf"</?(?:{_BLOCKS}){_REST}", re.I)
_TAG = re.compile(r"<[^<>]*>")
_SPACE = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[\n ]*")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def visible(page: str) -> str:
    """The page with a blank for each comment, doctype and hidden element; one pass, whatever is left unclosed.

    An opening without its end hides nothing. Once an end is missing it is missing for all later openings of that kind.
    """
    out, kept_from, at, endless = [], 0, 0, set()
    while (m := _OPEN.search(page, at)) is not None:
        kind, at = (m[1] or m[0][:4]).lower(), m.end()
        if kind in _CLOSE:
            end = None if kind in endless else _CLOSE[kind].search(page, at)
            if end is None:
                endless.add(kind)
                continue
            at = end.end()
        out.append(page[kept_from : m.start()])
        kept_from = at
    return " ".join([*out, page[kept_from:]])


def plain_text(page: str) -> str:
    """The visible text: blocks become lines, white space is folded, entities are resolved."""
    text = _TAG.sub("", _BREAK.sub("\n", visible(page)))
    return _LINES.sub("\n", _SPACE.sub(" ", entities.unescape(text))).strip(" \n")


def title(page: str) -> str:
    first = _TITLE.search(page)
    end = _CLOSE["title"].search(page, first.end()) if first else None
    return " ".join(entities.unescape(page[first.end() : end.start()]).split()) if first and end else ""


def header_value(value: str) -> str:
    """A value without what would end its line: control characters and blanks at the ends are percent-encoded or go."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value.strip(" "))


def record_uuid(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def _map(df: DataFrame, schema: str, make) -> DataFrame:
    short_batches(df.sparkSession)
    arrow = df.sparkSession.createDataFrame([], schema).schema
    names = arrow.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(arrow)
        for batch in batches:
            rows = [x for r in batch.to_pylist() for x in make(r)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows], schema=target)

    return df.mapInArrow(work, schema)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of pages: an HTTP head, the payload, and the digests of both."""

    def make(r: dict):
        body = (r["html"] or "").encode()
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
        url = None if r["url"] is None else _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", r["url"])
        yield r["page_id"], record_uuid(r["page_id"], url, digest(body)), url, date, head, r["html"] or "", digest(body), digest(head.encode() + body)

    return _map(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), RESPONSE, make)


def _derived(r: dict):
    payload = r["payload"] or ""
    text = plain_text(payload)
    source = [("WARC-Refers-To", r["record_id"])]
    if r["target_uri"] is not None:
        source.append(("WARC-Target-URI", r["target_uri"]))
    source.append(("WARC-Date", r["date"]))
    status, *fields = (r["http"] or "").rstrip("\r\n").split("\r\n")
    lang = _LANG.search(payload)
    links = [entities.unescape(m[1:-1] if m[0] in "\"'" else m) for m in _LINK.findall(payload)]
    lines = [
        ("title", title(payload)),
        ("language", lang[1].lower() if lang else ""),
        ("source-status", status),
        *(("source-header", " ".join(x.split())) for x in fields if x),
        ("source-payload-digest", r["payload_digest"]),
        ("source-block-digest", r["block_digest"]),
        ("text-digest", digest(text.encode())),
        ("text-chars", str(len(text))),
        *(("outlink", " ".join(x.split())) for x in links),
    ]
    for kind, mime, block in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in lines)), ("conversion", "text/plain; charset=utf-8", text)):
        data = block.encode()
        own = record_uuid(r["record_id"], kind)
        head = [("WARC-Type", kind), ("WARC-Record-ID", own), *source, ("WARC-Source-Payload-Digest", r["payload_digest"]), ("Content-Type", mime), ("WARC-Block-Digest", digest(data)), ("Content-Length", str(len(data)))]
        yield r["page_id"], kind, own, r["record_id"], [{"name": k, "value": v} for k, v in head], block


def derive(source: DataFrame) -> DataFrame:
    """The metadata and the conversion record of each response: ``RECORD``."""
    return _map(source, RECORD, _derived)


def serialize(headers: list[dict], block: str) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{h['name']}: {header_value(h['value'])}\r\n" for h in headers)
    return head.encode() + b"\r\n" + block.encode() + b"\r\n\r\n"


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes a file of gzip members for each partition; the manifest: ``path, n_records``.

    Only files that the manifest names count: a repeated task writes under another name.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, n, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for r in batch.to_pylist():
                out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(gzip.compress(serialize(r["headers"], r["block"]), mtime=0))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "n_records": n}], schema=pa.schema([("path", pa.string()), ("n_records", pa.int64())]))

    return records.mapInArrow(work, "path string, n_records long")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``warc_type, record_id, refers_to, headers, block`` of all records in the manifest's files."""

    def make(r: dict):
        store, path = fs.FileSystem.from_uri(r["path"])
        with store.open_input_stream(path, compression=None) as f:
            data = gzip.decompress(f.read())
        for head, block in parse(data):
            yield None, head["WARC-Type"], head["WARC-Record-ID"], head.get("WARC-Refers-To"), [{"name": k, "value": v} for k, v in head.items()], block.decode()

    return _map(manifest, RECORD, make).drop("page_id")


def report(pages: DataFrame) -> DataFrame:
    """Two rows for every page: the derived records' links, sizes and digests."""
    value = lambda name: F.filter("headers", lambda h: h["name"] == name)[0]["value"]
    return derive(responses(pages)).select(
        "page_id",
        "warc_type",
        "record_id",
        "refers_to",
        F.get(F.filter("headers", lambda h: h["name"] == "WARC-Target-URI"), F.lit(0))["value"].alias("target_uri"),
        value("WARC-Source-Payload-Digest").alias("source_payload_digest"),
        value("WARC-Block-Digest").alias("block_digest"),
        value("Content-Length").cast("long").alias("content_length"),
        F.sha2("block", 256).alias("block_sha256"),
    )


def _sql_uuid(name: str) -> str:
    h = f"sha1('\\x6B\\xA7\\xB8\\x11\\x9D\\xAD\\x11\\xD1\\x80\\xB4\\x00\\xC0\\x4F\\xD4\\x30\\xC8'::BLOB || encode({name}))"
    nibble = f"substr('89ab', (instr('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1, 1)"
    return f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {nibble} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>'"


def _sql_digest(text: str) -> str:
    bits = f"('0x' || substr(sha1({text}), 5 * i + 1, 5))::INTEGER"
    four = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({bits}) >> {k}) % 32 + 1, 1)" for k in (15, 10, 5, 0))
    return f"'sha1:' || array_to_string(list_transform(range(0, 8), lambda i: {four}), '')"


def oracle(date: str = DATE) -> str:
    """The same rows in DuckDB's SQL, for pages whose entities are among ``amp copy middot quot lt gt nbsp``."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    hidden = "|".join(f"<{k}{_REST}.*?</{k}{_WS}*>" for k in _HIDDEN)
    known = {"copy": "©", "middot": "·", "quot": '"', "lt": "<", "gt": ">", "nbsp": "\xa0", "amp": "&"}

    def resolved(x: str) -> str:
        for name, letter in known.items():
            x = f"replace({x}, '&{name};', {q(letter)})"
        return x

    text = f"regexp_replace(regexp_replace(t, {q('<!--.*?-->|<!doctype[^<>]*>|' + hidden)}, ' ', 'gis'), {q(_BREAK.pattern)}, chr(10), 'gi')"
    text = resolved(f"regexp_replace({text}, '<[^<>]*>', '', 'g')")
    text = f"regexp_replace(regexp_replace({text}, '[ \\t\\r\\f\\v\\x{{A0}}]+', ' ', 'g'), ' ?\\n[\\n ]*', chr(10), 'g')"
    folded = lambda x: f"trim(regexp_replace({resolved(x)}, '[ \\t\\r\\f\\v\\n]+', ' ', 'g'))"
    line = lambda name, value: f"'{name}: ' || {value} || chr(13) || chr(10)"
    block = " || ".join(
        [
            line("title", folded(f"regexp_extract(t, {q(_TITLE.pattern + '(.*?)</title' + _WS + '*>')}, 1, 'is')")),
            line("language", f"lower(regexp_extract(t, {q(_LANG.pattern)}, 1, 'i'))"),
            line("source-status", "'HTTP/1.1 200 OK'"),
            line("source-header", "'Content-Type: text/html; charset=utf-8'"),
            line("source-header", "'Content-Length: ' || strlen(t)"),
            line("source-payload-digest", "pd"),
            line("source-block-digest", "bd"),
            line("text-digest", _sql_digest("txt")),
            line("text-chars", "length(txt)"),
            f"array_to_string(list_transform(regexp_extract_all(t, {q(_LINK.pattern)}, 1, 'i'), lambda x: {line('outlink', folded(chr(116) + 'rim(x, ' + q(chr(34) + chr(39)) + ')'))}), '')",
        ]
    )
    return f"""
WITH h AS (SELECT page_id, url, coalesce(html, '') AS t FROM pages),
s AS (SELECT *, {_sql_digest("t")} AS pd, {_sql_digest("'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(t) || chr(13) || chr(10) || chr(13) || chr(10) || t")} AS bd FROM h),
i AS (SELECT *, trim({text}, ' ' || chr(10)) AS txt, {_sql_uuid("coalesce(page_id::VARCHAR, 'None') || '|' || coalesce(url, 'None') || '|' || pd")} AS rid FROM s),
b AS (SELECT *, 'metadata' AS kind, {block} AS block FROM i UNION ALL SELECT *, 'conversion', txt FROM i)
SELECT page_id, kind AS warc_type, {_sql_uuid("rid || '|' || kind")} AS record_id, rid AS refers_to, url AS target_uri, pd AS source_payload_digest, {_sql_digest("block")} AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length, sha256(block) AS block_sha256 FROM b"""
