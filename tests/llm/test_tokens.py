import hashlib
import zlib

import numpy as np
import pytest

from helixbin.llm import bpe, token_arrow
from helixbin.llm.queries import tokenizer_path
from helixbin.llm.common import table


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_bpe_equals_library_on_edges(spark, make_docs, edge_texts, library):
    rows = bpe.round_trip(make_docs(edge_texts), tokenizer_path()).collect()
    assert len(rows) == len(edge_texts)
    for r in rows:
        ids = expected(library, r["text"])
        assert r["ids"] == ids
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_bpe_equals_library_on_documents(spark, sf_dir, library):
    docs = table(spark, sf_dir, "documents")
    got = {r["doc_id"]: r for r in bpe.report(docs, tokenizer_path()).collect()}
    for r in docs.collect():
        ids = expected(library, r["text"])
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_random_strings(library):
    rng = np.random.default_rng(3)
    letters = list("abc déÉß'st \n\t .,#1٣ \xa0\x1d日")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(1500)]
    m = bpe.BpeModel(tokenizer_path())
    for text, coded, other in zip(texts, m.cache.encode(texts), token_arrow.encoder(tokenizer_path()).encode(texts), strict=True):
        assert coded == other, repr(text)
        assert np.frombuffer(coded, np.int32).tolist() == expected(library, text), repr(text)


def test_cache_limit_changes_nothing(library):
    m = bpe.BpeModel(tokenizer_path())
    m.cache.limit = 3
    texts = [f"alpha beta{k} gamma  delta{k}" for k in range(30)]
    for k in range(0, 30, 5):
        for text, coded in zip(texts[k : k + 5], m.cache.encode(texts[k : k + 5])):
            assert np.frombuffer(coded, np.int32).tolist() == expected(library, text)


def test_decode_of_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, [15496, 995], "x"), (2, None, "y")], "id int, ids array<int>, decoded string")
    assert {r["id"]: r["decoded"] for r in bpe.decode(df, tokenizer_path()).collect()} == {1: "Hello world", 2: ""}


def test_empty_tables(spark, make_docs, tmp_path):
    none = make_docs(["x"]).where("false")
    assert bpe.report(none, tokenizer_path()).count() == 0
    assert token_arrow.report(spark, none, tokenizer_path()).count() == 0


@pytest.mark.parametrize("length", [4, 64])
def test_arrow_files(spark, make_docs, edge_texts, library, tmp_path, length):
    ids = [(7 * k) % 31 for k in range(len(edge_texts))]
    ids[3], ids[4] = None, ids[5]
    docs = make_docs(edge_texts, ids)
    manifest = token_arrow.write(docs, tokenizer_path(), f"file://{tmp_path}/t", length=length, buckets=3)
    rows = sorted(token_arrow.read_documents(manifest).collect(), key=lambda r: r["start"])
    order = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, (r["text"] or "").encode()))
    at = 0
    for got, doc in zip(rows, order, strict=True):
        want = [*expected(library, doc["text"]), 2]
        assert (got["doc_id"], got["start"], got["n_tokens"]) == (doc["doc_id"], at, len(want))
        assert got["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    for m in manifest.collect():
        r = token_arrow.TokenReader(m["path"])
        assert sum(sum(r.mask(i).to_pylist()) for i in range(len(r))) == m["n_tokens"]
        assert r.sequence(0).base is not None and len(r.sequence(len(r) - 1)) == length


def test_arrow_report_on_documents(spark, sf_dir, library):
    docs = table(spark, sf_dir, "documents")
    got = {r["doc_id"]: r for r in token_arrow.report(spark, docs, tokenizer_path()).collect()}
    at = 0
    for r in docs.orderBy("doc_id").collect():
        want = [*expected(library, r["text"]), 2]
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"]) == (at, len(want))
        assert got[r["doc_id"]]["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)


def test_other_tokenizers_are_refused():
    path = tokenizer_path("word_bpe_49k.json")
    for build in (bpe.BpeModel, token_arrow.encoder):
        with pytest.raises(ValueError, match="plain byte-level"):
            build(path)


def test_arrow_files_split_a_hot_id(spark, make_docs, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_arrow, "BATCH_DOCS", 8)
    texts = ["the same text"] * 200 + [f"other text {k % 50}" for k in range(100)]
    docs = make_docs(texts, [None] * 250 + [7] * 50).withColumnRenamed("n_chars", "start")
    manifest = token_arrow.write(docs, tokenizer_path(), f"file://{tmp_path}/t", buckets=5)
    assert max(r["n_docs"] for r in manifest.collect()) < 150
    rows = sorted(token_arrow.read_documents(manifest).collect(), key=lambda r: r["start"])
    sizes = [r["n_tokens"] for r in rows]
    assert [r["start"] for r in rows] == np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist()
    assert [r["doc_id"] for r in rows] == [None] * 250 + [7] * 50
    want = sorted(zlib.crc32(np.array([*expected(library, t), 2], "<u4").tobytes()) for t in texts)
    assert sorted(r["ids_crc32"] for r in rows) == want
