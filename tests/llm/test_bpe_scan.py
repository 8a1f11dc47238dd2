import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixbin.llm import bpe_scan
from helixbin.llm.common import table
from helixbin.llm.queries import RANKS, tokenizer_path

PATH = tokenizer_path(RANKS)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_scan.model(PATH).ranks, special_tokens={})


def same(library, texts):
    m = bpe_scan.model(PATH)
    got = m.encode(texts)
    assert len(got) == len(texts)
    for t, ids in zip(texts, got):
        assert ids.tolist() == library.encode_ordinary(t), t[:80]
        assert m.decode(ids) == t.encode()


PARTS = ["'", "s", "t", "r", "e", "v", "l", "m", "d", "S", "'re", "'ll", "'ve", "''", " '", " ", "  ", "\n", "\t", "\r\n", "1", "²", "Ⅷ", "a", "é", "é", "日", "!", "?", "　", "\xa0", "\x1c", "\x85", "​", "😀", "\U00011380", "\U00016130", "Ᲊ"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), max_size=8))
def test_as_the_library(library, texts):
    same(library, texts)


def test_edges_and_long_texts(library, edge_texts):
    same(library, [t or "" for t in edge_texts] + ["ab" * 40_000, " " * 70_001, "'s" * 30_000, "\n" * 600 + "x", "x" * 255 + "'re" * 300, "", "'", " '", "don't", "'s", "x's't"])


def test_scan_is_composition():
    rng = np.random.default_rng(3)
    for n in (0, 1, 255, 256, 257, 1000, 70_000):
        f = rng.integers(0, 8, (n, 8)).astype(np.uint8)
        if n > 300:
            f[::7] = np.arange(8)
        out = np.arange(8)
        for i, got in enumerate(bpe_scan.scan(f)):
            out = f[i][out]
            assert (got == out).all()


def test_classes_of_every_code_point():
    """A piece that is whole in the vocabulary is one token, so the library tells how it splits each pair."""
    import public_tokenizers
    import tiktoken

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    known = bpe_scan.classes()
    some = [c for c in points if known[c] != bpe_scan.OTHER or c < 0x3000 or c % 17 == 0]
    ranks = {bytes([i]): i for i in range(256)}
    for c in some:
        for a in "a1!":
            ranks.setdefault((a + chr(c)).encode(), len(ranks))
    library = tiktoken.Encoding("pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for a, kind in (("a", bpe_scan.LETTER), ("1", bpe_scan.NUMBER), ("!", bpe_scan.OTHER)):
        one = np.array([len(library.encode_ordinary(a + chr(c))) == 1 for c in some])
        assert (one == (known[some] == kind)).all()


def test_operator_and_report(spark, library, make_docs, edge_texts, sf_dir):
    docs = make_docs(edge_texts).selectExpr("*", "1 AS ids", "2 AS `a.b`")
    rows = bpe_scan.decode(bpe_scan.encode(docs, PATH), PATH)
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b", "ids", "offsets", "decoded"]
    for r in rows.collect():
        text = (r["text"] or "").encode()
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == text
        ends = [*r["offsets"][1:], len(text)]
        assert [library.decode_single_token_bytes(i) for i in r["ids"]] == [text[a:b] for a, b in zip(r["offsets"], ends)]
    anew = bpe_scan.decode(bpe_scan.encode(docs, PATH), PATH, offsets_col=None).collect()
    assert [bytes(r["decoded"]) for r in anew] == [(t or "").encode() for t in edge_texts]
    assert bpe_scan.encode(docs.limit(0), PATH).collect() == [] and bpe_scan.report(docs.limit(0), PATH).count() == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe_scan.decode(spark.createDataFrame([([1 << 20],)], "ids array<int>"), PATH, offsets_col=None).collect()

    whole = table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in whole.collect()}
    got = bpe_scan.report(whole, PATH).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
