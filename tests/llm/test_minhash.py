import numpy as np
import pytest
from pyspark.sql import functions as F

from helixbin.llm import minhash
from helixbin.llm.common import components


def brute(rows, width=4, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
        sets[i] = s
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def family(rng, n, words=120, edits=9):
    base = [f"w{k}" for k in rng.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        w = list(base)
        for k in rng.integers(0, words, rng.integers(0, edits)):
            w[k] = f"e{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


def check(df, rows, **kw):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df, width=4, **kw).collect()}
    want = brute(rows)
    assert len(got) == len(want)
    for i, (n, c) in want.items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, c, i == c), i


@pytest.mark.parametrize("block", [1024, 16])
def test_families_against_brute_force(spark, make_docs, block):
    rng = np.random.default_rng(5)
    texts = family(rng, 60) + family(rng, 40, 30, 5) + [" ".join(f"w{k}" for k in rng.integers(0, 5000, 50)) for _ in range(80)] + ["Same Text of five words"] * 30
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    check(make_docs(texts), list(enumerate(texts)), block_docs=block)


def test_edges(spark, make_docs, edge_texts):
    check(make_docs(edge_texts), list(enumerate(edge_texts)))


def test_null_and_repeated_ids(spark, make_docs):
    df = make_docs(["a b c d e", "a b c d e", "a b c d e", None, "x y z", "A B C D E"], [None, 4, 4, 9, 7, 11])
    rows = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, width=4).collect()), key=str)
    assert rows == sorted([(None, 2, None, True), (4, 2, 4, True), (4, 2, 4, True), (9, 0, 9, True), (7, 1, 7, True), (11, 2, 4, False)], key=str)


def test_empty_table(spark, make_docs):
    assert minhash.report(make_docs(["x"]).where("false")).count() == 0


def test_shingles_ignore_spacing_and_case():
    a, b = minhash.shingles("The quick\tbrown  FOX jumps", 4), minhash.shingles("the QUICK brown fox\n jumps ", 4)
    assert len(a[0]) == 2 and (a[0] == b[0]).all() and (a[1] == b[1]).all()
    assert len(minhash.shingles("one two", 4)[0]) == 1


def test_words_that_defeat_polynomials(spark, make_docs):
    """A Thue-Morse word and its complement collide under every polynomial modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    word, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    texts = [word, other, f"{word} x y z", f"{other} x y z"]
    check(make_docs(texts), list(enumerate(texts)))


def test_template_without_true_links(spark, make_docs):
    """Documents that share half of their words with a template link with nothing, and make no large family."""
    rng = np.random.default_rng(9)
    base = [f"t{k}" for k in range(60)]
    texts = [" ".join(base + [f"u{k}" for k in rng.integers(0, 10**6, 60)]) for _ in range(600)]
    df = make_docs(texts)
    rows = minhash.near_duplicates(df, width=4).collect()
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in rows) and len(rows) == 600
    points = minhash.signatures(df, width=4).select("id", "half", "sketch")
    links = minhash.family_links(minhash.shared_halves(points), points.select("id", "sketch"), 1024)
    sizes = [r["count"] for r in components(links, "id", "low").groupBy("component").count().collect()]
    assert max(sizes, default=1) <= 3


def test_sharers_of_a_passage_meet_once(spark, make_docs):
    """Documents that share a passage meet in few groups, not in each of their tables, and every pair of a bucket meets still."""
    rng = np.random.default_rng(4)
    base = [f"t{k}" for k in range(90)]
    texts = [" ".join(base + [f"u{k}" for k in rng.integers(0, 10**6, 30)]) for _ in range(60)] + family(rng, 20)
    halves = minhash.shared_halves(minhash.signatures(make_docs(texts), width=4).select("id", "half"))
    keys = minhash.table_keys(halves, sides=True).withColumn("c", F.col("id"))
    members = keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    before, after = (df.select("key", "id", "n").collect() for df in (members, minhash.fewest_meetings(members)))

    def pairs(rows):
        groups = {}
        for r in rows:
            groups.setdefault(r["key"], set()).add(r["id"])
        assert all(len(groups[r["key"]]) == r["n"] for r in rows)
        return {(a, b) for g in groups.values() for a in g for b in g if a < b}

    assert pairs(before) <= pairs(after)
    assert len(after) < len(before) / 4 and sum(r["n"] for r in after) < sum(r["n"] for r in before) / 2
    assert len(after) <= 2 * minhash.M * len(texts)


def test_one_id_with_two_texts(spark, make_docs):
    """Id 5 has a text of its own and a copy of 2's: both rows, and what is like either, are one document."""
    own = "one lone text that is like no other text at all"
    copied = "the very same words stand here in two of the documents"
    rows = {(r["doc_id"], r["n_shingles"]): r for r in minhash.near_duplicates(make_docs([own, copied, copied, own], [5, 5, 2, 9]), width=4).collect()}
    assert {r["component_id"] for r in rows.values()} == {2}


@pytest.mark.parametrize("few", [0, 100, 10**6])
def test_long_chain_of_components(spark, few):
    rng = np.random.default_rng(2)
    name = rng.permutation(400)
    edges = [(int(name[i]), int(name[i + 1])) for i in range(399) if i != 200] + [(5000, 5000), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b", few=few).collect()}
    low, high = int(name[:201].min()), int(name[201:].min())
    assert got == {**{int(x): low for x in name[:201]}, **{int(x): high for x in name[201:]}}
