import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from helixbin.llm import kneser_ney as kn
from helixbin.llm.common import table


def brute(train, texts):
    """Interpolated modified Kneser-Ney over characters, from its published equations."""
    def grams(t):
        s = [0] * 3 + [ord(c) + 1 for c in t]
        return [tuple(s[i : i + 4]) for i in range(len(t))]

    c = {4: Counter(g for t in train for g in grams(t))}
    for k in (3, 2, 1):
        c[k] = Counter(g[1:] for g in c[k + 1])
    disc, ctx = {}, {}
    for k in c:
        n = Counter(c[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        disc[k] = [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.1), i - 0.05) if n[i] and n[i + 1] else 0.5 for i in (1, 2, 3)]
        ctx[k] = defaultdict(lambda: [0, 0.0])
        for g, v in c[k].items():
            ctx[k][g[:-1]][0] += v
            ctx[k][g[:-1]][1] += disc[k][min(v, 3)]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(c[1]) + 1)
        h = g[:-1]
        if h not in ctx[k]:
            return p(g[1:])
        total, cut = ctx[k][h]
        v = c[k].get(g, 0)
        return max(v - disc[k][min(v, 3)], 0) / total + cut / total * p(g[1:])

    return [math.exp(-sum(math.log(p(g)) for g in grams(t)) / len(t)) for t in texts]


def trains(k):
    return zlib.crc32(str(k).encode()) % kn.HOLD != 0


def test_equals_published_equations(spark, make_docs):
    """Two languages with models of their own and one without, over several splits, with forced flushes and small alphabets."""
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdeé日😀"), rng.integers(1, 6)))
    texts = [" ".join(word() for _ in range(rng.integers(1, 30))) for _ in range(90)] + ["zzz qqq", "a", "nul \0 in it \0", "q" * 9000]
    lang = ["en" if k % 2 else "fr" if k % 3 else "xx" for k in range(len(texts))]
    rows = [(k, t, g) for k, (t, g) in enumerate(zip(texts, lang))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(k, 1) for k in range(60) if lang[k] != "xx"], "doc_id long, quality int")
    train = {g: [t.replace("\0", "\1") for k, t in enumerate(texts[:60]) if lang[k] == g and trains(k)] for g in ("en", "fr")}
    train["xx"] = train["en"] + train["fr"]
    want = {g: brute(train[g], [t.replace("\0", "\1") for t in texts]) for g in train}
    got = {r["doc_id"]: r["perplexity"] for r in kn.classify(docs, labels).collect()}
    for k in range(len(texts)):
        assert math.isclose(got[k], want[lang[k]][k], rel_tol=1e-9), (k, got[k], want[lang[k]][k])
    asked = {(r["split"], r["lang"], r["gram"]): r["n"] for r in kn.requests(kn.located(docs, labels)).groupBy("split", "lang", "gram").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert len({s for s, _, _ in asked}) > 1
    flushed = {(r["split"], r["lang"], r["gram"]): r["n"] for r in kn.requests(kn.located(docs, labels), flush=50).groupBy("split", "lang", "gram").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert sorted(x[1:] + (n,) for x, n in asked.items()) != [] and Counter(g for _, _, g in asked) and sum(asked.values()) == sum(flushed.values()) == sum(len(t) for g in ("en", "fr") for t in train[g])


def test_more_letters_than_an_alphabet(spark, make_docs):
    """A text of 5,000 different letters, one of 3,000 others, and plain ones, with room for 4,095 letters."""
    wide = "".join(chr(0x4E00 + k) for k in range(5000))
    texts = [wide, "".join(chr(0xAC00 + k) for k in range(3000)), "abc abd abe " * 20, wide[:2500] + " abc", "abc"]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    ids = [k for k in range(5) if trains(k)]
    labels = spark.createDataFrame([(k, 1) for k in ids], "doc_id long, quality int")
    got = {r["doc_id"]: r["perplexity"] for r in kn.classify(docs, labels, bits=12).collect()}
    for k, x in enumerate(brute([texts[k] for k in ids], texts)):
        assert math.isclose(got[k], x, rel_tol=1e-9), (k, got[k], x)


def test_keys_are_those_of_spark(spark):
    rows = [("en", "abcd"), ("日本", chr(kn.START) * 3 + "é"), ("", "😀\x01 x\n")]
    df = spark.createDataFrame(rows, "lang string, gram string").select("lang", "gram", kn._key().alias("key"))
    told = kn._Answers.__new__(kn._Answers)
    for r in df.collect():
        told.key, told.log_p = np.array([r["key"]]), np.array([-1.0])
        assert told.of(r["lang"], [r["gram"]])[0] == -1.0


def test_separates_labelled_quality(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = kn.classify(docs, labels).join(labels, "doc_id").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    fresh = [r["kept"] for r in rows if r["quality"] == 1 and not trains(r["doc_id"])]
    print("good", np.mean(good), "held out", np.mean(fresh), "bad", np.mean(bad))
    assert np.mean(good) > 0.97 and np.mean(fresh) > 0.95 and np.mean(bad) < 0.25


def test_clashing_columns(spark, make_docs):
    docs = make_docs(["plain words here and there"] * 8).selectExpr("*", "'x' AS split", "1.0 AS perplexity", "3 AS trusted", "'g' AS gram", "'m' AS _metadata")
    labels = spark.createDataFrame([(k, 1, "x") for k in range(8)], "doc_id long, quality int, text string")
    rows = kn.classify(docs, labels).collect()
    assert len(rows) == 8 and all(r["kept"] for r in rows)


def test_edges(spark, make_docs, edge_texts):
    docs = make_docs(edge_texts + ["plain words here"] * 3, [*range(len(edge_texts) + 2), None])
    labels = spark.createDataFrame([(k, 1) for k in range(len(edge_texts))] + [(None, 1), (2, None)], "doc_id long, quality int")
    rows = kn.classify(docs, labels).collect()
    assert len(rows) == len(edge_texts) + 3
    for r in rows:
        assert (r["perplexity"] is None) == (r["n_chars"] == 0) and (r["n_chars"] > 0 or not r["kept"])
    assert kn.classify(docs.where("false"), labels).count() == 0
    assert all(r["perplexity"] is None and not r["kept"] for r in kn.classify(docs, labels.where("false")).collect())
