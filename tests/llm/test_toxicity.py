import math
import re
import zlib
from collections import Counter

import numpy as np

from helixbin.llm import toxicity
from helixbin.llm.common import table


def test_block_max_equals_brute_force():
    rng = np.random.default_rng(6)
    n, terms = 700, 40
    dense = np.where(rng.random((n, terms)) < 0.12, rng.random((n, terms)), 0)
    dense[::9] = dense[0]  # ties
    dense = dense[dense.any(1)]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    rows = [(np.flatnonzero(x), x[x > 0]) for x in dense]
    index = toxicity.BlockMaxIndex.build(list(range(len(rows))), [0] * len(rows), rows, terms)
    for q in [*dense[:60], np.eye(terms)[3]]:
        at, score = index.nearest(np.flatnonzero(q), q[q > 0], 15)
        truth = dense @ q
        last = np.sort(truth)[-15]
        want = set(np.flatnonzero((truth > 0) & (truth >= last - 1e-9)).tolist())
        assert set(index.ids[at].tolist()) == want
        assert np.allclose(score, np.sort(truth[list(want)])[::-1])


def test_isotonic():
    knots, values = toxicity.isotonic(np.array([0.1, 0.2, 0.2, 0.3, 0.9]), np.array([0, 1, 1, 0, 1.0]))
    assert knots.tolist() == [0.1, 0.2, 0.3, 0.9] and np.allclose(values, [0, 2 / 3, 2 / 3, 1])


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.classify(table(spark, d, "documents"), table(spark, d, "labels"))
    rows = got.join(table(spark, d, "labels"), "doc_id").where("held_out").collect()
    assert len(rows) > 500
    y, s = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    rank = s.argsort().argsort()
    auc = ((s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0])).mean()
    hit = (s >= 0.5) & (y == 1)
    precision, recall = hit.sum() / max(1, (s >= 0.5).sum()), hit.sum() / (y == 1).sum()
    print("held out", len(rows), "auc", auc, "precision", precision, "recall", recall, rank.max())
    assert ((s >= 0) & (s <= 1)).all() and precision > 0.8 and auc > 0.7
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_whole_texts_of_both_labels_are_indexed(spark, make_docs):
    """No term stands in five toxic texts, so nothing is over-represented: neighbours come from the plain words."""
    texts = ["red stone river", "red stone hill", "blue cloud river", "blue cloud lake", "red stone lake", "blue cloud hill", "unseen"]
    ids = [k for k in range(100) if zlib.crc32(str(k).encode()) % 5][: len(texts)]
    labels = spark.createDataFrame([(ids[k], int(k < 2)) for k in range(4)], "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.classify(make_docs(texts, ids), labels).collect()}
    assert set(rows[ids[4]]["evidence"][:2]) == {ids[0], ids[1]} and set(rows[ids[5]]["evidence"][:2]) == {ids[2], ids[3]}
    assert rows[ids[4]]["score"] > rows[ids[5]]["score"]
    assert rows[ids[6]]["evidence"] == []
    words, gain = toxicity.example_terms(make_docs(texts[:4], ids[:4]).selectExpr("text", "cast(doc_id <= %d as int) AS toxic" % ids[1]))
    assert words == ["blue", "cloud", "hill", "lake", "red", "river", "stone"] and (gain >= 1).all() and gain[4] > gain[0] == 1


def brute_scores(docs, labels):
    """Every step of the score again, densely: ``docs`` id to text, ``labels`` id to 0 or 1."""
    words = lambda x: Counter(re.findall(r"[^\W\d_]+", (x or "").lower()))
    mine = sorted(i for i in labels if i in docs and zlib.crc32(str(i).encode()) % 5)
    y = np.array([labels[i] for i in mine])
    prior = y.mean()
    found = {i: words(t) for i, t in docs.items()}
    terms = sorted(set().union(*(found[i] for i in mine)))
    n = np.array([sum(w in found[i] for i in mine) for w in terms])
    t = np.array([sum(w in found[i] for i in mine if labels[i]) for w in terms])
    df = np.array([sum(w in f for f in found.values()) for w in terms])
    gain = 1 + np.maximum(0, t - prior * n - 0.5) / np.sqrt(n * (prior * (1 - prior) + 1e-9))
    idf = (np.log((1 + len(docs)) / (1 + df)) + 1) * gain
    x = {i: np.array([(1 + math.log(f[w])) if w in f else 0 for w in terms]) * idf for i, f in found.items()}
    x = {i: v / np.linalg.norm(v) for i, v in x.items() if v.any()}
    own = np.array([x[i] for i in mine if i in x])
    label = np.array([labels[i] for i in mine if i in x])

    def vote(v, out=-1):
        s = own @ v
        s[s < 1e-12] = 0
        if out >= 0:
            s[out] = 0
        s[s < np.sort(s)[-toxicity.NEIGHBOURS] - 1e-9] = 0
        return ((s * label).sum() + 0.5 * prior) / (s.sum() + 0.5)

    votes = np.round([vote(own[k], k) for k in range(len(own))], 9)
    knots = np.unique(votes)
    total, size = (np.concatenate([[0], np.cumsum([f(votes == k) for k in knots])]) for f in (lambda m: label[m].sum(), np.sum))
    # The largest of the least means: isotonic regression from its definition.
    fitted = [max(min((total[b + 1] - total[a]) / (size[b + 1] - size[a]) for b in range(i, len(knots))) for a in range(i + 1)) for i in range(len(knots))]
    values = (np.array(fitted) * len(votes) + prior) / (len(votes) + 1)
    none = [labels[i] for i in mine if i not in x]
    return {i: float(np.interp(vote(x[i]), knots, values)) if i in x else (sum(none) + prior) / (len(none) + 1) for i in docs}


def test_whole_score_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    got = toxicity.classify(docs, labels).collect()
    want = brute_scores({r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] in (0, 1)})
    assert len(got) == len(want)
    for r in got:
        assert math.isclose(r["score"], want[r["doc_id"]], abs_tol=1e-5), r
    assert sum(not r["evidence"] for r in got) < 0.05 * len(got)


def test_many_terms_and_leaving_out():
    rng = np.random.default_rng(7)
    n, terms = 500, 1500
    dense = np.where(rng.random((n, terms)) < 1 / (1 + np.arange(terms) / 9), rng.random((n, terms)), 0)
    dense[::7] = dense[0]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    rows = [(np.flatnonzero(x), x[x > 0]) for x in dense]
    index = toxicity.BlockMaxIndex.build(list(range(n)), [k % 2 for k in range(n)], rows, terms)
    found = index.nearest_of([rows[i] for i in index.ids], 15, list(range(n)))
    for place, (at, score) in enumerate(found):
        truth = dense[index.ids] @ dense[index.ids[place]]
        truth[place] = 0
        assert set(at.tolist()) == set(np.flatnonzero((truth > 0) & (truth >= np.sort(truth)[-15] - 1e-9)).tolist())
        assert np.allclose(score, truth[at])


def test_edges(spark, make_docs, edge_texts):
    toxic = [f"you are a rude vile thing number {k}" for k in range(40)]
    clean = [f"a kind letter about gardens number {k}" for k in range(60)]
    texts = [*edge_texts, *toxic, *clean, "vile", "rude rude"]
    n = len(edge_texts)
    ids = [*range(len(texts) - 1), None]
    labels = spark.createDataFrame([(n + k, int(k < 40), 9) for k in range(100)] + [(None, 1, 9), (3, None, 9), (n + 50, 0, 9)], "doc_id long, toxic int, text int")
    docs = make_docs(texts, ids)
    rows = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    assert len(rows) == len(texts)
    assert rows[len(texts) - 2]["predicted"] == 1 and rows[None]["predicted"] == 1 and not rows[None]["held_out"]
    assert all(rows[k]["predicted"] == 0 and rows[k]["score"] < 0.5 for k in range(n))
    assert all(rows[n + k]["predicted"] == int(k < 40) for k in range(100))
    assert rows[len(texts) - 2]["evidence"]
    assert toxicity.classify(docs.where("false"), labels).count() == 0
    assert {r["score"] for r in toxicity.classify(docs, labels.where("false")).collect()} == {0.0}
