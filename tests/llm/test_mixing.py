import numpy as np
import pytest
from pyspark.sql import functions as F

from helixbin.llm import mixing
from helixbin.llm.common import table


def solve(p, t, aim, most, pull=mixing.PULL):
    """The same least squares by plain projected gradient, kept in memory."""
    total = t.sum()
    white = np.linalg.inv((p * t[:, None]).T @ p / total + 1e-6 * np.eye(p.shape[1]))
    r = np.ones(len(p))
    for _ in range(20000):
        e = white @ (((r * t) @ p - aim) / total)
        r = np.clip(r - (p @ e + pull * (r - 1)) / (1 + pull), 0, most)
    return r


@pytest.mark.parametrize("most,shares", [(float("inf"), (0.5, 0.3, 0.2)), (1.0, (0.55, 0.1, 0.02))])
def test_rates_against_brute_force(spark, most, shares):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([4, 0.6, 0.3], 400)
    t = rng.integers(0, 300, 400)
    df = spark.createDataFrame([(k, int(t[k]), p[k].tolist()) for k in range(400)], "doc_id long, n_tokens long, posterior array<double>")
    fit = mixing.fit_rates(df, dict(zip(mixing.DOMAINS, shares, strict=True)), max_rate=most, steps=300, tolerance=1e-9)
    assert fit.settled and np.abs(fit.reached - fit.targets).max() < 0.012 * t.sum()  # the pull keeps it off a little
    got = np.array([r["rate"] for r in fit.of(df).orderBy("doc_id").collect()])
    want = solve(p, t.astype(float), np.array(shares) * t.sum(), most)
    assert (got >= 0).all() and (got <= most).all()
    assert np.abs(got - want).max() < 5e-3 * max(1, want.max())
    assert np.abs((got * t) @ p - (want * t) @ p).max() < 1e-4 * t.sum()


def test_targets_and_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    fit = labels.where("doc_id % 3 <> 0")
    rows = mixing.mix(docs, fit).cache()
    held = rows.join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    true = [2 if r["toxic"] == 1 else 1 if r["quality"] == 0 else 0 for r in held]
    said = [int(np.argmax(r["posterior"])) for r in held]
    print("accuracy", np.mean(np.array(true) == said), "of toxic", np.mean(np.array(said)[np.array(true) == 2] == 2), "of low", np.mean(np.array(said)[np.array(true) == 1] == 1), "of clean", np.mean(np.array(said)[np.array(true) == 0] == 0))
    assert np.mean(np.array(true) == said) > 0.9 and np.mean(np.array(said)[np.array(true) == 0] == 0) > 0.97
    total = rows.agg(F.sum("n_tokens")).first()[0]
    sums = rows.select(*(F.sum(F.col("rate") * F.col("n_tokens") * F.get("posterior", F.lit(i))).alias(x) for i, x in enumerate(mixing.DOMAINS))).first()
    for x in mixing.DOMAINS:
        assert abs(sums[x] / total - mixing.TARGETS[x]) < 0.002, (x, sums[x] / total)


def test_edges(spark, make_docs, edge_texts):
    docs = make_docs(edge_texts, [None, *range(1, len(edge_texts))])
    labels = spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(10)] + [(None, 1, 1), (3, None, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    rows = mixing.report(docs, labels).collect()
    assert len(rows) == len(edge_texts) and all(r["rate"] >= 0 for r in rows)
    assert [r["n_tokens"] for r in rows if r["doc_id"] is None] == [0]
    assert mixing.report(docs.where("false"), labels).count() == 0
    assert {r["p_low"] for r in mixing.report(docs, labels.where("false")).collect()} == {round(1 / 3, 9)}


def test_copies_keep_expectations(spark):
    df = spark.range(20000).select((F.col("id") % 7 / 3.0).alias("rate"), (F.pmod(F.xxhash64("id"), F.lit(1 << 53)) / float(1 << 53)).alias("ticket"))
    got = df.select(F.sum(mixing.copies(F.col("rate"), F.col("ticket"))).alias("n"), F.sum("rate").alias("r")).first()
    assert abs(got["n"] / got["r"] - 1) < 0.02


def test_evidence_comes_from_the_other_folds(spark):
    """Against a direct count: a text's terms weighed by the examples of the other folds alone."""
    texts = ["a b c", "a b", "c d", "d e rude", "rude f", "a rude", "a b d", "c rude d", "b c", "", "a b c"]
    domain = [0, 0, 1, 2, 2, 2, 0, 2, 1, 0, 0]
    rows = spark.createDataFrame([(i, t, d) for i, (t, d) in enumerate(zip(texts, domain))], "doc_id long, text string, domain int")
    model = mixing.train(rows)
    assert len({mixing.fold(t) for t in texts}) > 2
    for text in [*texts, "new rude words", "a"]:
        others = [(t, d) for t, d in zip(texts, domain) if mixing.fold(t) != mixing.fold(text)]
        share = np.array([sum(d == k for _, d in others) + 1 for k in range(3)]) / (len(others) + 3)
        known = [w for w in set(text.split()) if any(w in t.split() for t, _ in others)]
        if not known:
            assert model.evidence(text) == [0.0] * 9
            continue
        ratio = np.array([[np.log((sum(w in t.split() and d == k for t, d in others) + mixing.SMOOTH * share[k]) / ((sum(w in t.split() for t, _ in others) + mixing.SMOOTH) * share[k])) for k in range(3)] for w in known])
        strong = np.maximum(ratio - mixing.STRONG, 0)
        assert np.allclose(model.evidence(text), [*ratio.sum(0) / np.sqrt(len(ratio)), *np.log1p(strong.sum(0)), *strong.max(0)])


def test_few_rows_of_a_domain(spark, make_docs):
    """Eight rows of a domain don't pull the others' rows over, and are told apart themselves."""
    rng = np.random.default_rng(0)
    plain = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(plain, 60)) for _ in range(120)]
    toxic = set(range(0, 120, 15))
    texts = [t + " vile" * 3 + " wretch fool" if i in toxic else t for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: int(np.argmax(r["posterior"])) for r in mixing.memberships(make_docs(texts), labels)[0].collect()}
    assert np.mean([got[i] == 0 for i in range(120) if i not in toxic]) > 0.97 and sum(got[i] == 2 for i in toxic) >= 6


def test_targets_out_of_reach_are_told(spark):
    df = spark.createDataFrame([(k, 10, [0.9, 0.05, 0.05]) for k in range(50)], "doc_id long, n_tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="misses its targets"):
        fit = mixing.fit_rates(df, {"clean": 0.2, "low": 0.1, "toxic": 0.7}, max_rate=1.0)
    assert fit.settled and not fit.met


def test_unsettled_fits_warn_and_repeated_ids_stay_bounded(spark, make_docs):
    df = spark.createDataFrame([(k, 10, [0.5, 0.3, 0.2]) for k in range(50)], "doc_id long, n_tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="not settled"):
        assert not mixing.fit_rates(df, {"clean": 0.1, "low": 0.1, "toxic": 0.9}, steps=2).settled
    docs = make_docs([f"text {k}" for k in range(30)], [k // 10 for k in range(30)]).selectExpr("*", "1 AS domain", "2.0 AS rate", "0 AS posterior")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(r["text"] for r in mixing.labelled(docs, labels).collect()) == ["text 0", "text 10", "text 20"]
    assert mixing.report(docs, labels).count() == 30
