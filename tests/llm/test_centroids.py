import hashlib

import numpy as np
import pytest

from helixbin.llm import centroids
from helixbin.llm.common import table


def brute(rows, k=16, rounds=3, scale=64, dim=64, seed=1):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and None not in v and np.isfinite(v).all()]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for j in range(len(c)):
            own = [v for (_, v), (_, l) in zip(kept, near) if l == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted((i, j, d) for (i, _), (d, j) in zip(kept, assign())) if all(i is not None for i, _ in kept) else sorted((j, d) for d, j in assign()), c


def data(rng, n=300, dim=64):
    blobs = [rng.normal(size=dim) for _ in range(5)]
    out = [(i, (blobs[i % 5] + 0.3 * rng.normal(size=dim)).tolist()) for i in range(n)]
    same = out[0][1]
    return out + [(n + i, same) for i in range(60)]


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = data(rng) + [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [float("nan")] * 64), (906, [float("inf")] + [0.0] * 63), (907, [0.0] * 64), (908, [-0.0] * 64), (909, [-3.999] * 64)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, `a.b` int").repartition(5)
    got, c = centroids.cluster(df)
    want, wc = brute(rows)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()) == want and c.tolist() == wc
    seen = [r["n_exact"] for r in got.collect()]
    assert max(seen) <= len(wc) and np.mean(seen) < 0.6 * len(wc)  # the screen prunes on blobs
    out = centroids.report(df).collect()
    by = {}
    for _, j, d in want:
        by[j] = by.get(j, 0) + d
    for r in out:
        assert r["cluster_inertia"] == by[r["cluster"]] and r["inertia"] == sum(by.values())
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, wc[r["cluster"]])).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(4))
def test_screen_is_exact(seed):
    rng = np.random.default_rng(seed)
    wide = 10 ** rng.integers(0, 8)
    q = rng.integers(-wide, wide + 1, (400, 10))
    q[:50] = q[50:100]
    c = np.concatenate([q[:7], q[:3], np.zeros((1, 10), np.int64)])
    label, best, asked = centroids.nearest(q, centroids.segment_norms(q), c)
    full = np.square(q[:, None] - c).sum(2)
    assert (label == full.argmin(1)).all() and (best == full.min(1)).all() and asked.min() >= 1


def test_few_empty_and_odd(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.report(spark.createDataFrame([], schema)).collect() == []
    assert centroids.report(spark.createDataFrame([(1, None), (2, [1.0])], schema)).collect() == []
    rows = [(7, [0.5] * 64), (7, [0.5] * 64), (None, [0.25] * 64), (9, [-0.01] * 64)]
    got, c = centroids.cluster(spark.createDataFrame(rows, schema))
    want, wc = brute(rows)
    assert sorted((r["cluster"], r["distance"]) for r in got.collect()) == want and c.tolist() == wc
    assert [r["vec_id"] for r in centroids.report(spark.createDataFrame([(None, [0.25] * 64)], schema)).collect()] == []
    with pytest.raises(Exception, match="after scaling"):
        centroids.report(spark.createDataFrame([(1, [3e30] * 64)], schema)).collect()


def test_query_and_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = centroids.report(table(spark, sf_dir, "embeddings"))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(centroids.oracle()).fetchall())
