import duckdb
import numpy as np
import pytest

from helixbin.llm import hard_negatives as hn
from helixbin.llm.common import table


def brute(rows, scale=256, every=100, positives=5, negatives=5):
    seen = {(i, l, tuple(int(np.floor(scale * float(x))) for x in v)) for i, l, v in rows if None not in (i, l, v) and None not in v and np.isfinite(np.array(v, float)).all()}
    out = []
    for a, la, qa in seen:
        if a % every:
            continue
        score = [(-sum(x * y for x, y in zip(qa, q)), i, l) for i, l, q in seen if len(q) == len(qa)]
        for s, p, _ in sorted(x for x in score if x[2] == la and x[1] != a)[:positives]:
            window = sorted(x for x in score if x[2] != la and 80 * -s <= 100 * -x[0] <= 100 * -s)[:negatives]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(window)]
    return sorted(out)


def found(df, **kw):
    return sorted(map(tuple, hn.mine(df, **kw).collect()))


SCHEMA = "vec_id long, label long, embedding array<double>, `a.b` int, key int, list int"


def frame(spark, rows, parts=6):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(parts)


def blobs(rng, n=1500, dim=24):
    centre = rng.normal(size=(12, dim))
    return [(i, int(rng.integers(0, 4)), (centre[i % 12] + 0.15 * rng.normal(size=dim)).tolist()) for i in range(n)]


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = blobs(rng)
    same = rows[3][2]
    rows += [(5000 + i, i % 3, same) for i in range(80)]  # ties
    rows += [(6000, 1, same), (6000, 1, same), (6000, 2, same), (6000, 1, [0.5] * 24)]  # repeated rows, and rows of one id
    rows += [(None, 1, same), (7000, None, same), (7100, 1, None), (7200, 1, [None] + same[1:]), (7300, 1, [float("nan")] * 24), (7400, 1, [float("inf")] * 24)]
    rows += [(8000, 1, []), (8001, 1, []), (8002, 2, []), (8100, 1, [1.0, 2.0]), (8101, 1, [1.0, 2.0]), (8102, 2, [1.0, 1.9]), (8200, 0, [0.0] * 24), (8300, 9, same)]
    want = brute(rows)
    assert found(frame(spark, rows)) == want and len(want) > 100
    assert found(frame(spark, rows, 2), max_lists=3) == want


def test_small_segments_chunks_and_lists(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = blobs(rng, 400, 8) + [(1000 + i, i % 2, [0.3] * 8) for i in range(40)]
    want = brute(rows, every=5, positives=3, negatives=4)
    for name, value in (("SEGMENT", 16), ("CHUNK", 8), ("FIRST", 1), ("HELD", 2)):
        monkeypatch.setattr(hn, name, value)
    assert found(frame(spark, rows), every=5, positives=3, negatives=4) == want


def test_bounds_prune_and_hold(spark):
    """A list whose bounds lie outside an anchor's windows isn't needed, and no row of it scores inside them."""
    rng = np.random.default_rng(7)
    x = np.floor(256 * np.array([v for _, _, v in blobs(rng)]))
    lists = hn.Lists(list(x), 20)
    at, c = lists[24]
    near = hn._closest(x, c)
    radius = {j: float(np.sqrt(np.square(x[near == j] - c[j]).sum(1)).max()) for j in range(len(c)) if (near == j).any()}
    top = (x[:50] @ x.T).max(1)
    low, high = (0.8 * top)[:, None], top[:, None]
    _, _, need = hn._needed(lists, radius, 24, x[:50], low, high)
    score = x[:50] @ x.T
    inside = (score >= low) & (score <= high)
    for j in radius:
        assert need[inside[:, near == j].any(1), j].all()
    assert need.mean() < 0.7


def test_best_keeps_ties_by_id():
    score = np.array([[5.0, 7, 7, 7, -np.inf], [-np.inf] * 5, [1.0, -np.inf, 2, -np.inf, -np.inf]])
    r, c = hn.best(score, np.array([9, 8, 3, 5, 1]), 2)
    assert list(zip(r.tolist(), c.tolist())) == [(0, 2), (0, 3), (2, 2), (2, 0)]


def test_empty_and_limits(spark):
    assert found(frame(spark, [])) == [] and found(frame(spark, [(None, 1, [1.0]), (100, 1, [1.0])])) == []
    with pytest.raises(Exception, match="after scaling"):
        found(frame(spark, [(100, 1, [1e30] * 4)]))


def test_query_and_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = sorted(map(tuple, hn.report(table(spark, sf_dir, "embeddings")).collect()))
    assert got == sorted(con.execute(hn.oracle()).fetchall()) and got
