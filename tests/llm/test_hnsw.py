import numpy as np
import pytest

from helixbin.llm import hnsw
from helixbin.llm.common import table


def brute(rows, threshold=0.95):
    good = {}
    for i, v in rows:
        if v is not None and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v, float)
            good[i] = x / np.linalg.norm(x)
    ids = list(good)
    parent = {i: i for i, _ in rows}
    n = dict.fromkeys(parent, 0)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold:
                n[a] += 1
                n[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (n[i], root(i)) for i in parent}


def vectors(rng, n=300, dim=16):
    out = [rng.normal(size=dim) for _ in range(n)]
    for spread, size in ((0.05, 40), (0.2, 60), (0.0, 25)):
        c = rng.normal(size=dim)
        out += [c + spread * rng.normal(size=dim) for _ in range(size)]
    return [v.tolist() for v in out]


@pytest.mark.parametrize("shard,block", [(4096, 1024), (100, 64)])
def test_against_brute_force(spark, shard, block):
    rng = np.random.default_rng(8)
    data = vectors(rng) + [None, [], [0.0] * 16, [-0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 8, [2.0] * 8, [1e-200] * 16, [1e200] * 16]
    rows = list(enumerate(data))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows)
    got = hnsw.near_duplicates(df, shard=shard, block=block).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["vec_id"]
        n, c = want[i]
        if data[i] is not None and len(data[i]) == 16 and abs(data[i][0] or 0) in (1e-200, 1e200):
            continue  # brute force overflows
        assert (r["n_links"], r["component_id"], r["kept"]) == (n, c, c == i), i
    scaled = {r["vec_id"]: r for r in got if data[r["vec_id"]] in ([1e-200] * 16, [1e200] * 16)}
    assert all(r["n_links"] == 1 for r in scaled.values()) and len({r["component_id"] for r in scaled.values()}) == 1
    assert min(r["recall"] for r in got) >= 0.9


def test_documents_table(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
    for r in hnsw.report(df).collect():
        assert (r["n_links"], r["component_id"]) == want[r["vec_id"]]


def test_every_size_goes_through_the_graph(spark, monkeypatch):
    """3,000 points in shards of 400: all links of brute force, found by searches of the shards' graphs."""
    rng = np.random.default_rng(12)
    data = vectors(rng, 2875)
    rows = list(enumerate(data))
    x = np.array(data)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= 0.95
    np.fill_diagonal(links, False)
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard=400, block=256).collect()}
    want = brute(rows)
    missed = sum(int(links[i].sum()) - got[i]["n_links"] for i in got)
    assert 0 <= missed <= 0.005 * links.sum() and all(got[i]["recall"] >= 0.95 for i in got)
    assert sum(got[i]["component_id"] != want[i][1] for i in got) <= 2
    # The same search in this process: every query goes through Graph.search, in a shard of 40 points too.
    asked = []
    search = hnsw.Graph.search
    monkeypatch.setattr(hnsw.Graph, "search", lambda self, q, beam: asked.append(len(q)) or search(self, q, beam))
    for n in (40, 400):
        asked.clear()
        pairs = {(int(a), int(p)) for aa, pp in hnsw.links_in_shard(hnsw.Graph(x[-n:]), x[-n:], x[-n:], 0.95) for a, p in zip(aa, pp)}
        assert asked[0] == n and pairs >= {(int(a), int(b)) for a, b in zip(*np.nonzero(links[-n:, -n:]))}


def test_extra_columns_that_clash(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 5, "x", 0.0), (2, [1.0, 0.0], 5, "y", 1.0)], "vec_id long, embedding array<double>, id int, key string, recall double")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in hnsw.report(df).collect()) == [(1, 1, 1), (2, 1, 1)]


def test_null_and_repeated_ids_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [1.0, 0.01]), (6, None)], "vec_id long, embedding array<float>")
    rows = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in hnsw.report(df).collect()), key=str)
    assert rows == sorted([(None, 0, None, True), (3, 2, 3, True), (3, 2, 3, True), (5, 2, 3, False), (6, 0, 6, True)], key=str)
    assert hnsw.report(df.where("false")).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g, q = hnsw.Graph(x[:1200]), x[1200:]
    ids, sim = g.search(q, 96)
    assert (sim[:, 0] >= (q @ x[:1200].T).max(1) - 1e-6).mean() >= 0.9
    assert ((ids[:, :1] >= 0) & (ids[:, :1] < 1200)).all()


def test_a_centre_keeps_the_graph_linear():
    """Points round one centre: all would link to it, and all are found."""
    rng = np.random.default_rng(3)
    for n in (1000, 3000):
        centre = np.zeros(32)
        centre[0] = 1
        side = rng.normal(size=(n, 32))
        side[:, 0] = 0
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        unit = np.concatenate([centre[None], 0.9 * centre + np.sqrt(1 - 0.81) * side])
        graph = hnsw.Graph(unit)
        assert graph.layers[0].shape[1] <= 4 * hnsw.M and graph.layers[0].nbytes <= 16 * hnsw.M * (n + 1)
        for threshold in (0.95, 0.89):
            beam, recall = hnsw.audit(graph, unit, unit[::7], threshold)
            got = {(int(a), int(p)) for x in hnsw.links_in_shard(graph, unit, unit, threshold, beam) for a, p in zip(*x)}
            want = set(zip(*(x.tolist() for x in np.nonzero(unit @ unit.T >= threshold))))
            assert got <= want and len(got) >= 0.99 * len(want) and recall >= 0.99
            pairs = sum(len(x[0]) for x in hnsw.links_in_shard(graph, unit, unit, threshold, beam))
            assert pairs == len(got)  # none twice


def test_few_tasks_stream_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    data = vectors(rng, 120)
    df = spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>")
    want = brute(list(enumerate(data)))
    monkeypatch.setattr(hnsw, "TASKS", 3)
    for r in hnsw.near_duplicates(df, shard=60, block=16).collect():
        assert (r["n_links"], r["component_id"]) == want[r["vec_id"]]
