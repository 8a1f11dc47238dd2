import numpy as np
import pytest

from helixbin.functions import special
from helixbin.operators import post, reduce, vbgmm


def frame(spark, x, extra=None):
    rows = [(f"r{i:04d}", [float(v) for v in row], *((extra[i],) if extra is not None else ())) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "chunk_id string, features array<double>" + (", cluster int" if extra is not None else ""))


def matrix(df):
    return np.array([r["features"] for r in df.orderBy("chunk_id").collect()])


def test_special_functions():
    assert np.allclose(special.digamma([1.0, 0.5, 10.0]), [-0.5772156649015329, -1.9635100260214235, 2.251752589066721])
    assert abs(special.betainc(2, 3, 0.4) - 0.5248) < 1e-12
    assert abs(special.pearson_p(0.5, 12) - 0.0978) < 2e-4 and special.pearson_p(1.0, 9) == 0


def test_cosine_kpca_equals_kernel(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 7)) + 1
    got, ratio = reduce.cosine_kpca(frame(spark, x), inertia=0.8, t=1.0)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    k = u @ u.T
    c = np.eye(40) - 1 / 40
    w, v = np.linalg.eigh(c @ k @ c)
    w, v = w[::-1], v[:, ::-1]
    n = max(int((np.cumsum(w / w.sum()) < 0.8).sum()), 3)
    y = matrix(got)
    assert y.shape == (40, n) and np.allclose(ratio, (w / w.sum())[:n])
    z = v[:, :n] / v[:, :n].std(0)
    assert np.allclose(np.abs((y * z).mean(0)), 1)
    assert np.allclose(y.mean(0), 0) and np.allclose(y.std(0), 1)


def test_merge_models(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(60, 6)), rng.normal(size=(60, 9))
    models = {"a": frame(spark, a), "b": frame(spark, b)}
    ids = models["a"].select("chunk_id")
    rows, fitted = reduce.merge_models(models, ids, 0.9)
    y = matrix(rows)
    share = np.cumsum(fitted.ratio)
    assert share[-1] > 0.9 and (len(share) == 1 or share[-2] <= 0.9) and y.shape[1] == len(share)
    assert np.allclose(np.cov(y.T) - np.diag(np.diag(np.cov(y.T))), 0, atol=1e-8)
    import hashlib

    for few, k in ((1, 10), (10_000, 10), (1, 0), (1, ids.count()), (1, 1), (1, 10**6)):
        reduce.FEW = few
        want = sorted((hashlib.md5(f"666:{r[0]}".encode()).hexdigest(), r[0]) for r in ids.collect())[:k]
        for part in (ids, ids.repartition(5)):
            some = reduce.sample(part, k)
            assert sorted(r[0] for r in some.collect()) == sorted(i for _, i in want)
        assert k == 0 or "SinglePartition" not in some._jdf.queryExecution().executedPlan().toString()
    reduce.FEW = 10_000
    with pytest.raises(ValueError):
        reduce.joined({"a": models["a"].limit(5)}, ids)


def blobs(seed=0, n=80):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.3, size=(n, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    return x, np.repeat([0, 1, 2], n)


def same_partition(a, b):
    pairs = set(zip(a, b, strict=True))
    return len(pairs) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("init", ["kmeans", "mustlink", "random"])
def test_mixture_finds_blobs(spark, init):
    x, truth = blobs()
    groups = spark.createDataFrame([(f"r{i:04d}", f"g{i // 8}") for i in range(len(x))], "chunk_id string, contig_id string")
    labels, runs = vbgmm.fit(frame(spark, x), 10, restarts=3, init=init, groups=groups, epsilon=1e-3)
    got = [r["cluster"] for r in labels.orderBy("chunk_id").collect()]
    assert same_partition(got, truth.tolist()) and runs.count() == 3
    again = vbgmm.fit(frame(spark, x).repartition(3), 10, restarts=3, init=init, groups=groups, epsilon=1e-3)[0]
    assert [r["cluster"] for r in again.orderBy("chunk_id").collect()] == got


def test_mixture_bound_rises(spark):
    x, truth = blobs(3, 40)
    _, state = vbgmm.fit_one(x, 6, bound="elbo", epsilon=1e-6)
    assert all(b >= a - 1e-6 for a, b in zip(state.bounds, state.bounds[1:]))
    with pytest.raises(ValueError):
        vbgmm.fit(frame(spark, x[:1]), 3)
    with pytest.raises(ValueError):
        vbgmm.fit(frame(spark, x), 3, restarts=1, init="mustlink")
    with pytest.raises(ValueError):
        vbgmm.fit(frame(spark, x), 3, init="other")
    z = np.eye(3)[truth]
    assert np.allclose(vbgmm.covariances(x, z, 0.0)[0], np.cov(x[truth == 0].T, ddof=0))


def overlapping(seed=5, n=70, d=4):
    """Blobs that touch, rows that repeat, and a column that hardly varies."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 1.0, size=(n, d)) for c in (0.0, 1.5, 3.0)])
    x[:, -1] *= 1e-3
    x[:20] = x[0]
    return x


@pytest.mark.parametrize("init,bound,few", [("kmeans", "compat", False), ("mustlink", "elbo", False), ("random", "compat", True), ("given", "elbo", False)])
def test_both_ways_give_equal_labels_and_bounds(spark, monkeypatch, init, bound, few):
    x = overlapping()
    groups = spark.createDataFrame([(f"r{i:04d}", f"g{i // 3}") for i in range(len(x))], "chunk_id string, contig_id string")
    rows = frame(spark, x).repartition(3).selectExpr("*", "cast(pmod(hash(chunk_id), 7) as int) AS start")
    run = lambda: [sorted(map(tuple, t.collect())) for t in vbgmm.fit(rows, 8, restarts=2, init=init, groups=groups, epsilon=1e-2, max_iter=6, bound=bound)]
    labels, runs = run()
    monkeypatch.setattr(vbgmm, "TASK_BYTES", 0)
    if few:  # passes of three components, and a restart after the other
        for name, value in (("SLICE_BYTES", 3 * 8 * 4 * 4), ("GROUP_BYTES", 0), ("WIDE_BYTES", 0)):
            monkeypatch.setattr(vbgmm, name, value)
    got, again = run()
    assert got == labels
    assert [r[:2] + r[3:] for r in again] == [r[:2] + r[3:] for r in runs] and np.allclose([r[2] for r in again], [r[2] for r in runs], rtol=1e-9)


def test_empty_clusters_restart_at_the_same_rows(spark):
    x = overlapping()[:40]
    rows = frame(spark, x).selectExpr("chunk_id", "features", "xxhash64(chunk_id) AS ids", "array(cast(pmod(hash(chunk_id), 2) as int)) AS start").repartition(3)
    local = rows.orderBy("chunk_id").collect()
    ids, start = np.array([r["ids"] for r in local]), np.array([r["start"][0] for r in local])
    centre = vbgmm.kmeans_in_cluster(rows, 9, x.shape[1], {0: 77})[0]  # seven clusters start empty
    assert (vbgmm._nearest(x, centre) == vbgmm.init_kmeans(x, 9, start, ids, 77)).all()


def test_winner_is_the_best_finite_bound(spark, monkeypatch):
    x, _ = blobs(3, 20)
    for bounds, best in (([float("nan"), -5.0, float("inf")], 1), ([-5.0, -7.0, -5.0], 0)):
        runs = [(r, 1, b, 1) for r, b in enumerate(bounds)]
        monkeypatch.setattr(vbgmm, "_fit_in_tasks", lambda rows, *a: ((lambda r: rows.selectExpr("chunk_id", f"{r} AS cluster")), runs))  # noqa: B023
        assert vbgmm.fit(frame(spark, x), 3, seed=1, restarts=3)[0].first()["cluster"] == best
    monkeypatch.setattr(vbgmm, "_fit_in_tasks", lambda rows, *a: (None, [(0, 1, float("nan"), 1)]))
    with pytest.raises(ValueError):
        vbgmm.fit(frame(spark, x), 3, restarts=1)


def test_long_arrays_are_added_up_in_slices(spark, monkeypatch):
    from helixbin import scratch

    monkeypatch.setattr(scratch, "SLICE", 7)
    monkeypatch.setattr(scratch, "FAN_IN", 2)
    rows = spark.range(0, 100, 1, 25)
    got = scratch.array_sum(rows, lambda b: np.arange(20.0) * b.column(0).to_numpy().sum())
    assert np.allclose(got, np.arange(20.0) * sum(range(100))) and scratch.array_sum(rows.where("id < 0"), lambda b: np.ones(3)) is None


def test_silhouettes_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x, c = rng.normal(size=(60, 5)), rng.integers(0, 4, 60)
    c[0] = 9
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    want = []
    for i in range(60):
        own = (c == c[i]) & (np.arange(60) != i)
        if not own.any():
            want.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, c == k].mean() for k in set(c.tolist()) - {c[i]})
        want.append((b - a) / max(a, b))
    got = {r["chunk_id"]: r["silhouette"] for r in post.silhouettes(frame(spark, x, c.tolist())).collect()}
    assert np.allclose([got[f"r{i:04d}"] for i in range(60)], want)
    assert all(r["silhouette"] == 0 for r in post.silhouettes(frame(spark, x, [1] * 60)).collect())


def test_verdicts(spark):
    rows = [(f"a{i}", 0, 0.9) for i in range(40)] + [(f"b{i}", 1, 0.1 - 0.02 * i) for i in range(40)] + [(f"c{i}", -1, 1.0) for i in range(5)]
    s = spark.createDataFrame(rows, "chunk_id string, cluster int, silhouette double")
    v = {r["cluster"]: r["accepted"] for r in post.verdicts(s).collect()}
    assert v == {0: True, 1: False, -1: False}
    assert {r["cluster"]: r["accepted"] for r in post.verdicts(s, keep_unbinned=True).collect()}[-1]
    kept, rest = post.extract_validated(s, post.verdicts(s))
    assert kept.count() == 40 and rest.count() == 45
    assert {r["cluster"] for r in post.box_stats(s).collect()} == {0, 1}


def test_reassign_tiny(spark):
    rows, at = [], 0
    for cluster, n in ((0, 100), (1, 60)):
        for _ in range(n):
            rows.append((f"x{at}", at, f"solo{at}", cluster))
            at += 1
    rows += [("t0", at, "k", 2), ("k1", at + 1, "k", 1), ("k2", at + 2, "k", 1), ("t1", at + 3, "lone", 2), ("v0", at + 4, "v", 7), ("v1", at + 5, "v", 4)]
    df = spark.createDataFrame(rows, "chunk_id string, seq_ord long, contig_id string, cluster int")
    got = {r["chunk_id"]: r["curated"] for r in post.reassign_tiny(df.repartition(5)).collect()}
    assert len(got) == len(rows) and got["t0"] == 1 and got["t1"] == -1
    assert got["v0"] == 7 and got["v1"] == 7  # a tie goes to the label met first
    assert all(got[f"x{i}"] == (0 if i < 100 else 1) for i in range(160))


def test_reassign_tiny_against_loop(spark):
    rng = np.random.default_rng(5)
    n = 600
    contig, label = rng.integers(0, 150, n), np.where(rng.random(n) < 0.8, rng.integers(0, 3, n), rng.integers(3, 40, n))
    rows = [(f"r{i}", i, f"c{contig[i]}", int(label[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "chunk_id string, seq_ord long, contig_id string, cluster int")
    sizes = np.bincount(label)
    limit = max(np.percentile(sizes[sizes > 0], 15), 50)
    now = label.copy()
    for i in range(n):
        if sizes[label[i]] <= limit:
            mates = now[contig == contig[i]]
            if len(mates) > 1:
                values = mates.tolist()
                now[i] = max(dict.fromkeys(values), key=values.count)
            else:
                now[i] = -1
    got = {r["chunk_id"]: r["curated"] for r in post.reassign_tiny(df).collect()}
    assert [got[f"r{i}"] for i in range(n)] == now.tolist()


def test_must_link_counts(spark):
    rng = np.random.default_rng(6)
    rows = [(f"c{rng.integers(0, 20)}", int(rng.integers(0, 4))) for _ in range(100)]
    df = spark.createDataFrame(rows, "contig_id string, cluster int")
    want = {}
    for a, i in rows:
        for b, j in rows:
            if a == b:
                want[i, j] = want.get((i, j), 0) + 1
    assert {(r["ci"], r["cj"]): r["n"] for r in post.must_link_matrix(df).collect()} == want
    for r in post.must_link_purity(df).collect():
        k = r["cluster"]
        assert abs(r["purity"] - want[k, k] / sum(v for (_, j), v in want.items() if j == k)) < 1e-12


def test_component_origins(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(50, 3))
    x[:, 2] = 1
    y = np.column_stack([x[:, 0] * 2 + 1, rng.normal(size=50)])
    got = {(r["component"], r["feature_ix"]): r for r in reduce.component_origins(frame(spark, y), {"m": frame(spark, x)}, 2).collect()}
    assert abs(got[0, 0]["r"] - 1) < 1e-9 and got[0, 0]["p"] < 1e-12
    assert got[0, 2]["r"] is None or np.isnan(got[0, 2]["r"])
    assert abs(got[1, 1]["r"] - np.corrcoef(x[:, 1], y[:, 1])[0, 1]) < 1e-9


@pytest.mark.parametrize("kernel,options", [("rbf", {}), ("poly", {"degree": 2, "gamma": 0.5}), ("sigmoid", {"gamma": 0.05}), ("linear", {})])
def test_kernels_equal_the_dense_ones_with_all_rows_as_landmarks(spark, kernel, options):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 5))
    f = np.array([r["features"] for r in reduce.landmark_features(frame(spark, x).repartition(3), kernel, landmarks=60, **options).orderBy("chunk_id").collect()])
    k = reduce._kernel(x, x, kernel, options.get("gamma", 1 / 5), options.get("degree", 3), 1.0)
    value, vector = np.linalg.eigh(k)
    k = (vector * np.maximum(value, 0)) @ vector.T  # the positive part
    assert np.allclose(f @ f.T, k, atol=1e-6)
    centre = np.eye(60) - 1 / 60
    value, vector = np.linalg.eigh(centre @ k @ centre)
    got, ratio = reduce.kernel_pca(frame(spark, x), inertia=0.8, t=1, kernel=kernel, landmarks=60, **options)
    n = max(3, int((np.cumsum(value[::-1] / value.sum()) < 0.8).sum()))
    assert len(ratio) == n and np.allclose(ratio, value[::-1][:n] / value.sum(), atol=1e-6)
    z = np.array([r["features"] for r in got.orderBy("chunk_id").collect()])
    want = vector[:, ::-1][:, :n] * np.sqrt(60)
    assert np.allclose(np.abs((z * want).mean(0)), 1, atol=1e-5)
    with pytest.raises(ValueError):
        reduce.landmark_features(frame(spark, x), "other")


def test_few_landmarks_come_near(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3))
    f = np.array([r["features"] for r in reduce.landmark_features(frame(spark, x), "rbf", landmarks=80).orderBy("chunk_id").collect()])
    k = reduce._kernel(x, x, "rbf", 1 / 3, 3, 1.0)
    assert f.shape[1] <= 80 and np.linalg.norm(f @ f.T - k) < 0.05 * np.linalg.norm(k)


def test_kernel_sums_by_blocks(spark):
    """Diagonal and row sums of all rows' kernel are those of a matrix, and of features from all rows as landmarks, which one process had to hold."""
    x = np.random.default_rng(3).normal(size=(45, 4))
    rows = spark.createDataFrame([(f"c{i}", v.tolist()) for i, v in enumerate(x)], "chunk_id string, features array<double>").repartition(3)
    for kernel in ("rbf", "poly"):
        want = reduce._kernel(x, x, kernel, 1 / 4, 3, 1.0)
        got = {r["chunk_id"]: (r["own"], r["total"]) for r in reduce.kernel_sums(rows, kernel, block=10).collect()}
        assert len(got) == 45 and np.allclose([got[f"c{i}"] for i in range(45)], np.stack([np.diagonal(want), want.sum(1)], 1))
    assert reduce.kernel_sums(rows.limit(0), "rbf").collect() == []


def test_totals_by_label():
    x, label = np.random.default_rng(1).normal(size=(70_000, 3)), np.random.default_rng(2).integers(0, 5, 70_000)
    want = np.zeros((6, 3))
    np.add.at(want, label, x)
    assert np.allclose(vbgmm._totals(x, label, 6), want) and not vbgmm._totals(x[:0], label[:0], 6).any()


def test_fits_go_by_blocks_of_rows(spark):
    """Neither way holds an array of rows by components, and a pass over the cluster reads a few binaries."""
    import tracemalloc

    x = np.random.default_rng(3).normal(size=(60_000, 8))
    tracemalloc.start()
    labels, state = vbgmm.fit_one(x, 20, max_iter=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(labels) == len(x) and peak < len(x) * 20 * 8
    z = state.responsibilities(x)
    y = x[:, None] - state.mean
    dist = state.nu * np.einsum("nki,kij,nkj->nk", y, state.w, y) - state.log_lambda + x.shape[1] / state.beta
    want = state.pi * np.exp(-0.5 * (dist - dist.min(1, keepdims=True)))
    assert np.allclose(z, want / want.sum(1, keepdims=True), atol=2 * vbgmm.MIN_Z) and (labels == z.argmax(1)).all()
    rows = frame(spark, x[:9000]).selectExpr("chunk_id", "features", "xxhash64(chunk_id) AS ids", "array(0, 1) AS start").repartition(2)
    blocks = vbgmm.packed(rows)
    assert blocks.count() <= 4 and tuple(blocks.selectExpr("sum(length(x))", "sum(length(ids))", "sum(length(start))").first()) == (9000 * 64, 9000 * 8, 9000 * 8)


def test_marks_tell_labellings_apart():
    """A pass of k-means finds each row's nearest centre once: the marks of two passes are equal where no label changed, however rows are dealt."""
    rng = np.random.default_rng(4)
    ids, label = rng.integers(-(1 << 62), 1 << 62, 5000), rng.integers(0, 9, 5000)
    value = lambda *parts: sum(int(low) + (int(high) << 32) for low, high in parts) % (1 << 64)
    order = rng.permutation(5000)
    whole = value(vbgmm._mark(ids, label, 9))
    assert whole == value(vbgmm._mark(ids[order[:70]], label[order[:70]], 9), vbgmm._mark(ids[order[70:]], label[order[70:]], 9))
    label[17] = (label[17] + 1) % 9
    assert whole != value(vbgmm._mark(ids, label, 9))


def test_kernel_sums_meet_blocks_once(spark, monkeypatch):
    """Polynomials are summed without pairs; for other kernels half of the pairs of blocks are enough, and a power beyond the moments' size too."""
    x = np.random.default_rng(6).normal(size=(70, 5))
    rows = spark.createDataFrame([(f"c{i}", v.tolist()) for i, v in enumerate(x)], "chunk_id string, features array<double>")
    whole = reduce._pair_sums
    hints, hint = [], type(rows).hint
    monkeypatch.setattr(type(rows), "hint", lambda df, *a: hints.append(a) or hint(df, *a))
    for kernel, options, size in (("linear", {}, None), ("poly", {"degree": 2, "gamma": 0.3, "coef0": -1.0}, None), ("poly", {"degree": 3}, None), ("poly", {"degree": 3}, 8), ("sigmoid", {}, None), ("rbf", {}, None)):
        if size is not None:
            monkeypatch.setattr(reduce, "MOMENTS", size)
        gamma, degree, coef0 = options.get("gamma", 1 / 5), options.get("degree", 3), options.get("coef0", 1.0)
        want = reduce._kernel(x, x, kernel, gamma, degree, coef0)
        got = {r["chunk_id"]: (r["own"], r["total"]) for r in reduce.kernel_sums(rows, kernel, block=10, **options).collect()}
        assert np.allclose([got[f"c{i}"] for i in range(70)], np.stack([np.diagonal(want), want.sum(1)], 1), rtol=1e-11)
        assert len(hints) == {"linear": 0, "poly": int(size == 8), "sigmoid": 2, "rbf": 3}[kernel]
    a, b = whole(x[:30], x[30:], "rbf", 0.2, 3, 1.0)
    want = reduce._kernel(x[:30], x[30:], "rbf", 0.2, 3, 1.0)
    assert np.allclose(a, want.sum(1)) and np.allclose(b, want.sum(0))
