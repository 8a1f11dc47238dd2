"""Dimension reduction: cosine kernel PCA, merging of models, attribution of components.

Cosine kernel PCA of n rows equals PCA of the rows scaled to unit length, so the n by n kernel is never formed:
executors add up d by d moments, the driver solves a d by d eigenproblem, d being at most a few thousand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import pearson_p
from ..scratch import array_sum, cut, vector_array

VECTORS = "chunk_id string, features array<double>"


def _stack(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index("features"))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def gram(rows: DataFrame, unit: bool = False) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sum of rows, sum of outer products), added up in the executors; ``unit`` scales rows to length 1."""

    def values(batch: pa.RecordBatch) -> np.ndarray:
        x = _stack(batch)
        x = _unit(x) if unit else x
        return np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])

    flat = array_sum(rows.select("features"), values)
    if flat is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    d = int((np.sqrt(4 * len(flat) - 3) - 1) / 2)
    return int(flat[0]), flat[1 : d + 1], flat[d + 1 :].reshape(d, d)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


#: Hexadecimal digits that a pass counts by, and rows among which a sort finds the last one of a sample.
DIGITS, FEW = 3, 10_000


def sample(rows: DataFrame, k: int, seed: int = 666) -> DataFrame:
    """Exactly k rows (all, if fewer), the same ones for a seed whatever the partitions: those of the smallest md5 of ``seed:chunk_id``.

    Counts by the hash's leading digits lead to the k-th hash, pass by pass; what is left is a filter, without a shuffle. Ids have to differ.
    """
    if k <= 0:
        return rows.limit(0)
    lot, prefix, left = F.md5(F.concat(F.lit(f"{seed}:"), F.col("chunk_id"))), "", k
    while True:
        inside = rows.where(lot.startswith(prefix)).groupBy(F.substring(lot, 1, len(prefix) + DIGITS).alias("p")).count().collect()  # at most 4096 rows
        if not prefix and sum(r["count"] for r in inside) <= k:
            return rows
        for r in sorted(inside):
            if r["count"] >= left:
                break
            left -= r["count"]
        prefix = r["p"]
        if r["count"] <= FEW or len(prefix) + DIGITS > 32:
            break
    near = rows.where(lot.startswith(prefix)).select(lot.alias("lot"), "chunk_id").orderBy("lot", "chunk_id").limit(left)
    last = near.agg(F.max(F.struct("lot", "chunk_id")).alias("last")).first()["last"]
    return rows.where((lot < last["lot"]) | ((lot == last["lot"]) & (F.col("chunk_id") <= last["chunk_id"])))


@dataclass
class Projection:
    """A fitted linear map: centre, components (columns), shares of variance, and whether rows are scaled to length 1."""

    mean: np.ndarray
    components: np.ndarray
    ratio: np.ndarray
    unit: bool

    @classmethod
    def fit(cls, rows: DataFrame, unit: bool) -> Projection:
        n, total, square = gram(rows, unit)
        if n < 2:
            raise ValueError("too few rows for components")
        mean = total / n
        values, vectors = np.linalg.eigh(square / n - np.outer(mean, mean))
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1, 1)
        return cls(mean, vectors, values / max(values.sum(), 1e-300), unit)

    def cut(self, n: int) -> Projection:
        return Projection(self.mean, self.components[:, :n], self.ratio[:n], self.unit)

    def transform(self, rows: DataFrame) -> DataFrame:
        """``chunk_id, features`` in the components' coordinates."""
        mean, comp, unit = self.mean, self.components, self.unit

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _stack(batch)
                if len(x):
                    y = ((_unit(x) if unit else x) - mean) @ comp
                    yield pa.record_batch([batch.column(0), vector_array(y)], names=["chunk_id", "features"])

        return rows.select("chunk_id", "features").mapInArrow(work, VECTORS)


def z_scores(rows: DataFrame) -> DataFrame:
    """Columns of mean 0 and population deviation 1; constant columns become 0."""
    flat = array_sum(rows.select("features"), lambda batch: np.concatenate([[batch.num_rows], (x := _stack(batch)).sum(0), (x * x).sum(0)]))
    if flat is None:
        return rows
    n, (total, square) = flat[0], flat[1:].reshape(2, -1)
    mean = total / n
    spread = np.sqrt(np.maximum(square / n - mean**2, 0))
    scale = np.where(spread > 1e-12 * (1 + np.abs(mean)), 1 / np.where(spread > 0, spread, 1), 0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _stack(batch)
            if len(x):
                yield pa.record_batch([batch.column(0), vector_array((x - mean) * scale)], names=["chunk_id", "features"])

    return rows.select("chunk_id", "features").mapInArrow(work, VECTORS)


def cosine_kpca(rows: DataFrame, inertia: float = 0.85, t: float = 0.2, min_comp: int = 3, seed: int = 666, unit: bool = True) -> tuple[DataFrame, np.ndarray]:
    """z-scored cosine kernel PCA, fitted on a share ``t`` of the rows; and the kept shares of variance.

    Kept are the components whose cumulative share stays below ``inertia``, ``min_comp`` at least. ``unit``: rows are scaled to length 1.
    """
    if not 0 < inertia <= 1 or not 0 < t <= 1:
        raise ValueError("inertia and t have to lie in (0, 1]")
    rows = cut(rows.select("chunk_id", "features"))  # read four times
    part = rows if t == 1 else sample(rows, max(2, int(rows.count() * t)), seed)
    fitted = Projection.fit(part, unit)
    positive = int((fitted.ratio > 1e-12).sum())
    n = min(max(int((np.cumsum(fitted.ratio) < inertia).sum()), min_comp), max(positive, 1))
    return z_scores(cut(fitted.cut(n).transform(rows))), fitted.ratio[:n]


#: Rows that a kernel other than the cosine is spanned by, at most.
LANDMARKS = 1000
KERNELS = ("cosine", "linear", "rbf", "poly", "sigmoid")


def _kernel(x: np.ndarray, y: np.ndarray, kind: str, gamma: float, degree: int, coef0: float) -> np.ndarray:
    if kind == "rbf":
        return np.exp(-gamma * np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0))
    dot = x @ y.T
    return dot if kind == "linear" else (gamma * dot + coef0) ** degree if kind == "poly" else np.tanh(gamma * dot + coef0)


def landmark_features(rows: DataFrame, kernel: str, gamma: float | None = None, degree: int = 3, coef0: float = 1.0, landmarks: int = LANDMARKS, seed: int = 666) -> DataFrame:
    """``chunk_id, features`` whose inner products are the kernel's, as far as ``landmarks`` rows span it (Nystrom): exact where they are all rows.

    A row's kernel with the landmarks times the root of their kernel's inverse. ``gamma`` is one over the number of columns if None. Of a
    kernel that isn't positive the positive part is kept.
    """
    if kernel not in KERNELS[1:]:
        raise ValueError(f"kernel has to be one of {', '.join(KERNELS[1:])}")
    held = sample(rows.select("chunk_id", "features"), landmarks, seed).orderBy("chunk_id").select("features").toArrow()  # a bounded number of rows
    if not len(held):
        return rows.select("chunk_id", "features")
    marks = held.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)
    options = (kernel, 1 / marks.shape[1] if gamma is None else gamma, degree, coef0)
    value, vector = np.linalg.eigh(_kernel(marks, marks, *options))
    good = value > 1e-10 * max(value.max(), 0)
    root = vector[:, good] / np.sqrt(value[good])
    shared = rows.sparkSession.sparkContext.broadcast((marks, root))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _stack(batch)
            if len(x):
                yield pa.record_batch([batch.column(0), vector_array(_kernel(x, shared.value[0], *options) @ shared.value[1])], names=["chunk_id", "features"])

    return rows.select("chunk_id", "features").mapInArrow(work, VECTORS)


#: Rows of a block of the kernel matrix, rows of a block that meet another block at once, and numbers of a block's sums that a task holds.
KERNEL_ROWS, KERNEL_STRIP, KERNEL_HELD = 2048, 128, 1 << 22
#: Numbers of a moment up to which a polynomial kernel's sums are taken from moments.
MOMENTS = 1 << 20


def _pair_sums(x: np.ndarray, y: np.ndarray, kind: str, gamma: float, degree: int, coef0: float) -> tuple[np.ndarray, np.ndarray]:
    """The sums over ``y`` of the kernel of each row of ``x``, and those over ``x`` for ``y``; what the kernel bends is one product for a strip of rows."""
    one = lambda z: np.ones((len(z), 1))
    if kind == "rbf":
        square = lambda z: -gamma * (z * z).sum(1, keepdims=True)
        x, y = np.hstack([2 * gamma * x, square(x), one(x)]), np.hstack([y, one(y), square(y)])
    elif kind != "linear":
        x, y = np.hstack([gamma * x, coef0 * one(x)]), np.hstack([y, one(y)])
    y, rows, columns = np.ascontiguousarray(y.T), np.empty(len(x)), np.zeros(y.shape[0])
    for at in range(0, len(x), KERNEL_STRIP):
        own = x[at : at + KERNEL_STRIP] @ y
        if kind == "rbf":
            np.exp(np.minimum(own, 0, out=own), out=own)
        elif kind == "sigmoid":
            np.tanh(own, out=own)
        elif kind == "poly":
            own = own**degree
        rows[at : at + KERNEL_STRIP] = own.sum(1)
        columns += own.sum(0)
    return rows, columns


def _diagonal(x: np.ndarray, kind: str, gamma: float, degree: int, coef0: float) -> np.ndarray:
    dot = (x * x).sum(1)
    return np.ones(len(x)) if kind == "rbf" else dot if kind == "linear" else (gamma * dot + coef0) ** degree if kind == "poly" else np.tanh(gamma * dot + coef0)


def _powers(x: np.ndarray, q: int) -> np.ndarray:
    """All products of q numbers of a row, a row for each."""
    out = np.ones((len(x), 1))
    for _ in range(q):
        out = (out[:, :, None] * x[:, None, :]).reshape(len(x), -1)
    return out


def _sums_by_moments(rows: DataFrame, kernel: str, options: tuple, degree: int, scale: float, shift: float) -> DataFrame:
    """A polynomial's sum over all rows is one in the row's own numbers, whose coefficients are the moments up to its degree: linear in the rows."""

    def values(batch: pa.RecordBatch) -> np.ndarray:
        out = [np.zeros((d ** (q // 2), d ** (q - q // 2))) for q in range(degree + 1)]
        for x in strips(_stack(batch)):
            for q, held in enumerate(out):
                held += _powers(x, q // 2).T @ _powers(x, q - q // 2)
        return np.concatenate([m.ravel() for m in out])

    d = len(rows.select("features").first()["features"])
    strips = lambda x: (x[at : at + KERNEL_STRIP] for at in range(0, len(x), KERNEL_STRIP))
    flat = array_sum(rows.select("features"), values)
    ends = np.cumsum([0, *(d**q for q in range(degree + 1))])
    moments = [math.comb(degree, q) * scale**q * shift ** (degree - q) * flat[ends[q] : ends[q + 1]].reshape(d ** (q // 2), -1) for q in range(degree + 1)]
    shared = rows.sparkSession.sparkContext.broadcast(moments)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _stack(batch)
            if len(x):
                total = np.concatenate([sum(((_powers(own, q // 2) @ m) * _powers(own, q - q // 2)).sum(1) for q, m in enumerate(shared.value)) for own in strips(x)])
                yield pa.record_batch([batch.column(0), pa.array(_diagonal(x, kernel, *options)), pa.array(total)], names=["chunk_id", "own", "total"])

    return rows.mapInArrow(work, "chunk_id string, own double, total double")


def kernel_sums(rows: DataFrame, kernel: str, gamma: float | None = None, degree: int = 3, coef0: float = 1.0, block: int = KERNEL_ROWS) -> DataFrame:
    """``chunk_id, own, total``: the diagonal and the row sums of the kernel matrix of all rows, which is what ``landmark_features`` give where all rows are landmarks.

    Polynomials are summed by moments. For other kernels two blocks of rows meet once, in one of the tasks, for the sums of both: the work is
    that of half of all pairs, memory that of two blocks and a bounded number of sums.
    """
    if kernel not in KERNELS[1:]:
        raise ValueError(f"kernel has to be one of {', '.join(KERNELS[1:])}")
    held = cut(rows.select("chunk_id", "features"))
    n = held.count()
    if not n:
        return held.select("chunk_id", F.lit(0.0).alias("own"), F.lit(0.0).alias("total"))
    d = len(held.select("features").first()["features"])
    options, blocks = (kernel, 1 / d if gamma is None else gamma, degree, coef0), -(-n // block)
    if kernel == "linear":
        return _sums_by_moments(held, kernel, options[1:], 1, 1.0, 0.0)
    if kernel == "poly" and isinstance(degree, int) and degree >= 0 and d**degree <= MOMENTS:
        return _sums_by_moments(held, kernel, options[1:], degree, options[1], coef0)

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk_id").combine_chunks()
        x = group.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table({"b": group.column("b").slice(0, 1), "ids": pa.array([group.column("chunk_id").to_pylist()], pa.list_(pa.string())), "x": pa.array([x.tobytes()], pa.binary())})

    dealt = held.withColumn("b", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int"))
    packed = cut(dealt.groupBy("b").applyInArrow(pack, "b int, ids array<string>, x binary"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for key, total in sums.items():
                yield pa.record_batch([pa.array([key], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["b", "total"])
            sums.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer()).reshape(-1, d) for c in ("x", "y"))
                b, c = (batch.column(name)[i].as_py() for name in ("b", "c"))
                for key, total in list(zip((b, c), _pair_sums(x, y, *options)))[: 1 if b == c else 2]:
                    sums[key] = sums[key] + total if key in sums else total
                if sum(map(len, sums.values())) > KERNEL_HELD:
                    yield from given()
        yield from given()

    def add(group: pa.Table) -> pa.Table:
        return pa.table({"b": group.column("b").slice(0, 1), "total": pa.array([sum(np.frombuffer(v.as_py()) for v in group.column("total")).tobytes()], pa.binary())})

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, total in zip(*(batch.column(c) for c in ("ids", "x", "total"))):
                own = _diagonal(np.frombuffer(x.as_buffer()).reshape(-1, d), *options)
                yield pa.record_batch([pa.array(ids.as_py(), pa.string()), pa.array(own), pa.array(np.frombuffer(total.as_py()))], names=["chunk_id", "own", "total"])

    # A block meets the blocks that follow it in a circle, up to the opposite one, so that all have as many to meet.
    ahead = F.pmod(F.col("c") - F.col("b"), F.lit(blocks))
    once = (2 * ahead < blocks) | ((2 * ahead == blocks) & (F.col("b") < F.col("c")))
    pairs = packed.select("b", "x").repartition(min(blocks, 512), "b").hint("shuffle_replicate_nl").join(packed.select(F.col("b").alias("c"), F.col("x").alias("y")), once)
    sums = cut(pairs.mapInArrow(meet, "b int, total binary")).groupBy("b").applyInArrow(add, "b int, total binary")
    return packed.join(sums, "b").select("ids", "x", "total").mapInArrow(unpack, "chunk_id string, own double, total double")


def kernel_pca(rows: DataFrame, inertia: float = 0.85, t: float = 0.2, min_comp: int = 3, seed: int = 666, kernel: str = "cosine", **options) -> tuple[DataFrame, np.ndarray]:
    """``cosine_kpca``, or the same over another kernel's ``landmark_features`` (``options``: ``gamma, degree, coef0, landmarks``)."""
    if kernel == "cosine":
        return cosine_kpca(rows, inertia, t, min_comp, seed)
    return cosine_kpca(landmark_features(rows, kernel, seed=seed, **options), inertia, t, min_comp, seed, unit=False)


def coordinates(rows: DataFrame, path: str | None = None, force: bool = False) -> DataFrame:
    """``chunk_id, x, y``: the first two principal components of the z-scores, for plots. A table at ``path`` is reused unless ``force``."""
    spark = rows.sparkSession
    if path and not force:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    scores = cut(z_scores(cut(rows.select("chunk_id", "features"))))
    out = Projection.fit(scores, False).cut(2).transform(scores).select("chunk_id", F.get("features", F.lit(0)).alias("x"), F.coalesce(F.get("features", F.lit(1)), F.lit(0.0)).alias("y"))
    if path:
        out.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    return out


def sample_size(n: int, t: float) -> int:
    return min(max(int(n * t), 3333), n)


def joined(models: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """``chunk_id, features``: the models' vectors one behind the other, for the given ids; missing rows are an error."""
    out = ids.select("chunk_id")
    for i, df in enumerate(models.values()):
        out = out.join(df.select("chunk_id", F.col("features").alias(f"_{i}")), "chunk_id", "left")
    if out.where(" OR ".join(f"_{i} IS NULL" for i in range(len(models)))).limit(1).count():
        raise ValueError("a model has no row for some id")
    return out.select("chunk_id", F.concat(*(f"_{i}" for i in range(len(models)))).alias("features"))


def merge_models(models: dict[str, DataFrame], ids: DataFrame, pca_inertia: float = 0.9999, kpca: dict | None = None, seed: int = 666) -> tuple[DataFrame, Projection]:
    """Kernel PCA of each model, then PCA of all of them side by side.

    Kept are the fewest components whose cumulative share exceeds ``pca_inertia``; three if there are too few.
    """
    kpca = {"seed": seed} | (kpca or {})
    n = ids.count()
    reduced = {name: kernel_pca(ids.join(df, "chunk_id"), **{**kpca, "t": sample_size(n, kpca.get("t", 0.2)) / n})[0] for name, df in models.items()}
    rows = cut(joined(reduced, ids))
    fitted = Projection.fit(sample(rows, sample_size(n, kpca.get("t", 0.2)), seed), False)
    keep = int((np.cumsum(fitted.ratio) <= pca_inertia).sum()) + 1
    keep = min(keep, int((fitted.ratio > 1e-12).sum())) if keep <= len(fitted.ratio) else min(3, len(fitted.ratio))
    fitted = fitted.cut(max(1, keep))
    return fitted.transform(rows), fitted


def component_origins(components: DataFrame, models: dict[str, DataFrame], n: int) -> DataFrame:
    """``component, model, feature_ix, r, p, abs_r``: correlation of the first n components with every feature.

    Executors add up n by d cross moments of each model's rows, centred at a first row; nothing is exploded.
    """
    y = components.select("chunk_id", F.slice("features", 1, n).alias("y"))
    out: list[tuple] = []
    for name, df in models.items():
        rows = y.join(df.select("chunk_id", "features"), "chunk_id").select("y", "features")
        first = rows.limit(1).collect()
        if not first:
            continue
        base_y, base_x = np.array(first[0]["y"]), np.array(first[0]["features"])

        def values(batch: pa.RecordBatch) -> np.ndarray:
            a = batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - base_y  # noqa: B023
            x = _stack(batch) - base_x  # noqa: B023
            return np.concatenate([[len(x)], a.sum(0), (a * a).sum(0), x.sum(0), (x * x).sum(0), (a.T @ x).ravel()])

        flat = array_sum(rows, values)
        k, d = len(base_y), len(base_x)
        m, a, aa, x, xx, ax = np.split(flat, np.cumsum([1, k, k, d, d]))
        m = m[0]
        cov = ax.reshape(k, d) / m - np.outer(a, x) / m**2
        var_y, var_x = aa / m - (a / m) ** 2, xx / m - (x / m) ** 2
        flat_y, flat_x = var_y <= 1e-14 * np.maximum(aa / m, 1e-300), var_x <= 1e-14 * np.maximum(xx / m, 1e-300)
        for c in range(k):
            for j in range(d):
                r = None if flat_y[c] or flat_x[j] else float(np.clip(cov[c, j] / np.sqrt(var_y[c] * var_x[j]), -1, 1))
                out.append((c, name, j, r, pearson_p(float("nan") if r is None else r, int(m)), None if r is None else abs(r)))
    return components.sparkSession.createDataFrame(out, "component int, model string, feature_ix int, r double, p double, abs_r double")
