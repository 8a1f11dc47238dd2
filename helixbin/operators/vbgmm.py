"""A variational-Bayes Gaussian mixture (Bishop, PRML 10.2) with point-estimated weights.

Starts are hashes of ids, computed once for all restarts. A matrix of up to ``TASK_BYTES`` goes to one task for each restart; a
larger one stays in the cluster, packed in blocks of rows, where a pass over the blocks adds up the moments of all restarts, by restart and
component. Both ways have the same starts and the same arithmetic, up to the order of sums. Labels stay in the cluster.
Components whose weight falls to ``ALIVE`` rows or less die.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import digamma, lgamma
from ..scratch import AT_DRIVER, array_sum, cut, keyed_sum, vector_array
from ..session import ship
from .reduce import _stack

#: Fixed values.
BETA0 = 1e-3
MIN_Z = 1e-6
ALIVE = 0.1
SEED_STEP = 1009
DEFAULT_RESTARTS = 10
KMEANS_STEPS = 1000
#: A matrix of up to so many bytes goes to one task a restart; beyond, a pass over the cluster takes less time than such a task.
TASK_BYTES = 32 << 20
#: Rows of a block, and the numbers that an E step holds of some of them, so that they stay in the processor's caches.
BLOCK_ROWS, BLOCK_NUMBERS = 4096, 1 << 18
#: Moments that a task adds up in one pass, and those of restarts that run together; sums beyond ``WIDE_BYTES`` reach the driver once.
SLICE_BYTES, GROUP_BYTES, WIDE_BYTES = 256 << 20, 256 << 20, 32 << 20


@dataclass
class Prior:
    beta: float
    nu: float
    w_inv: np.ndarray
    log_b: float

    @classmethod
    def of(cls, var: np.ndarray) -> Prior:
        """``var``: sample variances of the columns (n-1 in the denominator)."""
        d = len(var)
        w_inv = np.diag(d * var)
        return cls(BETA0, float(d), w_inv, float(log_wishart_b(np.array([float(d)]), -_logdet(w_inv[None]), d)[0]))


def _logdet(a: np.ndarray) -> np.ndarray:
    return 2 * np.log(np.diagonal(np.linalg.cholesky(a), axis1=-2, axis2=-1)).sum(-1)


def log_wishart_b(nu: np.ndarray, logdet_w: np.ndarray, d: int) -> np.ndarray:
    """ln B(W, nu), the Wishart normaliser."""
    nu = np.asarray(nu, float)
    tail = sum(lgamma((nu - i) / 2) for i in range(d))
    return -nu / 2 * logdet_w - nu * d / 2 * math.log(2) - d * (d - 1) / 4 * math.log(math.pi) - tail


def expected_logdet(nu: np.ndarray, logdet_w: np.ndarray, d: int) -> np.ndarray:
    """E[ln |Lambda|]."""
    return d * math.log(2) + logdet_w + sum(digamma((nu - i) / 2) for i in range(d))


@dataclass
class Mixture:
    """The state of one fit; rows of the arrays are components."""

    prior: Prior
    n: np.ndarray
    pi: np.ndarray
    mean: np.ndarray
    beta: np.ndarray
    nu: np.ndarray
    w: np.ndarray
    root: np.ndarray
    logdet_w: np.ndarray
    log_lambda: np.ndarray
    xbar: np.ndarray
    s: np.ndarray
    bounds: list[float] = field(default_factory=list)

    @classmethod
    def from_moments(cls, prior: Prior, n: np.ndarray, first: np.ndarray, second: np.ndarray) -> Mixture:
        """The M step from sums of z, z x and z x x'."""
        k, d = first.shape
        live = n > ALIVE
        safe = np.where(live, n, 1)
        xbar = np.where(live[:, None], first / safe[:, None], 0)
        scatter = np.where(live[:, None, None], second - n[:, None, None] * xbar[:, :, None] * xbar[:, None, :], 0)
        beta = np.where(live, prior.beta + n, prior.beta)
        nu = np.where(live, prior.nu + n, prior.nu)
        mean = np.where(live[:, None], first / beta[:, None], 0)
        shrink = np.where(live, prior.beta * n / beta, 0)
        w_inv = prior.w_inv + scatter + shrink[:, None, None] * xbar[:, :, None] * xbar[:, None, :]
        w_inv = (w_inv + np.swapaxes(w_inv, 1, 2)) / 2
        try:
            factor = np.linalg.cholesky(w_inv)
        except np.linalg.LinAlgError as e:
            raise ValueError("a component's scale matrix is not positive definite") from e
        pi = np.where(live, n, 0)
        logdet_w = -2 * np.log(np.diagonal(factor, axis1=-2, axis2=-1)).sum(-1)
        return cls(prior, np.where(live, n, 0), pi / max(pi.sum(), 1e-300), mean, beta, nu, np.linalg.inv(w_inv), np.linalg.inv(factor), logdet_w, expected_logdet(nu, logdet_w, d), xbar, scatter / safe[:, None, None])

    def responsibilities(self, x: np.ndarray) -> np.ndarray:
        """The E step: shares below ``MIN_Z`` are dropped, the rest scaled to 1."""
        k, d = self.mean.shape
        live = self.alive()
        if not len(live):
            return np.full((len(x), k), np.nan)
        # A distance is the squared length of root (x - mean): one product gives those of all components, and the ones below x subtract the means.
        root = np.sqrt(self.nu[live])[:, None, None] * self.root[live]
        wide = np.concatenate([root, -(root @ self.mean[live][:, :, None])], 2).reshape(-1, d + 1)
        more, pi = (d / self.beta[live] - self.log_lambda[live])[:, None], self.pi[live][:, None]
        out, size = np.zeros((k, len(x))), max(64, BLOCK_NUMBERS // len(wide))
        for at in range(0, len(x), size):
            own = x[at : at + size]
            y = wide @ np.concatenate([own.T, np.ones((1, len(own)))])
            y *= y
            dist = y.reshape(len(live), d, -1).sum(1) + more
            z = pi * np.exp(-0.5 * (dist - dist.min(0)))
            z /= z.sum(0)
            z *= z >= MIN_Z
            out[live, at : at + size] = z / z.sum(0)
        return out.T

    def alive(self) -> np.ndarray:
        return np.flatnonzero(self.pi > 0)

    def places(self) -> np.ndarray:
        """Dense numbers of the components that are alive, in their order; -1 for the others."""
        place = np.full(len(self.pi), -1, np.int32)
        place[self.alive()] = np.arange(len(self.alive()))
        return place

    def labelled(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``chunk_id, cluster`` of batches of ``chunk_id, features``."""
        for batch in batches:
            x = _stack(batch)
            if len(x):
                yield pa.record_batch([batch.column(0), pa.array(self.labels(x))], names=["chunk_id", "cluster"])

    def labels(self, x: np.ndarray) -> np.ndarray:
        """The dense number of each row's likeliest component."""
        return self.places()[np.concatenate([self.responsibilities(own).argmax(1) for own in _parts(x)])]

    def bound(self, z_moments: tuple[np.ndarray, np.ndarray, np.ndarray], entropy: float, kind: str) -> float:
        """The lower bound from the moments of z under this state; ``entropy`` is the sum of z ln z.

        ``compat`` uses E[ln |Lambda|] where ``elbo`` has the Wishart entropy.
        """
        n, first, second = z_moments
        live = (self.pi > 0) & (n > 0)
        n, first, second = n[live], first[live], second[live]
        d = self.mean.shape[1]
        p, m, beta, nu, w, ll, ldw = self.prior, self.mean[live], self.beta[live], self.nu[live], self.w[live], self.log_lambda[live], self.logdet_w[live]
        xbar = first / n[:, None]
        s = second / n[:, None, None] - xbar[:, :, None] * xbar[:, None, :]
        quad = np.einsum("ki,kij,kj->k", xbar - m, w, xbar - m)
        b1 = 0.5 * (n * (ll - d / beta - nu * np.einsum("kij,kji->k", s, w) - nu * quad - d * math.log(2 * math.pi))).sum()
        b2 = (n * np.log(self.pi[live])).sum()
        mwm = np.einsum("ki,kij,kj->k", m, w, m)
        b3 = 0.5 * (d * math.log(p.beta / (2 * math.pi)) + ll - d * p.beta / beta - p.beta * nu * mwm).sum() + live.sum() * p.log_b
        b3 += 0.5 * (p.nu - d - 1) * ll.sum() - 0.5 * (nu * np.einsum("ij,kji->k", p.w_inv, w)).sum()
        own = -log_wishart_b(nu, ldw, d) - 0.5 * (nu - d - 1) * ll + 0.5 * nu * d if kind == "elbo" else ll
        b5 = (0.5 * ll + 0.5 * d * np.log(beta / (2 * math.pi)) - 0.5 * d - own).sum()
        return float(b1 + b2 + b3 - entropy - b5)


def moments(x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of z, z x and z x x', a component after the other."""
    second = np.zeros((z.shape[1], x.shape[1], x.shape[1]))
    for j in range(z.shape[1]):
        at = np.flatnonzero(z[:, j])
        y = x[at]
        second[j] = y.T @ (y * z[at, j, None])
    return z.sum(0), z.T @ x, second


def entropy(z: np.ndarray) -> float:
    own = z[z > 0]
    return float((own * np.log(own)).sum())


def _parts(x: np.ndarray) -> Iterator[np.ndarray]:
    return (x[at : at + BLOCK_ROWS] for at in range(0, len(x), BLOCK_ROWS))


def passed(x: np.ndarray, given: Mixture | np.ndarray, k: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], float]:
    """Moments and entropy of the rows' shares under a state, or of labels, a block of rows after the other."""
    d, e = x.shape[1], 0.0
    held = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
    for i, own in enumerate(_parts(x)):
        z = given.responsibilities(own) if isinstance(given, Mixture) else np.eye(k)[given[i * BLOCK_ROWS :][: len(own)]]
        for total, part in zip(held, moments(own, z)):
            total += part
        e += entropy(z)
    return held, e


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = (centre * centre).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *((half - own @ centre.T).argmin(1) for own in _parts(x))])


def _totals(x: np.ndarray, label: np.ndarray, k: int) -> np.ndarray:
    """The sums of the rows of each label, as products of slices."""
    total, at = np.zeros((k, x.shape[1])), 0
    for own in _parts(x):
        z = np.zeros((k, len(own)))
        z[label[at : at + len(own)], np.arange(len(own))] = 1
        total += z @ own
        at += len(own)
    return total


def _lot(ids: np.ndarray, seed: int, draw: int) -> np.ndarray:
    """A hash of the rows' id hashes for the given draw; its smallest value draws a row."""
    x = ids.view(np.uint64) + np.uint64((seed * 1_000_003 + draw + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def init_kmeans(x: np.ndarray, k: int, start: np.ndarray, ids: np.ndarray, seed: int, steps: int = KMEANS_STEPS) -> np.ndarray:
    """Labels by Lloyd's steps from the labels ``start``; an empty cluster restarts at a row drawn by ``_lot``."""
    label = start
    for step in range(steps):
        n = np.bincount(label, minlength=k)
        centre = _totals(x, label, k) / np.maximum(n, 1)[:, None]
        for j in np.flatnonzero(n == 0).tolist():
            centre[j] = x[_lot(ids, seed, step * k + j).argmin()]
        new = _nearest(x, centre)
        if (new == label).all():
            break
        label = new
    return label


def _ended(bounds: list[float], step: int, max_iter: int, epsilon: float) -> bool:
    return not math.isfinite(bounds[-1]) or step == max_iter or (step > 0 and abs(bounds[-1] - bounds[-2]) <= epsilon)


def fit_one(x: np.ndarray, k: int, start: np.ndarray | None = None, ids: np.ndarray | None = None, seed: int = 666, init: str = "random", max_iter: int = 600, epsilon: float = 1e-4, bound: str = "compat") -> tuple[np.ndarray, Mixture]:
    """Labels (dense, from 0, in component order) and the state of one restart from the labels ``start`` (row number modulo k if None)."""
    if len(x) < 2:
        raise ValueError("too few rows")
    start = np.arange(len(x)) % k if start is None else start
    prior = Prior.of(np.maximum(x.var(0, ddof=1), 1e-12))
    if init == "kmeans":
        start = init_kmeans(x, k, start, np.arange(len(x)) if ids is None else ids, seed)
    state, bounds = Mixture.from_moments(prior, *passed(x, start, k)[0]), []
    for i in range(max_iter + 1):
        held, e = passed(x, state, k)
        bounds.append(state.bound(held, e, bound))
        if _ended(bounds, i, max_iter, epsilon):
            break
        state = Mixture.from_moments(prior, *held)
    state.bounds = bounds
    return state.labels(x), state


def covariances(x: np.ndarray, z: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Maximum-likelihood covariances of the components, with a ridge before the division."""
    n, first, second = moments(x, z)
    m = first / np.maximum(n, 1e-300)[:, None]
    return (second - n[:, None, None] * m[:, :, None] * m[:, None, :] + ridge * np.eye(x.shape[1])) / np.maximum(n, 1e-300)[:, None, None]


def parameters(rows: DataFrame, ridge: float = 1e-3) -> DataFrame:
    """``cluster, n, mean, covariance``: means and maximum-likelihood covariances of labelled rows (``features, cluster``), a row a cluster."""
    names = sorted(r["cluster"] for r in rows.select("cluster").distinct().collect())  # a row a cluster

    def values(batch: pa.RecordBatch) -> np.ndarray:
        x = _stack(batch)
        z = np.eye(len(names))[np.searchsorted(names, batch.column(batch.schema.get_field_index("cluster")).to_numpy())]
        return np.concatenate([m.ravel() for m in moments(x, z)])

    flat = array_sum(rows.select("features", "cluster"), values)
    if flat is None:
        return rows.sparkSession.createDataFrame([], "cluster int, n long, mean array<double>, covariance array<array<double>>")
    k = len(names)
    d = int((np.sqrt(4 * (len(flat) // k) - 3) - 1) / 2)
    n, first, second = flat[:k], flat[k : k + k * d].reshape(k, d), flat[k + k * d :].reshape(k, d, d)
    m = first / n[:, None]
    cov = (second - n[:, None, None] * m[:, :, None] * m[:, None, :] + ridge * np.eye(d)) / n[:, None, None]
    out = [(int(names[j]), int(n[j]), m[j].tolist(), cov[j].tolist()) for j in range(k)]
    return rows.sparkSession.createDataFrame(out, "cluster int, n long, mean array<double>, covariance array<array<double>>")


INITS = ("kmeans", "mustlink", "random", "given")


def _started(rows: DataFrame, k: int, seed: int, restarts: int, init: str, groups: DataFrame | None) -> DataFrame:
    """``chunk_id, features, ids, start``: a hash of the id, and a label for each restart."""
    if init not in INITS:
        raise ValueError(f"init has to be one of {', '.join(INITS)}")
    key = F.col("chunk_id")
    if init == "given":
        start = F.array_repeat(F.col("start").cast("int"), restarts)
    else:
        if init == "mustlink":
            if groups is None:
                raise ValueError("must-link initialisation takes the rows' groups")
            rows, key = rows.join(groups.select("chunk_id", "contig_id"), "chunk_id", "left"), F.coalesce("contig_id", "chunk_id")
        start = F.array(*(F.pmod(F.xxhash64(key, F.lit(seed + SEED_STEP * r)), F.lit(k)).cast("int") for r in range(restarts)))
    return cut(rows.select("chunk_id", "features", F.xxhash64("chunk_id").alias("ids"), start.alias("start")))


def fit(rows: DataFrame, max_cluster: int, seed: int = 666, restarts: int = DEFAULT_RESTARTS, init: str = "kmeans", groups: DataFrame | None = None, max_iter: int = 600, epsilon: float = 1e-4, bound: str = "compat") -> tuple[DataFrame, DataFrame]:
    """(``chunk_id, cluster``; ``restart, seed, bound, n_clusters``) of the restart with the best bound, ties to the first.

    ``rows``: ``chunk_id, features``, and with ``init='given'`` the labels to ``start`` from, below ``max_cluster``. ``groups``: ``chunk_id, contig_id``.
    """
    spark = rows.sparkSession
    ship(spark)
    started = _started(rows, max_cluster, seed, restarts, init, groups)
    n = started.count()
    if n < 2:
        raise ValueError("too few rows to cluster")
    width = len(started.select("features").first()["features"])
    run = _fit_in_tasks if n * width * 8 <= TASK_BYTES else _fit_in_cluster
    labels, runs = run(started, max_cluster, seed, restarts, init, max_iter, epsilon, bound)
    good = [r for r in runs if math.isfinite(r[2])]
    if not good:
        raise ValueError("no restart reached a finite bound")
    best = max(good, key=lambda r: (r[2], -r[0]))
    return labels(best[0]), spark.createDataFrame(runs, "restart int, seed long, bound double, n_clusters int")


def _fit_in_tasks(rows: DataFrame, k: int, seed: int, restarts: int, init: str, max_iter: int, epsilon: float, bound: str):
    """A task for each restart, which gets all rows; labels are rows of a table."""

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk_id").combine_chunks()
        r = group.column("restart")[0].as_py()
        x = group.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
        labels, state = fit_one(x, k, group.column("own").to_numpy(), group.column("ids").to_numpy(), seed + SEED_STEP * r, init, max_iter, epsilon, bound)
        same = lambda v, kind: pa.array(np.full(len(x), v), kind)
        return pa.table({"chunk_id": group.column("chunk_id"), "cluster": pa.array(labels, pa.int32()), "restart": same(r, pa.int32()), "bound": same(state.bounds[-1], pa.float64()), "n_clusters": same(len(state.alive()), pa.int32())})

    # Dealt by range, so that no two restarts meet in a task.
    each = rows.select("chunk_id", "features", "ids", F.posexplode("start").alias("restart", "own")).repartitionByRange(restarts, "restart")
    done = cut(each.groupBy("restart").applyInArrow(work, "chunk_id string, cluster int, restart int, bound double, n_clusters int"))
    runs = done.groupBy("restart").agg(F.first("bound").alias("bound"), F.first("n_clusters").alias("n")).collect()  # a row a restart
    return (lambda best: done.where(F.col("restart") == best).select("chunk_id", "cluster")), [(r["restart"], seed + SEED_STEP * r["restart"], r["bound"], r["n"]) for r in sorted(runs)]


#: Bytes of a block at which it is closed with fewer rows.
BLOCK_BYTES = 8 << 20


def packed(rows: DataFrame) -> DataFrame:
    """``x, ids, start``: rows of ``features, ids, start`` in blocks, each column as one binary, so that a pass only copies bytes."""

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        column = lambda name, kind: np.concatenate([b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False) for b in held]).astype(kind)
        start = np.concatenate([b.column(b.schema.get_field_index("start")).flatten().to_numpy() for b in held]).astype(np.int32)
        values = [np.concatenate([_stack(b) for b in held]), column("ids", np.int64), start]
        return pa.record_batch([pa.array([v.tobytes()], pa.binary()) for v in values], names=["x", "ids", "start"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK_ROWS or sum(b.nbytes for b in held) >= BLOCK_BYTES:
                yield whole(held)
                held = []
        if held:
            yield whole(held)

    each = 2 * rows.sparkSession.sparkContext.defaultParallelism  # files of a size, so that tasks are
    return cut(rows.select("features", F.col("ids").cast("long").alias("ids"), "start").mapInArrow(work, "x binary, ids binary, start binary").repartition(each))


def _unpacked(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, hashes of their ids, their starts) of each block."""
    for batch in batches:
        for x, ids, start in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("x", "ids", "start"))):
            rows = np.frombuffer(x.as_buffer()).reshape(-1, d)
            yield rows, np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(start.as_buffer(), np.int32).reshape(len(rows), -1)


def _direct(numbers: int) -> int:
    """How many arrays of a key may reach the driver, for tasks that give so many numbers each."""
    return max(AT_DRIVER, WIDE_BYTES // (8 * numbers))


def _mark(ids: np.ndarray, label: np.ndarray, k: int) -> tuple[float, float]:
    """The two halves of a sum that tells labellings apart, whatever the order of rows: id hashes times a number of the label."""
    times = _lot(np.arange(k, dtype=np.int64), 0, 0).view(np.uint64) | np.uint64(1)
    total = int((ids.view(np.uint64) * times[label]).sum())
    return float(total & 0xFFFFFFFF), float(total >> 32)


def kmeans_in_cluster(rows: DataFrame, k: int, d: int, seeds: dict[int, int], steps: int = KMEANS_STEPS) -> dict[int, np.ndarray]:
    """The centres whose nearest rows are ``init_kmeans``' labels, for each restart of ``seeds``; one pass a step serves all of them."""
    rows = rows if "x" in rows.columns else packed(rows)
    centre: dict[int, np.ndarray | None] = dict.fromkeys(seeds)
    done: dict[int, np.ndarray] = {}

    def sums(live: list[int]) -> dict[int, np.ndarray]:
        """Sizes and sums of each restart's clusters, and the mark of its labels."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
            held = {r: np.zeros(k + k * d + 2) for r in live}
            for x, ids, start in _unpacked(batches, d):
                for r in live:
                    label = start[:, r] if centre[r] is None else _nearest(x, centre[r])
                    held[r] += np.concatenate([np.bincount(label, minlength=k), _totals(x, label, k).ravel(), _mark(ids, label, k)])
            yield from held.items()

        return keyed_sum(rows, work, _direct(len(live) * (k + k * d + 2)))

    def drawn(lots: list[tuple[int, int, int]]) -> dict[tuple[int, int], list[float]]:
        """The rows that (restart, cluster, draw) get by lot."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, ids, _ in _unpacked(batches, d):
                for r, j, draw in lots:
                    lot = _lot(ids, seeds[r], draw)
                    at = int(lot.argmin())
                    yield pa.record_batch([pa.array([r]), pa.array([j]), pa.array([int(lot[at])]), pa.array([x[at].tolist()], pa.list_(pa.float64()))], names=["r", "j", "lot", "x"])

        least = rows.mapInArrow(work, "r long, j long, lot long, x array<double>").groupBy("r", "j").agg(F.min_by("x", "lot").alias("x"))
        return {(r["r"], r["j"]): r["x"] for r in least.collect()}  # a row a lot

    def mark(r: int) -> int:
        return (int(found[r][-2]) + (int(found[r][-1]) << 32)) % (1 << 64)

    found = sums(list(seeds))
    for step in range(steps):
        live = [r for r in seeds if r not in done]
        lots = []
        for r in live:
            n, total = found[r][:k], found[r][k:-2].reshape(k, d)
            centre[r] = total / np.maximum(n, 1)[:, None]
            lots += [(r, j, step * k + j) for j in np.flatnonzero(n == 0).tolist()]
        for (r, j), x in (drawn(lots) if lots else {}).items():
            centre[r][j] = x
        before = {r: mark(r) for r in live}
        found = sums(live)
        done |= {r: centre[r] for r in live if mark(r) == before[r] or step == steps - 1}
        if len(done) == len(seeds):
            break
    return done


class Group:
    """Restarts that go through the same passes over the rows (``features, ids, start``), or over their ``blocks``."""

    def __init__(self, rows: DataFrame, k: int, d: int, seeds: dict[int, int], init: str, blocks: DataFrame | None = None) -> None:
        self.rows, self.k, self.d = packed(rows) if blocks is None else blocks, k, d
        self.prior = Prior.of(_variances(rows, d))
        self.centres = kmeans_in_cluster(self.rows, k, d, seeds) if init == "kmeans" else {}
        self.states: dict[int, Mixture] = {}
        held = self.sums(list(seeds), True)
        self.states = {r: Mixture.from_moments(self.prior, *held[r][0]) for r in seeds}

    def sums(self, live: list[int], start: bool = False) -> dict[int, tuple[tuple[np.ndarray, np.ndarray, np.ndarray], float]]:
        """Moments and entropies of the given restarts' responsibilities, or of their start; a pass for each slice of components."""
        k, d, cell = self.k, self.d, self.d * (self.d + 3) // 2 + 1
        cells = [(r, j) for r in live for j in range(k)]
        per = max(1, SLICE_BYTES // (8 * self.d * self.d))
        found: dict[int, np.ndarray] = {}
        for at in range(0, len(cells), per):
            own = cells[at : at + per]
            found |= self._pass(own, start, 1 if per * cell * 8 > WIDE_BYTES and len(cells) * cell * 8 > WIDE_BYTES else _direct(len(own) * cell))
        out = {}
        for r in live:
            flat = np.array([found[r * (k + 1) + j] for j in range(k)])
            second = np.zeros((k, d, d))
            upper = np.triu_indices(d)
            second[:, upper[0], upper[1]] = second[:, upper[1], upper[0]] = flat[:, 1 + d :]
            out[r] = (flat[:, 0], flat[:, 1 : 1 + d], second), float(found[r * (k + 1) + k][0])
        return out

    def _pass(self, cells: list[tuple[int, int]], start: bool, at_driver: int) -> dict[int, np.ndarray]:
        k, d, own = self.k, self.d, {}
        for r, j in cells:
            own.setdefault(r, []).append(j)
        centres = self.centres if start else {}
        shared = self.rows.sparkSession.sparkContext.broadcast({} if start else {r: self.states[r] for r in own})

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
            held = {r: [np.zeros(len(js)), np.zeros((len(js), d)), np.zeros((len(js), d, d)), 0.0] for r, js in own.items()}
            for x, _, starts in _unpacked(batches, d):
                for r, js in own.items():
                    for at in range(0, len(x), BLOCK_ROWS):
                        part = x[at : at + BLOCK_ROWS]
                        if start:
                            z = np.eye(k)[_nearest(part, centres[r]) if r in centres else starts[at : at + BLOCK_ROWS, r]]
                        else:
                            z = shared.value[r].responsibilities(part)
                        for total, more in zip(held[r], moments(part, z if len(js) == k else z[:, js])):
                            total += more
                        held[r][3] += entropy(z)
            upper = np.triu_indices(d)
            for r, js in own.items():
                n, first, second, e = held[r]
                for i, j in enumerate(js):
                    yield r * (k + 1) + j, np.concatenate([[n[i]], first[i], second[i][upper]])
                if js[0] == 0:  # the restart's entropy, once
                    yield r * (k + 1) + k, np.array([e])

        found = keyed_sum(self.rows, work, at_driver)
        shared.unpersist()
        return found


def _variances(rows: DataFrame, d: int) -> np.ndarray:
    """Sample variances of the columns, about a first row."""
    base = np.array(rows.select("features").first()["features"])
    flat = array_sum(rows.select("features"), lambda batch: np.concatenate([[batch.num_rows], (x := _stack(batch) - base).sum(0), (x * x).sum(0)]))
    return np.maximum((flat[1 + d :] - flat[1 : d + 1] ** 2 / flat[0]) / (flat[0] - 1), 1e-12)


def _fit_in_cluster(rows: DataFrame, k: int, seed: int, restarts: int, init: str, max_iter: int, epsilon: float, bound: str):
    """Rows stay where they are; restarts go through the passes in groups whose moments take ``GROUP_BYTES`` or less, or singly."""
    d = len(rows.select("features").first()["features"])
    together = max(1, GROUP_BYTES // (8 * k * d * d))
    best: Mixture | None = None
    number, runs, blocks = -1, [], packed(rows)
    for at in range(0, restarts, together):
        seeds = {r: seed + SEED_STEP * r for r in range(at, min(at + together, restarts))}
        group = Group(rows, k, d, seeds, init, blocks)
        bounds: dict[int, list[float]] = {r: [] for r in seeds}
        live = list(seeds)
        for i in range(max_iter + 1):
            held = group.sums(live)
            for r in live:
                bounds[r].append(group.states[r].bound(*held[r], bound))
            live = [r for r in live if not _ended(bounds[r], i, max_iter, epsilon)]
            if not live:
                break
            group.states |= {r: Mixture.from_moments(group.prior, *held[r][0]) for r in live}
        for r, state in group.states.items():
            state.bounds = bounds[r]
            runs.append((r, seeds[r], bounds[r][-1], len(state.alive())))
            if math.isfinite(bounds[r][-1]) and (best is None or bounds[r][-1] > best.bounds[-1]):
                best, number = state, r  # one winner is kept, whatever the number of restarts

    def labels(r: int) -> DataFrame:
        assert r == number
        return rows.select("chunk_id", "features").mapInArrow(best.labelled, "chunk_id string, cluster int")

    return labels, runs


def trace(rows: DataFrame, k: int, steps: int, in_cluster: bool, bound: str = "compat") -> list[tuple[Mixture, float]]:
    """The states before each of the first ``steps`` E steps from the rows' labels ``start``, and the bound each reaches."""
    started = _started(rows, k, 0, 1, "given", None)
    d = len(started.select("features").first()["features"])
    if in_cluster:
        group, out = Group(started, k, d, {0: 0}, "given"), []
        for _ in range(steps):
            state, (held, e) = group.states[0], group.sums([0])[0]
            out.append((state, state.bound(held, e, bound)))
            group.states[0] = Mixture.from_moments(group.prior, *held)
        return out

    def work(table: pa.Table) -> pa.Table:
        x = table.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        kept, start = [], table.column("own").to_numpy()
        for i in range(steps):
            state = fit_one(x, k, start, max_iter=i, epsilon=-1.0, bound=bound)[1]
            kept.append(pickle.dumps((state, state.bounds[-1])))
        return pa.table({"state": pa.array(kept, pa.binary())})

    one = started.select("features", F.get("start", F.lit(0)).alias("own"), F.lit(0).alias("g"))
    return [pickle.loads(r["state"]) for r in one.groupBy("g").applyInArrow(work, "state binary").collect()]  # a row a step


def responsibilities(rows: DataFrame, state: Mixture) -> DataFrame:
    """``chunk_id, z``: the rows' shares in the components of ``state``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _stack(batch)
            if len(x):
                yield pa.record_batch([batch.column(0), vector_array(state.responsibilities(x))], names=["chunk_id", "z"])

    return rows.select("chunk_id", "features").mapInArrow(work, "chunk_id string, z array<double>")
