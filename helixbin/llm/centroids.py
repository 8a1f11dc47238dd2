"""Centroid clustering of integer vectors: exact Lloyd rounds, screened by the norms of segments.

1. Vectors with exactly ``dim`` components, none null or non-finite, are kept; a component x becomes floor(scale * x). Their segments'
   norms are computed once and stored beside them: they are the compressed vectors.
2. By Cauchy-Schwarz a distance is at least |x|^2 + |c|^2 - 2 * sum over segments of |x_s| |c_s|. The centroid of the lowest bound gets
   an exact integer distance, then each centroid whose bound, less a margin for rounding, doesn't lie above the best so far.
3. A round adds up counts and component sums in the tasks; a row for each cluster and component reaches the driver. Vectors never move.

Centroids start as the kept vectors with the smallest sha256 of ``seed:id``, ties by the vector; a row without an id starts none, but
is assigned and counted. Fewer kept vectors give fewer centroids. Distance ties go to the smaller number; a cluster without vectors
keeps its centroid. Repeated rows and rows of equal id count each for itself. Extra columns are ignored, whatever their names. An empty
table, or one without kept vectors that have an id, gives no rows. A component of more than ``LIMIT`` after scaling is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, short_batches

SEGMENT = 4  # components
LIMIT = 1 << 27  # squared distances of a thousand components fit 64 bits
BATCH = 4096
MARGIN = 1e-12


def segment_norms(q: np.ndarray) -> np.ndarray:
    """The norms of the segments of each row; the last one may be shorter."""
    x = np.zeros((len(q), -(-q.shape[1] // SEGMENT) * SEGMENT))
    x[:, : q.shape[1]] = q
    x = x.reshape(len(q), -1, SEGMENT)
    return np.sqrt(np.einsum("nsi,nsi->ns", x, x))


def nearest(q: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of int64 ``q``: the nearest centroid, its squared distance, and how many exact distances that took."""
    own = segment_norms(centroids)
    whole = (norms * norms).sum(1)[:, None] + (own * own).sum(1)
    low = whole - 2 * norms @ own.T - (MARGIN * whole + 0.5)
    label = low.argmin(1)
    first = label.copy()
    best = np.square(q - centroids[label]).sum(1)
    asked = np.ones(len(q), np.int32)
    for j in range(len(centroids)):
        at = np.flatnonzero((low[:, j] <= best) & (first != j))
        if len(at):
            d = np.square(q[at] - centroids[j]).sum(1)
            asked[at] += 1
            closer = (d < best[at]) | ((d == best[at]) & (j < label[at]))
            best[at[closer]], label[at[closer]] = d[closer], j
    return label, best, asked


def _prepared(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """``id, q, norms``: scaled components as 32-bit integers and segment norms, both as bytes."""
    v = F.col("v")
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = kept.where((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(scale * batch.column(1).flatten().to_numpy().reshape(-1, dim))
            if np.abs(x).max(initial=0) > LIMIT:
                raise ValueError(f"a component is beyond {LIMIT} after scaling")
            q = x.astype("<i4")
            yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in q], pa.binary()), pa.array([r.tobytes() for r in segment_norms(q)], pa.binary())], names=["id", "q", "norms"])

    return kept.mapInArrow(work, "id long, q binary, norms binary")


def _arrays(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    q = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("q")).to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)
    norms = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("norms")).to_pylist()), float).reshape(len(q), -1)
    return q, norms


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of each component over a cluster's vectors."""
    k, dim = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            q, norms = _arrays(batch, dim)
            label = nearest(q, norms, centroids)[0]
            np.add.at(total, label, q)
            count += np.bincount(label, minlength=k)
        live = np.flatnonzero(count)
        yield pa.record_batch([pa.array(np.repeat(live, dim).astype(np.int32)), pa.array(np.tile(np.arange(dim, dtype=np.int32), len(live))), pa.array(np.repeat(count[live], dim)), pa.array(total[live].ravel())], names=["cluster", "place", "n", "total"])

    sums = rows.mapInArrow(work, "cluster int, place int, n long, total long").groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = centroids.copy()
    for r in sums.collect():  # a row for each cluster and component
        out[r["cluster"], r["place"]] = r["total"] // r["n"]
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(``id_col, cluster, distance, n_exact``; the final centroids, a row each). ``n_exact`` counts the last assignment's exact distances."""
    spark = vectors.sparkSession
    short_batches(spark, BATCH)
    rows = Written(_prepared(vectors, id_col, vector_col, dim, scale)).df
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.where("id IS NOT NULL").orderBy(order, "q").select("q").limit(k).collect()
    centroids = np.array([np.frombuffer(r["q"], "<i4") for r in first], np.int64).reshape(-1, dim)
    if not len(centroids):
        return spark.createDataFrame([], f"`{id_col}` long, cluster int, distance long, n_exact int"), centroids
    for _ in range(rounds):
        centroids = _moved(rows, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, distance, asked = nearest(*_arrays(batch, dim), centroids)
            yield pa.record_batch([batch.column(0), pa.array(label.astype(np.int32)), pa.array(distance), pa.array(asked)], names=["id", "cluster", "distance", "n_exact"])

    done = Written(rows.mapInArrow(assign, "id long, cluster int, distance long, n_exact int")).df
    return done.withColumnRenamed("id", id_col), centroids


def report(embeddings: DataFrame) -> DataFrame:
    """The contract's columns for every kept vector of ``embeddings``."""
    rows, centroids = cluster(embeddings.select("vec_id", "embedding"))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row a cluster
    of = lambda values, kind: F.get(F.array(*map(F.lit, values or [None])).cast(f"array<{kind}>"), F.col("cluster"))
    return rows.select(
        "vec_id",
        "cluster",
        "distance",
        of([inertia.get(j, 0) for j in range(len(names))], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        of(names, "string").alias("centroid_sha256"),
    )


def oracle() -> str:
    """The contract's columns in DuckDB's SQL."""
    steps = []
    for i in range(4):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT vec_id, cl, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cl) AS r FROM
  (SELECT q.vec_id, c.cl, CAST(sum((q.x - c.x) * (q.x - c.x)) AS BIGINT) AS d FROM q JOIN c{i} c ON q.place = c.place GROUP BY 1, 2)) WHERE r = 1)""")
        if i < 3:
            steps.append(f"""
s{i} AS (SELECT a.cl, q.place, CAST(sum(q.x) AS BIGINT) AS s, count(*) AS n FROM q JOIN a{i} a ON q.vec_id = a.vec_id GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT c.cl, c.place, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{i} c LEFT JOIN s{i} s ON s.cl = c.cl AND s.place = c.place)""")
    return f"""
WITH k AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
q AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS place, CAST(floor(64 * unnest(v)) AS BIGINT) AS x FROM k),
f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cl FROM k ORDER BY cl LIMIT 16),
c0 AS MATERIALIZED (SELECT f.cl, q.place, q.x FROM f JOIN q ON q.vec_id = f.vec_id),{",".join(steps)},
h AS (SELECT cl, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY place)) AS h FROM c3 GROUP BY 1)
SELECT vec_id, CAST(a3.cl AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a3.cl) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a3 JOIN h ON h.cl = a3.cl"""
