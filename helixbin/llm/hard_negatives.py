"""Hard negatives by k-means inverted lists, exact.

1. Components become floor(scale * x); a score is an integer inner product, higher first, ties by smaller id. Centroids come from a sample
   of bounded size; every row goes to the list of its nearest centroid.
2. Lists are stored as segments of at most ``SEGMENT`` rows, each with the greatest distance from the centroid; the largest of a list is
   its radius. Rows are dealt by range of (list, hash of id), so a list of any size spreads over many tasks.
3. By Cauchy-Schwarz a list's scores for an anchor a lie within a.c +- |a| * radius. Anchors visit lists by that upper bound in waves:
   the ``FIRST`` best lists, then every other list whose bound isn't strictly below the kth score found. Within a wave the same bounds, by
   segment and with the task's own kth scores, skip rows of a pair of segment and chunk of anchors.
4. Positives are found first: the best rows of the anchor's label. Each gives a window of scores; lists that lie outside all windows of an
   anchor are skipped, the others are visited as above for the best rows of other labels inside each window.

Segments and chunks of anchors meet by a join on the list. Rows with a null id, a null label, a null vector, or any null or
non-finite component take no part. Vectors are compared with vectors of their own length; empty vectors score 0 with each other.
Equal rows (id, label and vector) count once; rows that share an id but differ are rows of their own, and never each other's
positives. Extra columns are ignored, whatever their names; an empty table gives no rows. A vector whose largest component
after scaling, times the root of its length, is above ``LIMIT`` is an error: scores stay exact in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, short_batches

MAX_LISTS = 1024
SAMPLE = 64  # rows a list that centroids are fitted on
FIT_STEPS = 8
SEGMENT = 2048
CHUNK = 256
FIRST = 8
HELD = 512  # chunks of anchors whose best a task keeps before it hands them on
LIMIT = 1 << 26
SLACK = 1e-9


def _fit(x: np.ndarray, k: int) -> np.ndarray:
    """k-means on the sample; an empty cluster keeps its centroid."""
    c = x[:k].copy()
    for _ in range(FIT_STEPS):
        label = _closest(x, c)
        n = np.bincount(label, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, label, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


class Lists:
    """Centroids of each length of vector; a list's number is a place in all of them. Lengths unseen in the sample have one list each."""

    def __init__(self, sample: list[np.ndarray], lists: int) -> None:
        self.of: dict[int, tuple[int, np.ndarray]] = {}
        at = 0
        for d in sorted({len(x) for x in sample}):
            own = [v for v in sample if len(v) == d]
            x = np.array(own, float).reshape(len(own), d)
            c = _fit(x, max(1, min(len(x), lists * len(x) // len(sample))))
            self.of[d] = (at, c)
            at += len(c)

    def __getitem__(self, d: int) -> tuple[int, np.ndarray]:
        return self.of.get(d, (-1 - d, np.zeros((1, d))))


def _matrix(parts: list[bytes], d: int) -> np.ndarray:
    return np.frombuffer(b"".join(parts), "<i4").reshape(len(parts), d).astype(float)


def _by_length(q: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) for each length in a batch."""
    size = np.fromiter(map(len, q), np.int64, len(q)) // 4
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        yield d, rows, _matrix([q[i] for i in rows], d)


def _sound(df: DataFrame) -> DataFrame:
    v = F.col("v")
    return df.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _scaled(values: pa.Array, scale: int) -> list[np.ndarray]:
    lists = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(float))
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    out = np.split(flat, ends[:-1]) if len(ends) else []
    if any(np.abs(x).max(initial=0) * np.sqrt(len(x)) > LIMIT for x in out):
        raise ValueError(f"a vector is beyond {LIMIT} after scaling")
    return out


def _assigned(rows: DataFrame, lists: Lists, scale: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = [x.astype("<i4").tobytes() for x in _scaled(batch.column(2), scale)]
            place, away = np.zeros(len(q), np.int32), np.zeros(len(q))
            for d, own, x in _by_length(q):
                at, c = lists[d]
                near = _closest(x, c)
                place[own], away[own] = at + near, np.sqrt(np.square(x - c[near]).sum(1))
            yield pa.record_batch([pa.array(place), batch.column(0), batch.column(1), pa.array(q, pa.binary()), pa.array(away)], names=["list", "id", "label", "q", "away"])

    return rows.mapInArrow(work, "list int, id long, label long, q binary, away double")


def _segments(rows: DataFrame) -> DataFrame:
    """``list, segment, radius, ids, labels, q``: a list's rows in segments, equal rows once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, made = [], None, 0

        def packed():
            ids, labels, q, away = zip(*(r[1:] for r in held))
            return pa.record_batch([pa.array([held[0][0]], pa.int32()), pa.array([made]), pa.array([len(q[0]) // 4], pa.int32()), pa.array([max(away)]), pa.array([np.array(ids).tobytes()]), pa.array([np.array(labels).tobytes()]), pa.array([b"".join(q)])], names=["list", "segment", "dim", "radius", "ids", "labels", "q"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (len(held) == SEGMENT or held[0][0] != r[0]):
                    yield packed()
                    held, made = [], made + 1
                if last != r[:4]:
                    held.append(r)
                last = r[:4]
        if held:
            yield packed()

    dealt = rows.withColumn("h", F.xxhash64("id")).repartitionByRange("list", "h").sortWithinPartitions("list", "h", "id", "label", "q").drop("h")
    part = F.spark_partition_id().cast("long") * (1 << 33)
    return dealt.mapInArrow(work, "list int, segment long, dim int, radius double, ids binary, labels binary, q binary").withColumn("segment", F.col("segment") + part)


def _needed(lists: Lists, radius: dict[int, float], d: int, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of the first list, upper bounds, whether a list's bounds meet a slot's window) of anchors ``x`` of length ``d``."""
    at, c = lists[d]
    r = np.array([radius.get(at + j, -1.0) for j in range(len(c))])
    middle, size = x @ c.T, np.sqrt((x * x).sum(1))[:, None]
    reach = size * r + SLACK * size * (r + np.sqrt((c * c).sum(1))) + 1
    most, least = middle + reach, middle - reach
    need = np.zeros(most.shape, bool)
    for j in range(low.shape[1]):
        need |= (most >= low[:, j, None]) & (least <= high[:, j, None])
    return at, most, need & (r >= 0)


def _slots(column: pa.Array, n: int, slots: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, slots)


def _first(anchors: DataFrame, lists: Lists, radius: dict[int, float], slots: int) -> DataFrame:
    """Adds ``first``: the numbers of the ``FIRST`` needed lists with the highest bounds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(3).to_pylist()
            low, high = (_slots(batch.column(k), len(q), slots) for k in (4, 5))
            first: list[list[int]] = [[]] * len(q)
            for d, own, x in _by_length(q):
                at, most, need = _needed(lists, radius, d, x, low[own], high[own])
                order = np.argsort(np.where(need, -most, np.inf), axis=1, kind="stable")[:, :FIRST]
                for i, row in enumerate(own.tolist()):
                    first[row] = [at + j for j in order[i].tolist() if need[i, j]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.list_(pa.int32()))], names=[*batch.schema.names, "first"])

    return anchors.select("key", "id", "label", "q", "low", "high").mapInArrow(work, "key long, id long, label long, q binary, low array<double>, high array<double>, first array<int>")


def _chunks(anchors: DataFrame, lists: Lists, radius: dict[int, float], slots: int, first: bool) -> DataFrame:
    """For each list that its anchors visit in this wave, chunks of them: ``list, keys, own_ids, own_labels, own_q, low, high``.

    ``anchors``: ``key, id, label, q, low, high, first``, where the slots' bounds are arrays: scores below ``low`` or above ``high`` don't matter.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, labels = (batch.column(k).to_numpy() for k in range(3))
            q, own_first = batch.column(3).to_pylist(), batch.column(6).to_pylist()
            low, high = (_slots(batch.column(k), len(q), slots) for k in (4, 5))
            for d, own, x in _by_length(q):
                at, most, need = _needed(lists, radius, d, x, low[own], high[own])
                visited = np.zeros(need.shape, bool)
                for i, row in enumerate(own.tolist()):
                    visited[i, [j - at for j in own_first[row]]] = True
                need = visited if first else need & ~visited
                for j in np.flatnonzero(need.any(0)).tolist():
                    some = own[need[:, j]]
                    for k in range(0, len(some), CHUNK):
                        s = some[k : k + CHUNK]
                        yield pa.record_batch([pa.array([at + j], pa.int32()), *(pa.array([a[s].tobytes()]) for a in (keys, ids, labels)), pa.array([b"".join(q[i] for i in s)]), *(pa.array([a[s].tobytes()]) for a in (low, high))], names=["list", "keys", "own_ids", "own_labels", "own_q", "low", "high"])

    return anchors.mapInArrow(work, "list int, keys binary, own_ids binary, own_labels binary, own_q binary, low binary, high binary")


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best finite scores of each row, ties by smaller id."""
    floor = np.full(len(score), -np.inf)
    many = np.flatnonzero((score > -np.inf).sum(1) > k)
    if len(many):
        floor[many] = np.partition(score[many], score.shape[1] - k, axis=1)[:, -k]
    r, c = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
    order = np.lexsort((ids[c], -score[r, c], r))
    r, c = r[order], c[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], c[keep]


class _Chunk:
    """The best that a task has found for a chunk of anchors: (anchor's place * slots + slot, score, id)."""

    def __init__(self, keys: bytes, slots: int, low: bytes) -> None:
        self.keys, self.slots = np.frombuffer(keys, np.int64), slots
        self.floor = np.frombuffer(low, float).reshape(-1, slots).copy()
        self.cell, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, cell: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> None:
        cell, score, ids = (np.concatenate(x) for x in ((self.cell, cell), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, cell))
        cell, score, ids = cell[order], score[order], ids[order]
        place = np.arange(len(cell)) - np.searchsorted(cell, cell)
        keep = place < k
        self.cell, self.score, self.id = cell[keep], score[keep], ids[keep]
        full = place == k - 1
        flat = self.floor.ravel()
        np.maximum.at(flat, cell[full], score[full])

    def rows(self) -> pa.RecordBatch:
        return pa.record_batch([pa.array(self.keys[self.cell // self.slots]), pa.array((self.cell % self.slots).astype(np.int32)), pa.array(self.score.astype(np.int64)), pa.array(self.id)], names=["key", "slot", "score", "found"])


def _found(segments: DataFrame, chunks: DataFrame, lists: Lists, slots: int, k: int, same: bool) -> DataFrame:
    """``key, slot, score, found``: the k best rows of the same or of other labels of each anchor and slot, by task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, _Chunk] = {}
        now, x, ids, labels = None, None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                if now != r["segment"]:
                    now, ids, labels = r["segment"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
                    x = np.frombuffer(r["q"], "<i4").reshape(len(ids), r["dim"]).astype(float)
                at, c = lists[r["dim"]]
                name = (r["list"], r["keys"][:8], len(r["keys"]))
                if name not in held and len(held) >= HELD:
                    yield from (h.rows() for h in held.values())
                    held = {}
                if name not in held:
                    held[name] = _Chunk(r["keys"], slots, r["low"])
                chunk = held[name]
                a = np.frombuffer(r["own_q"], "<i4").reshape(len(chunk.keys), r["dim"]).astype(float)
                centre, high = c[r["list"] - at], np.frombuffer(r["high"], float).reshape(-1, slots)
                size = np.sqrt((a * a).sum(1))
                reach = size * r["radius"] + SLACK * size * (r["radius"] + np.sqrt(centre @ centre)) + 1
                middle = a @ centre
                live = np.flatnonzero((((middle + reach)[:, None] >= chunk.floor) & ((middle - reach)[:, None] <= high)).any(1))
                if not len(live):
                    continue
                score = a[live] @ x.T
                own_id, own_label = np.frombuffer(r["own_ids"], np.int64)[live], np.frombuffer(r["own_labels"], np.int64)[live]
                fits = own_label[:, None] == labels
                fits = fits & (own_id[:, None] != ids) if same else ~fits
                for j in range(slots):
                    inside = np.where(fits & (score >= chunk.floor[live, j, None]) & (score <= high[live, j, None]), score, -np.inf)
                    row, col = best(inside, ids, k)
                    if len(row):
                        chunk.add(live[row] * slots + j, inside[row, col], ids[col], k)
        yield from (h.rows() for h in held.values())

    return segments.join(chunks, "list").mapInArrow(work, "key long, slot int, score long, found long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and slot: ``key, slot, rank, score, found``."""
    order = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "found")
    return found.select("key", "slot", "score", "found", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def _search(anchors: DataFrame, segments: DataFrame, lists: Lists, radius: dict[int, float], slots: int, k: int, same: bool) -> Written:
    """The k best of each anchor and slot over all lists, in two waves; ``anchors`` as ``_chunks`` takes them."""
    spark = anchors.sparkSession

    def wave(state: DataFrame, first: bool) -> DataFrame:
        short_batches(spark, 4096)
        chunks = Written(_chunks(state.select("key", "id", "label", "q", "low", "high", "first"), lists, radius, slots, first))
        short_batches(spark, 16)  # a row holds a segment
        found = Written(_ranked(_found(segments, chunks.df, lists, slots, k, same), k))
        chunks.drop()
        return found

    short_batches(spark, 4096)
    begun = Written(_first(anchors, lists, radius, slots))
    near = wave(begun.df, True)
    kth = near.df.where(F.col("rank") == k).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.col("score").cast("double")))).alias("kth"))
    # A score strictly below the kth can't come in any more.
    floor = F.transform("low", lambda x, j: F.greatest(x, F.coalesce(F.element_at("kth", j), F.lit(float("-inf")))))
    rest = wave(begun.df.join(kth, "key", "left").withColumn("low", floor), False)
    done = Written(_ranked(near.df.unionByName(rest.df), k))
    for x in (begun, near, rest):
        x.drop()
    short_batches(spark)
    return done


def _floor_percent(score: Column, percent: int) -> Column:
    whole = score * percent
    return F.call_function("div", whole - F.pmod(whole, F.lit(100)), F.lit(100))


def mine(vectors: DataFrame, id_col: str = "vec_id", label_col: str | Column = "label", vector_col: str = "embedding", every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, max_lists: int = MAX_LISTS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for anchors, the rows whose id is divisible by ``every``.

    A negative's score lies between ``low`` and ``high`` percent of the positive's.
    """
    spark = vectors.sparkSession
    short_batches(spark, 4096)
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    rows = _sound(vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v")))
    n = vectors.count()
    lists = max(1, min(max_lists, int(n**0.5 / 2)))
    wanted = SAMPLE * lists
    share = min(1 << 30, -(-(wanted << 30) // max(1, n)))
    drawn = rows.where(F.pmod(F.xxhash64("id", "label", "v"), F.lit(1 << 30)) < share).select("v").limit(2 * wanted).toArrow()
    index = Lists(_scaled(drawn.column("v"), scale) if len(drawn) else [], lists)
    dealt = Written(_assigned(rows, index, scale))
    segments = Written(_segments(dealt.df))
    radius = {r["list"]: r["r"] for r in segments.df.groupBy("list").agg(F.max("radius").alias("r")).collect()}  # a row a list

    own = dealt.df.where(F.col("id") % every == 0).select("id", "label", "q").distinct()
    anchors = Written(own.select(F.monotonically_increasing_id().alias("key"), "*"))
    any_score = [F.array(F.lit(float(x))).alias(c) for x, c in (("-inf", "low"), ("inf", "high"))]
    near = _search(anchors.df.select("*", *any_score), segments.df, index, radius, 1, positives, True)

    best_of = near.df.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "found"))).alias("p"))
    # Slots beyond an anchor's positives have an empty window.
    slot = lambda f, none: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda j: F.coalesce(f(F.get("p", j)["score"]).cast("double"), F.lit(none)))
    least, most = slot(lambda s: -_floor_percent(-s, low), float("inf")), slot(lambda s: _floor_percent(s, high), float("-inf"))
    windows = Written(anchors.df.join(best_of, "key").select("key", "id", "label", "q", least.alias("low"), most.alias("high")))
    far = _search(windows.df, segments.df, index, radius, positives, negatives, False)
    positive = near.df.select("key", (F.col("rank") - 1).alias("slot"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.df.join(positive, ["key", "slot"]).join(anchors.df.select("key", F.col("id").alias("anchor_id")), "key")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def report(embeddings: DataFrame) -> DataFrame:
    """The contract's columns for every anchor of ``embeddings``; labels of ids divisible by 7 move on first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings.select("vec_id", "label", "embedding"), label_col=moved)


def oracle() -> str:
    """The contract's columns in DuckDB's SQL, by brute force."""
    return """
WITH v AS MATERIALIZED (SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
  list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
a AS (SELECT *, row_number() OVER () AS k FROM v WHERE vec_id % 100 = 0),
s AS MATERIALIZED (SELECT a.k, a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, CAST(coalesce(list_dot_product(a.q, v.q), 0) AS BIGINT) AS score
  FROM a JOIN v ON len(a.q) = len(v.q) WHERE a.label <> v.label OR a.vec_id <> v.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS slot FROM s WHERE same QUALIFY slot <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.k, p.slot ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.k = p.k AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score QUALIFY rank <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n"""
