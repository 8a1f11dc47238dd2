"""What several operators of this subpackage share: tables, shared scratch space, connected components."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import folder as scratch
from ..scratch import remove
from ..session import ship

#: Rows of an Arrow batch handed to Python; texts may be long, so batches stay short.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds what a Python worker holds at once, and sees to it that workers find this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class Written:
    """A table written to the shared scratch space, which cuts its lineage."""

    def __init__(self, df: DataFrame, codec: str = "zstd") -> None:
        self.spark = df.sparkSession
        self.path = f"{scratch(self.spark)}/helixbin-{uuid.uuid4().hex}"
        df.write.option("compression", codec).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        atexit.register(self.drop)

    def drop(self) -> None:
        remove(self.spark, self.path)
        atexit.unregister(self.drop)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: A graph of at most so many links is finished by one task (16 MB).
FEW_LINKS = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (x, smallest) that span the same components as the pairs (a, b)."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        # The roots of both ends take the smaller label, then paths are halved until they are flat.
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = np.minimum(new, new[new])
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _finished(links: DataFrame) -> DataFrame:
    """The components of a bounded number of links (``u, v``), in one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if parts:
            x, low = forest(*(np.concatenate(p) for p in zip(*parts)))
            roots = np.unique(low)
            yield pa.record_batch([pa.array(np.concatenate([x, roots])), pa.array(np.concatenate([low, roots]))], names=["node", "component"])

    return links.select("u", "v").coalesce(1).mapInArrow(work, "node long, component long")


def components(edges: DataFrame, left: str, right: str, rounds: int = 60, few: int = FEW_LINKS) -> DataFrame:
    """Connected components of an undirected graph over long ids: ``node``, ``component`` (the smallest node reachable).

    Alternates large-star and small-star steps until the edges stand still, which takes a number of
    rounds logarithmic in the graph's size, or until ``few`` are left, which one task finishes. Each round is written to the
    shared scratch space. Hub nodes never gather their neighbours in one task: a partial minimum is joined back, and
    adaptive execution splits a skewed join. Nodes without an edge don't appear.
    """
    pairs = (
        edges.select(F.col(left).alias("u"), F.col(right).alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    now, before = Written(pairs), None
    for _ in range(rounds):
        state = now.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] <= few:
            if before is not None:
                before[1].drop()
            done = Written(_finished(now.df))
            now.drop()
            return done.df
        if before is not None and state == before[0]:
            break
        e = now.df
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        if before is not None:
            before[1].drop()
        before, now = (state, now), Written(small)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if before is not None:
        before[1].drop()
    e = now.df
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
