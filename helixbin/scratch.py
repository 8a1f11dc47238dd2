"""Tables in the shared scratch space, and sums of arrays that never pass through one task."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN_IN = 32
AT_DRIVER = 8
SLICE = 1 << 20  # numbers of an array that travel together


def folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return str(named)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get())
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="helixbin-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders through Hadoop's file system; one that isn't there is no error."""
    for path in paths:
        with contextlib.suppress(Exception):
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_scopes: list[list[str]] = []


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``cut`` writes within are removed at its end, but for those handed to the function it gives."""
    made: list[str] = []
    _scopes.append(made)

    def keep(df: DataFrame) -> DataFrame:
        path = getattr(df, "_cut_path", None)
        if path in made:
            made.remove(path)
            if len(_scopes) > 1:
                _scopes[-2].append(path)
        return df

    try:
        yield keep
    finally:
        _scopes.remove(made)
        for path in made:
            remove(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared scratch space and read again, which cuts the lineage; removed when its scope or the process ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/helixbin-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def numbered(rows: DataFrame, *order: str, name: str) -> DataFrame:
    """Rows with their places from 0 in a distributed sort. The places are taken in the run that writes the rows, since another
    run may draw other ranges and a read returns files in any order."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    written = cut(rows.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), inside.alias("_in")))
    sizes = {r["_part"]: r["count"] for r in written.groupBy("_part").count().collect()}  # a row a partition
    first = np.cumsum([0, *(sizes.get(p, 0) for p in range(max(sizes, default=0)))]).tolist()
    return written.withColumn(name, F.get(F.array(*map(F.lit, first)), F.col("_part")).cast("long") + F.col("_in")).drop("_part", "_in")


def keyed_sum(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]], at_driver: int = AT_DRIVER) -> dict[int, np.ndarray]:
    """Sums of arrays by key: ``work`` gives a task's (key, array), each key once.

    Tasks' arrays are added up as binaries in a tree: a task of the tree adds ``FAN_IN`` arrays of one key, in the order of the
    partitions they come from, and at most ``at_driver`` arrays of a key reach the driver.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, x in work(batches):
            yield pa.record_batch([pa.array([key]), pa.array([np.asarray(x, float).tobytes()], pa.binary())], names=["key", "x"])

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("p")
        total = None
        for x in group.column("x"):
            part = np.frombuffer(x.as_py(), float)
            total = part.copy() if total is None else np.add(total, part, out=total)
        return pa.table({"key": group.column("key").slice(0, 1), "p": pa.array([group.column("g")[0].as_py()], pa.int32()), "x": pa.array([total.tobytes()], pa.binary())})

    parts = rows.rdd.getNumPartitions()
    sums = rows.mapInArrow(first, "key long, x binary").select("key", F.spark_partition_id().alias("p"), "x")
    while parts > at_driver:
        parts = -(-parts // FAN_IN)
        sums = sums.withColumn("g", F.pmod(F.col("p"), F.lit(parts))).groupBy("key", "g").applyInArrow(add, "key long, p int, x binary")
    out: dict[int, np.ndarray] = {}
    for r in sorted(sums.collect(), key=lambda r: (r["key"], r["p"])):  # a few arrays of each key
        part = np.frombuffer(r["x"], float)
        out[r["key"]] = out[r["key"]] + part if r["key"] in out else part
    return out


def array_sum(rows: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum over all batches of what ``values`` gives for each; None without rows. Long arrays are added up slice by slice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        held = None
        for batch in batches:
            if batch.num_rows:
                part = np.asarray(values(batch), float)
                held = part if held is None else held + part
        if held is not None:
            for k in range(0, len(held), SLICE):
                yield k, held[k : k + SLICE]

    found = keyed_sum(rows, work)
    return np.concatenate([found[k] for k in sorted(found)]) if found else None


def vector_array(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x, dtype=float).ravel()))
