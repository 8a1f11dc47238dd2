"""Other files: GFF, coverage tables, the bank and model store, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bank import BankSpec
from ..scratch import cut

GFF = "seqid string, source string, type string, start int, end int, score string, strand string, phase string, attributes string"


def file_format(path: str) -> str:
    """A file's kind from its suffix, in capitals."""
    return path.rsplit(".", 1)[-1].upper() if "." in path else ""


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", comment="#", schema=GFF)
    return rows.where("start IS NOT NULL").withColumn("score", F.expr("try_cast(score AS double)"))


def coverage_csv(spark: SparkSession, path: str) -> DataFrame:
    """``row_ord, value``: a file without header and with one numeric column, in row order; of a folder, files in the order of their names.

    The scan deals parts of files to tasks in any order, so rows are numbered by file, part and place in the part; a part is a row at the driver.
    """
    rows = spark.read.csv(path)
    if len(rows.columns) != 1:
        raise ValueError(f"{path} has to have one column, it has {len(rows.columns)}")
    part = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    placed = cut(rows.select(*part, F.monotonically_increasing_id().alias("place"), F.col(rows.columns[0]).cast("double").alias("value")))
    parts = sorted(placed.groupBy("file", "start").agg(F.min("place").alias("first"), F.count("*").alias("n")).collect())
    ends = [0]
    for r in parts:
        ends.append(ends[-1] + r["n"])
    base = spark.createDataFrame([(r["file"], r["start"], at - r["first"]) for r, at in zip(parts, ends)], "file string, start long, base long")
    return placed.join(F.broadcast(base), ["file", "start"]).select((F.col("base") + F.col("place")).alias("row_ord"), "value")


def coverage_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``chunk_id, value``: a file with a header, ids first and one numeric column."""
    rows = spark.read.csv(path, sep="\t", header=True)
    if len(rows.columns) != 2:
        raise ValueError(f"{path} has to have an id and one value column")
    return rows.select(F.col(rows.columns[0]).alias("chunk_id"), F.col(rows.columns[1]).cast("double").alias("value"))


class Store:
    """A folder with the bank, its parameters and a partition for each raw model."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def save_bank(self, bank: DataFrame, spec: BankSpec) -> None:
        bank.write.mode("overwrite").parquet(f"{self.path}/bank")
        self.spark.createDataFrame([(json.dumps(spec.as_row()),)], "spec string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/spec")

    def bank(self) -> tuple[DataFrame, BankSpec]:
        raw = json.loads(self.spark.read.parquet(f"{self.path}/spec").first()["spec"])
        raw["overlap"] = raw["overlap"] if raw["overlap"] == "auto" else int(raw["overlap"])
        return self.spark.read.parquet(f"{self.path}/bank"), BankSpec(**raw)

    def save_model(self, name: str, features: DataFrame) -> None:
        """``chunk_id, features`` array<double>; replaces the model's partition only."""
        out = features.select("chunk_id", F.col("features").cast("array<double>").alias("features"))
        out.write.mode("overwrite").parquet(f"{self.path}/rawmodel/model={name}")

    def models(self) -> list[str]:
        """Names of the stored models."""
        try:
            names = self.spark.read.parquet(f"{self.path}/rawmodel").select("model").distinct().collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        return sorted(str(r["model"]) for r in names)

    def load_models(self, names: list[str]) -> dict[str, DataFrame]:
        """The named models; partitions of others aren't read. Models of different chunks are an error."""
        unknown = sorted(set(names) - set(self.models()))
        if unknown:
            raise KeyError(f"no such model: {', '.join(unknown)}")
        out = {n: self.spark.read.parquet(f"{self.path}/rawmodel/model={n}") for n in names}
        first = None
        for n, df in out.items():
            ids = df.agg(F.count("*"), F.sum(F.xxhash64("chunk_id").cast("decimal(38,0)"))).first()
            if first is not None and ids != first:
                raise ValueError(f"model {n} covers other chunks than {names[0]}")
            first = ids
        return out


def write_clustering(result: DataFrame, path: str) -> None:
    """``chunk_id, cluster`` as tab-separated text with the header ``#SEQID CLUSTER``."""
    result.select(F.col("chunk_id").alias("#SEQID"), F.col("cluster").cast("string").alias("CLUSTER")).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def read_clustering(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", "\t").csv(path).toDF("chunk_id", "cluster")


def reindexed(ids: DataFrame, clustering: DataFrame) -> DataFrame:
    """The clusters of ``ids`` (``chunk_id``), each once; null where the clustering has none."""
    return ids.select("chunk_id").join(clustering.select("chunk_id", "cluster"), "chunk_id", "left")


def count_sequences(genes: DataFrame) -> int:
    """How many sequences a gene table names."""
    return genes.agg(F.count_distinct("seqid")).first()[0]


def rewrite(store: Store, files: int = 1) -> None:
    """Writes each stored model again in fewer files; the new partition replaces the old one once it is complete."""
    for name in store.models():
        path = f"{store.path}/rawmodel/model={name}"
        df = store.spark.read.parquet(path)
        df.coalesce(files).write.mode("overwrite").parquet(f"{store.path}/_repack")
        store.spark.read.parquet(f"{store.path}/_repack").write.mode("overwrite").parquet(path)
    fs_path = store.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store.path}/_repack")
    fs_path.getFileSystem(store.spark.sparkContext._jsc.hadoopConfiguration()).delete(fs_path, True)
