"""Row-local operators over streams: new sequences are chunked and characterised as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import sanitize
from ..operators import kmer
from ..operators.bank import BankSpec, chunk

CONTIGS = "contig_id string, contig_ord long, seq string"


def read_contigs(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of contigs from Parquet files that land in a folder."""
    return spark.readStream.schema(CONTIGS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def chunk_stream(contigs: DataFrame, spec: BankSpec) -> DataFrame:
    """The bank's chunks of a stream; without a contig limit, which needs all rows."""
    if spec.max_contigs > 0:
        raise ValueError("a stream has no contig limit")
    return chunk(contigs.where(F.length("seq") >= spec.min_length).withColumn("seq", sanitize(F.col("seq"), spec.mode, spec.case)), spec)


def kmer_stream(contigs: DataFrame, spec: BankSpec, mask: str) -> DataFrame:
    """k-mer counts of a stream's chunks, in append mode."""
    return kmer.count(chunk_stream(contigs, spec), mask)


def write_counts(counts: DataFrame, folder: str, checkpoint: str):
    """Appends to Parquet, each record once; runs until the input is used up."""
    return counts.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
