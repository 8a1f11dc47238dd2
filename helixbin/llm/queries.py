"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, bpe_scan, centroids, hard_negatives, hnsw, kneser_ney, line_quality, minhash, mixing, secrets, token_arrow, toxicity, warc
from .common import table

#: The tokenizer file of op7 and op10 is a parameter of their operators; the queries use this one.
TOKENIZER = "byte_bpe_50k.json"
#: And op13 this file of ranks.
RANKS = "byte_bpe_multi_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.report(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_arrow.report(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.report(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.report(table(spark, sf_dir, "embeddings"))


def op13_scan_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_scan.report(table(spark, sf_dir, "documents"), tokenizer_path(RANKS))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_warc": op2_warc,
    "op3_kneser_ney": op3_kneser_ney,
    "op4_toxicity": op4_toxicity,
    "op5_hnsw": op5_hnsw,
    "op6_mixing": op6_mixing,
    "op7_token_arrow": op7_token_arrow,
    "op8_line_quality": op8_line_quality,
    "op9_minhash": op9_minhash,
    "op10_bpe": op10_bpe,
    "op11_centroids": op11_centroids,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_scan_bpe": op13_scan_bpe,
}

ORACLES: dict[str, Callable[[], str]] = {
    "op1_secret_scan": secrets.oracle,
    "op2_warc": warc.oracle,
    "op5_hnsw": hnsw.oracle,
    "op8_line_quality": line_quality.oracle,
    "op9_minhash": minhash.oracle,
    "op11_centroids": centroids.oracle,
    "op12_hard_negatives": hard_negatives.oracle,
}
