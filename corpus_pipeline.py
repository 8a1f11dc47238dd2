"""A training corpus from raw documents: quality rules, near-dedup, secret scan, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the shared scratch
space and read again as the next stage's documents. All but the last return the columns of ``documents``.

Null and empty texts have no word, so the quality rules drop them; later stages keep them. Very long texts stay whole. Rows with a
null id are never duplicates and take part in the mix as any other row. Of rows of one id near-dedup leaves one, the first by text, language,
source and length. Other columns are ignored, whatever their names. An empty table gives no rows of any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixbin.llm import bpe, line_quality, minhash, mixing, secrets
from helixbin.llm.common import Written, table
from helixbin.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: How much the mix keeps of the tokens of each domain, beyond likely clean documents.
KEEP = {"clean": 1.0, "low": 0.5, "toxic": 0.25}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go from every text; documents that lose too much, or fail the base rule, go."""
    rows = line_quality.judged(docs.select(*COLUMNS)).where("quality.kept")
    lost = F.col("quality.removed_chars") > 0
    text = F.when(lost, line_quality.cleaned_text(F.col("text"), F.col("quality.boilerplate"))).otherwise(F.col("text"))
    rows = rows.select("doc_id", text.alias("text"), "lang", "source", "n_chars", lost.alias("_lost"))
    return rows.withColumn("n_chars", F.when(F.col("_lost"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


#: Ids that may be broadcast to the texts, so that texts aren't shuffled; beyond, a join takes over.
BROADCAST_IDS = 2_000_000


def _bounded(ids: DataFrame) -> DataFrame:
    """``ids``, broadcast if there are few enough."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group stays (5-word shingles, similarity 0.8).

    Of the texts of one id the first in order stays; rows with a null id stay.
    """
    docs = docs.select(*COLUMNS)
    found = minhash.near_duplicates(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    # Only ids that go, or have several texts, meet the texts.
    odd = Written(found.where("NOT kept OR n > 1")).df
    once = docs.join(_bounded(odd.select("doc_id")), "doc_id", "left_anti")  # rows with a null id are among them
    texts = docs.join(_bounded(odd.where("kept").select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("x")).select("doc_id", "x.*")
    return once.unionByName(texts).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced; every document stays."""
    found = secrets.redact(secrets.find_secrets(docs.select(*COLUMNS)))
    return found.withColumn("n_chars", F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_targets(members: DataFrame) -> dict[str, float]:
    """Tokens of each domain if likely clean documents stay and the others by the shares of ``KEEP`` that their posteriors mix:
    totals that rates within [0, 1] can reach."""
    p = [F.get("posterior", F.lit(i)) for i in range(len(mixing.DOMAINS))]
    rate = F.when(p[0] >= F.greatest(*p), 1.0).otherwise(sum((x * KEEP[d] for x, d in zip(p, mixing.DOMAINS)), F.lit(0.0)))
    supply = members.select(*(F.sum(F.col("n_tokens") * x * rate).alias(d) for x, d in zip(p, mixing.DOMAINS))).first()
    return {d: supply[d] or 0.0 for d in mixing.DOMAINS}


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aims at ``mix_targets``; nothing is taken twice.

    Documents whose likeliest domain is clean keep rate 1, so the others alone carry the reduction. A fit that doesn't
    settle warns. Rows with a null id are taken by their own rate, told apart by their text.
    """
    docs = docs.select(*COLUMNS)
    members = Written(mixing.memberships(docs, table(spark, sf_dir, "labels"))[0]).df
    rates = mixing.fit_rates(members, mix_targets(members), shares=False, max_rate=1.0, floor=1.0).of(members)
    taken = mixing.copies(F.col("rate"), F.col("ticket")) > 0
    # A document's rows stay if one of them is taken; rows with a null id each by their own ticket. Only what goes meets the texts.
    gone = Written(rates.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("ticket")).alias("ticket")).agg(F.max(taken).alias("taken")).where("NOT taken")).df
    some = docs.where("doc_id IS NOT NULL").join(_bounded(gone.where("doc_id IS NOT NULL").select("doc_id")), "doc_id", "left_anti")
    rest = docs.where("doc_id IS NULL").withColumn("_ticket", mixing.ticket())
    rest = rest.join(gone.where("doc_id IS NULL").select(F.col("ticket").alias("_ticket")), "_ticket", "left_anti")
    return some.select(*COLUMNS).unionByName(rest.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    rows = bpe.round_trip(docs.select(*COLUMNS), tokenizer_path())
    whole = F.col("decoded") == F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), whole.alias("decodes"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mixing_to_targets", mixing_to_targets),
    ("tokens", tokens),
]

#: MinHash, the classifier and the tokenizer can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES:
        now = Written(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        before, docs = now, now.df
    return docs
