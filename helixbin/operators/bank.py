"""The sequence bank: length filter, sanitising, overlapping chunks, and the must-link relation.

A bank is ``seq_ord long, contig_id string, chunk_ix int, chunk_id string, seq string``. Chunks of one contig must
link; the relation is the equality of ``contig_id`` and its pairs are never stored.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import check_mode, sanitize


@dataclass(frozen=True)
class BankSpec:
    """``overlap='auto'`` is a seventh of the chunk size; ``max_contigs`` of 0 or less takes all."""

    min_length: int = 1000
    chunk_size: int = 10000
    overlap: int | str = "auto"
    max_contigs: int = 0
    mode: str = "strict"
    case: str = "upper"
    merge: str = "compat"

    def __post_init__(self) -> None:
        check_mode(self.mode)
        if self.merge not in ("compat", "extend"):
            raise ValueError("merge has to be 'compat' or 'extend'")
        if self.overlap != "auto" and (not isinstance(self.overlap, int) or self.overlap < 0):
            raise ValueError("overlap has to be 'auto' or a number of letters")
        if self.chunk_size > 0 and self.letters >= self.chunk_size:
            raise ValueError("overlap has to be smaller than chunk_size")

    @property
    def letters(self) -> int:
        """The overlap in letters."""
        return max(0, self.chunk_size) // 7 if self.overlap == "auto" else int(self.overlap)

    def file_stem(self, stem: str) -> str:
        return f"{stem}.l{self.min_length}c{self.chunk_size}o{self.letters}"

    def as_row(self) -> dict:
        return {k: str(v) if k == "overlap" else v for k, v in asdict(self).items()}


def with_positions(df: DataFrame, name: str = "seq_ord") -> DataFrame:
    """Numbers rows in source order from 0: partition sizes give offsets, so no global sort and no single task."""
    sizes = {r["p"]: r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    offsets, at = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(at)
        at += sizes.get(p, 0)
    own = F.monotonically_increasing_id()
    base = F.get(F.array(*map(F.lit, offsets)), F.spark_partition_id()) if offsets else F.lit(0)
    return df.withColumn(name, (base + own.bitwiseAND(F.lit((1 << 33) - 1))).cast("long"))


def keep_contigs(contigs: DataFrame, spec: BankSpec) -> DataFrame:
    """Contigs of ``min_length`` or more letters; a limit counts those, in source order."""
    kept = contigs.where(F.length("seq") >= spec.min_length)
    return kept.orderBy("contig_ord").limit(spec.max_contigs) if spec.max_contigs > 0 else kept


def _pieces(spec: BankSpec) -> tuple[Column, Column, Column]:
    """(chunks before merging, whether the last is merged into its predecessor, the step)."""
    length, c, o = F.length("seq"), spec.chunk_size, spec.letters
    if c <= 0:
        return F.lit(1), F.lit(False), F.lit(0)
    n = F.when(length <= c, 1).otherwise((F.ceil((length - c) / F.lit(c - o)) + 1).cast("int"))
    return n, (n > 1) & (length - (n - 1) * (c - o) < spec.min_length), F.lit(c - o)


def chunk(contigs: DataFrame, spec: BankSpec) -> DataFrame:
    """``contig_id, contig_ord, seq`` to ``contig_id, contig_ord, chunk_ix, chunk_id, seq``.

    A last piece shorter than ``min_length`` joins its predecessor: ``compat`` appends its letters, so that the
    overlap occurs twice; ``extend`` lengthens the predecessor to the contig's end. Cutting is done on bytes, where a
    piece costs its own length wherever it lies.
    """
    n, merged, step = _pieces(spec)
    c = spec.chunk_size
    rows = contigs.withColumns({"_n": n, "_m": merged}).withColumn("chunk_ix", F.explode(F.sequence(F.lit(0), F.col("_n") - 1 - F.col("_m").cast("int"))))
    raw = F.col("seq").cast("binary")
    cut = lambda at, size: F.substring(raw, at + 1, size).cast("string")
    if c <= 0:
        piece = F.col("seq")
    else:
        at = F.col("chunk_ix") * step
        last = F.col("_m") & (F.col("chunk_ix") == F.col("_n") - 2)
        tail = F.concat(cut(at, F.lit(c)), cut(at + step, F.lit(c))) if spec.merge == "compat" else cut(at, F.length("seq"))
        piece = F.when(last, tail).otherwise(cut(at, F.lit(c)))
    return rows.select(
        F.col("contig_id").cast("string").alias("contig_id"), "contig_ord", "chunk_ix", F.concat_ws("__", F.col("contig_id").cast("string"), "chunk_ix").alias("chunk_id"), piece.alias("seq")
    )


def build(contigs: DataFrame, spec: BankSpec | None = None) -> DataFrame:
    """The bank of ``contig_id, contig_ord, seq``; a later contig of the same id replaces an earlier one."""
    spec = spec or BankSpec()
    kept = keep_contigs(contigs, spec)
    # A look at the ids alone, for which no sequence is read where they have a column of their own.
    if contigs.groupBy("contig_id").agg(F.count("*").alias("n")).where("n > 1 AND contig_id IS NOT NULL").limit(1).count():
        kept = latest_by_id(kept)
    kept = kept.withColumn("seq", sanitize(F.col("seq"), spec.mode, spec.case))
    return chunk(kept, spec).withColumn("seq_ord", F.shiftleft(F.col("contig_ord").cast("long"), 24) + F.col("chunk_ix"))


#: Replaced contigs whose numbers may be broadcast.
FEW_REPEATS = 1_000_000


def latest_by_id(contigs: DataFrame) -> DataFrame:
    """Keeps the last contig of each id. Ids and lengths are looked at first; sequences only move where many repeat."""
    last = contigs.groupBy("contig_id").agg(F.max("contig_ord").alias("_last"), F.count("*").alias("_n")).where("_n > 1 AND contig_id IS NOT NULL").select("contig_id", "_last")
    n = last.limit(FEW_REPEATS + 1).count()
    if not n:
        return contigs
    old = contigs.join(F.broadcast(last) if n <= FEW_REPEATS else last, "contig_id", "left")
    return old.where("_last IS NULL OR contig_ord = _last").drop("_last")


def must_link_pairs(bank: DataFrame) -> DataFrame:
    """``a, b``: ordered pairs of chunks of a contig, each with itself too. A view; statistics need no pairs."""
    left = bank.select("contig_id", F.col("chunk_id").alias("a"))
    return left.join(bank.select("contig_id", F.col("chunk_id").alias("b")), "contig_id").select("a", "b")


def must_link_groups(bank: DataFrame, order: str = "seq_ord") -> DataFrame:
    """``contig_id, members``: the chunks of each contig in order."""
    return bank.groupBy("contig_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "chunk_id"))), lambda x: x["chunk_id"]).alias("members"))


def must_link_stats(bank: DataFrame) -> DataFrame:
    """``n_chunks, nnz, density_percent`` of the relation's matrix, from group sizes."""
    sizes = bank.groupBy("contig_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").cast("long").alias("n_chunks"), F.sum(F.col("n") * F.col("n")).cast("long").alias("nnz")).withColumn("density_percent", 100 * F.col("nnz") / (F.col("n_chunks") * F.col("n_chunks")))
