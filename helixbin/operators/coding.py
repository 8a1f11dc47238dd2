"""Coding density: the share of a sequence's letters inside genes, for each gene finder.

Gene finders are external programs and off by default: ``run_tool`` calls one if it is installed. The density itself is
relational and takes gene tables from anywhere.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut

#: The gene finders and their command lines.
TOOLS = {
    "prodigal": ("prodigal", ["-i", "{input}", "-o", "{output}", "-f", "gff", "-p", "meta"]),
    "fraggenescan": ("run_FragGeneScan.pl", ["-genome={input}", "-out={stem}", "-complete=0", "-train=complete"]),
    "metageneannotator": ("mga", ["-m", "{input}"]),
}


def density(genes: DataFrame, gene_len: str = "exact", lengths: DataFrame | None = None) -> DataFrame:
    """``seqid, density`` of ``genes`` (``seqid, start, end``; starts count from 1).

    ``gene_len='compat'`` counts a letter more for each gene. Without ``lengths`` (``seqid, length``) the
    denominator is the end of a sequence's last gene. Overlapping genes count each.
    """
    if gene_len not in ("exact", "compat"):
        raise ValueError("gene_len has to be 'exact' or 'compat'")
    more = 1 if gene_len == "compat" else 0
    own = genes.groupBy("seqid").agg(F.sum(F.abs(F.col("end") - (F.col("start") - 1)) + more).alias("coding"), F.max("end").alias("last"))
    if lengths is None:
        return own.select("seqid", F.try_divide("coding", "last").alias("density"))
    return lengths.join(own, "seqid", "left").select("seqid", F.coalesce(F.try_divide("coding", "length"), F.lit(0.0)).alias("density"))


def across_tools(densities: dict[str, DataFrame]) -> DataFrame:
    """``seqid`` and a column for each tool: a full outer join, missing densities are 0."""
    out = None
    for name, table in densities.items():
        one = table.select("seqid", F.col("density").alias(name))
        out = one if out is None else out.join(one, "seqid", "full")
    if out is None:
        raise ValueError("no gene table")
    return out.na.fill(0.0, list(densities))


def parse_mga(lines: DataFrame) -> DataFrame:
    """MetaGeneAnnotator's report (``row_ord, value`` in line order) as gene rows.

    Headers name the sequence of the lines below; ``# gc`` and ``# self`` lines are skipped.
    """
    head = F.when(F.col("value").startswith("# ") & ~F.col("value").rlike("^# (gc|self)"), F.substring("value", 3, 1 << 20))
    rows = lines.select("row_ord", "value", head.alias("head")).orderBy("row_ord").withColumn("part", F.spark_partition_id())

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            seqid = []
            for x in batch.column("head").to_pylist():
                now = x if x is not None else now
                seqid.append(now)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("part", "row_ord", "value")] + [pa.array(seqid, pa.string())], names=["part", "row_ord", "value", "seqid"])

    filled = cut(rows.mapInArrow(fill, "part int, row_ord long, value string, seqid string"))
    # Lines before a part's first header belong to the last header of the parts before it: a row a part.
    parts = filled.groupBy("part").agg(F.min("row_ord").alias("first"), F.max(F.when(F.col("seqid").isNotNull(), F.struct("row_ord", "seqid"))).alias("last")).orderBy("first").collect()
    before, now = [], None
    for r in parts:
        before.append((r["part"], now))
        now = r["last"]["seqid"] if r["last"] else now
    told = lines.sparkSession.createDataFrame(before, "part int, before string")
    named = filled.join(F.broadcast(told), "part").withColumn("seqid", F.coalesce("seqid", "before"))
    f = F.split("value", "\t")
    return named.where(~F.col("value").startswith("#") & (F.size(f) >= 11)).select(
        "seqid", F.lit("MGA").alias("source"), F.lit("gene").alias("type"), f[1].cast("int").alias("start"), f[2].cast("int").alias("end"), f[6].cast("double").alias("score"), f[3].alias("strand"), f[4].alias("phase"), F.lit("-").alias("attributes")
    )


def available(tools: list[str]) -> list[str]:
    """Those tools that are installed."""
    return [t for t in tools if shutil.which(TOOLS[t][0])]


def run_tool(name: str, fasta: str, output: str, force: bool = False) -> str:
    """Runs a gene finder on a local FASTA file; an existing output is a cache hit unless ``force``."""
    if Path(output).exists() and not force:
        return output
    program, args = TOOLS[name]
    if shutil.which(program) is None:
        raise FileNotFoundError(f"{program} is not installed")
    stem = str(Path(output).with_suffix(""))
    with open(output if name == "metageneannotator" else "/dev/null", "w") as out:
        subprocess.run([program, *(a.format(input=fasta, output=output, stem=stem) for a in args)], check=True, stdout=out)
    return output


GENES = "seqid string, source string, type string, start int, end int, score double, strand string, phase string, attributes string"


def _genes_of(tool: str, text: str) -> Iterator[tuple]:
    """Gene rows of a finder's output: GFF, or MetaGeneAnnotator's report."""
    seqid = None
    number = lambda x: float(x) if x.replace(".", "", 1).replace("-", "", 1).isdigit() else None
    for line in text.splitlines():
        f = line.split("\t")
        if tool == "metageneannotator":
            if line.startswith("# ") and not line.startswith(("# gc", "# self")):
                seqid = line[2:]
            elif not line.startswith("#") and len(f) >= 11:
                yield seqid, "MGA", "gene", int(f[1]), int(f[2]), number(f[6]), f[3], f[4], "-"
        elif not line.startswith("#") and len(f) == 9:
            yield f[0], f[1], f[2], int(f[3]), int(f[4]), number(f[5]), f[6], f[7], f[8]


def predict(bank: DataFrame, tool: str) -> DataFrame:
    """Genes (``GENES``) of a bank's chunks: every task hands its chunks to the finder, a batch a run, in a folder of its own."""
    program, args = TOOLS[tool]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tempfile

        for batch in batches:
            if not batch.num_rows:
                continue
            with tempfile.TemporaryDirectory() as d:  # the program's own files; nothing is read back later
                stem, source = f"{d}/genes", Path(d, "chunks.fasta")
                output = stem + ".gff"
                source.write_text("".join(f">{i}\n{s}\n" for i, s in zip(batch.column("chunk_id").to_pylist(), batch.column("seq").to_pylist(), strict=True)))
                ran = subprocess.run([program, *(a.format(input=source, output=output, stem=stem) for a in args)], check=True, capture_output=True, text=True)
                text = ran.stdout if tool == "metageneannotator" else Path(output).read_text()
            rows = list(_genes_of(tool, text))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string(), pa.string())
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in GENES.split(", ")])

    return bank.select("chunk_id", "seq").mapInArrow(work, GENES)
