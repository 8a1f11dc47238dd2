"""Sequence records: a scan of FASTA, FASTQ, GenBank and EMBL that splits big files between records, a data source, and writers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.bank import with_positions

SCHEMA = "contig_id string, description string, seq string"

#: What a record's first line begins with.
FIRST = {"fasta": ">", "fastq": "@", "genbank": "LOCUS", "embl": "ID   "}


def sniff(spark: SparkSession, path: str) -> str:
    """The format of files, from the first line that isn't blank."""
    line = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    for name, mark in FIRST.items():
        if line and line[0]["value"].lstrip("\ufeff").startswith(mark):
            return name
    raise ValueError(f"{path} begins like none of {', '.join(FIRST)}")


def _after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``, from the next line on."""
    rest = F.substring(text, F.instr(text, mark) + len(mark), F.length(text))
    return F.when(F.instr(text, mark) > 0, F.regexp_replace(rest, r"^[^\n]*\n?", "")).otherwise("")


def _field(text: Column, mark: str, width: int) -> Column:
    """A field's lines joined: the line that begins with ``mark`` and those that go on with blanks or with the mark again."""
    lines = F.regexp_extract(text, rf"\n{mark}([^\n]*(?:\n(?: {{{width}}}|{mark})[^\n]*)*)", 1)
    return F.trim(F.regexp_replace(lines, rf"\s*\n(?: {{{width}}}|{mark})\s*", " "))


def read(spark: SparkSession, path: str, format: str | None = "fasta") -> DataFrame:
    """``contig_id, description, contig_ord, seq`` in file order; gzip by file name; the format is found by ``sniff`` if None.

    The scan cuts files where records begin, so that parts of a big file are read by different tasks. A record's id is the first word of its header
    (the locus of GenBank, the first item of EMBL's id). Lines of one record are joined; FASTQ records have four lines.
    """
    format = format or sniff(spark, path)
    if format not in FIRST:
        raise ValueError(f"format has to be one of {', '.join(FIRST)}, or None")
    pieces = spark.read.option("lineSep", f"\n{FIRST[format]}").text(path)
    body = F.regexp_replace(F.regexp_replace("value", "\r", ""), rf"^\s*{FIRST[format]}", "") if format != "fastq" else F.regexp_replace(F.regexp_replace("value", "\r", ""), "^@", "")
    rows, b = pieces.select(body.alias("b")), F.col("b")
    first = F.trim(F.substring_index(b, "\n", 1))
    bare = lambda x, also="": F.regexp_replace(x, rf"[\s{also}]", "")
    name, text = F.regexp_extract(first, r"^(\S*)", 1), F.regexp_extract(first, r"^\S*\s+(.*)$", 1)
    if format == "fasta":
        rows, seq = rows.where(F.trim(b) != ""), F.when(F.instr(b, "\n") > 0, bare(F.substring(b, F.instr(b, "\n") + 1, F.length(b)))).otherwise("")
    elif format == "fastq":
        # A line of qualities may begin with the mark too; what it is cut off from has its other three lines.
        lines = F.split(b, "\n")
        rows, seq = rows.where((F.size(lines) >= 3) & F.get(lines, F.lit(2)).startswith("+")), bare(F.get(lines, F.lit(1)))
    elif format == "genbank":
        rows, seq, text = rows.where(F.trim(b) != ""), bare(F.substring_index(_after(b, "\nORIGIN"), "//", 1), r"\d"), _field(b, "DEFINITION", 12)
    else:
        rows, seq, name, text = rows.where(F.trim(b) != ""), bare(F.substring_index(_after(b, "\nSQ"), "//", 1), r"\d"), F.regexp_extract(first, r"^([^;\s]*)", 1), _field(b, "DE   ", 5)
    return with_positions(rows.select(name.alias("contig_id"), text.alias("description"), seq.alias("seq")), "contig_ord").select("contig_id", "description", "contig_ord", "seq")


@dataclass
class Span(InputPartition):
    """The records of a file that begin from ``start`` on and before ``end``."""

    path: str
    start: int
    end: int


#: Parts up to which ``splitBytes`` alone gives their size; a task costs far more than 100 kB of records, so more parts are only
#: made where they would be larger than ``LARGE`` bytes.
PARTS, LARGE = 256, 64 << 20


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[InputPartition]:
        import glob
        import os
        import re

        out, sizes = [], {p: os.path.getsize(p) for p in sorted(glob.glob(re.sub("^file:/+", "/", self.path)))}
        size = max(self.size, min(LARGE, -(-sum(sizes.values()) // PARTS)))
        for p, whole in sizes.items():
            step = whole or 1 if p.endswith(".gz") else size
            out += [Span(p, at, min(at + step, whole)) for at in range(0, whole, step)]
        return out

    def read(self, partition: Span):
        import gzip

        packed = partition.path.endswith(".gz")
        letters = lambda lines: "".join(b"".join(lines).decode("utf-8", "replace").split())
        name, rest, parts = None, "", []
        with (gzip.open if packed else open)(partition.path, "rb") as f:
            at = partition.start
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1  # the line that began before belongs to the part before
            for raw in f:
                if raw.startswith(b">"):
                    if name is not None:
                        yield name, rest, letters(parts)
                        name = None
                    if not packed and at >= partition.end:
                        return
                    name, _, rest = raw[1:].decode("utf-8", "replace").strip().partition(" ")
                    parts = []
                elif name is not None:
                    parts.append(raw)
                elif not packed and at >= partition.end:
                    return
                at += len(raw)
        if name is not None:
            yield name, rest, letters(parts)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class Staged(WriterCommitMessage):
    path: str
    records: int


class _Writer(DataSourceWriter):
    """Tasks write files of their own under ``_staged``; only files of tasks that Spark commits are moved into the folder."""

    def __init__(self, path: str, columns: list[str], width: int, overwrite: bool) -> None:
        self.path, self.columns, self.width, self.overwrite, self.run = path.rstrip("/"), columns, width, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, base = _store(self.path)
        store.create_dir(f"{base}/_staged-{self.run}", recursive=True)
        path, n = f"{base}/_staged-{self.run}/part-{uuid.uuid4().hex}.fasta", 0
        key = "chunk_id" if "chunk_id" in self.columns else "contig_id"
        with store.open_output_stream(path) as out:
            for row in iterator:
                if row[key] is None:
                    raise ValueError("a record has no id")
                seq, text = row["seq"] or "", (row["description"] if "description" in self.columns else None) or ""
                lines = [f">{row[key]} {text}".rstrip(), *(seq[k : k + self.width] for k in range(0, len(seq), self.width))]
                out.write(("\n".join(lines) + "\n").encode())
                n += 1
        return Staged(path, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = _store(self.path)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(base)):
                if old.type == fs.FileType.File:
                    store.delete_file(old.path)
        for m in messages:
            if m is not None and m.records:
                store.move(m.path, f"{base}/{m.path.rsplit('/', 1)[-1]}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = _store(self.path)
        if store.get_file_info(f"{base}/_staged-{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/_staged-{self.run}")


class FastaDataSource(DataSource):
    """``spark.read.format('fasta').load(pattern)`` for files that every executor reaches, in parts of ``splitBytes`` (64 MiB), or larger ones beyond ``PARTS`` parts, cut between records;
    ``df.write.format('fasta').save(folder)`` of ``chunk_id`` or ``contig_id``, ``seq`` and perhaps ``description``, all or nothing, with ``width`` letters (80) a line."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("splitBytes", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema.names, int(self.options.get("width", 80)), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastaDataSource)


def write(bank: DataFrame, path: str, ids: DataFrame | None = None, compress: bool = False, append: bool = False, width: int = 80) -> str:
    """Writes ``chunk_id, seq`` as FASTA text, ``width`` letters a line; ``ids`` (``chunk_id``) picks some."""
    rows = bank.join(ids.select("chunk_id"), "chunk_id", "left_semi") if ids is not None else bank
    wrapped = F.regexp_replace(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), "\n$", "")
    text = rows.orderBy("seq_ord") if "seq_ord" in bank.columns else rows
    text.select(F.concat(F.lit(">"), "chunk_id", F.lit("\n"), wrapped).alias("value")).write.mode("append" if append else "overwrite").option("compression", "gzip" if compress else "none").text(path)
    return path


def count_records(spark: SparkSession, path: str, min_length: int = 0, format: str | None = "fasta") -> int:
    """How many records of a file have ``min_length`` letters or more."""
    return read(spark, path, format).where(F.length("seq") >= min_length).count()
