import glob
import gzip
import os

import numpy as np
import pytest

from helixbin.sources import fasta


def records(n=300):
    rng = np.random.default_rng(2)
    return [(f"s{i}", f"record {i} of many" if i % 3 else "", "".join(rng.choice(list("ACGTN"), int(rng.integers(1, 400))))) for i in range(n)]


def wrapped(s, w, lead=""):
    return "\n".join(lead + s[k : k + w] for k in range(0, len(s), w))


def as_text(rows, format):
    rng = np.random.default_rng(3)
    out = []
    for i, d, s in rows:
        if format == "fasta":
            out.append(f">{i} {d}".rstrip() + "\n" + wrapped(s, 60))
        elif format == "fastq":
            quality = "".join(rng.choice(list("@+>!I"), len(s)))  # qualities that look like marks
            out.append(f"@{i} {d}".rstrip() + f"\n{s}\n+{i if len(s) % 2 else ''}\n{quality}")
        elif format == "genbank":
            two = d.replace(" of ", "\n            of ")
            out.append(f"LOCUS       {i}    {len(s)} bp    DNA\nDEFINITION  {two}\nACCESSION   X{i}\nFEATURES             Location\n     source          1..{len(s)}\nORIGIN      \n" + "\n".join(f"{k + 1:>9} {s[k : k + 10]} {s[k + 10 : k + 60]}".rstrip() for k in range(0, len(s), 60)) + "\n//")
        else:
            two = d.replace(" of ", "\nDE   of ")
            out.append(f"ID   {i}; SV 1; linear; {len(s)} BP.\nXX\nDE   {two}\nSQ   Sequence {len(s)} BP; 1 A; 2 C;\n" + "\n".join(f"     {s[k : k + 10]} {s[k + 10 : k + 60]}   {min(k + 60, len(s))}" for k in range(0, len(s), 60)) + "\n//")
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("format", list(fasta.FIRST))
@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_one_file_in_many_parts_equals_the_whole(spark, tmp_path, format, ending):
    rows = records()
    path = tmp_path / "x.seq"
    path.write_bytes(as_text(rows, format).replace("\n", ending).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("128m", "4k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            df = fasta.read(spark, str(path), None)
            assert (df.rdd.getNumPartitions() > 10) == (size == "4k")
            assert [tuple(r) for r in df.orderBy("contig_ord").select("contig_id", "description", "seq").collect()] == rows
            assert [r[0] for r in df.select("contig_ord").orderBy("contig_ord").collect()] == list(range(len(rows)))
    finally:
        for name, value in zip(("maxPartitionBytes", "openCostInBytes"), before):
            spark.conf.set(f"spark.sql.files.{name}", value)
    with gzip.open(tmp_path / "y.seq.gz", "wb") as f:
        f.write(path.read_bytes())
    assert fasta.sniff(spark, str(tmp_path / "y.seq.gz")) == format and fasta.count_records(spark, str(tmp_path / "y.seq.gz"), format=None) == len(rows)


def test_unknown_formats(spark, tmp_path):
    (tmp_path / "z").write_text("\n\nhello\n")
    with pytest.raises(ValueError, match="begins like none"):
        fasta.read(spark, str(tmp_path / "z"), None)
    with pytest.raises(ValueError):
        fasta.read(spark, str(tmp_path / "z"), "other")


def test_source_splits_and_sink_commits(spark, tmp_path):
    fasta.register(spark)
    rows = records(80) + [("last", "", "")]
    df = spark.createDataFrame(rows, fasta.SCHEMA)
    out = str(tmp_path / "out")
    df.repartition(5).write.format("fasta").option("width", 50).mode("append").save(out)
    files = glob.glob(f"{out}/*.fasta")
    assert 1 < len(files) <= 5 and not glob.glob(f"{out}/_staged*")
    for size in (100, 1000, 1 << 20):
        got = spark.read.format("fasta").option("splitBytes", size).load(f"{out}/*.fasta")
        assert sorted(map(tuple, got.collect())) == sorted(rows)
    assert sorted(map(tuple, fasta.read(spark, out).select("contig_id", "description", "seq").collect())) == sorted(rows)

    # Small parts of much text don't become a task each, and miss no record.
    with open(tmp_path / "large.fa", "w") as f:
        f.write(as_text(records(2000), "fasta"))
    parts = (reader := fasta._Reader(str(tmp_path / "*.fa"), 100)).partitions()
    assert fasta.PARTS / 2 < len(parts) <= fasta.PARTS
    assert [r for p in parts for r in reader.read(p)] == records(2000)

    # A task that fails leaves no record, neither its own nor others'.
    bad = spark.createDataFrame([(f"n{i}", "A") for i in range(50)] + [(None, "C")], "chunk_id string, seq string").repartition(4)
    with pytest.raises(Exception, match="no id"):
        bad.write.format("fasta").mode("append").save(out)
    assert sorted(glob.glob(f"{out}/*")) == sorted(files) and [f for f in os.listdir(out) if f.startswith("_")] == []
    df.limit(3).write.format("fasta").mode("overwrite").save(out)
    assert spark.read.format("fasta").load(f"{out}/*.fasta").count() == 3
