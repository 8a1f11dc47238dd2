import gzip

import numpy as np
import pytest

import __spark_entry__
from helixbin import cli
from helixbin.operators import bank as banks
from helixbin.operators.bank import BankSpec
from helixbin.plans.pipeline import DEFAULT_MODELS, Extraction, characterize, extract
from helixbin.sources import fasta
from helixbin.sources.tables import Store, read_clustering, read_gff, write_clustering
from helixbin.streaming import features


def genome(seed, n, length, bias):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("ATGC"), length, p=bias)) for _ in range(n)]


@pytest.fixture(scope="module")
def fasta_file(tmp_path_factory):
    p = tmp_path_factory.mktemp("f") / "x.fasta"
    seqs = genome(0, 12, 900, [0.9, 0.04, 0.03, 0.03]) + genome(1, 12, 900, [0.1, 0.15, 0.4, 0.35])
    p.write_text("".join(f">s{i} some > words\n" + "\n".join(s[k : k + 70] for k in range(0, len(s), 70)) + "\n" for i, s in enumerate(seqs)))
    return str(p), seqs


def test_fasta_scan_and_write(spark, fasta_file, tmp_path):
    path, seqs = fasta_file
    rows = fasta.read(spark, path).orderBy("contig_ord").collect()
    assert [(r["contig_id"], r["description"], r["seq"]) for r in rows] == [(f"s{i}", "some > words", s) for i, s in enumerate(seqs)]
    bank = banks.build(fasta.read(spark, path), BankSpec(100, 300, 0))
    out = fasta.write(bank, str(tmp_path / "o"), compress=True)
    back = {r["contig_id"]: r["seq"] for r in fasta.read(spark, out).collect()}
    assert back == {r["chunk_id"]: r["seq"] for r in bank.collect()}
    some = bank.limit(3).select("chunk_id")
    fasta.write(bank, str(tmp_path / "p"), ids=some)
    fasta.write(bank, str(tmp_path / "p"), ids=some, append=True)
    assert fasta.read(spark, str(tmp_path / "p")).count() == 6


def test_fastq_and_data_source(spark, fasta_file, tmp_path):
    path, seqs = fasta_file
    q = tmp_path / "x.fastq"
    q.write_text("".join(f"@r{i} d\nACGT{'A' * i}\n+\nIIII{'I' * i}\n" for i in range(5)))
    assert {r["contig_id"]: r["seq"] for r in fasta.read(spark, str(q), "fastq").collect()} == {f"r{i}": "ACGT" + "A" * i for i in range(5)}
    z = tmp_path / "y.fasta.gz"
    z.write_bytes(gzip.compress(open(path, "rb").read()))
    fasta.register(spark)
    assert {r["contig_id"]: r["seq"] for r in spark.read.format("fasta").load(str(z)).collect()} == {f"s{i}": s for i, s in enumerate(seqs)}
    with pytest.raises(ValueError):
        fasta.read(spark, path, "sam")


def test_gff_and_reports(spark, tmp_path):
    p = tmp_path / "g.gff"
    p.write_text("##gff-version 3\ns1\ttool\tgene\t5\t20\t3.5\t+\t0\tID=1\ns2\ttool\tgene\t1\t9\t.\t-\t.\tID=2\n")
    rows = read_gff(spark, str(p)).collect()
    assert [(r["seqid"], r["start"], r["end"], r["score"]) for r in rows] == [("s1", 5, 20, 3.5), ("s2", 1, 9, None)]
    df = spark.createDataFrame([("a", "0"), ("b", "maxiter_1")], "chunk_id string, cluster string")
    write_clustering(df, str(tmp_path / "c"))
    assert {tuple(r) for r in read_clustering(spark, str(tmp_path / "c")).collect()} == {("a", "0"), ("b", "maxiter_1")}


def test_characterize_extract_and_store(spark, fasta_file, tmp_path):
    path, seqs = fasta_file
    models = {m: DEFAULT_MODELS[m] for m in ("kmers3", "ind15")}
    store = characterize(spark, fasta.read(spark, path), str(tmp_path / "s"), BankSpec(100, 300, 0), models)
    assert store.models() == ["ind15", "kmers3"] and store.bank()[1] == BankSpec(100, 300, 0)
    with pytest.raises(KeyError):
        store.load_models(["nothing"])
    bank = store.bank()[0]
    result = extract(spark, bank, store.load_models(["kmers3"]), Extraction(max_iter=2, max_cluster=6, restarts=3, min_rows=10, vb_iter=60)).collect()
    assert sorted(r["chunk_id"] for r in result) == sorted(r["chunk_id"] for r in bank.collect())
    good = [r for r in result if r["status"] == "validated"]
    assert good
    side = {f"s{i}": i < 12 for i in range(24)}
    for c in {r["cluster"] for r in good}:
        members = [side[r["chunk_id"].split("__")[0]] for r in good if r["cluster"] == c]
        assert len(set(members)) == 1
    early = extract(spark, bank, store.load_models(["kmers3"]), Extraction(min_rows=1000)).collect()
    assert {r["cluster"] for r in early} == {"notenough_0"}
    with pytest.raises(ValueError):
        Extraction(init="x")


def test_a_run_that_was_killed_goes_on(spark, fasta_file, tmp_path, monkeypatch):
    import os

    from helixbin import scratch
    from helixbin.operators import post, vbgmm
    from helixbin.plans import pipeline

    path, _ = fasta_file
    bank = scratch.cut(banks.build(fasta.read(spark, path), BankSpec(100, 300, 0)))
    models = {"kmers3": scratch.cut(DEFAULT_MODELS["kmers3"](bank))}
    p = Extraction(max_iter=3, max_cluster=6, restarts=2, min_rows=10, vb_iter=20)
    # One cluster is accepted at a time, so that several iterations run.
    verdicts = post.verdicts
    monkeypatch.setattr(post, "verdicts", lambda s: (v := verdicts(s)).withColumn("accepted", v["accepted"] & (v["cluster"] == v.where("accepted").selectExpr("min(cluster) AS c").first()["c"])))
    table = lambda df: sorted(map(tuple, df.collect()))
    fit, commit, calls = vbgmm.fit, pipeline.Log.commit, []
    monkeypatch.setattr(vbgmm, "fit", lambda *a, **k: (calls.append(1), fit(*a, **k))[1])
    whole, needed = table(extract(spark, bank, models, p)), len(calls)
    assert len({r[2] for r in whole}) > 1
    state = str(tmp_path / "state")

    def dying(self, n, *a):
        if len(calls) < needed + 2:  # before the first commit, then after it
            raise KeyboardInterrupt
        commit(self, n, *a)
        raise KeyboardInterrupt

    monkeypatch.setattr(pipeline.Log, "commit", dying)
    for commits in (0, 1):
        with pytest.raises(KeyboardInterrupt):
            extract(spark, bank, models, p, state=state)
        assert os.path.exists(f"{state}/commits") == bool(commits)
    monkeypatch.setattr(pipeline.Log, "commit", commit)
    calls.clear()
    assert table(extract(spark, bank, models, p, state=state)) == whole and len(calls) == needed - 1
    calls.clear()
    assert table(extract(spark, bank, models, p, state=state)) == whole and not calls  # complete: read again
    with pytest.raises(ValueError, match="other parameters"):
        extract(spark, bank, models, Extraction(max_iter=4), state=state)


def test_scratch_tables_go_with_their_scope(spark):
    import os

    from helixbin import scratch

    with scratch.scope(spark):
        with scratch.scope(spark) as keep:
            gone, kept = scratch.cut(spark.range(5)), keep(scratch.cut(spark.range(6)))
            files = gone.inputFiles()[0].removeprefix("file://"), kept.inputFiles()[0].removeprefix("file://")
        assert not os.path.exists(files[0]) and os.path.exists(files[1]) and kept.count() == 6
    assert not os.path.exists(files[1])


def test_command_line(spark, fasta_file, tmp_path, capsys):
    path, _ = fasta_file
    out = str(tmp_path / "cli")
    cli.main(["model", "--input", path, "--min_length", "100", "--chunk_size", "300", "--overlap", "0", "--outfile", out, "--models", "kmers3"])
    cli.main(["describe", "--input", out])
    text = capsys.readouterr().out
    assert "kmers3" in text and "n_chunks" in text
    cli.main(["extract", "--input", out, "--models", "kmers3", "--outfile", f"{out}.csv", "--max_iter", "1", "--max_cluster", "4"])
    assert read_clustering(spark, f"{out}.csv").count() == Store(spark, out).bank()[0].count()


def test_stream_of_chunks(spark, fasta_file, tmp_path):
    path, _ = fasta_file
    rows = fasta.read(spark, path).select("contig_id", "contig_ord", "seq")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    spec = BankSpec(100, 300, 0)
    stream = features.kmer_stream(features.read_contigs(spark, str(tmp_path / "in"), 1), spec, "111")
    features.write_counts(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    from helixbin.operators import kmer

    want = {tuple(r) for r in kmer.count(banks.build(rows, spec), "111").collect()}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    with pytest.raises(ValueError):
        features.chunk_stream(rows, BankSpec(max_contigs=3))


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["chunk_id", "feature", "n"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
