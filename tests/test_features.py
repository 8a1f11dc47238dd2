import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixbin.functions import dna
from helixbin.operators import bank as banks
from helixbin.operators import coding, contig2vec, coverage, ind, kmer
from helixbin.operators.bank import BankSpec


def contigs(spark, seqs):
    return spark.createDataFrame([(f"c{i}", i, s) for i, s in enumerate(seqs)], "contig_id string, contig_ord long, seq string")


def one_bank(spark, seqs):
    return spark.createDataFrame([(f"c{i}__0", i, s) for i, s in enumerate(seqs)], "chunk_id string, seq_ord long, seq string")


def cut_by_loop(s, c, o, m):
    """The published chunking, step by step."""
    if c <= 0 or len(s) <= c:
        return [s]
    out, at = [], 0
    while True:
        out.append(s[at : at + c])
        if at + c >= len(s):
            break
        at += c - o
    if len(out) > 1 and len(out[-1]) < m:
        last = out.pop()
        out[-1] += last
    return out


@pytest.mark.parametrize("c,o,m", [(10, 2, 5), (10, 0, 5), (50, 7, 20), (0, 0, 5), (1000, 3, 1)])
def test_chunks_against_loop(spark, c, o, m):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ATGCNatx") for _ in range(rng.randint(0, 120))) for _ in range(60)]
    got = {}
    for r in banks.build(contigs(spark, seqs), BankSpec(m, c, o)).orderBy("seq_ord").collect():
        got.setdefault(r["contig_id"], []).append(r["seq"])
    clean = ["".join(x if x in "ATGC" else "N" for x in s.upper()) for s in seqs]
    assert got == {f"c{i}": cut_by_loop(s, c, o, m) for i, s in enumerate(clean) if len(s) >= m}


def test_bank_parameters(spark):
    for bad in ({"overlap": 10, "chunk_size": 10}, {"mode": "x"}, {"merge": "x"}, {"overlap": -1}):
        with pytest.raises(ValueError):
            BankSpec(**bad)
    assert BankSpec(chunk_size=10000).letters == 1428
    rows = banks.build(contigs(spark, ["A" * 5, "T" * 20, "G" * 30, "C" * 40]), BankSpec(10, 100, 0, max_contigs=2)).collect()
    assert {r["contig_id"] for r in rows} == {"c1", "c2"}
    r = banks.build(contigs(spark, ["A" * 20]), BankSpec(5, 10, 2, merge="extend")).orderBy("seq_ord").collect()
    assert [len(x["seq"]) for x in r] == [10, 12]
    assert banks.build(contigs(spark, ["acgtRYn"]), BankSpec(1, 0, 0, mode="iupac")).first()["seq"] == "ACGTRYN"
    assert banks.build(contigs(spark, ["acgtRYn"]), BankSpec(1, 0, 0, case="preserve")).first()["seq"] == "acgtNNN"


def test_must_link(spark):
    b = banks.build(contigs(spark, ["A" * 10, "T" * 20, "G" * 30]), BankSpec(1, 10, 0))
    s = banks.must_link_stats(b).first()
    assert (s["n_chunks"], s["nnz"]) == (6, 14) and banks.must_link_pairs(b).count() == 14
    assert {r["contig_id"]: r["members"] for r in banks.must_link_groups(b).collect()}["c2"] == ["c2__0", "c2__1", "c2__2"]


def test_positions_survive_partitions(spark):
    df = spark.range(0, 1000, 1, 7).withColumnRenamed("id", "x")
    assert all(r["x"] == r["seq_ord"] for r in banks.with_positions(df).collect())


def test_masks_and_canonical_forms(spark):
    row = spark.createDataFrame([("CTAA", "TTAG", "GTG", "ATGCGT")], "a string, b string, c string, d string").select(
        dna.canonical(F.col("a")).alias("a"), dna.canonical(F.col("b")).alias("b"), dna.maskify(F.col("c"), "101").alias("c"), dna.maskify(F.col("d"), "110011").alias("d")
    )
    assert tuple(row.first()) == ("CTAA", "CTAA", "CxC", "ACxxAT")
    for bad in ("1", "011", "1101", "", "0"):
        with pytest.raises(ValueError):
            dna.check_mask(bad)
    assert len(kmer.full_vocabulary("1111")) == 136 and len(kmer.full_vocabulary("1001001")) == 32 and len(kmer.full_vocabulary("11000100011")) == 512


def brute_kmers(s, mask):
    pair, out = dict(zip(dna.CODES, dna.COMPLEMENTS, strict=True)) | {"x": "x"}, {}
    for i in range(len(s) - len(mask) + 1):
        k = "".join(c if m == "1" else "x" for c, m in zip(s[i:], mask))
        k = min(k, "".join(pair[c] for c in reversed(k)))
        if "N" not in k:
            out[k] = out.get(k, 0) + 1
    return out


@pytest.mark.parametrize("mask", ["11", "111", "1111", "101", "110011", "1001001"])
def test_kmer_counts(spark, mask):
    rng = random.Random(2)
    seqs = ["".join(rng.choice("ATGCATGCN") for _ in range(rng.randint(0, 90))) for _ in range(25)] + ["ANT", "NNNNN", "ATRYSWKMBDHVNG"]
    b = one_bank(spark, seqs)
    want = {(f"c{i}__0", k): n for i, s in enumerate(seqs) for k, n in brute_kmers(s, mask).items()}
    for f in (kmer.count, kmer.count_sql):
        assert {(r["chunk_id"], r["feature"]): r["n"] for r in f(b, mask).collect()} == want
    counts = kmer.count(b, mask)
    words = kmer.observed_vocabulary(counts)
    wide = {r["chunk_id"]: r for r in kmer.matrix(b, counts, words).collect()}
    assert len(wide) == len(seqs) and sum(wide["c26__0"][1:]) == 0
    vec = {r["chunk_id"]: r["features"] for r in kmer.vectors(b, counts, words).collect()}
    assert all(vec[c] == [float(x) for x in wide[c][1:]] for c in wide)


def test_kmers_of_both_strands_are_equal(spark):
    s = "ATGCCGTTAGACCATGNATTACAGGT"
    rc = s.translate(str.maketrans("ATGC", "TACG"))[::-1]
    assert brute_kmers(s, "110011") == brute_kmers(rc, "110011")
    with pytest.raises(ValueError):
        kmer.window_codes("acgt", "11")


def brute_ind(s, k):
    """State machine of the published definition."""
    last, runs = {}, {b: [] for b in "ATGC"}
    dist = {(e, c): [] for e in "ATGC" for c in "ATGC"}
    for p, c in enumerate(s):
        if c not in "ATGC":
            continue
        for e in "ATGC":
            if e in last and (e == c or last[e] > last.get(c, -1)):
                dist[e, c].append(p - last[e])
        last[c] = p
    i = 0
    while i < len(s):
        j = i
        while j < len(s) and s[j] == s[i]:
            j += 1
        if s[i] in "ATGC":
            runs[s[i]].append(1 if j == len(s) else j - i)
        i = j
    parts = [runs[b] for b in "ATGC"] + [dist[e, c] for e in "ATGC" for c in "ATGC"]
    return [x.count(v) / len(x) if x else 0.0 for x in parts for v in range(1, k + 1)]


def test_inter_nucleotide_distances(spark):
    rng = random.Random(3)
    seqs = ["AATTT", "ANA", "", "N", "A"] + ["".join(rng.choice("AATTGCN") for _ in range(rng.randint(1, 80))) for _ in range(40)]
    got = {r["chunk_id"]: r["features"] for r in ind.vectors(one_bank(spark, seqs), 5).collect()}
    for i, s in enumerate(seqs):
        assert np.allclose(got[f"c{i}__0"], brute_ind(s, 5), atol=0), s
    assert len(ind.columns(15)) == 300
    v = dict(zip(ind.columns(3), ind.profile("AATTT", 3), strict=True))
    assert v["f1_A_2"] == 1 and v["f1_T_1"] == 1


def test_coverage(spark, tmp_path):
    b = one_bank(spark, ["A", "T", "G"])
    (tmp_path / "a.csv").write_text("1.5\n2\n3\n")
    (tmp_path / "b.tsv").write_text("id\tcov\nc2__0\t9\nc0__0\t7\n")
    (tmp_path / "c.txt").write_text("x")
    got = {r["chunk_id"]: tuple(r)[1:] for r in coverage.model(b, [str(tmp_path / x) for x in ("a.csv", "c.txt", "b.tsv")]).collect()}
    assert got == {"c0__0": (1.5, 7.0), "c1__0": (2.0, None), "c2__0": (3.0, 9.0)}
    (tmp_path / "d.csv").write_text("1\n2\n")
    with pytest.raises(ValueError):
        coverage.model(b, [str(tmp_path / "d.csv")])


def test_coding_density(spark):
    genes = spark.createDataFrame([("a", 1, 10), ("a", 21, 40), ("b", 5, 14)], "seqid string, start int, end int")
    own = {r["seqid"]: r["density"] for r in coding.density(genes).collect()}
    assert own == {"a": 30 / 40, "b": 10 / 14}
    assert {r["seqid"]: r["density"] for r in coding.density(genes, "compat").collect()} == {"a": 32 / 40, "b": 11 / 14}
    lengths = spark.createDataFrame([("a", 100), ("c", 5)], "seqid string, length int")
    assert {r["seqid"]: r["density"] for r in coding.density(genes, "exact", lengths).collect()} == {"a": 0.3, "c": 0.0}
    both = {r["seqid"]: tuple(r)[1:] for r in coding.across_tools({"x": coding.density(genes), "y": coding.density(genes.where("seqid = 'b'"))}).collect()}
    assert both == {"a": (0.75, 0.0), "b": (10 / 14, 10 / 14)}
    lines = ["# s1", "# gc = 0.5", "# self: -", "gene_1\t5\t20\t+\t0\t11\t3.5\tp\t-\t-\t-", "# s2 x", "# gc = 0", "# self: s"]
    mga = coding.parse_mga(spark.createDataFrame(list(enumerate(lines)), "row_ord long, value string")).collect()
    assert [(r["seqid"], r["start"], r["end"], r["strand"], r["phase"], r["score"]) for r in mga] == [("s1", 5, 20, "+", "0", 3.5)]
    assert coding.available(["prodigal"]) in ([], ["prodigal"])


def test_contig2vec(spark):
    b = one_bank(spark, ["ATGATGC", "ATGNATT", "GGGGG"])
    t = {r["chunk_id"]: r["tokens"] for r in contig2vec.tokens(b, 3).collect()}
    assert t["c1__0"] == ["ATG", "ATT"] and t["c2__0"] == ["GGG"] * 3
    counts = contig2vec.word_counts(b, 3)
    words = sorted({w for x in t.values() for w in x})
    rng = np.random.default_rng(0)
    v = {w: rng.normal(size=4) for w in words}
    table = spark.createDataFrame([(w, x.tolist()) for w, x in v.items()], "word string, vector array<double>")
    total = sum(map(len, t.values()))
    p = {w: sum(x.count(w) for x in t.values()) / total for w in words}
    want = {c: np.mean([1e-3 / (1e-3 + p[w]) * v[w] for w in x], axis=0) for c, x in t.items()}
    means = contig2vec.weighted_means(counts, table)
    got = {r["chunk_id"]: np.array(r["features"]) for r in means.collect()}
    assert all(np.allclose(got[c], want[c]) for c in want)
    u = np.linalg.svd(np.stack([want[c] for c in sorted(want)]))[2][0]
    for r in contig2vec.remove_common(means).collect():
        assert np.allclose(r["features"], want[r["chunk_id"]] - (want[r["chunk_id"]] @ u) * u)
    with pytest.raises(KeyError):
        contig2vec.weighted_means(counts, table.where("word <> 'GGG'"))


def test_places_in_a_sort_of_many_files(spark):
    """Files of very different sizes, read back in any order, keep the places of the sort."""
    from helixbin.operators import post
    from helixbin.scratch import array_sum, numbered

    rng = np.random.default_rng(5)
    x = rng.normal(size=3000) ** 3
    df = spark.createDataFrame([(float(v), int(k % 3)) for k, v in enumerate(x)], "silhouette double, cluster int").repartition(13)
    got = [r["silhouette"] for r in numbered(df, "silhouette", name="at").orderBy("at").collect()]
    assert got == sorted(x.tolist())
    rows = {r["cluster"]: r for r in post.percentiles(df, {"a": 0.1, "b": 0.5, "c": 1.0}, "cluster").collect()}
    for k in range(3):
        assert np.allclose([rows[k][c] for c in "abc"], np.quantile(x[k::3], [0.1, 0.5, 1.0])) and rows[k]["n"] == 1000
    total = array_sum(df.repartition(300), lambda b: np.array([b.num_rows, b.column("silhouette").to_numpy().sum()]))
    assert total[0] == 3000 and np.isclose(total[1], x.sum())


def test_repeated_contigs(spark):
    df = spark.createDataFrame([("c", 0, "A" * 30), ("d", 1, "G" * 20), ("c", 2, "T" * 25), (None, 3, "C" * 20), (None, 4, "C" * 20)], "contig_id string, contig_ord long, seq string")
    rows = banks.build(df, BankSpec(min_length=10, chunk_size=0, overlap=0)).orderBy("seq_ord").collect()
    assert [(r["chunk_id"], r["seq"][0]) for r in rows] == [("d__0", "G"), ("c__0", "T"), ("0", "C"), ("0", "C")]


def test_dense_vectors_equal_counted_ones(spark):
    rng = np.random.default_rng(3)
    seqs = ["".join(rng.choice(list("ACGTN"), rng.integers(0, 90), p=[0.24] * 4 + [0.04])) for _ in range(40)]
    b = spark.createDataFrame([(f"s{k}", s) for k, s in enumerate(seqs)], "chunk_id string, seq string")
    for mask in ("111", "1001", "11011"):
        want = {r["chunk_id"]: r["features"] for r in kmer.vectors(b, kmer.count(b, mask), kmer.full_vocabulary(mask)).collect()}
        assert {r["chunk_id"]: r["features"] for r in kmer.dense(b, mask).collect()} == want


def test_gene_reports_over_many_parts(spark):
    lines = []
    for k in range(40):
        lines += [f"# seq{k}", "# gc = 0.5", "# self: -"] + [f"gene_{j}\t{j + 1}\t{j + 50}\t+\t0\t11\t1.5\t-\t-\t-\t-" for j in range(k % 5)]
    df = spark.createDataFrame(list(enumerate(lines)), "row_ord long, value string").repartition(7)
    got = {(r["seqid"], r["n"]) for r in coding.parse_mga(df).groupBy("seqid").agg(F.count("*").alias("n")).collect()}
    assert got == {(f"seq{k}", k % 5) for k in range(40) if k % 5}


def test_word_means_in_the_task_equal_joined_ones(spark):
    rng = np.random.default_rng(4)
    b = spark.createDataFrame([(f"s{k}", "".join(rng.choice(list("ACGT"), 60))) for k in range(20)], "chunk_id string, seq string")
    words = ["".join(w) for w in __import__("itertools").product("ACGT", repeat=2)]
    table = spark.createDataFrame([(w, rng.normal(size=4).tolist()) for w in words], "word string, vector array<double>")
    want = {r["chunk_id"]: r["features"] for r in contig2vec.remove_common(contig2vec.weighted_means(contig2vec.word_counts(b, 2), table)).collect()}
    got = {r["chunk_id"]: r["features"] for r in contig2vec.embed(b, 2, table).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in got)
    with pytest.raises(KeyError):
        contig2vec.embed(b, 2, table.where("word <> 'GG'"))


def test_word_vectors_do_not_depend_on_partitions_or_place(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(f"c{i}", "".join(rng.choice(list("AACGT"), 300)) + "N" + "ACG" * 20) for i in range(30)] + [("short", "TTT"), ("none", "N"), ("empty", "")]
    b = spark.createDataFrame(rows, "chunk_id string, seq string")
    one = {r["word"]: r["vector"] for r in contig2vec.train(b, 3, 10).collect()}
    monkeypatch.setattr(contig2vec, "FEW_WORDS", 0)
    for parts in (b, b.repartition(7)):
        other = {r["word"]: r["vector"] for r in contig2vec.train(parts, 3, 10).collect()}
        assert set(other) == set(one)
        x, y = (np.array([v[w] for w in sorted(one)]) for v in (one, other))
        assert np.linalg.norm(x @ x.T - y @ y.T) < 1e-4 * np.linalg.norm(x @ x.T)  # single columns turn where eigenvalues are close
    # Against a count of all pairs, and the eigenvectors of the whole matrix.
    words = sorted(one)
    n = np.zeros((len(words), len(words)))
    for _, s in rows:
        t = [s[i : i + 3] for i in range(len(s) - 2) if "N" not in s[i : i + 3]]
        for i, w in enumerate(t):
            for v in t[i + 1 : i + 6]:
                n[words.index(w), words.index(v)] += 1
    n = n + n.T
    own = n.sum(1)
    with np.errstate(divide="ignore"):
        m = np.maximum(np.log(n * n.sum() / np.outer(own, own) / contig2vec.NOISE), 0)
    value, vector = np.linalg.eigh(m)
    top = np.argsort(-np.abs(value))[:10]
    want = (vector[:, top] * np.abs(value[top])) @ vector[:, top].T
    got = np.array([one[w] for w in words])
    assert np.linalg.norm(got @ got.T - want) < 0.05 * np.linalg.norm(want)
    assert len(contig2vec.embed(b, 3, size=10).collect()) == 31


def test_word_vector_files(spark, tmp_path):
    import struct

    vectors = {"AAA": [1.5, -2.0, 0.25], "ACG": [0.0, 1e-3, 7.0], "TTT": [3.0, 2.0, 1.0]}
    table = spark.createDataFrame(list(vectors.items()), "word string, vector array<double>")
    path = contig2vec.write_vectors(table, str(tmp_path / "v"))
    assert {r["word"]: r["vector"] for r in contig2vec.read_vectors(spark, path).collect()} == vectors
    for end in (b"", b"\n"):
        (tmp_path / "v.bin").write_bytes(b"3 3\n" + b"".join(w.encode() + b" " + struct.pack("<3f", *v) + end for w, v in vectors.items()))
        got = {r["word"]: r["vector"] for r in contig2vec.read_vectors(spark, str(tmp_path / "v.bin"), binary=True).collect()}
        assert set(got) == set(vectors) and all(np.allclose(got[w], vectors[w]) for w in got)
    (tmp_path / "bad.txt").write_text("2 3\nAAA 1 2 3\nAAC 1 2\n")
    with pytest.raises(Exception, match="has not 3 values"):
        contig2vec.read_vectors(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "none.txt").write_text("AAA 1 2 3\n")
    with pytest.raises(ValueError, match="no header"):
        contig2vec.read_vectors(spark, str(tmp_path / "none.txt"))
    from helixbin.models import WordVectorModel

    b = spark.createDataFrame([("c", "AAACG")], "chunk_id string, seq string")
    with pytest.raises(KeyError):
        WordVectorModel(3, file=path).fit_transform(b)


def test_masks_as_an_expression(spark):
    masks = ["1111", "110011", "1101", "011", "1", "101", "12021", "", None, "11", "10"]
    df = spark.createDataFrame([(m,) for m in masks], "m string")
    for r in df.select("m", dna.valid_mask(F.col("m")).alias("v")).collect():
        try:
            dna.check_mask(r["m"] or "")
            assert r["v"]
        except ValueError:
            assert not r["v"]


def test_word_pairs_of_many_chunks_stay_small(spark):
    """What a task holds depends on a slice of a batch, not on the batch: the counts of all pairs took 160 bytes a letter of a batch."""
    import tracemalloc

    import pyarrow as pa

    seqs = ["".join(random.Random(i).choice("ACGT") for _ in range(2000)) for i in range(1500)] + ["", None, "AC", "ANA"]
    taken = {}

    class Bank:
        def select(self, *names):
            return self

        def mapInArrow(self, work, schema):
            taken["work"] = work
            return spark.createDataFrame([], schema)

    contig2vec.cooccurrences(Bank(), 3)
    batch = pa.record_batch([pa.array([str(i) for i in range(len(seqs))]), pa.array(seqs, pa.string())], names=["chunk_id", "seq"])
    tracemalloc.start()
    rows = sum(len(b) for b in taken["work"](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows and peak < 150e6
    few = seqs[:3] + seqs[-4:]
    want = {}
    for s in few:
        words = [s[i : i + 3] for i in range(len(s or "") - 2)] if s else []
        words = [w for w in words if "N" not in w]
        for i, w in enumerate(words):
            want.setdefault((w, w), 0)
            for v in words[max(0, i - 5) : i] + words[i + 1 : i + 6]:
                want[w, v] = want.get((w, v), 0) + 1
    got = contig2vec.cooccurrences(one_bank(spark, few).select("chunk_id", "seq"), 3).collect()
    assert {(kmer.decode(r["a"], "111"), kmer.decode(r["b"], "111")): r["n"] for r in got} == want


def test_table_functions_join_nothing(spark):
    """A function's rows are made where its arguments are: no join by the sequence, which gave every k-mer its whole sequence."""
    from helixbin.functions import sql

    sql.register(spark)
    spark.createDataFrame([("a", "ACGTNACGTTGA" * 3), ("b", None), ("c", "AC"), ("d", "")], "id string, s string").createOrReplaceTempView("table_function_rows")
    for call in ("dna_kmers(s, '1001001')", "dna_chunks(s, 10, 2, 5)"):
        df = spark.sql(f"SELECT * FROM table_function_rows, LATERAL {call}")
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() > 0
    rows = spark.sql("SELECT place, kmer FROM table_function_rows, LATERAL dna_kmers(s, '1001') WHERE id = 'a'").collect()
    s, pair = "ACGTNACGTTGA" * 3, str.maketrans("ACGTN", "TGCAN")
    want = {i + 1: min(k, k.translate(pair)[::-1]) for i in range(len(s) - 3) if "N" not in (k := f"{s[i]}xx{s[i + 3]}")}
    assert {r["place"]: r["kmer"] for r in rows} == want


def test_words_are_cut_from_letters(spark):
    """Words are cut once from a slice's letters (a window's place cost time in built-in expressions); nothing crosses a chunk's end."""
    seqs = ["ACGTAC", "", "AC", "GGNTTTTA", None, "ACG" * 50]
    b = one_bank(spark, seqs)
    df = contig2vec.tokens(b, 3)
    assert "substring" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r["chunk_id"]: r["tokens"] for r in df.collect()}
    assert got == {f"c{i}__0": [w for p in range(len(s or "") - 2) if "N" not in (w := s[p : p + 3])] for i, s in enumerate(seqs)}
    totals = {r["word"]: r["n"] for r in contig2vec.word_totals(b, 3).collect()}
    assert totals == {r["word"]: r["n"] for r in contig2vec.word_counts(b, 3).groupBy("word").agg(F.sum("n").alias("n")).collect()}


def test_coverage_by_position_of_many_files(spark, tmp_path):
    """Values in several files, of which the scan reads the largest first, keep the order of the files' names."""
    from helixbin.sources import tables

    for name, values in (("part-0", [0]), ("part-1", range(1, 500)), ("part-2", range(500, 530))):
        (tmp_path / f"{name}.csv").write_text("".join(f"{v}\n" for v in values))
    assert sorted((r["row_ord"], r["value"]) for r in tables.coverage_csv(spark, str(tmp_path)).collect()) == [(i, float(i)) for i in range(530)]


@pytest.mark.parametrize("query", ["word_counts", "tokens", "word_totals", "cooccurrences"])
def test_workers_are_handed_no_more_rows_than_a_slice(spark, query):
    """What a worker holds doesn't grow with the rows of its task."""
    bank = spark.range(0, 3 * kmer.SLICE_ROWS, 1, 1).selectExpr("CAST(id AS STRING) AS chunk_id", "'ACGTNACGGT' AS seq")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    getattr(contig2vec, query)(bank, 3).count()

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows])], names=["n"])

    found = [r["n"] for r in bank.mapInArrow(sizes, "n long").collect()]
    assert sum(found) == 3 * kmer.SLICE_ROWS and max(found) <= kmer.SLICE_ROWS


def test_kmer_rows_by_numbers_and_by_letters():
    """The k-mers of a batch are cut in numpy, not window by window in expressions; letters or masks that numbers don't hold go another way."""
    import pyarrow as pa

    from helixbin.functions import sql
    from helixbin.functions.dna import CODES, COMPLEMENTS

    rng, pair = np.random.default_rng(8), str.maketrans(CODES, COMPLEMENTS)
    rows = ["".join(rng.choice(list("ACGTN"), n)) for n in (0, 3, 6, 7, 8, 200)] + [None, "", "RYKMACGT" * 3, "ACG"]
    for texts in (rows, [*rows, "acgTTGACCA-ACGTNAC"], [*rows, "ACGT\u00e9ACGTTGCA"], [None], []):
        for mask in ("1001001", "11", "111111", "10011", None):
            got = sql.kmer_rows(pa.array(texts, pa.string()), pa.array([mask] * len(texts), pa.string())).to_pylist()
            want, m = [], mask or ""
            for s in texts:
                cut = [(i + 1, "".join(c if b == "1" else "x" for c, b in zip(s[i:], m))) for i in range(len(s) - len(m) + 1)] if s and m else []
                want.append([{"place": i, "kmer": min(k, k.translate(pair)[::-1])} for i, k in cut if "N" not in k])
            assert got == want
    assert sql._all_kmers(["ACGT"], "11") is not None and sql._all_kmers(["acgt"], "11") is None
