from collections import Counter
from statistics import median

import numpy as np
import pytest

from helixbin.models import KmerCoverageModel
from helixbin.operators import coverage

TABLE = str.maketrans("ACGT", "TGCA")


def brute(rows, k):
    kmers = {i: [min(w, w.translate(TABLE)[::-1]) for p in range(len(s) - k + 1) if set(w := s[p : p + k]) <= set("ACGT")] for i, s in rows}
    total = Counter(w for ws in kmers.values() for w in ws)
    return {i: float(median([total[w] for w in ws])) if ws else 0.0 for i, ws in kmers.items()}, {i: Counter(total[w] for w in ws) for i, ws in kmers.items()}


def sequences():
    rng = np.random.default_rng(1)
    make = lambda n: "".join(rng.choice(list("ACGT"), n))
    base = make(400)
    rows = [base, base, base[50:350], base.translate(TABLE)[::-1], make(300), "A" * 200, "AC" * 90 + "N" + "AC" * 40, "", "ACGT", "N" * 60, base[:100] + "N" + base[100:220] + "R" + base[220:], make(31), make(30)]
    return [(f"c{i}", s) for i, s in enumerate(rows)]


@pytest.mark.parametrize("k,hot,bucket", [(31, 4_000_000, 500_000), (31, 50, 200), (31, 0, 500), (5, 100, 300), (13, 10, 10**6), (1, 5, 100)])
def test_against_brute_force(spark, monkeypatch, k, hot, bucket):
    """With few k-mers allowed in a bucket, some or all are split into single k-mers."""
    monkeypatch.setattr(coverage, "HOT", hot)
    monkeypatch.setattr(coverage, "BUCKET", bucket)
    rows = sequences()
    bank = spark.createDataFrame(rows, "chunk_id string, seq string").repartition(3)
    want, counts = brute(rows, k)
    got = coverage.kmer_counts_by_chunk(bank, k).collect()
    assert {(r["chunk_id"], r["count"]): r["n"] for r in got} == {(i, c): n for i, own in counts.items() for c, n in own.items()} and len(got) == sum(map(len, counts.values()))
    if k == 31:
        assert {r["chunk_id"]: r["features"][0] for r in KmerCoverageModel(k).fit_transform(bank).collect()} == want


def test_kmers_stay_with_their_minimizer(spark):
    rows = sequences()
    supers = coverage.super_kmers(spark.createDataFrame(rows, "chunk_id string, seq string"), 31, 64).collect()
    place, letters = {}, 0
    for r in supers:
        s = bytes(r["letters"]).decode()
        letters += len(s)
        assert r["n"] == len(s) - 30
        for p in range(r["n"]):
            w = min(s[p : p + 31], s[p : p + 31].translate(TABLE)[::-1])
            assert place.setdefault(w, r["bucket"]) == r["bucket"]
    kmers = sum(r["n"] for r in supers)
    assert kmers == sum(sum(c.values()) for c in brute(rows, 31)[1].values()) and letters < 8 * kmers


def test_empty_and_bad_sizes(spark):
    none = spark.createDataFrame([], "chunk_id string, seq string")
    assert coverage.from_kmers(none).collect() == []
    for k in (0, 32):
        with pytest.raises(ValueError):
            coverage.from_kmers(none, k)


def test_pairs_are_counted_as_numbers(monkeypatch):
    """np.unique over rows compares them as records, which takes over ten times as long."""
    unique = np.unique

    def flat(x, *args, **options):
        assert "axis" not in options
        return unique(x, *args, **options)

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50, 5000), rng.integers(0, 9, 5000)
    monkeypatch.setattr(coverage.np, "unique", flat)
    own, other, n = coverage._pairs(a, b)
    assert Counter(zip(a.tolist(), b.tolist())) == dict(zip(zip(own.tolist(), other.tolist()), n.tolist()))
    assert [len(x) for x in coverage._pairs(a[:0], b[:0])] == [0, 0, 0]


def test_rows_are_dealt_by_slice_and_cell(spark, monkeypatch):
    """A super-k-mer isn't a row of its own, nor are its letters a byte each; ids that repeat count as one chunk."""
    rows = [(f"{i}-{c}", s) for i in range(20) for c, s in sequences()]
    monkeypatch.setattr(coverage, "CELLS", 8)
    whole = coverage.dealt(spark.createDataFrame(rows, "chunk_id string, seq string").coalesce(1), 31)
    n, kmers, size = whole.where("cell >= 0").selectExpr("count(*)", "sum(n)", "sum(length(letters))").first()
    assert n <= 8 and kmers == sum(sum(c.values()) for c in brute(rows, 31)[1].values()) and size < 2 * kmers
    twice = [("c", s) for _, s in sequences()[:3]]
    bank = spark.createDataFrame(twice, "chunk_id string, seq string").repartition(3)
    total = Counter(min(w, w.translate(TABLE)[::-1]) for _, s in twice for w in (s[p : p + 31] for p in range(len(s) - 30)))
    want = Counter(n for w, n in total.items() for _ in range(n))
    assert {(r["chunk_id"], r["count"]): r["n"] for r in coverage.kmer_counts_by_chunk(bank).collect()} == {("c", c): n for c, n in want.items()}
    assert [r["value"] for r in coverage.from_kmers(bank).collect()] == [median(want.elements())] * 3


def test_counts_of_a_chunk_come_from_one_task(spark):
    """Counts come back by slice, so a histogram over chunks shuffles no row for each bucket that a chunk has k-mers in."""
    bank = spark.createDataFrame(sequences(), "chunk_id string, seq string").repartition(3)
    plan = coverage.kmer_counts_by_chunk(bank)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(slice" in plan and "hashpartitioning(chunk_id" not in plan
