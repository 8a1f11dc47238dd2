"""k-mer and spaced-seed counts, long or wide.

Counting runs in numpy over Arrow batches: a sequence's windows become integers whose order is the k-mers' ASCII
order, so the canonical form is the smaller of a window's code and its reverse complement's. ``count_sql`` is the
same in built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import vector_array
from ..functions.dna import CODES, COMPLEMENTS, canonical, check_mask, maskify

LETTERS = "".join(sorted(CODES))
_RANK = np.full(256, 255, np.uint8)
_RANK[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS), dtype=np.uint8)
_PAIR = np.array([LETTERS.index(COMPLEMENTS[CODES.index(c)]) for c in LETTERS], np.int64)
_N = LETTERS.index("N")


#: Rows whose windows a task holds at once, and their letters.
SLICE_ROWS, SLICE_LETTERS = 256, 1 << 18


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """A batch with ``seq`` in parts of at most ``rows`` rows and ``SLICE_LETTERS`` letters, or of one row."""
    ends = np.cumsum([0, *(n or 0 for n in pc.binary_length(batch.column("seq")).to_pylist())])
    at = 0
    while at < batch.num_rows:
        n = int(np.searchsorted(ends, ends[at] + SLICE_LETTERS, "right")) - 1 - at
        n = max(1, min(n, rows, batch.num_rows - at))
        yield batch.slice(at, n)
        at += n


def by_slices(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` for work that goes by ``slices``: a worker is handed no more rows at once than a slice has, so what it holds doesn't grow with its task."""
    out = rows.mapInArrow(work, schema)
    out.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SLICE_ROWS))
    return out


def window_codes(seq: str, mask: str, both_strands: bool = True) -> np.ndarray:
    """Codes of a sequence's windows without N at the mask's ones; four bits a letter. Canonical for ``both_strands``."""
    raw = _RANK[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    if (raw == 255).any():
        raise ValueError("the sequence has letters outside the IUPAC codes; sanitise it first")
    ones = [i for i, c in enumerate(mask) if c == "1"]
    if len(ones) > 15:
        raise ValueError("a mask may have 15 ones at most")
    n = len(raw) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    letters, forward, backward, good = raw.astype(np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    for i in ones:
        x = letters[i : i + n]
        forward = (forward << 4) | x
        good &= x != _N
    for i in reversed(ones):
        backward = (backward << 4) | _PAIR[letters[i : i + n]]
    return (np.minimum(forward, backward) if both_strands else forward)[good]


def decode(code: int, mask: str) -> str:
    """The k-mer of a code, with x under the mask's zeros."""
    ones = mask.count("1")
    letters = iter(LETTERS[(code >> (4 * (ones - 1 - i))) & 15] for i in range(ones))
    return "".join(next(letters) if c == "1" else "x" for c in mask)


def count(bank: DataFrame, mask: str, both_strands: bool = True) -> DataFrame:
    """``chunk_id, feature, n`` of the k-mers that occur in each chunk, in canonical form for ``both_strands``."""
    check_mask(mask)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[int, str] = {}
        for batch in (part for whole in batches for part in slices(whole)):
            ids, features, counts = [], [], []
            for chunk, seq in zip(batch.column("chunk_id").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                codes, n = np.unique(window_codes(seq or "", mask, both_strands), return_counts=True)
                for c in codes.tolist():
                    if c not in names:
                        names[c] = decode(c, mask)
                    features.append(names[c])
                ids += [chunk] * len(codes)
                counts.append(n)
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(features, pa.string()), pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]), pa.int64())], names=["chunk_id", "feature", "n"])

    return by_slices(bank.select("chunk_id", "seq"), work, "chunk_id string, feature string, n long")


def count_sql(bank: DataFrame, mask: str) -> DataFrame:
    """``count`` in built-in expressions: counts first, canonical form after."""
    check_mask(mask)
    w = len(mask)
    # Cut on bytes, where a window costs its own length wherever it lies.
    letters = bank.select("chunk_id", F.col("seq").cast("binary").alias("b")).where(F.length("b") >= w)
    windows = letters.select("chunk_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("b") - w + 1), lambda i: F.substring("b", i, F.lit(w)))).alias("k"))
    raw = windows.groupBy("chunk_id", "k").count().withColumn("k", F.col("k").cast("string"))
    made = canonical(F.col("k")) if "0" not in mask else maskify(F.col("k"), mask)
    return raw.select("chunk_id", made.alias("feature"), F.col("count").alias("n")).where(F.instr("feature", "N") == 0).groupBy("chunk_id", "feature").agg(F.sum("n").alias("n"))


def full_vocabulary(mask: str) -> list[str]:
    """All canonical features of A, C, G, T, in order."""
    check_mask(mask)
    table = str.maketrans(CODES, COMPLEMENTS)
    found = set()
    for letters in product("ACGT", repeat=mask.count("1")):
        it = iter(letters)
        k = "".join(next(it) if c == "1" else "x" for c in mask)
        found.add(min(k, k.translate(table)[::-1]))
    return sorted(found)


def observed_vocabulary(counts: DataFrame) -> list[str]:
    """The features that occur, in order; at most 15 to the power of the mask's ones."""
    return sorted(r["feature"] for r in counts.select("feature").distinct().collect())


def matrix(bank: DataFrame, counts: DataFrame, vocabulary: list[str]) -> DataFrame:
    """One column a feature; chunks without any k-mer stay as rows of zeros."""
    wide = counts.groupBy("chunk_id").pivot("feature", vocabulary).agg(F.sum("n")) if vocabulary else counts.select("chunk_id").distinct()
    return bank.select("chunk_id").join(wide, "chunk_id", "left").select("chunk_id", *(F.coalesce(f"`{v}`", F.lit(0)).cast("long").alias(v) for v in vocabulary))


#: Features that a broadcast vocabulary may have.
MAX_BROADCAST = 1 << 20


def vectors(bank: DataFrame, counts: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``chunk_id, features`` array<double> over the vocabulary; chunks without any k-mer are zero."""
    spark, width = bank.sparkSession, len(vocabulary)
    places = spark.createDataFrame(list(zip(vocabulary, range(width))), "feature string, ix int")
    pairs = counts.join(F.broadcast(places) if width <= MAX_BROADCAST else places, "feature").groupBy("chunk_id").agg(F.collect_list(F.struct("ix", "n")).alias("m"))
    rows = bank.select("chunk_id").join(pairs, "chunk_id", "left").select("chunk_id", F.transform("m", lambda e: e["ix"]).alias("ix"), F.transform("m", lambda e: e["n"]).alias("n"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ix = batch.column("ix").fill_null([])
            x = np.zeros((batch.num_rows, width))
            row = np.repeat(np.arange(batch.num_rows), ix.value_lengths().to_numpy(zero_copy_only=False))
            x[row, ix.flatten().to_numpy()] = batch.column("n").fill_null([]).flatten().to_numpy()
            yield pa.record_batch([batch.column("chunk_id"), vector_array(x)], names=["chunk_id", "features"])

    return rows.mapInArrow(work, "chunk_id string, features array<double>")


def dense(bank: DataFrame, mask: str) -> DataFrame:
    """``vectors`` over the full vocabulary, counted within each chunk: nothing is shuffled or joined."""
    words = full_vocabulary(mask)
    ones = [i for i, c in enumerate(mask) if c == "1"]
    codes = np.array([sum(LETTERS.index(w[p]) << (4 * (len(ones) - 1 - i)) for i, p in enumerate(ones)) for w in words], np.int64)
    order = np.argsort(codes)
    codes = codes[order]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            x = np.zeros((batch.num_rows, len(codes)))
            for i, seq in enumerate(batch.column("seq").to_pylist()):
                found = window_codes(seq or "", mask)
                at = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
                x[i, order] = np.bincount(at[codes[at] == found], minlength=len(codes))
            yield pa.record_batch([batch.column("chunk_id"), vector_array(x)], names=["chunk_id", "features"])

    return by_slices(bank.select("chunk_id", "seq"), work, "chunk_id string, features array<double>")
