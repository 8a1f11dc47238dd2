"""Inter-nucleotide distances (f0) and homopolymer runs (f1), as shares of the first K values.

The 20K columns are f1 of A, T, G, C, then f0 of each ordered pair of them, K values each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the order of the bases.
BASES = "ATGC"
_NUMBER = np.full(256, -1, np.int8)
_NUMBER[[ord(b) for b in BASES]] = range(4)


def distances(seq: str) -> list[tuple[int, int, np.ndarray]]:
    """(e, c, distances): from each base c back to the last e since the c before; other letters only take room."""
    x = _NUMBER[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    place = np.arange(len(x))
    last = []
    for b in range(4):
        seen = np.maximum.accumulate(np.where(x == b, place, -1)) if len(x) else place
        last.append(np.concatenate([[-1], seen[:-1]]) if len(x) else seen)
    out = []
    for e in range(4):
        for c in range(4):
            at = np.flatnonzero(x == c)
            before, own = last[e][at], last[c][at]
            hit = before >= 0 if e == c else before > own
            out.append((e, c, at[hit] - before[hit]))
    return out


def runs(seq: str) -> list[np.ndarray]:
    """Run lengths of each base; a run that ends the sequence counts as one letter."""
    x = _NUMBER[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    if not len(x):
        return [np.zeros(0, int)] * 4
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    length = np.diff(np.append(start, len(x)))
    length[-1] = 1
    return [length[x[start] == b] for b in range(4)]


def profile(seq: str, k: int) -> np.ndarray:
    """The 20K shares; denominators count values above K too, and an absent base or pair gives zeros."""
    parts = [*runs(seq), *(d for _, _, d in distances(seq))]
    out = np.zeros((20, k))
    for i, values in enumerate(parts):
        if len(values):
            out[i] = np.bincount(values[values <= k], minlength=k + 1)[1 : k + 1] / len(values)
    return out.ravel()


def columns(k: int) -> list[str]:
    return [f"f1_{a}_{i}" for a in BASES for i in range(1, k + 1)] + [f"f0_{e}{c}_{i}" for e in BASES for c in BASES for i in range(1, k + 1)]


def vectors(bank: DataFrame, k: int = 15) -> DataFrame:
    """``chunk_id, features`` array<double> of 20K shares."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("chunk_id"), pa.array([profile(s or "", k) for s in batch.column("seq").to_pylist()], pa.list_(pa.float64()))], names=["chunk_id", "features"])

    return bank.select("chunk_id", "seq").mapInArrow(work, "chunk_id string, features array<double>")


def long_form(wide: DataFrame, k: int) -> DataFrame:
    """``chunk_id, feature, value`` of the values above zero."""
    names = F.array(*map(F.lit, columns(k)))
    pairs = F.explode(F.arrays_zip(names.alias("feature"), F.col("features").alias("value")))
    return wide.select("chunk_id", pairs.alias("x")).select("chunk_id", "x.feature", "x.value").where("value > 0")
