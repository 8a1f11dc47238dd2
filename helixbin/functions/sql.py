"""The sequence functions for SQL: temporary functions and table functions made of built-in expressions, but that k-mers are cut in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import kmer
from ..session import ship
from .dna import BASES_OF_LETTERS, CODES, COMPLEMENTS, LETTERS

FUNCTIONS = {
    "dna_sanitize(s STRING)": "STRING RETURN regexp_replace(upper(s), '[^ATGC]', 'N')",
    "dna_from_letters(s STRING)": f"STRING RETURN translate(upper(regexp_replace(s, '[^a-zA-Z]', '')), '{LETTERS}', '{BASES_OF_LETTERS}')",
    "reverse_complement(s STRING)": f"STRING RETURN reverse(translate(s, '{CODES}', '{COMPLEMENTS}'))",
    "canonical_kmer(s STRING)": f"STRING RETURN least(s, reverse(translate(s, '{CODES}', '{COMPLEMENTS}')))",
    "kmers(s STRING, k INT)": "ARRAY<STRING> RETURN CASE WHEN length(s) >= k THEN transform(sequence(1, length(s) - k + 1), i -> substring(s, i, k)) ELSE cast(array() AS ARRAY<STRING>) END",
}


#: Functions that give rows, for ``FROM t, LATERAL f(...)``: chunks as the bank cuts them, and the k-mers of a mask with their places, in canonical form.
#: Each is one generator over its arguments, so that Spark makes rows where ``t``'s rows are; a query around a generator would be joined back by the whole sequence.
TABLES = {
    "dna_chunks(s STRING, size INT, overlap INT, least INT)": """TABLE(chunk_ix INT, piece STRING) RETURN
SELECT chunk_ix, piece FROM inline(flatten(transform(array(CASE WHEN length(s) <= size THEN 1 ELSE CAST(ceil((length(s) - size) / (size - overlap)) AS INT) + 1 END),
n -> transform(sequence(0, n - 1 - CAST(n > 1 AND length(s) - (n - 1) * (size - overlap) < least AS INT)),
j -> struct(j AS chunk_ix, CASE WHEN n > 1 AND length(s) - (n - 1) * (size - overlap) < least AND j = n - 2 THEN concat(substring(s, j * (size - overlap) + 1, size), substring(s, (j + 1) * (size - overlap) + 1, size)) ELSE substring(s, j * (size - overlap) + 1, size) END AS piece)))))""",
    "dna_kmers(s STRING, mask STRING)": "TABLE(place INT, kmer STRING) RETURN SELECT place, kmer FROM inline(dna_kmer_rows(s, mask))",
}


#: Rows that a worker is handed at once.
SLICE_ROWS = 256
_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[list(CODES.encode())] = list(COMPLEMENTS.encode())


def masked_kmers(s: str, mask: str) -> tuple[np.ndarray, pa.Array]:
    """(places from 1, k-mers in canonical form) of a sequence's windows without N at the mask's ones; x stands at its other places."""
    w = len(mask)
    if not w or len(s) < w:
        return np.zeros(0, np.int32), pa.array([], pa.string())
    if not s.isascii():
        pair, found = str.maketrans(CODES, COMPLEMENTS), []
        for i in range(len(s) - w + 1):
            k = "".join(c if m == "1" else "x" for c, m in zip(s[i : i + w], mask))
            if "N" not in k:
                found.append((i + 1, min(k, k.translate(pair)[::-1])))
        return np.array([i for i, _ in found], np.int32), pa.array([k for _, k in found], pa.string())
    ones = np.frombuffer(mask.encode(), np.uint8) == ord("1") if mask.isascii() else np.array([c == "1" for c in mask])
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(s.encode(), np.uint8), w)
    at = np.flatnonzero((windows[:, ones] != ord("N")).all(1))
    k = windows[at]
    k[:, ~ones] = ord("x")
    back = np.ascontiguousarray(_COMPLEMENT[k[:, ::-1]])
    less = back.view(f"S{w}").ravel() < k.view(f"S{w}").ravel()
    k[less] = back[less]
    ends = np.arange(len(at) + 1, dtype=np.int32) * w
    return (at + 1).astype(np.int32), pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(k)])


def _all_kmers(texts: list[str], mask: str) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
    """(rows' first k-mers and the end, places, k-mers) of all rows at once, by numbers of four bits a letter; None where letters or the mask don't allow it."""
    ones, w = [i for i, m in enumerate(mask) if m == "1"], len(mask)
    data = "\n".join(texts)
    if not 1 <= len(ones) <= 4 or mask != mask[::-1] or not data.isascii():
        return None
    raw, breaks = kmer._RANK[np.frombuffer(data.encode(), np.uint8)], np.cumsum([len(x) + 1 for x in texts[:-1]], dtype=np.int64) - 1
    if (raw == 255).sum() != len(breaks):
        return None
    n = max(0, len(raw) - w + 1)
    good = np.ones(n, bool)
    over = (breaks[:, None] - np.arange(w)).ravel()  # windows over the end of a row
    good[over[(over >= 0) & (over < n)]] = False
    forward, backward, pair = np.zeros(n, np.uint16), np.zeros(n, np.uint16), np.zeros(256, np.uint16)
    pair[: len(kmer._PAIR)] = kmer._PAIR
    for i, j in zip(ones, reversed(ones)):
        forward = forward << 4 | raw[i : i + n]
        backward = backward << 4 | pair[raw[j : j + n]]
        good &= raw[i : i + n] != kmer._N
    at = np.flatnonzero(good)
    codes = np.minimum(forward, backward)[at]
    different = np.flatnonzero(np.bincount(codes, minlength=1))
    place = np.zeros(1 << 16, np.int32)
    place[different] = np.arange(len(different))
    names = pa.array([kmer.decode(c, mask) for c in different.tolist()], pa.string())
    starts = np.concatenate([[0], breaks + 1])
    first = np.append(np.searchsorted(at, starts), len(at))
    return first, at - np.repeat(starts, np.diff(first)) + 1, names.take(pa.array(place[codes]))


def kmer_rows(s: pa.Array, mask: pa.Array) -> pa.Array:
    """``masked_kmers`` of each row as a list of places and k-mers."""
    texts, masks = [x or "" for x in s.to_pylist()], [m or "" for m in mask.to_pylist()]
    whole = _all_kmers(texts, masks[0]) if len(set(masks)) == 1 else None
    if whole is None:
        found = [masked_kmers(x, m) for x, m in zip(texts, masks)]
        whole = np.cumsum([0, *(len(at) for at, _ in found)]), np.concatenate([at for at, _ in found] or [np.zeros(0, np.int32)]), pa.concat_arrays([k for _, k in found] or [pa.array([], pa.string())])
    first, places, kmers = whole
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays([pa.array(places.astype(np.int32)), kmers], ["place", "kmer"]))


def register(spark: SparkSession) -> list[str]:
    """Creates them in the session; returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {body}")
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SLICE_ROWS))  # a row becomes thousands
    spark.udf.register("dna_kmer_rows", F.arrow_udf(kmer_rows, "array<struct<place:int,kmer:string>>"))
    for head, body in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {body}")
    return [head.split("(")[0] for head in (*FUNCTIONS, *TABLES)]
