"""Byte-level BPE: a priority queue of merge ranks over a doubly linked list of symbols.

``encode`` adds token ids to texts, ``decode`` turns ids back by concatenating vocabulary strings,
``round_trip`` does both in one pass. Ids equal those of the tokenizers library for the same file.
The file has to be a plain byte-level BPE tokenizer; any other is an error. A null text counts as empty and has no ids; texts of
any length are encoded whole. Rows are independent: ties, repeated rows, null ids and other columns pass through, but for those of the
added columns' names, which are replaced; an empty table gives an empty table with the added columns.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import short_batches
from .pieces import PieceCache, byte_level

#: Fixed value: the pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class BpeModel:
    """Ranks, vocabulary and special strings of a tokenizer file."""

    def __init__(self, path: str) -> None:
        spec = byte_level(path)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = {(vocab[a] << 32) | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cache = PieceCache(lambda pieces: [self.piece(p) for p in pieces])

    def merged(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        symbol = [self.first[b] for b in data]
        end = len(symbol)
        if end == 1:
            return symbol
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        merges, queue = self.merges, []
        for i in range(end - 1):
            if (hit := merges.get((symbol[i] << 32) | symbol[i + 1])) is not None:
                queue.append((hit[0], i, symbol[i], symbol[i + 1], hit[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, whole = heapq.heappop(queue)
            j = after[i]
            if symbol[i] != a or j >= end or symbol[j] != b:
                continue  # stale: one of the two has been merged since
            symbol[i], symbol[j] = whole, -1
            k = after[i] = after[j]
            if k < end:
                before[k] = i
                if (hit := merges.get((whole << 32) | symbol[k])) is not None:
                    heapq.heappush(queue, (hit[0], i, whole, symbol[k], hit[1]))
            h = before[i]
            if h >= 0 and (hit := merges.get((symbol[h] << 32) | whole)) is not None:
                heapq.heappush(queue, (hit[0], h, symbol[h], whole, hit[1]))
        return [s for s in symbol if s >= 0]

    def piece(self, text: str) -> bytes:
        ids = array("i")
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            for token in self.pattern.findall(text[at : m.start()]):
                ids.extend(self.merged(token.encode()))
            ids.append(self.special[m[0]])
            at = m.end()
        for token in self.pattern.findall(text[at:] if at else text):
            ids.extend(self.merged(token.encode()))
        return ids.tobytes()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def model(path: str) -> BpeModel:
    return BpeModel(path)


def _ids_array(coded: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in coded)], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), np.int32)))


def _run(df: DataFrame, fields: list[T.StructField], batch_columns) -> DataFrame:
    """``df`` with the columns that ``batch_columns`` makes from each Arrow batch."""
    short_batches(df.sparkSession)
    new = {f.name for f in fields}
    kept = [c for c in df.columns if c not in new]
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = batch_columns(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *added], names=[*kept, *(f.name for f in fields)])

    return df.mapInArrow(work, schema)


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds ``ids_col`` array<int>."""

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        return [_ids_array(model(path).cache.encode([x or "" for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]))]

    return _run(df, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], columns)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds ``text_col`` from ``ids_col``; null ids give an empty text, ids outside the vocabulary an error."""

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        m = model(path)
        return [pa.array([m.decode(x or []) for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()], pa.string())]

    return _run(df, [T.StructField(text_col, T.StringType())], columns)


def round_trip(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the texts; the decoded text comes from the ids alone."""

    def columns(batch: pa.RecordBatch) -> list[pa.Array]:
        m = model(path)
        coded = m.cache.encode([x or "" for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()])
        return [_ids_array(coded), pa.array([m.decode(np.frombuffer(x, np.int32).tolist()) for x in coded], pa.string())]

    return _run(df, [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(decoded_col, T.StringType())], columns)


def report(documents: DataFrame, path: str) -> DataFrame:
    """The contract's columns for every row of ``documents``."""
    rows = round_trip(documents.select("doc_id", "text"), path).drop("text")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
