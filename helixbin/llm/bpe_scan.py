"""Byte-level BPE from a file of ranks, with pre-tokens found by array scans instead of a regex.

1. Every code point of a batch of texts gets its class from an array over all code points. Look-ahead (does white space or text
   follow, does a contraction follow an apostrophe) is put into the class by shifted comparisons.
2. A class is a transition function on eight states. Functions compose associatively, so the states before all
   characters come from a blocked prefix scan: compositions within blocks, side by side for all blocks, then over the blocks
   (by the same scan), then the blocks' entering states are put in. A text's first character resets the state.
3. State and class tell where a pre-token begins. Slices of the texts' bytes go to the merges of ranks through a bounded cache.
4. Each id keeps its byte offset in the text; ``decode`` writes vocabulary bytes to those places at once.

Pre-tokens are those of the usual pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``; ids are
those of the tiktoken library for the same ranks, without special tokens. A null text counts as empty and has no ids; texts of any
length are encoded whole. Rows are independent: ties, repeated rows, null ids and other columns pass through, but for those of
the added columns' names, which are replaced; an empty table gives an empty table with the added columns.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import short_batches

#: White space, and what Unicode 16 adds to the letters and numbers of Unicode 15.1.
WHITE = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")

#: Classes of characters; the last five know what follows.
LETTER, NUMBER, OTHER, WHITESPACE, SPACE_THEN_TEXT, WHITE_THEN_TEXT, QUOTE_ONE, QUOTE_TWO = range(8)
#: States: between pre-tokens; in letters, numbers, others, white space; after a joining space; one or two letters of a contraction left.
BETWEEN, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, JOINING, ONE_LEFT, TWO_LEFT = range(8)

BLOCK = 256
CACHE, KEEP_BYTES = 2_000_000, 48
CHUNK_CHARS = 4_000_000  # scanned at once; a longer text is scanned alone


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """``step[class, state]``: the next state; ``begins[class, state]``: whether a pre-token begins at the character."""
    own = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, WHITESPACE: IN_WHITE, SPACE_THEN_TEXT: JOINING, WHITE_THEN_TEXT: BETWEEN, QUOTE_ONE: ONE_LEFT, QUOTE_TWO: TWO_LEFT}
    step = np.repeat(np.array([own[c] for c in range(8)], np.uint8)[:, None], 8, axis=1)
    begins = np.ones((8, 8), bool)
    for c, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        begins[c, [state, JOINING]] = False
    begins[WHITESPACE, IN_WHITE] = False
    # An apostrophe begins a contraction only where no pre-token goes on.
    for c in (QUOTE_ONE, QUOTE_TWO):
        step[c, [IN_OTHERS, JOINING]] = IN_OTHERS
        begins[c, [IN_OTHERS, JOINING]] = False
    step[LETTER, TWO_LEFT], step[LETTER, ONE_LEFT] = ONE_LEFT, BETWEEN
    begins[LETTER, [TWO_LEFT, ONE_LEFT]] = False
    return step, begins


STEP, BEGINS = _machine()
#: ``POWERS[class, n - 1]``: the function of n characters of a class.
POWERS = np.stack([np.stack([f, f[f], f[f[f]]]) for f in STEP])


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, without what follows it."""
    out = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    for ranges, c in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER), (WHITE, WHITESPACE)):
        for low, high in ranges:
            out[low : high + 1] = c
    return out


def kinds(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The classes of code points with what follows them; ``first`` marks the texts' first characters."""
    kind = classes()[points]
    ends = np.concatenate([first[1:], [True]])  # nothing follows within the text
    text_next = np.concatenate([kind[1:] != WHITESPACE, [False]]) & ~ends
    white = kind == WHITESPACE
    space = points == 0x20
    kind[white & text_next & space] = SPACE_THEN_TEXT
    kind[white & text_next & ~space] = WHITE_THEN_TEXT
    at = np.flatnonzero((points == ord("'")) & ~ends)
    if len(at):
        one = points[at + 1]
        two = np.where(ends[at + 1], 0, points[np.minimum(at + 2, len(points) - 1)])
        kind[at[np.isin(one, [ord(c) for c in SHORT_ENDINGS])]] = QUOTE_ONE
        for a, b in LONG_ENDINGS:
            kind[at[(one == ord(a)) & (two == ord(b))]] = QUOTE_TWO
    return kind


def scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of ``functions`` (n x states, values are states), first function first."""
    n, s = functions.shape
    if n <= BLOCK:
        out = functions.copy()
        for i in range(1, n):
            out[i] = functions[i][out[i - 1]]
        return out
    m = -(-n // BLOCK)
    full = np.empty((m * BLOCK, s), np.uint8)
    full[:n], full[n:] = functions, np.arange(s, dtype=np.uint8)
    cube = np.ascontiguousarray(full.reshape(m, BLOCK, s).transpose(1, 0, 2))
    base = (np.arange(m) * s)[:, None]
    for i in range(1, BLOCK):
        cube[i] = cube[i].ravel()[base + cube[i - 1]]
    before = np.concatenate([np.arange(s, dtype=np.uint8)[None], scan(cube[-1])[:-1]])
    for i in range(BLOCK):
        cube[i] = cube[i].ravel()[base + before]
    return cube.transpose(1, 0, 2).reshape(m * BLOCK, s)[:n]


def starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The places where pre-tokens begin, for texts one after the other; ``first`` marks the texts' first characters.

    A run of one class is one function, its class' function as often as the run is long: of letters the third and later
    ones change nothing more, of other classes the second and later ones.
    """
    if not len(points):
        return np.zeros(0, np.int64)
    kind = kinds(points, first)
    new = np.concatenate([[True], kind[1:] != kind[:-1]]) | first
    run = np.flatnonzero(new)
    size = np.diff(run, append=len(points))
    c = kind[run]
    f = POWERS[c, np.minimum(size, 3) - 1]
    reset = first[run]
    f[reset] = f[reset][:, [BETWEEN]]
    before = np.concatenate([[BETWEEN], scan(f)[:-1, BETWEEN]])
    before[reset] = BETWEEN
    # Within a run a pre-token begins only where a contraction has ended.
    ended = [run[(c == LETTER) & (before == state) & (size > left)] + left for state, left in ((ONE_LEFT, 1), (TWO_LEFT, 2))]
    return np.sort(np.concatenate([run[BEGINS[c, before]], *ended]))


class Ranks:
    """Ranks of byte strings, their merges, and the vocabulary as one array of bytes."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.ranks.values()) + 1
        strings = [b""] * size
        for b, i in self.ranks.items():
            strings[i] = b
        self.width = np.array([len(b) for b in strings], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.width)[:-1]])
        self.blob = np.frombuffer(b"".join(strings), np.uint8)
        self.cache: dict[bytes, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: the lowest rank of two neighbours merges first, the leftmost of equals."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))  # of the symbol that begins here; 0 where none does
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, stop = heapq.heappop(queue)
            j = after[i]
            if not end[i] or j >= n or end[j] != stop:
                continue  # one of the two has been merged since
            end[i], end[j] = stop, 0
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(piece[i : end[k]])) is not None:
                    heapq.heappush(queue, (r, i, end[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(queue, (r, h, stop))
        return [ranks[piece[i:e]] for i, e in enumerate(end) if e]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids (int32) of each text."""
        out: list[np.ndarray] = []
        held, chars = [], 0
        for t in texts:
            if held and chars + len(t) > CHUNK_CHARS:
                out += self._encode(held)
                held, chars = [], 0
            held.append(t)
            chars += len(t)
        return out + (self._encode(held) if held else [])

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        size = np.array([len(t) for t in texts])
        ends = np.cumsum(size)
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        first = np.zeros(len(points), bool)
        first[(ends - size)[size > 0]] = True
        begin = starts(points, first)
        data = joined.encode()
        if len(data) == len(points):
            place = begin
        else:
            wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            place = (np.cumsum(wide) - wide)[begin]
        cut = [*place.tolist(), len(data)]
        if len(self.cache) > CACHE:
            self.cache.clear()
        kept = self.cache
        pieces = [data[a:b] for a, b in zip(cut, cut[1:])]
        own = {}  # long pieces aren't kept
        for p in set(pieces).difference(kept):
            (kept if len(p) <= KEEP_BYTES else own)[p] = np.array(self.merged(p), np.int32).tobytes()
        coded = list(map(kept.get, pieces))
        if own:
            coded = [own[p] if x is None else x for p, x in zip(pieces, coded)]
        ids = np.frombuffer(b"".join(coded), np.int32)
        counts = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded))) // 4
        upto = np.concatenate([[0], counts])[np.searchsorted(begin, ends)]
        return np.split(ids, upto[:-1]) if len(texts) else []

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte offset of each id in its text; an id outside the vocabulary is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.width)):
            raise ValueError("an id is outside the vocabulary")
        width = self.width[ids]
        return np.cumsum(width) - width

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """Vocabulary bytes, each written to its offset."""
        if not len(ids):
            return b""
        offsets = self.offsets(ids) if offsets is None else offsets
        width = self.width[ids]
        out = np.zeros(int((offsets + width).max()), np.uint8)
        inside = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
        out[np.repeat(offsets, width) + inside] = self.blob[np.repeat(self.at[ids], width) + inside]
        return out.tobytes()


@lru_cache(maxsize=4)
def model(path: str) -> Ranks:
    return Ranks(path)


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _lists(parts: list[np.ndarray], kind: type) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, kind), *parts]).astype(kind)))


def _run(df: DataFrame, inputs: list[str], fields: list[T.StructField], added) -> DataFrame:
    """``df`` with the columns that ``added`` makes from the columns ``inputs`` of each Arrow batch."""
    short_batches(df.sparkSession)
    new = {f.name for f in fields}
    places, own = [k for k, c in enumerate(df.columns) if c not in new], [df.columns.index(c) for c in inputs]
    schema = T.StructType([*(df.schema[k] for k in places), *fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*map(batch.column, places), *added(*map(batch.column, own))], names=schema.names)

    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(work, schema)  # plain names: dots in them would be read as fields


IDS, OFFSETS = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", offsets_col: str = "offsets") -> DataFrame:
    """Adds ``ids_col`` array<int> and ``offsets_col`` array<long>, the byte offset of each id in the text's UTF-8."""

    def columns(texts: pa.Array) -> list[pa.Array]:
        m = model(path)
        ids = m.encode(_texts(texts))
        return [_lists(ids, np.int32), _lists([m.offsets(x) for x in ids], np.int64)]

    return _run(df, [text_col], [T.StructField(ids_col, IDS), T.StructField(offsets_col, OFFSETS)], columns)


def decode(df: DataFrame, path: str, ids_col: str = "ids", offsets_col: str | None = "offsets", bytes_col: str = "decoded") -> DataFrame:
    """Adds ``bytes_col`` binary from ids and their offsets, which are found anew where ``offsets_col`` is None. Null ids give no bytes."""

    def columns(ids: pa.Array, *offsets: pa.Array) -> list[pa.Array]:
        m = model(path)
        ids = [np.array(x or [], np.int64) for x in ids.to_pylist()]
        at = [None if x is None else np.array(x, np.int64) for x in offsets[0].to_pylist()] if offsets else [None] * len(ids)
        return [pa.array([m.decode(i, o) for i, o in zip(ids, at)], pa.binary())]

    return _run(df, [ids_col] + [offsets_col] * (offsets_col is not None), [T.StructField(bytes_col, T.BinaryType())], columns)


def round_trip(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids_bytes", decoded_col: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass: ids as little-endian unsigned 32-bit integers, and the bytes that come from them alone."""

    def columns(texts: pa.Array) -> list[pa.Array]:
        m = model(path)
        ids = m.encode(_texts(texts))
        return [pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([m.decode(x) for x in ids], pa.binary())]

    return _run(df, [text_col], [T.StructField(ids_col, T.BinaryType()), T.StructField(decoded_col, T.BinaryType())], columns)


def report(documents: DataFrame, path: str) -> DataFrame:
    """The contract's columns for every row of ``documents``."""
    rows = round_trip(documents.select("doc_id", "text"), path).drop("text")
    return rows.select("doc_id", (F.length("ids_bytes") / 4).cast("long").alias("n_tokens"), F.sha2("ids_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
