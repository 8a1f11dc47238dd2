"""Token ids in Arrow files of fixed-size lists: equal-length sequences and masks, open to random access.

``write`` deals documents by ascending id into ranges, encodes each range with the tokenizers library and
writes two Arrow IPC files for it into a folder that all executors share. There are as many ranges as shuffle partitions, and more
where a file would otherwise hold over ``FILE_BYTES`` of text:

* ``*.tokens.arrow``: ``tokens`` fixed_size_list<uint16|uint32>[L] and ``mask`` fixed_size_list<bool>[L]. The
  documents follow each other, each closed by the end id; only the last sequence of a file is padded.
* ``*.docs.arrow``: ``doc_id``, ``start`` (in the file), ``n_tokens``.

A file is complete once its manifest row exists: a task writes under a name of its own, so a repeated or
lost task leaves at most a file that no manifest names. ``read_documents`` maps the files into memory and
slices documents out of the flat values without copying. The tokenizer's file has to be a plain byte-level BPE tokenizer; any other is an
error. A null text counts as empty and has the end id only; texts of any length are encoded whole. Null ids come first; rows of equal id
are ordered by their first ``PREFIX`` letters, then by a hash of the text, and may be dealt to several ranges, as may repeated rows. An
empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import atexit
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import Written, remove, scratch, short_batches
from .pieces import PieceCache, byte_level

LENGTH = 512
BATCH_SEQUENCES = 1024
BATCH_DOCS = 8192
FILE_BYTES = 256 << 20
PREFIX = 64
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "bucket int, path string, n_docs long, n_tokens long"


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceCache:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    byte_level(path)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    ids = lambda texts: [array("i", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    letters = dict(enumerate(byte_letters()))
    space, merges = letters[32], tokenizer.model.tokenize
    ends = {"": b"", **dict(zip(".,;:!?", ids(list(".,;:!?")), strict=True))}

    def pieces(texts: list[str]) -> list[bytes]:
        """A word, perhaps with a mark behind it, goes straight to the library's merges; the rest through all of it."""
        out: list[bytes] = []
        rest: list[int] = []
        for i, x in enumerate(texts):
            mark = x[-1:] if x[-1:] in ends else ""
            word = x[: len(x) - len(mark)]
            core = word[1:] if word[:1] == " " else word
            if core.isalpha() and (core.isascii() or max(core) < "\u0250"):
                known = word.encode().decode("latin-1").translate(letters) if core is word or not core.isascii() else space + core
                out.append(array("i", [t.id for t in merges(known)]).tobytes() + ends[mark])
            else:
                out.append(b"")
                rest.append(i)
        for k in range(0, len(rest), 4096):
            for i, x in zip(rest[k : k + 4096], ids([texts[i] for i in rest[k : k + 4096]]), strict=True):
                out[i] = x
        return out

    return PieceCache(pieces)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class _TokenFile:
    """Packs documents into sequences; at most one batch of them, and of the documents' places, is in memory."""

    def __init__(self, folder: str, stem: str, kind: np.dtype, length: int) -> None:
        self.fs, root = _open(folder)
        self.name, self.base, self.kind, self.length = f"{folder}/{stem}", f"{root}/{stem}", kind, length
        value = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("tokens", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(f"{self.base}.tokens.arrow")
        self.out = ipc.new_file(self.sink, self.schema)
        self.docs_sink = self.fs.open_output_stream(f"{self.base}.docs.arrow")
        self.docs_out = ipc.new_file(self.docs_sink, DOCS)
        self.rest: list[np.ndarray] = []
        self.held = self.total = self.n_docs = 0
        self.docs: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.total, len(ids)))
        if len(self.docs) >= BATCH_DOCS:
            self._place()
        self.total += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BATCH_SEQUENCES * self.length:
            self._flush(False)

    def _place(self) -> None:
        self.docs_out.write_batch(pa.record_batch([pa.array(x, pa.int64()) for x in zip(*self.docs, strict=True)], schema=DOCS))
        self.n_docs += len(self.docs)
        self.docs = []

    def _flush(self, last: bool) -> None:
        flat = np.concatenate([*self.rest, np.zeros(0, self.kind)]).astype(self.kind)
        n = len(flat) // self.length * self.length
        body, self.rest = flat[:n], [flat[n:]]
        self.held = len(flat) - n
        mask = np.ones(n, bool)
        if last and self.held:
            pad = self.length - self.held
            body = np.concatenate([flat, np.zeros(pad, self.kind)])
            mask = np.concatenate([np.ones(len(flat), bool), np.zeros(pad, bool)])
        for k in range(0, len(body), BATCH_SEQUENCES * self.length):
            part = slice(k, k + BATCH_SEQUENCES * self.length)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[part]), self.length) for x in (body, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> tuple[str, int, int]:
        self._flush(True)
        self.out.close()
        self.sink.close()
        if self.docs:
            self._place()
        self.docs_out.close()
        self.docs_sink.close()
        return self.name, self.n_docs, self.total


def write(documents: DataFrame, path: str, folder: str, end_id: int = 2, length: int = LENGTH, buckets: int | None = None) -> DataFrame:
    """Writes the files into ``folder``; the manifest: ``bucket, path, n_docs, n_tokens, start``, in id order.

    ``start`` is the number of ids in all files before. ``folder`` is a URI of pyarrow's file systems that every executor reaches.
    """
    spark = documents.sparkSession
    short_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = buckets or max(parts, -(-(documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES))
    # Rows alike in all else are told apart by their place, so that no group of copies has to fit into a file.
    keys = {"_prefix": F.substring("text", 1, PREFIX), "_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns(keys)
    kind = np.dtype(np.uint16 if vocabulary_size(path) <= 1 << 16 else np.uint32)
    dealt = rows.repartitionByRange(n, "doc_id", *keys).sortWithinPartitions("doc_id", *keys).select("doc_id", "text", F.spark_partition_id().alias("bucket"))
    store = _open(folder)
    store[0].create_dir(store[1], recursive=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = encoder(path), np.array([end_id], np.int32)
        file, at = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(("bucket", "path", "n_docs", "n_tokens"), (at, *file.close())))], schema=pa.schema([("bucket", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            coded = cache.encode([x or "" for x in batch.column("text").to_pylist()])
            for doc_id, b, ids in zip(batch.column("doc_id").to_pylist(), batch.column("bucket").to_pylist(), coded):
                if b != at:
                    if file is not None:
                        yield done()
                    file, at = _TokenFile(folder, f"{b:08d}-{uuid.uuid4().hex}", kind, length), b
                file.add(doc_id, np.concatenate([np.frombuffer(ids, np.int32), end]).astype(kind))
        if file is not None:
            yield done()

    manifest = Written(dealt.mapInArrow(work, MANIFEST))
    total, listed = 0, []
    for r in sorted(manifest.df.collect(), key=lambda r: r["bucket"]):  # one row a file
        listed.append((r["bucket"], r["path"], r["n_docs"], r["n_tokens"], total))
        total += r["n_tokens"]
    return spark.createDataFrame(listed, f"{MANIFEST}, start long")


def _arrow(path: str) -> pa.ipc.RecordBatchFileReader:
    store, at = _open(path)
    return ipc.open_file(pa.memory_map(at) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(at))


class TokenReader:
    """Random access to one file: ``sequence(i)`` and ``mask(i)`` are views of the mapped file."""

    def __init__(self, base: str) -> None:
        self.file = _arrow(f"{base}.tokens.arrow")
        self.sizes = np.array([self.file.get_batch(i).num_rows for i in range(self.file.num_record_batches)], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.length = self.file.schema.field("tokens").type.list_size
        self.docs = _arrow(f"{base}.docs.arrow")

    def __len__(self) -> int:
        return int(self.first[-1])

    def _at(self, i: int) -> tuple[pa.RecordBatch, int]:
        b = int(np.searchsorted(self.first, i, "right")) - 1
        return self.file.get_batch(b), i - int(self.first[b])

    def sequence(self, i: int) -> np.ndarray:
        batch, k = self._at(i)
        return batch.column(0).values.to_numpy()[k * self.length : (k + 1) * self.length]

    def mask(self, i: int) -> pa.Array:
        batch, k = self._at(i)
        return batch.column(1)[k].values

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on; a view unless they cross a batch."""
        parts, per = [], self.length
        while n > 0:
            b = int(np.searchsorted(self.first * per, start, "right")) - 1
            flat = self.file.get_batch(b).column(0).values.to_numpy()
            got = flat[start - int(self.first[b]) * per :][:n]
            parts.append(got)
            start, n = start + len(got), n - len(got)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def read_documents(manifest: DataFrame) -> DataFrame:
    """From the files: ``doc_id, start`` (of the whole collection), ``n_tokens, ids_crc32``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                r = TokenReader(row["path"])
                for k in range(r.docs.num_record_batches):
                    docs = r.docs.get_batch(k)
                    start, size = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(r.ids(s, n).astype("<u4").tobytes()) for s, n in zip(start.tolist(), size.tolist())]
                    yield pa.record_batch([docs.column("doc_id"), pa.array(start + row["start"]), docs.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("path", "start").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def report(spark: SparkSession, documents: DataFrame, path: str) -> DataFrame:
    """The contract's columns for every row of ``documents``, from files in the shared scratch space, which go when the driver ends."""
    folder = f"{scratch(spark)}/helixbin-tokens-{uuid.uuid4().hex}"
    atexit.register(remove, spark, folder)
    return read_documents(write(documents, path, folder))
