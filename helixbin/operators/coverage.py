"""Coverage columns for chunks, joined by id or by position."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, numbered
from .kmer import slices
from ..sources.tables import coverage_csv, coverage_tsv, file_format


def by_id(bank: DataFrame, tables: list[DataFrame], prefix: str = "cov_") -> DataFrame:
    """``chunk_id`` and a column for each table (``chunk_id, value``); chunks without a value get null."""
    out = bank.select("chunk_id")
    for i, t in enumerate(tables):
        out = out.join(t.select("chunk_id", F.col("value").cast("double").alias(f"{prefix}{i}")), "chunk_id", "left")
    return out


def by_position(bank: DataFrame, values: DataFrame, order: str = "seq_ord") -> DataFrame:
    """``chunk_id, value``: the n-th value belongs to the n-th chunk; a difference in number is an error."""
    joined = numbered(bank.select(order, "chunk_id"), order, name="row").join(values.withColumnRenamed("row_ord", "row"), "row", "full")
    bad = joined.where("chunk_id IS NULL OR value IS NULL").limit(1).count()
    if bad:
        raise ValueError("the file has not as many values as the bank has chunks")
    return joined.select("chunk_id", "value")


def model(bank: DataFrame, files: list[str], prefix: str = "cov_") -> DataFrame:
    """Columns from CSV files (by position) and TSV files (by id); other kinds are skipped and take no number."""
    spark, tables = bank.sparkSession, []
    for path in files:
        kind = file_format(path)
        if kind == "CSV":
            tables.append(by_position(bank, coverage_csv(spark, path)))
        elif kind == "TSV":
            tables.append(coverage_tsv(spark, path))
    return by_id(bank, tables, prefix)


#: An external k-mer coverage program, its index and its look-up.
KMER_TOOL = "gattaca"
KMER_INDEX = ["index", "-k", "{k}", "-i", "{fasta}"]
KMER_LOOKUP = ["lookup", "-c", "{fasta}", "-i", "{fasta}.k{k}.gatc", "-o", "{output}", "-m"]


def kmer_coverage(fasta: str, output: str, k: int = 31, program: str = KMER_TOOL) -> str:
    """Median k-mer coverages of a FASTA file's sequences, as a CSV file for ``model``; an existing file is a cache hit."""
    if not Path(output).exists():
        if shutil.which(program) is None:
            raise FileNotFoundError(f"{program} is not installed")
        for args in (KMER_INDEX, KMER_LOOKUP):
            subprocess.run([program, *(a.format(k=k, fasta=fasta, output=output) for a in args)], check=True)
    return output


#: Letters of a minimizer, and the cells that minimizers are dealt into; letters and rows of a slice of the bank.
MINIMIZER, CELLS, SLICE_LETTERS, SLICE_ROWS = 13, 8192, 1 << 22, 1 << 16
#: k-mers of a bucket of cells on average, k-mers that are sorted together, and k-mers beyond which a cell's are counted one by one, by any number of tasks.
BUCKET, SORTED, HOT = 1_000_000, 1 << 19, 4_000_000
_CODE = np.full(256, 4, np.uint8)
_CODE[[ord(c) for c in "ACGT"]] = np.arange(4)


def _windows(codes: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """The windows of k letters, two bits each, all or those that begin ``at``: pairs of windows make ones of twice the length."""
    x, span = codes.astype(np.uint64) & np.uint64(3), 1
    while 2 * span <= k:
        x, span = (x[:-span] << np.uint64(2 * span)) | x[span:], 2 * span
    rest = k - span
    if at is not None:
        return (x[at] << np.uint64(2 * rest)) | x[at + rest] if rest else x[at]
    return (x[: len(x) - rest] << np.uint64(2 * rest)) | x[rest:] if rest else x


def _canonical(x: np.ndarray, k: int) -> np.ndarray:
    """The smaller of k-mers and their reverse complements: pairs of bits change places within bytes, then bytes do."""
    back = x ^ np.uint64((1 << 2 * k) - 1)
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        back = ((back >> np.uint64(shift)) & np.uint64(mask)) | ((back & np.uint64(mask)) << np.uint64(shift))
    return np.minimum(x, back.byteswap() >> np.uint64(64 - 2 * k))


def _scattered(x: np.ndarray) -> np.ndarray:
    """A hash, so that runs of one letter aren't everyone's minimizer."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _minimizers(codes: np.ndarray, k: int, m: int) -> np.ndarray:
    """The smallest hash of the canonical m-mers in each window of k letters."""
    low, span, window = _scattered(_canonical(_windows(codes, m), m)), 1, k - m + 1
    while 2 * span <= window:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    rest = window - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _pieces(batch: pa.RecordBatch, k: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters and codes of all rows; owner, start, k-mers and minimizer of each super-k-mer, which has no N)."""
    seqs = [(s or "").encode("latin-1", "replace") for s in batch.column("seq").to_pylist()]
    data = b"\n".join(seqs)  # no k-mer reaches over the break
    codes = _CODE[np.frombuffer(data, np.uint8)]
    if len(codes) < k:
        return data, codes, *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64)
    bad = np.concatenate([[0], np.cumsum(codes == 4)])
    good = bad[k:] == bad[:-k]
    low = _minimizers(codes, k, min(MINIMIZER, k))
    edge = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (good[1:] != good[:-1])]))
    size = np.diff(edge, append=len(good))
    edge, size = edge[good[edge]], size[good[edge]]
    first = np.cumsum([0, *(len(s) + 1 for s in seqs)])[:-1]
    return data, codes, np.searchsorted(first, edge, "right") - 1, edge, size, low[edge]


def super_kmers(bank: DataFrame, k: int, buckets: int) -> DataFrame:
    """``chunk_id, bucket, n, letters``: the longest pieces of n neighbouring k-mers with one minimizer; the minimizer gives the bucket.

    A k-mer and its reverse complement have the same minimizer, so all occurrences of a canonical k-mer meet in one bucket.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            data, _, owner, edge, size, low = _pieces(batch, k)
            yield pa.record_batch(
                [batch.column("chunk_id").take(pa.array(owner)), pa.array((low % np.uint64(buckets)).astype(np.int64)), pa.array(size.astype(np.int32)), pa.array([data[a:b] for a, b in zip(edge.tolist(), (edge + size + k - 1).tolist())], pa.binary())],
                names=["chunk_id", "bucket", "n", "letters"],
            )

    return bank.select("chunk_id", "seq").mapInArrow(work, "chunk_id string, bucket long, n int, letters binary")


def _binaries(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """The values from each of ``first`` on to the next as one binary."""
    ends = np.append(first, len(values)) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _joined(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``first, first + 1, ...`` of each size, one after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


_DEALT = "slice long, cell int, n long, chunks array<string>, owners binary, sizes binary, letters binary"


def dealt(bank: DataFrame, k: int) -> DataFrame:
    """``slice, cell, n, chunks, owners, sizes, letters``: the super-k-mers of a slice of the bank, a row for each cell that their minimizers lie in.

    A row has its pieces' owners (numbers of rows within the slice), numbers of k-mers, and letters, four a byte, each piece beginning with a
    byte. The row of cell -1 has the slice's chunk ids.
    """

    def one(number: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows, at = [], 0, 0
        for part in parts:
            _, codes, owner, edge, size, low = _pieces(part, k)
            found.append((codes, owner + rows, edge + at, size, (low % np.uint64(CELLS)).astype(np.uint16)))
            rows, at = rows + part.num_rows, at + len(codes)
        codes, owner, edge, size, cell = map(np.concatenate, zip(*found))
        ids = pa.array([[i for part in parts for i in part.column("chunk_id").to_pylist()]], pa.list_(pa.string()))
        none = pa.nulls(1, pa.binary())
        yield pa.record_batch([pa.array([number]), pa.array([-1], pa.int32()), pa.array([0]), ids, none, none, none], names=names)
        if not len(cell):
            return
        order = np.argsort(cell, kind="stable")
        owner, edge, size, cell = owner[order], edge[order], size[order], cell[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        length = (size + k + 2) // 4 * 4
        four = codes[np.minimum(_spread(edge.astype(np.int32), length.astype(np.int32)), len(codes) - 1)].reshape(-1, 4) & 3
        letters = four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]
        columns = [pa.array(np.full(len(first), number)), pa.array(cell[first].astype(np.int32)), pa.array(np.add.reduceat(size, first)), pa.nulls(len(first), pa.list_(pa.string()))]
        columns += [_binaries(owner.astype(np.int32), first), _binaries(size.astype(np.int32), first), _binaries(letters, (np.cumsum(length) - length)[first] // 4)]
        yield pa.record_batch(columns, names=names)

    names = [c.split()[0] for c in _DEALT.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, letters, rows = TaskContext.get().partitionId() << 32, [], 0, 0
        for part in (part for whole in batches for part in slices(whole)):
            held.append(part)
            letters, rows = letters + part.column("seq").nbytes, rows + part.num_rows
            if letters >= SLICE_LETTERS or rows >= SLICE_ROWS:
                yield from one(number, held)
                number, held, letters, rows = number + 1, [], 0, 0
        if held:
            yield from one(number, held)

    return bank.select("chunk_id", "seq").mapInArrow(work, _DEALT)


def _kmers_of(rows: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(canonical k-mers of rows of ``dealt``, one after the other; the pieces' first k-mers, owners and rows)."""
    sizes, owners = _joined(rows.column("sizes"), np.int32).astype(np.int64), _joined(rows.column("owners"), np.int32)
    packed = _joined(rows.column("letters"), np.uint8)
    codes = np.stack([packed >> 6, packed >> 4, packed >> 2, packed], 1).ravel()
    length = (sizes + k + 2) // 4 * 4
    pieces = [len(x) // 4 for x in rows.column("owners").to_pylist()]
    at = _spread(np.cumsum(length) - length, sizes)
    return _canonical(_windows(codes, k, at), k), np.cumsum(sizes) - sizes, owners, np.repeat(np.arange(rows.num_rows), pieces)


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of small numbers, and how often each occurs; as one number each, since rows sort ten times slower."""
    width = int(b.max(initial=0)) + 1
    found, n = np.unique(a.astype(np.int64) * width + b, return_counts=True)
    return *np.divmod(found, width), n


_COUNTED = "slice long, owners binary, counts binary, ns binary"


def _by_slice(number: np.ndarray, owner: np.ndarray, count: np.ndarray, n: np.ndarray) -> pa.Table:
    """Counts of rows that are sorted by slice, a row a slice."""
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.zeros(0, np.int64)
    columns = [_binaries(x.astype(kind), first) for x, kind in ((owner, np.int32), (count, np.int64), (n, np.int32))]
    return pa.table([pa.array(number[first]), *columns], names=["slice", "owners", "counts", "ns"])


def _counted(bank: DataFrame, k: int) -> DataFrame:
    """``slice, chunks, owners, counts, ns``: rows of how often the k-mers of a slice's chunks occur in the whole bank, and a row of its chunk ids.

    Super-k-mers are shuffled once, by the cell of their minimizer, and a cell's k-mers are counted and looked up together. A cell of more than
    ``HOT`` k-mers is split into single k-mers, summed before they are shuffled and joined with their sums.
    """
    if not 1 <= k <= 31:
        raise ValueError("k has to lie between 1 and 31")
    spark = bank.sparkSession
    whole = cut(dealt(bank, k))
    pieces = whole.where("cell >= 0").drop("chunks")
    size = sorted(pieces.groupBy("cell").agg(F.sum("n").alias("n")).collect())  # a row a cell
    hot = [r["cell"] for r in size if r["n"] > HOT]
    places, total = [], 0
    for r in size:
        if r["n"] <= HOT:
            places.append((r["cell"], total // BUCKET))
            total += r["n"]
    place = F.broadcast(spark.createDataFrame(places, "cell int, bucket long"))

    def counted(group: pa.Table) -> pa.Table:
        group = group.sort_by([("cell", "ascending"), ("slice", "ascending")])
        cell, n, out = group.column("cell").to_numpy(), group.column("n").to_numpy(), []
        start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        batch = (np.cumsum(n) - n)[start] // SORTED  # of whole cells
        edges = [*start[np.flatnonzero(np.concatenate([[True], batch[1:] != batch[:-1]]))].tolist(), len(cell)]
        for at, end in zip(edges, edges[1:]):
            rows = group.slice(at, end - at).sort_by("slice")
            kmers, first, owner, row = _kmers_of(rows, k)
            _, inverse, times = np.unique(kmers, return_inverse=True, return_counts=True)
            count = times[inverse]
            new = np.concatenate([[True], count[1:] != count[:-1]])
            new[first] = True
            edge = np.flatnonzero(new)
            piece = np.searchsorted(first, edge, "right") - 1
            out.append(_by_slice(rows.column("slice").to_numpy()[row[piece]], owner[piece], count[edge], np.diff(edge, append=len(kmers))))
        return pa.concat_tables(out)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                kmers, first, owner, _ = _kmers_of(batch.slice(i, 1), k)
                own, at, n = _pairs(np.repeat(owner, np.diff(first, append=len(kmers))), (found := np.unique(kmers, return_inverse=True))[1])
                yield pa.record_batch([pa.array(np.full(len(own), batch.column("slice")[i].as_py())), pa.array(own), pa.array(found[0][at].view(np.int64)), pa.array(n)], names=["slice", "owner", "kmer", "n"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("slice", "owner", "count", "n")]
            order = np.argsort(columns[0], kind="stable")
            yield from _by_slice(*(x[order] for x in columns)).to_batches()

    out = pieces.join(place, "cell").groupBy("bucket").applyInArrow(counted, _COUNTED)
    if hot:
        each = cut(pieces.where(F.col("cell").isin(hot)).select("slice", "owners", "sizes", "letters").mapInArrow(single, "slice long, owner long, kmer long, n long"))
        sums = each.groupBy("kmer").agg(F.sum("n").alias("count"))
        out = out.unionByName(each.join(sums, "kmer").select("slice", "owner", "count", "n").mapInArrow(together, _COUNTED))
    return whole.where("cell < 0").select("slice", "chunks").unionByName(out, allowMissingColumns=True)


def _sums(group: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(the slice's chunk ids; owner, count and number of k-mers, in the order of owners and counts)."""
    owner, count, n = (_joined(group.column(c), kind) for c, kind in (("owners", np.int32), ("counts", np.int64), ("ns", np.int32)))
    order = np.lexsort((count, owner))
    owner, count, n = owner[order], count[order], n[order].astype(np.int64)
    new = np.concatenate([np.ones(min(1, len(owner)), bool), (owner[1:] != owner[:-1]) | (count[1:] != count[:-1])])
    first = np.flatnonzero(new)
    chunks = pa.array([i for ids in group.column("chunks").to_pylist() if ids is not None for i in ids], pa.string())
    return chunks, owner[first], count[first], np.add.reduceat(n, first) if len(first) else n


def _repeated(counted: DataFrame) -> bool:
    """Whether some chunk id stands in several rows of the bank."""
    return bool(counted.where("chunks IS NOT NULL").select(F.explode("chunks").alias("c")).groupBy("c").count().where("count > 1").limit(1).count())


def _long(counted: DataFrame, repeated: bool) -> DataFrame:
    def work(group: pa.Table) -> pa.Table:
        chunks, owner, count, n = _sums(group)
        return pa.table({"chunk_id": chunks.take(pa.array(owner)), "count": pa.array(count), "n": pa.array(n)})

    out = counted.groupBy("slice").applyInArrow(work, "chunk_id string, count long, n long")
    return out.groupBy("chunk_id", "count").agg(F.sum("n").alias("n")) if repeated else out


def kmer_counts_by_chunk(bank: DataFrame, k: int = 31) -> DataFrame:
    """``chunk_id, count, n``: n of the chunk's k-mers occur ``count`` times in the whole bank, strands alike; k-mers with N don't count."""
    counted = _counted(bank, k)
    return _long(counted, _repeated(counted))


def from_kmers(bank: DataFrame, k: int = 31) -> DataFrame:
    """``chunk_id, value``: the exact median, over a chunk's k-mers, of how often each occurs in the bank; 0 for a chunk without k-mers."""
    counted = _counted(bank, k)
    if _repeated(counted):
        medians = _long(counted, True).groupBy("chunk_id").agg(F.percentile("count", F.lit(0.5), F.col("n")).alias("value"))
        return bank.select("chunk_id").join(medians, "chunk_id", "left").select("chunk_id", F.coalesce("value", F.lit(0.0)).alias("value"))

    def work(group: pa.Table) -> pa.Table:
        chunks, owner, count, n = _sums(group)
        value = np.zeros(len(chunks))
        if len(owner):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            ends, size = np.cumsum(n), np.add.reduceat(n, first)
            before = (ends - n)[first]
            middle = lambda at: count[np.searchsorted(ends, before + at, "right")]
            value[owner[first]] = (middle((size - 1) // 2) + middle(size // 2)) / 2
        return pa.table({"chunk_id": chunks, "value": pa.array(value)})

    return counted.groupBy("slice").applyInArrow(work, "chunk_id string, value double")
