r"""MinHash near-dedup with tensored banding, exact verification and connected components.

A document's set holds its distinct w-word shingles (words ``[^\x20\x09-\x0D]+``, A-Z lower-cased); with
fewer words the whole sequence is one shingle. Null texts and texts without words have an empty set and
link with nothing. Documents link if the Jaccard similarity of their full sets reaches the threshold.

1. ``signatures``: two small collections of m half keys, each made of k minhashes, and a sketch of ``SKETCH`` bytes.
   Documents of equal sets form a class; only its smallest id goes on.
2. ``table_keys``: m*m tables, keyed by pairs of half keys, one from each collection: 2*m*k minhashes do the
   work of m*m*2*k. Half keys that no other document has are dropped before the pairs are formed. A pair at similarity s
   is missed with probability at most 2*(1-s^k)^m (0.00005 at 0.8 for the defaults).
3. ``family_links``: candidates, that share a table key, are checked by their sketches; only those whose estimate reaches
   ``ALIKE`` (over five standard deviations below 0.8) make families, so that documents which share a template don't percolate into
   one. A document is compared with the smallest id of all its buckets, then with those of buckets that this leaves in another
   family; buckets that are still in several families are compared in full, in blocks that return forests, and the buckets of
   one half key at once where that makes fewer pairs.
4. ``verified_links``: candidates are confirmed on full sets of 128-bit shingles, within families. Families beyond a block
   are compared with up to ``LEADERS`` of their members first; what links to these is done with each other, and only the rest
   is compared with everything, a pair of blocks a task. No pairs are emitted; no family has to fit into a task.
5. The components of the verified links are the classes.

A shingle's key is mixed from its words' 128-bit hashes, so different shingles differ however their letters are arranged. Very
long texts are cut into shingles whole. Rows of equal id are one document, linked by any of its texts; rows with a null id keep
a row of their own with a null component and link with nothing. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, components, short_batches

M, K = 14, 3
SKETCH = 84
ALIKE = 0.55
LEADERS = 8
SEED = 7919
BLOCK_DOCS = 1024
BLOCK_SHINGLES = 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text as two 64-bit keys each, ascending by the first."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    lanes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
    width = min(width, len(words))
    n = len(words) - width + 1
    keys = []
    for lane in (0, 1):
        # The words' digests times an odd number for each place: 128 bits that depend on every word and on their order.
        word = np.ascontiguousarray(lanes[:, lane])
        odd = _mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(SEED + lane)) | np.uint64(1)
        x = np.full(n, np.uint64(width), np.uint64)
        for i in range(width):
            x += word[i : i + n] * odd[i]
        keys.append(x)
    a, b = _mix(keys[0]), keys[1]
    order = np.argsort(a)
    a, b = a[order], b[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    return a[new], b[new]


def minhashes(keys: np.ndarray, n: int) -> np.ndarray:
    """``n`` minima of independent 32-bit mixes of the upper halves of a set's keys, a slice of the keys at a time.

    Keys that meet in 32 bits can only add candidates, which are verified.
    """
    half = (keys >> np.uint64(32)).astype(np.uint32)
    seeds = (_mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD) >> np.uint64(32)).astype(np.uint32)[:, None]
    out = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(half), 1024):
        x = half[None, k : k + 1024] ^ seeds
        x *= np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA77)
        np.minimum(out, x.min(1), out=out)
    return out.astype(np.uint64)


def half_keys(keys: np.ndarray, m: int, k: int) -> np.ndarray:
    """The 2*m half keys of a set: the first m are one collection, the rest the other."""
    return _halves(minhashes(keys, 2 * m * k), m, k)


def _halves(mins: np.ndarray, m: int, k: int) -> np.ndarray:
    mins = mins.reshape(2 * m, k)
    out = np.zeros(2 * m, np.uint64)
    for i in range(k):
        out = _mix(out * _ODD + mins[:, i])
    return out.view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, m: int = M, k: int = K) -> DataFrame:
    """``id, n_shingles, class_a, class_b`` (128 bits of the set's digest) ``, half`` array<long> of 2*m half keys, ``sketch``."""
    short_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, halves, sketches = [], [], [], []
            for text in batch.column("text").to_pylist():
                keys, more = shingles(text, width)
                sizes.append(len(keys))
                if len(keys):
                    digests.append((int(_mix(keys ^ _mix(more)).sum(dtype=np.uint64).view(np.int64)), int(_mix(more * _ODD + np.uint64(1)).sum(dtype=np.uint64).view(np.int64))))
                    mins = minhashes(keys, max(2 * m * k, SKETCH))
                    halves.append(_halves(mins[: 2 * m * k], m, k))
                    sketches.append((mins[:SKETCH] & np.uint64(255)).astype(np.uint8).tobytes())
                else:
                    digests.append((None, None))
                    halves.append(None)
                    sketches.append(None)
            flat = np.concatenate([h for h in halves if h is not None] or [np.zeros(0, np.int64)])
            ends = np.cumsum([0, *(0 if h is None else 2 * m for h in halves)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array([a for a, _ in digests], pa.int64()), pa.array([b for _, b in digests], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(sketches, pa.binary())],
                names=["id", "n_shingles", "class_a", "class_b", "half", "sketch"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "id long, n_shingles long, class_a long, class_b long, half array<long>, sketch binary")


def shared_halves(reps: DataFrame, m: int = M) -> DataFrame:
    """``id, a, b``: the half keys of each collection that some other document has too, with their places.

    A table key that two documents share is made of half keys that both share, so the others can go before
    the m*m combinations are formed.
    """
    rows = reps.select("id", F.posexplode("half").alias("place", "half"))
    common = rows.groupBy("place", "half").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("place", "half")
    own = rows.join(common, ["place", "half"]).groupBy("id").agg(F.sort_array(F.collect_set(F.struct("place", "half"))).alias("x"))  # 2*m at most for a text
    return own.select("id", F.filter("x", lambda h: h["place"] < m).alias("a"), F.filter("x", lambda h: h["place"] >= m).alias("b"))


def table_keys(halves: DataFrame, sides: bool = False) -> DataFrame:
    """``halves`` with ``key`` for each pair of half keys, one from each collection; equal only within a table. With ``sides``, ``side`` tells the first of the two."""
    key = lambda a, b: F.xxhash64(a["place"], a["half"], b["place"], b["half"])
    both = lambda a, b: F.struct(F.xxhash64(a["place"], a["half"]).alias("side"), key(a, b).alias("key"))
    made = F.explode(F.flatten(F.transform("a", lambda a: F.transform("b", lambda b: (both if sides else key)(a, b)))))
    kept = [c for c in halves.columns if c not in ("a", "b")]
    return halves.select(*kept, made.alias("e")).select(*kept, "e.*") if sides else halves.select(*kept, made.alias("key"))


def fewest_meetings(members: DataFrame) -> DataFrame:
    """``key, id, c, n``: groups in which all those meet that meet in the buckets of ``members`` (``key, side, id, c``, and ``n`` of the bucket).

    Documents that share a passage meet again in most buckets of a half key. Where all documents of its buckets make no more pairs than the
    buckets one by one, they meet once, as one group, so that a document is in 2*m groups or fewer and not in m*m.
    """
    members = Written(members).df
    once = Written(members.groupBy("side", "id").agg(F.min("c").alias("c"), F.sum("n").alias("pairs"))).df
    sizes = once.groupBy("side").agg(F.count("*").alias("n"), F.sum("pairs").alias("pairs"))
    merged = Written(sizes.where("n * n <= pairs").select("side", "n")).df
    apart = members.join(merged, "side", "left_anti").select("key", "id", "c", "n")
    return apart.unionByName(once.join(merged, "side").select(F.col("side").alias("key"), "id", "c", "n"))


def _estimates(a: pa.Array, b: pa.Array) -> np.ndarray:
    """The share of equal bytes of sketches, row by row."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, SKETCH) for c in (a, b))
    return (x == y).mean(1)


def family_links(halves: DataFrame, sketches: DataFrame, block_docs: int) -> DataFrame:
    """``id, low``: links whose components hold every candidate pair with an estimate of ``ALIKE`` or more.

    ``halves``: ``id, a, b`` of ``shared_halves``; ``sketches``: ``id, sketch``. A document's component goes along as its keys are formed,
    so that a bucket tells by itself whether it holds several, and pairs are formed in such buckets alone.
    """
    short_batches(halves.sparkSession, 4096)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = _estimates(batch.column("sketch"), batch.column("other")) >= ALIKE
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("low"), pa.array(good)], names=["id", "low", "alike"])

    def judged(pairs: DataFrame) -> DataFrame:
        """Those ``pairs`` that are alike."""
        rows = pairs.join(sketches, "id").join(sketches.select(F.col("id").alias("low"), F.col("sketch").alias("other")), "low")
        return Written(rows.select("id", "low", "sketch", "other").mapInArrow(judge, "id long, low long, alike boolean")).df.where("alike").select("id", "low")

    def keyed(links: DataFrame, sides: bool = False) -> DataFrame:
        """``id, c, key``: keys with the component of ``links`` that a document is in; with their ``side`` if asked for."""
        of = components(links, "id", "low").select(F.col("node").alias("id"), F.col("component").alias("c"))
        return table_keys(Written(halves.join(of, "id", "left").withColumn("c", F.coalesce("c", "id"))).df, sides)

    def still_open(keys: DataFrame) -> DataFrame:
        """``key, first, n`` of the buckets that hold several components."""
        several = keys.groupBy("key").agg(F.min(F.struct("id", "c")).alias("first"), F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("n"))
        return Written(several.where("least < most").select("key", "first", "n")).df

    keys = table_keys(halves)
    buckets = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key", "low")
    alike = judged(keys.join(buckets, "key").where("id <> low").groupBy("id").agg(F.min("low").alias("low")))
    keys = keyed(alike)
    open_keys = still_open(keys)
    pairs = keys.join(open_keys, "key").where("c <> first.c").select("id", F.col("first.id").alias("low")).distinct()
    alike = alike.unionByName(judged(pairs))
    if not open_keys.where("n > 2").limit(1).count():
        return alike
    # A bucket of two has been compared; larger ones are open where they still hold several components.
    keys = keyed(alike, sides=True)
    some = still_open(keys).where("n > 2")
    if not some.limit(1).count():
        return alike
    members = fewest_meetings(keys.join(some.select("key", "n"), "key")).withColumn("blocks", F.ceil(F.col("n") / block_docs).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    members = members.join(sketches, "id").select("key", "id", "c", "sketch", "block", F.explode(_meetings(F.lit(0), F.col("blocks"), F.col("block"))).alias("at"))

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, c = group.column("id").to_numpy(), group.column("c").to_numpy()
        far = group.column("block").to_numpy() != group.column("i")[0].as_py()
        x = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        label, across = np.arange(len(ids)), bool(far.any())
        for a in range(len(ids)):
            if across and far[a]:
                continue
            other = np.flatnonzero((c != c[a]) & far) if across else a + 1 + np.flatnonzero(c[a + 1 :] != c[a])
            hit = other[(x[other] == x[a]).mean(1) >= ALIKE] if len(other) else other
            _unite(label, hit, a)
        moved = label != np.arange(len(ids))
        return pa.table({"id": pa.array(ids[moved], pa.int64()), "low": pa.array(ids[label[moved]], pa.int64())})

    open_links = members.select("key", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "block", "id", "c", "sketch").groupBy("key", "i", "j").applyInArrow(compare, "id long, low long")
    return alike.unionByName(open_links)


def _unite(label: np.ndarray, hit: np.ndarray, a: int) -> None:
    roots = np.unique(np.append(label[hit], label[a]))
    if len(roots) > 1:
        label[np.isin(label, roots)] = roots[0]


def _meetings(open_blocks, blocks, block):
    """The pairs of blocks (i <= j) that a row of ``block`` takes part in: with every block; with the first ``open_blocks`` alone for a block beyond those (0: all are open)."""
    last = F.when((open_blocks > 0) & (block >= open_blocks), open_blocks).otherwise(blocks) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda j: F.struct(F.least(block, j).alias("i"), F.greatest(block, j).alias("j")))


def _linked(sets: list[tuple[np.ndarray, np.ndarray]], side: np.ndarray, percent: int) -> np.ndarray:
    """Component labels of the documents of one task; ``side`` keeps pairs of one block to that block's own task.

    Overlaps come from an inverted index over the task's shingles: a document's postings, counted at once.
    """
    n = len(sets)
    sizes = np.array([len(s) for s, _ in sets], np.int64)
    flat, more = (np.concatenate([s[i] for s in sets]) for i in (0, 1))
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    by, rest = flat[order], more[order]
    if ((by[1:] == by[:-1]) & (rest[1:] != rest[:-1])).any():
        order = np.lexsort((more, flat))
        by, rest = flat[order], more[order]
    new = np.append(True, (by[1:] != by[:-1]) | (rest[1:] != rest[:-1]))
    local = np.empty(len(flat), np.int64)
    local[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(flat)))
    by_key = owner[order]
    start = np.concatenate([[0], np.cumsum(sizes)])
    label = np.arange(n)
    across = bool((side != side[0]).any())
    for a in range(n):
        if across and side[a]:
            continue
        own = local[start[a] : start[a + 1]]
        own = own[length[own] > 1]
        if not len(own):
            continue
        runs = length[own]
        at = np.repeat(first[own] - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
        shared = np.bincount(by_key[at], minlength=n)
        hit = np.flatnonzero(100 * shared >= percent * (sizes[a] + sizes - shared))
        _unite(label, hit[side[hit] == 1] if across else hit, a)
    return label


def verified_links(docs: DataFrame, families: DataFrame, width: int, percent: int, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``id, low``: links that span the same components as all links within families.

    ``docs``: ``id, text``; ``families``: ``id, family, n_shingles``.
    """

    def work(group: pa.Table) -> pa.Table:
        ids, side = group.column("id").to_numpy(), group.column("side").to_numpy()
        order = np.lexsort((side, ids))
        ids, text = ids[order], group.column("text").to_pylist()
        label = _linked([shingles(text[i], width) for i in order], side[order], percent)
        moved = label != np.arange(len(ids))
        return pa.table({"id": pa.array(ids[moved], pa.int64()), "low": pa.array(ids[label[moved]], pa.int64())})

    def compared(rows: DataFrame) -> DataFrame:
        return rows.select("family", "i", "j", "id", "text", "side").groupBy("family", "i", "j").applyInArrow(work, "id long, low long")

    size = F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n_shingles") / block_shingles)).cast("int")
    sizes = families.groupBy("family").agg(size.alias("blocks"))
    placed = families.join(sizes, "family").select("id", "family", "n_shingles", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    # Never a broadcast: the families grow with the documents.
    texts = Written(docs.join(placed.hint("merge"), "id"))
    side = F.lit(0).alias("side")
    links = compared(texts.df.where("blocks = 1").select("*", F.lit(0).alias("i"), F.lit(0).alias("j"), side))
    large = texts.df.where("blocks > 1")
    if not large.limit(1).count():
        return links
    # Up to LEADERS members of a large family meet each of its blocks.
    chosen = large.groupBy("family", F.pmod("block", F.lit(LEADERS)).alias("part")).agg(F.min("id").alias("id")).select("family", "id")
    leaders = large.join(chosen, ["family", "id"], "left_semi").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = large.select("*", F.col("block").alias("i"), F.lit(0).alias("j"), F.lit(1).alias("side"))
    told = Written(compared(members.unionByName(leaders.select(*large.columns, "i", F.lit(0).alias("j"), side))))
    of = components(told.df, "id", "low").select(F.col("node").alias("id"), "component")
    state = large.select("id", "family", "n_shingles").join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
    # The largest component of a family is done with itself; the others are compared with everything.
    chief = state.groupBy("family", "component").agg(F.count("*").alias("n")).groupBy("family").agg(F.max(F.struct("n", F.col("component"))).alias("m")).select("family", F.col("m.component").alias("component"), F.lit(True).alias("done"))
    state = state.join(chief, ["family", "component"], "left").withColumn("done", F.coalesce("done", F.lit(False)))
    split = Written(state.select("id", "family", "n_shingles", "done"))
    counts = split.df.groupBy("family", "done").agg(size.alias("blocks")).groupBy("family").agg(*(F.coalesce(F.max(F.when(F.col("done") == d, F.col("blocks"))), F.lit(0)).alias(c) for d, c in ((False, "rest"), (True, "own"))))
    dealt = split.df.join(counts.where("rest > 0"), "family").distinct()
    dealt = dealt.select("id", "family", "rest", (F.col("rest") + F.col("own")).alias("all"), F.when(F.col("done"), F.col("rest") + F.pmod(F.xxhash64("id"), F.col("own"))).otherwise(F.pmod(F.xxhash64("id"), F.col("rest"))).cast("int").alias("b"))
    met = large.select("id", "text").join(dealt, "id").select("family", "id", "text", "b", F.explode(_meetings(F.col("rest"), F.col("all"), F.col("b"))).alias("at"))
    rest = compared(met.select("family", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "id", "text", (F.col("b") != F.col("at.i")).cast("int").alias("side")))
    return links.unionByName(told.df).unionByName(rest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, m: int = M, k: int = K, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per input row: ``id_col, n_shingles, component_id`` (smallest id reachable by links), ``kept``."""
    sig = Written(signatures(docs, id_col, text_col, width, m, k))
    one, digest = ["id", "class_a", "class_b"], ["class_a", "class_b"]
    real = sig.df.where("n_shingles > 0 AND id IS NOT NULL")
    classes = real.groupBy(*digest).agg(F.min("id").alias("id"))
    reps = Written(classes.join(sig.df.select(*one, "n_shingles", "half", "sketch"), one).dropDuplicates(one))
    # An id that stands for several classes has one sketch for each; they are told apart as points of their own.
    points = reps.df.select("id", "half", "sketch").withColumn("point", F.monotonically_increasing_id())
    points = Written(points)
    halves = Written(shared_halves(points.df.select(F.col("point").alias("id"), "half"), m))
    near = family_links(halves.df, points.df.select(F.col("point").alias("id"), "sketch"), block_docs)
    families = components(near, "id", "low").select(F.col("node").alias("point"), F.col("component").alias("family"))
    families = families.join(points.df.select("point", "id"), "point").groupBy("id").agg(F.collect_set("family").alias("f"))  # an id's classes at most
    families = families.join(reps.df.groupBy("id").agg(F.sum("n_shingles").alias("n_shingles")), "id").select("id", F.explode("f").alias("family"), "n_shingles")
    families = Written(families)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    links = verified_links(texts.where("id IS NOT NULL"), families.df, width, percent, block_docs)
    # Classes of one id are one document: their representatives are linked.
    many = real.groupBy("id").agg(F.min(F.struct(*digest)).alias("x"), F.max(F.struct(*digest)).alias("y")).where("x <> y").select("id")
    own = real.join(many, "id", "left_semi").select(*one).join(reps.df.select(F.col("id").alias("rep"), *digest), digest).select("id", "rep").distinct()
    same = own.join(own.groupBy("id").agg(F.min("rep").alias("low")), "id").where("rep <> low").select(F.col("rep").alias("id"), "low")
    joined = components(links.unionByName(same), "id", "low").select(F.col("node").alias("rep"), "component")
    table = reps.df.select(F.col("id").alias("rep"), *digest).join(joined, "rep", "left")
    out = sig.df.select("id", "n_shingles", *digest).join(table, digest, "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "rep", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def report(documents: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``documents``: 4-word shingles, 80 percent."""
    return near_duplicates(documents.select("doc_id", "text"), width=4, percent=80)


def oracle(width: int = 4, percent: int = 80) -> str:
    """The same rows in DuckDB's SQL: every pair that shares a shingle, then the links' closure."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+{width - 1}], ' ') AS sh FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - {width - 1}))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.node = e.a),
k AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM k LEFT JOIN n USING (doc_id)"""
