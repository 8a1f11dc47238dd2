"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model's units are characters, unfolded, its order is 4, with one model for each language and a pooled one, ``*``, for
languages without trusted text.

1. ``requests``: every distinct 4-gram of each split of the input files, of all rows, with its count in trusted rows. A split is
   what one task reads; its n-grams are summed there, so the table that is shuffled holds no repeats of a split.
2. ``probabilities``: sharded count joins. Lower orders are continuation counts of the order above. Count tables are sharded by
   (lang, context) and joined with their context's totals, then by (lang, suffix) with the order below; discounts come from
   counts of counts.
3. ``resolved``: the requested n-grams are joined with the seen ones; the others with their context's weight and, as distinct
   suffixes, with the order below, down to the unknown character. ``answers`` joins the probabilities back to the splits.
4. ``score``: a second pass over the texts adds up log probabilities from the answers of its own split.
5. ``classify``: a document is kept if its perplexity is at most its language's threshold: the ``QUANTILE`` of the
   perplexities of that language's trusted rows that were held out of training, those whose crc32(doc_id as text) mod ``HOLD``
   is 0. Languages with fewer than ``MIN_HELD`` such rows take the pooled quantile if that is higher; without any such row it is
   the trusted rows' own.

Trusted rows are those with quality 1 in ``labels``. Null languages count as ``und``. Null and empty texts have
no perplexity and are not kept; texts of any length are scored whole. A NUL counts as U+0001. Repeated rows count each; null ids are
scored and never trusted. Without any trusted text nothing has a perplexity. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import io
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, remove, scratch, short_batches

ORDER = 4
BITS = 15
START = 0x10FFFF  # stands before a text
QUANTILE = 0.995
HOLD = 5
MIN_HELD = 100
FLUSH = 3_000_000
BROADCAST_ROWS = 2_000_000
BROADCAST_LANGS = 100_000
POOLED = "*"


class Alphabet:
    """Numbers for the letters met so far, at most 32767, so that a 4-gram fits into 60 bits."""

    def __init__(self, bits: int = BITS) -> None:
        self.bits = bits
        self.place = np.zeros(START + 1, np.int64)
        self.letters = np.array([START], np.uint32)

    def codes(self, texts: list[str]) -> np.ndarray | None:
        """The letters of all texts, ``ORDER - 1`` blanks (0) before each; None if they don't fit."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        points = np.maximum(points, 1)
        out = self.place[points]
        new = np.unique(points[(out == 0) & (points != START)])
        if len(new):
            if len(self.letters) + len(new) > 1 << self.bits:
                return None
            self.place[new] = np.arange(len(self.letters), len(self.letters) + len(new))
            self.letters = np.concatenate([self.letters, new.astype(np.uint32)])
            out = self.place[points]
        sizes = np.array([len(t) for t in texts], np.int64)
        at = np.arange(len(out)) + np.repeat(np.arange(1, len(texts) + 1) * (ORDER - 1), sizes)
        flat = np.zeros(len(out) + len(texts) * (ORDER - 1), np.int64)
        flat[at] = out
        gram = out.copy()
        for k in range(1, ORDER):
            gram |= flat[at - k] << (self.bits * k)
        return gram

    def strings(self, gram: np.ndarray) -> list[str]:
        places = (gram[:, None] >> (self.bits * np.arange(ORDER - 1, -1, -1))) & ((1 << self.bits) - 1)
        return np.ascontiguousarray(self.letters[places]).view(f"<U{ORDER}").ravel().tolist()


def plain_grams(text: str) -> list[str]:
    """The 4-gram that ends at each character."""
    padded = chr(START) * (ORDER - 1) + text.replace("\0", "\1")
    return [padded[i : i + ORDER] for i in range(len(text))]


def _lang() -> Column:
    return F.coalesce(F.col("lang"), F.lit("und"))


def located(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, lang, text, trusted`` (0, 1, or 2 for held out) and ``split``, what a task reads of a file.

    A table that isn't read from files is written to the shared scratch space first. Trusted ids are broadcast up to a checked
    number of rows; beyond it their join with the documents is written.
    """
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = good.withColumn("trusted", F.when(F.crc32(F.col("doc_id").cast("string")) % HOLD == 0, 2).otherwise(1))
    names = [F.col("doc_id").cast("long").alias("doc_id"), _lang().alias("lang"), "text"]
    split = F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("split")
    flag = F.coalesce("trusted", F.lit(0)).alias("trusted")
    if good.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        rows = documents.select(*names).join(good, "doc_id", "left").select("doc_id", "lang", "text", flag)
        return Written(rows).df.select("*", split)
    try:
        rows = documents.select(*names, split)
    except AnalysisException:
        rows = Written(documents.select(*names)).df.select("*", split)
    return rows.join(F.broadcast(good), "doc_id", "left").select("doc_id", "lang", "text", flag, "split")


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, dict[str, list[int]]]]:
    """Rows with text by language, for each split of a batch, in order."""
    split, lang, text = (batch.column(c).to_pylist() for c in ("split", "lang", "text"))
    i = 0
    while i < len(split):
        by: dict[str, list[int]] = {}
        j = i
        while j < len(split) and split[j] == split[i]:
            if text[j]:
                by.setdefault(lang[j], []).append(j)
            j += 1
        yield split[i], by
        i = j


def requests(rows: DataFrame, flush: int = FLUSH, bits: int = BITS) -> DataFrame:
    """``split, lang, gram, n``: the 4-grams of each split's texts; ``n`` counts those of training rows."""
    short_batches(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        letters, size, now = Alphabet(bits), 0, None

        def batch_of(lang: str, grams: list[str], n) -> pa.RecordBatch:
            k = len(grams)
            return pa.record_batch([pa.array([now] * k, pa.int64()), pa.array([lang] * k, pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())], names=["split", "lang", "gram", "n"])

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                gram, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([c for _, c in parts])).astype(np.int64)
                for k in range(0, len(gram), 100_000):
                    yield batch_of(lang, letters.strings(gram[k : k + 100_000]), n[k : k + 100_000])

        for batch in batches:
            texts, trusted = batch.column("text").to_pylist(), batch.column("trusted").to_pylist()
            for split, by in _groups(batch):
                if split != now or size > flush:
                    yield from flushed()
                    held, size, now = {}, 0, split
                todo = [(lang, [i for i in found if (trusted[i] == 1) == train], train) for lang, found in by.items() for train in (True, False)]
                while todo:
                    lang, found, train = todo.pop()
                    if not found:
                        continue
                    gram = letters.codes([texts[i] for i in found])
                    if gram is None and len(letters.letters) > 1:
                        yield from flushed()
                        held, size, letters = {}, 0, Alphabet(bits)
                        todo.append((lang, found, train))
                    elif gram is not None:
                        gram, n = np.unique(gram, return_counts=True)
                        held.setdefault(lang, []).append((gram, n * train))
                        size += len(gram)
                    elif len(found) > 1:
                        half = len(found) // 2
                        todo += [(lang, found[:half], train), (lang, found[half:], train)]
                    else:  # one text of more letters than an alphabet holds
                        counted = Counter(plain_grams(texts[found[0]]))
                        yield batch_of(lang, list(counted), [c * train for c in counted.values()])
        yield from flushed()

    return rows.select("split", "lang", "text", "trusted").mapInArrow(work, "split long, lang string, gram string, n long")


def probabilities(counts: DataFrame) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """(seen, contexts): ``lang, gram, p`` of seen n-grams and ``lang, gram, gamma`` of contexts, by order."""
    tables = {ORDER: Written(counts).df}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = Written(tables[k + 1].select("lang", F.substring("gram", 2, k).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))).df
    seen, contexts = {}, {}
    for k in range(1, ORDER + 1):
        t = tables[k]
        of = t.groupBy("lang").agg(*(F.sum(F.when(F.col("n") == i, 1).otherwise(0)).cast("double").alias(f"c{i}") for i in (1, 2, 3, 4)), F.count("*").alias("kinds"))
        y = F.when(F.col("c1") + 2 * F.col("c2") > 0, F.col("c1") / (F.col("c1") + 2 * F.col("c2"))).otherwise(F.lit(0.5))
        d = []
        for i in (1, 2, 3):
            low, high = F.col(f"c{i}"), F.col(f"c{i + 1}")
            d.append(F.when((low > 0) & (high > 0), F.least(F.greatest(i - (i + 1) * y * high / low, F.lit(0.1)), F.lit(i - 0.05))).otherwise(F.lit(0.5)))
        of = Written(of.select("lang", "kinds", *(x.alias(f"d{i + 1}") for i, x in enumerate(d)))).df
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = t.join(_small(of), "lang").select("lang", "gram", "n", "kinds", cut.alias("cut"), F.substring("gram", 1, k - 1).alias("context"))
        totals = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("gamma"), F.max("kinds").alias("kinds"))
        totals = Written(totals).df
        joined = rows.drop("kinds").join(totals, ["lang", "context"])
        rest = (F.col("n") - F.col("cut")) / F.col("total")
        if k == 1:
            gamma = F.col("gamma") / (F.col("kinds") + 1)
            p = joined.select("lang", "gram", (rest + gamma).alias("p"))
        else:
            gamma = F.col("gamma")
            lower = seen[k - 1].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
            p = joined.withColumn("suffix", F.substring("gram", 2, k - 1)).join(lower, ["lang", "suffix"]).select("lang", "gram", (rest + F.col("gamma") * F.col("q")).alias("p"))
        contexts[k] = totals.select("lang", F.col("context").alias("gram"), gamma.alias("gamma"))
        seen[k] = Written(p).df
    return seen, contexts


def _small(by_lang: DataFrame) -> DataFrame:
    """A row a language, broadcast up to a checked number of them."""
    return F.broadcast(by_lang) if by_lang.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS else by_lang


def resolved(wanted: DataFrame, seen: dict[int, DataFrame], contexts: dict[int, DataFrame], k: int = ORDER) -> DataFrame:
    """``lang, gram, p`` of the distinct n-grams ``wanted`` of order k, seen or not."""
    found = Written(wanted.join(seen[k], ["lang", "gram"], "left")).df
    missed = found.where("p IS NULL").select("lang", "gram", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("suffix"))
    weighed = missed.join(contexts[k].select("lang", F.col("gram").alias("context"), "gamma"), ["lang", "context"], "left").withColumn("gamma", F.coalesce("gamma", F.lit(1.0)))
    if k == 1:
        p = weighed.select("lang", "gram", F.col("gamma").alias("p"))
    else:
        lower = resolved(missed.select("lang", F.col("suffix").alias("gram")).distinct(), seen, contexts, k - 1)
        p = weighed.join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q")), ["lang", "suffix"]).select("lang", "gram", (F.col("gamma") * F.col("q")).alias("p"))
    return found.where("p IS NOT NULL").unionByName(p)


def _key() -> Column:
    return F.xxhash64("lang", "gram")


def answers(asked: DataFrame) -> str | None:
    """The folder of each split's n-gram log probabilities, a file a split; None without any trusted text."""
    spark = asked.sparkSession
    every = Written(asked.groupBy("lang", "gram").agg(F.sum("n").alias("n"))).df
    own = every.where("n > 0")
    langs = Written(every.groupBy("lang").agg(F.sum("n").alias("n"))).df
    if not langs.where("n > 0").limit(1).count():
        return None
    if langs.where("n = 0").limit(1).count():  # some have no model of their own
        counts = own.unionByName(own.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("lang"), "gram", "n"))
        seen, contexts = probabilities(counts)
        of = every.select("lang", "gram").join(_small(langs.select("lang", F.when(F.col("n") > 0, F.col("lang")).otherwise(F.lit(POOLED)).alias("model"))), "lang")
        p = resolved(of.select(F.col("model").alias("lang"), "gram").distinct(), seen, contexts)
        p = of.join(p.select(F.col("lang").alias("model"), "gram", "p"), ["model", "gram"]).select("lang", "gram", "p")
    else:
        p = resolved(every.select("lang", "gram"), *probabilities(own))
    table = p.select(_key().alias("key"), F.log("p").alias("log_p"))
    told = asked.select("split", _key().alias("key")).join(table, "key")
    folder = f"{scratch(spark)}/helixbin-kn-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)

    def save(group: pa.Table) -> pa.Table:
        key, first = np.unique(group.column("key").to_numpy(), return_index=True)
        held = io.BytesIO()
        np.savez(held, key=key, log_p=group.column("log_p").to_numpy()[first])
        s, p = fs.FileSystem.from_uri(_file(folder, group.column("split")[0].as_py()))
        # A repeated task writes the same bytes, under a name of its own until they are complete.
        own = f"{p}.{uuid.uuid4().hex}"
        with s.open_output_stream(own) as out:
            out.write(held.getbuffer())
        s.move(own, p)
        return pa.table({"n": pa.array([len(key)], pa.int64())})

    told.groupBy("split").applyInArrow(save, "n long").agg(F.sum("n")).collect()
    return folder


def _file(folder: str, split: int) -> str:
    return f"{folder}/{split & (1 << 64) - 1:016x}.npz"


class _Answers:
    """A split's log probabilities by n-gram."""

    def __init__(self, path: str) -> None:
        store, at = fs.FileSystem.from_uri(path)
        with store.open_input_file(at) as f, np.load(io.BytesIO(f.read())) as z:
            self.key, self.log_p = z["key"], z["log_p"]

    def of(self, lang: str, grams: list[str]) -> np.ndarray:
        seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        key = np.array([xxhash.xxh64_intdigest(g.encode(), seed) for g in grams], np.uint64).view(np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        if len(key) and not (self.key[at] == key).all():
            raise RuntimeError("the input's splits have changed between the passes")
        return self.log_p[at]


def score(rows: DataFrame, folder: str | None, bits: int = BITS) -> DataFrame:
    """``doc_id, lang, trusted, n_chars, log_prob`` of each row; ``log_prob`` is null for texts without characters."""
    short_batches(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, now, told = Alphabet(bits), None, None
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def logs(lang: str, gram: np.ndarray) -> np.ndarray:
            keys, values = known.get(lang, (np.zeros(0, np.int64), np.zeros(0)))
            at = np.minimum(np.searchsorted(keys, gram), max(0, len(keys) - 1))
            new = np.unique(gram[keys[at] != gram]) if len(keys) else np.unique(gram)
            if len(new):
                keys, values = np.concatenate([keys, new]), np.concatenate([values, told.of(lang, letters.strings(new))])
                order = np.argsort(keys, kind="stable")
                known[lang] = keys, values = keys[order], values[order]
                at = np.searchsorted(keys, gram)
            return values[at]

        for batch in batches:
            texts = batch.column("text").to_pylist()
            found: list[float | None] = [None] * len(texts)
            for split, by in _groups(batch) if folder else ():
                if split != now and by:
                    now, told, known = split, _Answers(_file(folder, split)), {}
                todo = list(by.items())
                while todo:
                    lang, mine = todo.pop()
                    own = [texts[i] for i in mine]
                    gram = letters.codes(own)
                    if gram is None and len(letters.letters) > 1:
                        letters, known = Alphabet(bits), {}
                        todo.append((lang, mine))
                    elif gram is not None:
                        total = np.add.reduceat(logs(lang, gram), np.concatenate([[0], np.cumsum([len(t) for t in own])[:-1]]).astype(int))
                        for i, x in zip(mine, total.tolist(), strict=True):
                            found[i] = x
                    elif len(mine) > 1:
                        half = len(mine) // 2
                        todo += [(lang, mine[:half]), (lang, mine[half:])]
                    else:
                        found[mine[0]] = float(told.of(lang, plain_grams(own[0])).sum())
            n = pa.array([len(t or "") for t in texts], pa.int64())
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "lang", "trusted")), n, pa.array(found, pa.float64())], names=["doc_id", "lang", "trusted", "n_chars", "log_prob"])

    return rows.select("doc_id", "lang", "trusted", "text", "split").mapInArrow(work, "doc_id long, lang string, trusted int, n_chars long, log_prob double")


def classify(documents: DataFrame, labels: DataFrame, quantile: float = QUANTILE, bits: int = BITS) -> DataFrame:
    """``doc_id, lang, n_chars, perplexity, threshold, kept`` for every row of ``documents``."""
    rows = located(documents, labels)
    asked = Written(requests(rows, bits=bits))
    folder = answers(asked.df)
    asked.drop()
    scored = Written(score(rows, folder, bits)).df.withColumn("perplexity", F.when(F.col("n_chars") > 0, F.exp(-F.col("log_prob") / F.col("n_chars"))))
    if folder:
        remove(documents.sparkSession, folder)
    known = scored.where("trusted > 0 AND perplexity IS NOT NULL")
    held = F.when(F.col("trusted") == 2, F.col("perplexity"))
    cut = lambda x: F.percentile_approx(x, quantile, 100_000)
    pooled = known.agg(F.coalesce(cut(held), cut("perplexity")).alias("pooled"))  # one row
    pooled = Written(pooled).df
    own = known.groupBy("lang").agg(cut(held).alias("own"), F.count(held).alias("n_held"))
    limits = Written(own.join(F.broadcast(pooled)).select("lang", F.when(F.col("n_held") >= MIN_HELD, F.col("own")).otherwise(F.greatest("own", "pooled")).alias("threshold"))).df
    out = scored.join(_small(limits), "lang", "left").join(F.broadcast(pooled)).withColumn("threshold", F.coalesce("threshold", "pooled"))
    return out.select("doc_id", "lang", "n_chars", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))
