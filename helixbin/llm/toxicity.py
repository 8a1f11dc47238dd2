r"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

* Labelled rows are those of ``labels`` with toxic 0 or 1 whose crc32(doc_id as text) mod 5 isn't 0. At most
  ``MAX_EXAMPLES`` of them, taken by a hash of the id, make the examples (a bounded, documented sample).
* Terms are lower-cased runs of letters. Every term of every example, of either label, is indexed; a term of no example
  can't change which example is nearest and is left out of the norm. Document frequencies are counted over all documents.
* A document's vector is its TF-IDF weights, of unit length. A term that stands in examples of label 1 above
  chance weighs more by its ``relevance``; no term weighs less than its TF-IDF. ``BlockMaxIndex`` finds the
  ``NEIGHBOURS`` nearest examples exactly: the blocks of the highest upper bounds are opened, then all whose
  bound reaches the least similarity kept. Equal similarities share the vote, so order never matters.
* Votes are weighted by similarity and calibrated by an isotonic fit of the examples' own leave-one-out votes.
  A document without a term of any example gets the share of label 1 among such examples.

Labels, lang, source and doc_id are never inputs of a score. A null text counts as empty. Rows with a null id are
scored, never held out and never examples; repeated labels of an id count as toxic if one is, and of repeated documents of a labelled id
the first text is the example. Texts of any length are read whole. Without labelled rows every score is 0. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, short_batches

MAX_EXAMPLES = 12_000
NEIGHBOURS = 15
BLOCK = 64
HOT = 512
FIRST = 4
TERM = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def examples(documents: DataFrame, labels: DataFrame, most: int = MAX_EXAMPLES) -> DataFrame:
    """``doc_id, text, toxic`` of the labelled rows that may be learned from."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded, so it may be broadcast
    return documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


def _terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").lower())


def relevance(n: np.ndarray, t: np.ndarray, total: int, toxic: int) -> np.ndarray:
    """1 and, for terms of more of the ``toxic`` rows than chance gives, the score by which they do (half a row less)."""
    p = toxic / total if total else 0.0
    return 1 + np.maximum(0, t - p * n - 0.5) / np.sqrt(np.maximum(n, 1) * (p * (1 - p) + 1e-9))


def _term_rows(rows: DataFrame) -> DataFrame:
    """``term, n, t``: in how many rows each term stands, and in how many of label 1."""
    short_batches(rows.sparkSession)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_rows, toxic = Counter(), Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = set(_terms(text))
                all_rows.update(found)
                if label:
                    toxic.update(found)
            words = list(all_rows)
            yield pa.record_batch([pa.array(words, pa.string()), pa.array([all_rows[w] for w in words], pa.int64()), pa.array([toxic[w] for w in words], pa.int64())], names=["term", "n", "t"])

    return rows.select("text", "toxic").mapInArrow(distinct, "term string, n long, t long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def example_terms(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Every term of the bounded ``rows``, in order, and its relevance."""
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    got = _term_rows(rows).orderBy("term").toArrow()
    n, t = (got.column(c).to_numpy().astype(float) for c in ("n", "t"))
    return got.column("term").to_pylist(), relevance(n, t, total["n"], total["t"] or 0)


def term_counts(docs: DataFrame, words: list[str]) -> DataFrame:
    """``docs`` without its text, with ``terms`` (numbers in the vocabulary, ascending) and their ``counts``."""
    short_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(shared.value)}
        for batch in batches:
            found = [Counter(_terms(x)) for x in batch.column("text").to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(f) for f in found])
            term = np.fromiter((number.get(w, -1) for f in found for w in f), np.int64, len(row))
            count = np.fromiter((c for f in found for c in f.values()), np.int32, len(row))
            row, term, count = row[term >= 0], term[term >= 0], count[term >= 0]
            by = np.argsort(row * len(number) + term)
            at = pa.array(np.searchsorted(row, np.arange(len(found) + 1)).astype(np.int32))
            terms, counts = (pa.ListArray.from_arrays(at, pa.array(x[by])) for x in (term.astype(np.int32), count))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), terms, counts], names=[*kept, "terms", "counts"])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept, "text").mapInArrow(work, f"{schema}, terms array<int>, counts array<int>")


def document_frequencies(counted: DataFrame, n_terms: int) -> np.ndarray:
    """Of each term: how many rows of ``counted`` have it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_terms, np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        t = np.flatnonzero(held)
        yield pa.record_batch([pa.array(t.astype(np.int32)), pa.array(held[t])], names=["t", "n"])

    got = counted.select("terms").mapInArrow(work, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(n_terms)
    df[got.column("t").to_numpy()] = got.column("n").to_numpy()
    return df


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


@dataclass
class BlockMaxIndex:
    """Postings by term over blocks of ``BLOCK`` examples. The ``HOT`` commonest terms have each block's largest weight."""

    ids: np.ndarray
    labels: np.ndarray
    docs: np.ndarray  # postings by term: the examples that have it, ascending,
    weights: np.ndarray  # and its weights
    starts: np.ndarray  # where each term's postings start
    hot: np.ndarray  # each term's number among the commonest, or -1

    @classmethod
    def build(cls, ids: list[int], labels: list[int], rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> BlockMaxIndex:
        """``rows``: terms and unit weights of each example. Examples of one label, commonest term and size stand together."""
        sizes = np.array([len(t) for t, _ in rows], np.int64)
        terms = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in rows)])
        weights = np.concatenate([np.zeros(0), *(w for _, w in rows)])
        common = np.bincount(terms, minlength=n_terms)
        order = sorted(range(len(rows)), key=lambda i: (labels[i], int(rows[i][0][common[rows[i][0]].argmax()]) if sizes[i] else -1, sizes[i], rows[i][0].tobytes(), ids[i]))
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(len(rows))
        docs = np.repeat(place, sizes)
        by = np.lexsort((docs, terms))
        terms, docs, weights = terms[by], docs[by], weights[by]
        hot = np.full(n_terms, -1, np.int32)
        most = np.argsort(-common, kind="stable")[:HOT]
        hot[most] = np.arange(len(most))
        return cls(np.array([ids[i] for i in order], np.int64), np.array([labels[i] for i in order], np.int64), docs.astype(np.int32), weights, np.searchsorted(terms, np.arange(n_terms + 1)), hot)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("dense", "peaks")}

    @cached_property
    def dense(self) -> np.ndarray:
        """Weights of the hot terms, block by block: (block, hot term, example)."""
        out = np.zeros((-(-len(self.ids) // BLOCK), int(self.hot.max(initial=-1)) + 1, BLOCK))
        for t in np.flatnonzero(self.hot >= 0):
            part = slice(self.starts[t], self.starts[t + 1])
            out[self.docs[part] // BLOCK, self.hot[t], self.docs[part] % BLOCK] = self.weights[part]
        return out

    @cached_property
    def peaks(self) -> np.ndarray:
        """Largest weights: (hot term, block)."""
        return np.ascontiguousarray(self.dense.max(2).T)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples and all that tie with the last, nearest first; ``without`` leaves one out."""
        return self.nearest_of([(terms, weights)], k, [without])[0]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of each query. Scores of the other terms are added up first; they sharpen the blocks' bounds."""
        n_blocks = len(self.dense)
        if not n_blocks:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        scores = np.zeros((len(queries), n_blocks * BLOCK))
        hot = np.zeros((len(queries), len(self.peaks)))
        for i, (terms, weights) in enumerate(queries):
            h = self.hot[terms]
            hot[i, h[h >= 0]] = weights[h >= 0]
            rare, w = terms[h < 0], weights[h < 0]
            n = self.starts[rare + 1] - self.starts[rare]
            at = _ranges(self.starts[rare], n)
            scores[i] = np.bincount(self.docs[at], np.repeat(w, n) * self.weights[at], minlength=scores.shape[1])
        blocks = scores.reshape(len(queries), n_blocks, BLOCK)
        bound = hot @ self.peaks + blocks.max(2)
        some = np.argpartition(-bound, min(FIRST, n_blocks) - 1, 1)[:, :FIRST]
        opened = np.zeros(bound.shape, bool)
        np.put_along_axis(opened, some, True, 1)
        for last in (False, True):
            fresh = opened if not last else (bound >= least - 1e-9) & ~opened
            for b in np.flatnonzero(fresh.any(0)):
                q = np.flatnonzero(fresh[:, b])
                blocks[q, b] += hot[q] @ self.dense[b]
            out = np.array(without)
            scores[np.flatnonzero(out >= 0), out[out >= 0]] = 0
            opened = opened | fresh
            if not last:  # the first blocks' scores bound the last of the nearest from below
                near = np.take_along_axis(blocks, some[:, :, None], 1).reshape(len(queries), -1)
                least = np.partition(near, -k, 1)[:, -k, None] if near.shape[1] >= k else np.zeros((len(near), 1))
        blocks[~opened] = 0
        found = []
        for score, bar in zip(scores, least[:, 0], strict=True):
            at = np.flatnonzero(score >= max(bar - 1e-9, 1e-12))
            score = np.round(score[at], 12)  # a product's last digits depend on how rows meet in it
            if len(score) >= k:
                keep = score >= np.partition(score, -k)[-k] - 1e-9
                at, score = at[keep], score[keep]
            order = np.lexsort((at, -score))
            found.append((at[order], score[order]))
        return found


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing values."""
    knots, inverse = np.unique(x, return_inverse=True)
    total = np.bincount(inverse, y)
    size = np.bincount(inverse).astype(float)
    pools: list[list[float]] = []
    for i in range(len(knots)):
        pools.append([total[i], size[i], 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            for j in range(3):
                pools[-1][j] += last[j]
    return knots, np.concatenate([np.full(int(c), t / s) for t, s, c in pools] or [np.zeros(0)])


@dataclass
class Scorer:
    idf: np.ndarray  # times the terms' relevance
    index: BlockMaxIndex
    blank: float
    prior: float
    rows: np.ndarray  # keys of the examples' rows, in the index's order
    k: int = NEIGHBOURS

    def weigh(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.idf[terms]
        return terms, w / np.sqrt((w * w).sum())

    def votes(self, rows: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[float, np.ndarray]]:
        """The vote and the neighbours of each of ``rows``, terms and counts that aren't empty."""
        found = self.index.nearest_of([self.weigh(*r) for r in rows], self.k, without or [-1] * len(rows))
        return [(float(((score * self.index.labels[at]).sum() + 0.5 * self.prior) / (score.sum() + 0.5)), at) for at, score in found]

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]], fitted: tuple[np.ndarray, np.ndarray]) -> list[tuple[float, list[int]]]:
        """The score and the evidence of each of ``rows``; rows alike are looked up once."""
        keys = [(t.tobytes(), c.tobytes()) for t, c in rows]
        once = {key: r for key, r in zip(keys, rows, strict=True) if len(r[0])}
        out: dict = {(b"", b""): (self.blank, [])}
        for key, (vote, at) in zip(once, self.votes(list(once.values())), strict=True):
            value = float(np.interp(vote, *fitted)) if len(fitted[0]) else vote
            out[key] = (min(1.0, max(0.0, value)), self.index.ids[at[:3]].tolist())
        return [out[key] for key in keys]


def _lists(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Terms and counts of each row."""
    t, c = ((x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x) for x in (batch.column("terms"), batch.column("counts")))
    ends = np.cumsum(t.value_lengths().to_numpy(zero_copy_only=False))[:-1]
    return zip(np.split(t.flatten().to_numpy(), ends), np.split(c.flatten().to_numpy(), ends), strict=True) if len(t) else iter(())


def fit(all_counts: DataFrame, example_counts: DataFrame, gain: np.ndarray) -> Scorer:
    """``all_counts`` gives document frequencies over every document; ``example_counts`` holds the bounded examples, with a key ``row``."""
    df = document_frequencies(all_counts, len(gain))
    got = example_counts.select("row", "doc_id", "toxic", "terms", "counts").toArrow()
    key, doc_id, toxic = (got.column(c).to_numpy() for c in ("row", "doc_id", "toxic"))
    prior = float(toxic.mean()) if len(toxic) else 0.0
    made = Scorer((np.log((1 + all_counts.count()) / (1 + df)) + 1) * gain, None, 0.0, prior, key)  # type: ignore[arg-type]
    lists = list(_lists(got))
    own = [i for i, (t, _) in enumerate(lists) if len(t)]
    blanks = [toxic[i] for i, (t, _) in enumerate(lists) if not len(t)]
    made.blank = float((sum(blanks) + prior) / (len(blanks) + 1))
    vectors = [made.weigh(*lists[i]) for i in own]
    # Rows are told apart by id and text; those of one id and text are alike.
    rank = np.lexsort((key[own], doc_id[own]))
    at = np.empty(len(own), np.int64)
    at[rank] = np.arange(len(own))
    made.index = BlockMaxIndex.build(at.tolist(), toxic[own].tolist(), vectors, len(gain))
    mine = np.array(own, np.int64)[rank][made.index.ids]
    made.index.ids, made.rows = doc_id[mine], key[mine]
    return made


def calibration(examples: DataFrame, shared, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The isotonic map of votes, fitted to leave-one-out votes of the examples; empty where they have one label only."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {r: i for i, r in enumerate(shared.value.rows.tolist())}
        for batch in batches:
            at = batch.column("row").to_pylist()
            rows = list(_lists(batch))
            own = [i for i, (t, _) in enumerate(rows) if len(t)]
            votes = [v for v, _ in shared.value.votes([rows[i] for i in own], [place[at[i]] for i in own])]
            yield pa.record_batch([batch.column("toxic").take(pa.array(own, pa.int64())), pa.array(votes, pa.float64())], names=["toxic", "vote"])

    tasks = max(1, shared.value.rows.size // 256)
    got = examples.repartition(tasks, "row").mapInArrow(work, "toxic int, vote double").toArrow()
    toxic, votes = got.column("toxic").to_numpy().astype(float), got.column("vote").to_numpy()
    if len(set(toxic.tolist())) < 2:
        return np.zeros(0), np.zeros(0)
    knots, values = isotonic(votes, toxic)
    # Shrunk a little to the prior, so that no score is certain.
    return knots, (values * len(votes) + prior) / (len(votes) + 1)


def classify(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted`` and ``evidence``, the ids of the nearest examples."""
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    rows = Written(examples(docs, labels).withColumn("row", F.monotonically_increasing_id()))
    words, gain = example_terms(rows.df)
    counted = Written(term_counts(docs, words))
    learned = Written(term_counts(rows.df, words))
    rows.drop()
    scorer = fit(counted.df, learned.df, gain)
    shared = spark.sparkContext.broadcast(scorer)
    fitted = calibration(learned.df, shared, scorer.prior)
    learned.drop()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = shared.value.score(list(_lists(batch)), fitted)
            score = np.array([x[0] for x in out])
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), pa.array([x[1] for x in out], pa.list_(pa.int64()))],
                names=["doc_id", "score", "predicted", "evidence"],
            )

    scored = counted.df.mapInArrow(work, "doc_id long, score double, predicted int, evidence array<long>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")
