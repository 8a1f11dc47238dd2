"""Mixing to target weights by soft membership.

1. ``train`` fits a softmax classifier of the domain of labelled rows: at most ``MAX_ROWS`` of them (a bounded,
   documented sample), on the evidence of all their terms (log ratios of a term's share of a domain's rows, smoothed) and on
   shape features. Texts fall into ``FOLDS`` by a hash; any text, labelled or not, is judged by the terms' counts in the other folds, so neither
   it nor a copy of it is evidence for itself, and what is learned holds for texts seen and unseen alike. ``memberships`` gives
   every document its posteriors and its tokens (white-space words).
2. ``fit_rates`` finds document rates 0 <= r <= max_rate whose expected domain token totals, the sums of
   r * tokens * posterior, match the targets: least squares over the residuals, whitened by the domains' Gram
   matrix, with a small pull towards rate 1, by accelerated projected gradient. A step needs one number for each
   domain from the cluster. A document's rate follows from its posteriors and the steps' residuals since the rates were last
   written (every ``REPLAY`` steps), so a lost executor costs nothing but its tasks. A fit that hasn't settled after ``STEPS``
   steps warns with its gap, and so does one that stands still off its targets, which rates within their bounds may not be able to
   reach; ``Rates.reached``, ``Rates.settled`` and ``Rates.met`` tell.
3. ``resample`` turns rates into copies, rounding by a hash of the document, so that expectations hold.

The domain of a labelled row: ``toxic`` if toxic is 1, else ``low`` if quality is 0, else ``clean``. Rows with a null
id or null labels aren't used; repeated labels of an id use the worst one, repeated documents of a labelled id the first text. Null texts
count as empty and have no tokens; null ids get a rate as any row, repeated rows each their own. Texts of any length are read whole.
Without labelled rows all posteriors are equal. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, short_batches

DOMAINS = ("clean", "low", "toxic")
#: Shares of the corpus' tokens that the query aims at.
TARGETS = {"clean": 0.90, "low": 0.06, "toxic": 0.04}
MAX_ROWS = 6_000
SMOOTH = 5.0  # rows that the prior counts as in a term's share
FOLDS = 10
RIDGE = 2.0  # rows that the prior of the weights counts as
STRONG = 1.0  # a log ratio beyond which a term is evidence by itself
PULL = 1e-3
STEPS = 400
REPLAY = 16
TOLERANCE = 1e-6
MET = 0.02
TERM = re.compile(r"[^\W\d_]+")
SYMBOLS = "#*$%&|<>"


def labelled(documents: DataFrame, labels: DataFrame, most: int = MAX_ROWS) -> DataFrame:
    """``doc_id, text, domain`` of a bounded sample of labelled rows."""
    named = labels.where("doc_id IS NOT NULL AND quality IN (0, 1) AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("t"), F.min("quality").alias("q"))
    domain = F.when(F.col("t") == 1, 2).when(F.col("q") == 0, 1).otherwise(0)
    picked = named.select("doc_id", domain.alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text")).select("doc_id", "text", "domain")


def shape(text: str) -> list[float]:
    """Features of a text's form."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    symbols = sum(map(text.count, SYMBOLS))
    return [np.log1p(len(words)), symbols / n, text.count("|") / n, text.count("\n") / n, len("".join(words)) / n, (text.count(".") + text.count(",")) / n, len(set(words)) / n, symbols / chars]


def fold(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % FOLDS


@dataclass
class Classifier:
    terms: dict[str, int]
    counts: np.ndarray  # (term, fold, domain): in how many examples of the other folds
    rows: np.ndarray  # (fold, domain): examples of the other folds
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None  # (features + 1, domains)

    def evidence(self, text: str) -> list[float]:
        """For each domain: the sum, the strong part and the strongest of the log ratios of a text's terms in the other folds."""
        own = fold(text)
        found = np.array([i for w in set(TERM.findall(text.lower())) if (i := self.terms.get(w)) is not None], np.int64)
        n, rows = self.counts[found, own].astype(float), self.rows[own].astype(float)
        n = n[n.sum(1) > 0]  # terms that the other folds have
        if not len(n):
            return [0.0] * (3 * len(DOMAINS))
        share = (rows + 1) / (rows.sum() + len(rows))
        ratio = np.log((n + SMOOTH * share) / ((n.sum(1, keepdims=True) + SMOOTH) * share))
        strong = np.maximum(ratio - STRONG, 0)
        return [*(ratio.sum(0) / np.sqrt(len(n))), *np.log1p(strong.sum(0)), *strong.max(0)]

    def features(self, texts: list[str]) -> np.ndarray:
        return np.array([shape(t) + self.evidence(t) for t in texts]).reshape(len(texts), 8 + 3 * len(DOMAINS))

    def posteriors(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full((len(texts), len(DOMAINS)), 1 / len(DOMAINS))
        return _softmax(((self.features(texts) - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1])


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def train(rows: DataFrame, ridge: float = RIDGE, steps: int = 400) -> Classifier:
    """A softmax regression by accelerated gradient descent on the driver; ``rows`` is bounded."""
    width = len(DOMAINS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple[str, int, int], int] = {}
            for text, d in zip(batch.column("text").to_pylist(), batch.column("domain").to_pylist(), strict=True):
                f = fold(text or "")
                for w in set(TERM.findall((text or "").lower())):
                    held[w, f, d] = held.get((w, f, d), 0) + 1
            terms, cells = [w for w, _, _ in held], [f * width + d for _, f, d in held]
            yield pa.record_batch([pa.array(terms, pa.string()), pa.array(cells, pa.int32()), pa.array(list(held.values()), pa.int64())], names=["term", "cell", "n"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [fold(t or "") * width + d for t, d in zip(batch.column("text").to_pylist(), batch.column("domain").to_pylist())]
            yield pa.record_batch([pa.array(cells, pa.int32())], names=["cell"])

    counted = rows.select("text", "domain").mapInArrow(count, "term string, cell int, n long").groupBy("term", "cell").agg(F.sum("n").alias("n"))
    got = counted.orderBy("term", "cell").toArrow()  # terms of the bounded sample
    term, place = np.unique(np.array(got.column("term").to_pylist(), object).astype(str), return_inverse=True)
    of, counts = np.zeros(FOLDS * width), np.zeros((len(term), FOLDS * width), np.int16)
    counts[place, got.column("cell").to_numpy()] = got.column("n").to_numpy()
    for r in rows.select("text", "domain").mapInArrow(tally, "cell int").groupBy("cell").count().collect():
        of[r["cell"]] = r["count"]
    of, counts = of.reshape(FOLDS, width), counts.reshape(-1, FOLDS, width)
    k = 8 + 3 * width
    model = Classifier(dict(zip(term.tolist(), range(len(term)))), counts.sum(1, keepdims=True, dtype=np.int16) - counts, of.sum(0) - of, np.zeros(k), np.ones(k), None)
    if (of.sum(0) > 0).sum() < 2:
        return model
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shared.value.features([t or "" for t in batch.column("text").to_pylist()])
            yield pa.record_batch([pa.array(list(x), pa.list_(pa.float64())), batch.column("domain")], names=["x", "domain"])

    got = rows.orderBy("doc_id", "text").select("text", "domain").mapInArrow(work, "x array<double>, domain int").toArrow()
    y = got.column("domain").to_numpy()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), k)
    model.mean = x.mean(0)
    model.scale = np.sqrt(((x - model.mean) ** 2).mean(0)) + 1e-9
    x = np.column_stack([(x - model.mean) / model.scale, np.ones(len(x))])
    aim, ridge = np.eye(len(DOMAINS))[y], ridge / len(y)
    step = 1 / (0.5 * float(np.linalg.norm(x, 2)) ** 2 / len(x) + ridge)
    w = ahead = np.zeros((x.shape[1], len(DOMAINS)))
    for i in range(steps):
        grad = x.T @ (_softmax(x @ ahead) - aim) / len(x) + ridge * ahead
        new = ahead - step * grad
        ahead, w = new + i / (i + 3) * (new - w), new
    model.weights = w
    return model


def ticket() -> Column:
    """A document's draw from [0, 1), by a hash of its id, or of its text where it has none."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(1 << 53)) / float(1 << 53)


def memberships(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, Classifier]:
    """``documents`` without text, with ``n_tokens`` and ``posterior``; and the classifier."""
    spark = documents.sparkSession
    short_batches(spark)
    rows = Written(labelled(documents, labels))
    model = train(rows.df)
    rows.drop()
    shared = spark.sparkContext.broadcast(model)  # the terms of MAX_ROWS texts

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("ticket"), pa.array([len(t.split()) for t in texts], pa.int64()), pa.array(list(shared.value.posteriors(texts)), pa.list_(pa.float64()))],
                names=["doc_id", "ticket", "n_tokens", "posterior"],
            )

    out = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", ticket().alias("ticket"))
    return out.mapInArrow(work, "doc_id long, ticket double, n_tokens long, posterior array<double>"), model


def _step(p: np.ndarray, e: np.ndarray, rate: np.ndarray, ahead: np.ndarray, bounds: tuple[float, float, float]) -> np.ndarray:
    """A projected gradient step from ``ahead``; ``bounds``: largest rate, pull, least rate of likely clean documents."""
    most, pull, floor = bounds
    return np.clip(ahead - (p @ e + pull * (ahead - 1)) / (1 + pull), np.where(p.argmax(1) == 0, floor, 0.0), most)


def _replay(p: np.ndarray, steps: list[tuple[np.ndarray, float]], bounds: tuple[float, float, float], rate: np.ndarray | None = None, ahead: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the steps, and the point ahead of them, by each step's momentum, that the next step starts from."""
    rate = np.ones(len(p)) if rate is None else rate
    ahead = np.ones(len(p)) if ahead is None else ahead
    for e, momentum in steps:
        new = _step(p, e, rate, ahead, bounds)
        ahead, rate = new + momentum * (new - rate), new
    return rate, ahead


@dataclass
class Rates:
    """The steps' whitened residuals, from which any document's rate follows."""

    steps: list[tuple[np.ndarray, float]]
    bounds: tuple[float, float, float]
    targets: np.ndarray
    reached: np.ndarray
    settled: bool = True

    @property
    def met(self) -> bool:
        """Whether each total lies within ``MET`` of its target, or within a thousandth of all tokens."""
        return bool((np.abs(self.reached - self.targets) <= np.maximum(MET * self.targets, 1e-3 * self.targets.sum())).all())

    def of(self, members: DataFrame) -> DataFrame:
        """``members`` with ``rate``."""
        names, steps, bounds = members.columns, self.steps, self.bounds

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_replay(_matrix(batch), steps, bounds)[0])], names=[*names, "rate"])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema)
        return members.mapInArrow(work, f"{schema}, rate double")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("posterior")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), len(DOMAINS))


def fit_rates(members: DataFrame, targets: dict[str, float] | None = None, shares: bool = True, max_rate: float = float("inf"), pull: float = PULL, steps: int = STEPS, tolerance: float = TOLERANCE, floor: float = 0.0) -> Rates:
    """Fits rates to token totals (``shares``: of all tokens; else the totals themselves by domain).

    ``floor`` is the least rate of documents whose likeliest domain is the first, clean text.
    """
    width, bounds = len(DOMAINS), (max_rate, pull, floor)

    state, since = members.select("n_tokens", "posterior"), 0  # later with the rates after ``since`` steps

    def total(values) -> np.ndarray:
        """Sums over all rows of what ``values(posteriors, tokens, rate, ahead)`` gives for each."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                part = values(_matrix(batch), batch.column("n_tokens").to_numpy().astype(float), *(batch.column(c).to_numpy() for c in batch.schema.names[2:]))
                held = part if held is None else held + part
            if held is not None:
                yield pa.record_batch([pa.array(np.arange(len(held)), pa.int32()), pa.array(held)], names=["i", "x"])

        rows = state.mapInArrow(work, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # a row a domain or pair
        return np.array([r["x"] for r in sorted(rows, key=lambda r: r["i"])])

    first = total(lambda p, t: np.concatenate([p.T @ t, ((p * t[:, None]).T @ p).ravel()]))
    supply = first[:width] if len(first) else np.zeros(width)
    everything = float(supply.sum())
    aim = np.array([(targets or TARGETS)[d] for d in DOMAINS]) * (everything if shares else 1)
    if not everything:
        return Rates([], bounds, aim, supply)
    gram = first[width:].reshape(width, width) / everything
    white = np.linalg.inv(gram + 1e-6 * np.eye(width))
    done: list[tuple[np.ndarray, float]] = []
    reached = ahead = supply
    settled, kept, pace = False, None, 0

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now = _replay(_matrix(batch), done[since:], bounds, *(batch.column(c).to_numpy() for c in batch.schema.names[2:]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *map(pa.array, now)], names=["n_tokens", "posterior", "rate", "ahead"])

    def tried(p: np.ndarray, t: np.ndarray, *at: np.ndarray) -> np.ndarray:
        """Domain totals of the next step's rates, and whether the momentum led away from them."""
        rate, there = _replay(p, done[since:], bounds, *at)
        new = _step(p, e, rate, there, bounds)
        return np.append(p.T @ (t * new), ((there - new) * t * (new - rate)).sum())

    for _ in range(steps):
        e = white @ ((ahead - aim) / everything)
        found = total(tried)
        pace = 0 if found[-1] > 0 else pace + 1  # the momentum starts anew where it led away
        before, reached = reached, found[:width]
        momentum = max(0, pace - 1) / (max(0, pace - 1) + 3)
        done.append((e, momentum))
        ahead = reached + momentum * (reached - before)
        if np.abs(reached - aim).max() <= tolerance * everything or (len(done) > 3 and np.abs(reached - before).max() <= 0.1 * tolerance * everything):
            settled = True
            break
        if len(done) - since == REPLAY:
            now = Written(state.mapInArrow(carry, "n_tokens long, posterior array<double>, rate double, ahead double"))
            if kept is not None:
                kept.drop()
            kept, state, since = now, now.df, len(done)
    if kept is not None:
        kept.drop()
    if not settled:
        warnings.warn(f"the mix has not settled after {steps} steps: {reached.round(1).tolist()} of {aim.round(1).tolist()} tokens", stacklevel=2)
    fit = Rates(done, bounds, aim, reached, settled)
    if settled and not fit.met:
        warnings.warn(f"the mix misses its targets: {reached.round(1).tolist()} of {aim.round(1).tolist()} tokens", stacklevel=2)
    return fit


def mix(documents: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, max_rate: float = float("inf")) -> DataFrame:
    """``doc_id, ticket, n_tokens, posterior, rate`` for every row of ``documents``."""
    members = Written(memberships(documents, labels)[0])
    return fit_rates(members.df, targets, max_rate=max_rate).of(members.df)


def copies(rate, ticket):
    """How often a document is taken: the rate, rounded up where the ticket falls below its fraction."""
    return (F.floor(rate) + F.when(ticket < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Rates of all documents; posteriors and rates rounded to 9 digits."""
    rows = mix(documents.select("doc_id", "text"), labels)
    p = lambda i: F.round(F.get("posterior", F.lit(i)), 9)
    return rows.select("doc_id", "n_tokens", *(p(i).alias(f"p_{d}") for i, d in enumerate(DOMAINS)), F.round("rate", 9).alias("rate"), copies(F.col("rate"), F.col("ticket")).alias("copies"))
