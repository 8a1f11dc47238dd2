"""The two whole runs: characterise sequences into a store, and extract clusters from it iteratively."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..models import CoverageModel
from ..operators import bank as banks
from ..operators import contig2vec, ind, kmer, post, reduce, vbgmm
from ..operators.bank import BankSpec
from ..scratch import cut, remove, scope
from ..sources.tables import Store

#: The raw models of the default characterisation.
DEFAULT_MODELS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "kmers4": lambda b: kmer.dense(b, "1111"),
    "kmers110011": lambda b: kmer.dense(b, "110011"),
    "kmers3": lambda b: kmer.dense(b, "111"),
    "kmers1001001": lambda b: kmer.dense(b, "1001001"),
    "kmers11000100011": lambda b: kmer.dense(b, "11000100011"),
    "ind15": lambda b: ind.vectors(b, 15),
    "contig2vec4": lambda b: contig2vec.embed(b, 4),
    "contig2vec6": lambda b: contig2vec.embed(b, 6),
}


def characterize(spark: SparkSession, contigs: DataFrame, path: str, spec: BankSpec | None = None, models: dict[str, Callable[[DataFrame], DataFrame]] | None = None, coverage_files: list[str] | None = None) -> Store:
    """Writes the bank and those raw models that the store hasn't yet; coverage files make the model ``coverage``."""
    store, spec = Store(spark, path), spec or BankSpec()
    models = dict(DEFAULT_MODELS if models is None else models)
    if coverage_files:
        models["coverage"] = CoverageModel(coverage_files, fill=0.0).transform
    try:
        bank, _ = store.bank()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        store.save_bank(banks.build(contigs, spec), spec)
        bank, _ = store.bank()
    for name in sorted(set(models) - set(store.models())):
        store.save_model(name, models[name](bank))
    return store


@dataclass
class Extraction:
    """Parameters of the iterative extraction."""

    max_iter: int = 10
    max_cluster: int = 100
    min_rows: int = 50
    max_components: int = 250
    kpca: dict = field(default_factory=lambda: {"inertia": 0.85, "t": 0.25})
    pca_inertia: float = 0.99
    init: str = "kmeans"
    mode: str = "reassigntiny"
    seed: int = 666
    restarts: int = vbgmm.DEFAULT_RESTARTS
    vb_iter: int = 600
    epsilon: float = 1e-2
    bound: str = "compat"

    def __post_init__(self) -> None:
        if self.init not in ("kmeans", "mustlink", "random") or self.mode not in ("nopostprocessing", "reassigntiny"):
            raise ValueError("unknown init or mode")


class Log:
    """The iterations that a run has committed to a folder: the table of what each decided, and what the last one left over.

    An iteration counts once its commit is written, which comes last; tables of an iteration without a commit are written anew. A folder holds
    one run: parameters and models have to be the same when it goes on.
    """

    def __init__(self, spark: SparkSession, path: str, about: dict) -> None:
        self.spark, self.path, self.about = spark, path.rstrip("/"), json.dumps(about, sort_keys=True)
        self.commits: list[dict] = []
        try:
            rows = spark.read.parquet(f"{self.path}/commits").collect()  # a row an iteration
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            rows = []
        self.commits = sorted((r.asDict() for r in rows), key=lambda r: r["n"])
        if any(r["about"] != self.about for r in self.commits):
            raise ValueError(f"{path} holds a run with other parameters or models")

    def done(self) -> list[DataFrame]:
        return [self.spark.read.parquet(f"{self.path}/done/{r['n']}") for r in self.commits]

    def remaining(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/remaining/{self.commits[-1]['n']}")

    def commit(self, n: int, done: DataFrame, remaining: DataFrame | None, number: int, clusters_left: int) -> None:
        """``remaining`` is None where the run has ended."""
        done.write.mode("overwrite").parquet(f"{self.path}/done/{n}")
        if remaining is not None:
            remaining.write.mode("overwrite").parquet(f"{self.path}/remaining/{n}")
        row = {"n": n, "number": number, "clusters_left": clusters_left, "ended": remaining is None, "about": self.about}
        self.spark.createDataFrame([tuple(row.values())], "n int, number int, clusters_left int, ended boolean, about string").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        for old in self.commits:
            remove(self.spark, f"{self.path}/remaining/{old['n']}")
        self.commits.append(row)


def extract(spark: SparkSession, bank: DataFrame, models: dict[str, DataFrame], params: Extraction | None = None, reports: str | None = None, state: str | None = None) -> DataFrame:
    """``chunk_id, cluster, iter, status``: every chunk of the models once.

    ``reports`` is a folder for tables of each iteration: ``inputs, explained_variance, component_origins, clusters,
    mustlink, verdicts, boxes`` and ``coordinates``, each partitioned by ``iter``. ``state`` is a folder where iterations are committed: a run
    that ended early goes on after the last commit, and one that is complete is read again.

    Validated clusters are numbered from 0 across iterations, in order of their first chunk. What is left carries the
    reason: ``maxiter_n, lastcluster_n, notenough_n, unbinned_n`` or ``badbinned_c``.
    """
    p = params or Extraction()
    spec = bank.select("chunk_id", "contig_id", "seq_ord")
    first = next(iter(models.values()))
    width = sum(len(df.select("features").first()["features"]) for df in models.values())
    log = Log(spark, state, asdict(p) | {"models": sorted(models)}) if state else None
    if log and log.commits:
        last = log.commits[-1]
        done, number, clusters_left, n = log.done(), last["number"], last["clusters_left"], last["n"] + 1
        remaining = None if last["ended"] else log.remaining()
    else:
        done, number, clusters_left, n = [], 0, p.max_cluster, 0
        remaining = cut(first.select("chunk_id"))

    def report(name: str, df: DataFrame) -> None:
        if reports:
            df.write.mode("overwrite").parquet(f"{reports.rstrip('/')}/{name}/iter={n}")

    def left(rows: DataFrame, label) -> DataFrame:
        return rows.select("chunk_id", label.alias("cluster"), F.lit(n).alias("iter"), F.lit("left").alias("status"))

    def iteration() -> tuple[DataFrame, DataFrame | None, int]:
        """What this iteration decides, what is left over (None at the end), and how many clusters it validates."""
        count = remaining.count()
        reason = f"maxiter_{n}" if n >= p.max_iter else f"lastcluster_{n}" if clusters_left <= 1 else f"notenough_{n}" if count < p.min_rows else None
        if reason:
            return left(remaining, F.lit(reason)), None, 0
        merged, fitted = reduce.merge_models(models, remaining, p.pca_inertia, p.kpca, p.seed)
        if fitted.components.shape[1] > min(p.max_components, width // 3):
            return left(remaining, F.lit(f"unbinned_{n}")), None, 0
        merged = cut(merged)
        report("inputs", merged)
        report("explained_variance", spark.createDataFrame(list(enumerate(fitted.ratio.tolist())), "component int, ratio double"))
        if reports:
            report("component_origins", reduce.component_origins(merged, models, min(10, fitted.components.shape[1])))
        labels, _ = vbgmm.fit(merged, clusters_left, p.seed, p.restarts, p.init, spec, p.vb_iter, p.epsilon, p.bound)
        labels = cut(labels.join(spec, "chunk_id"))
        curated = post.reassign_tiny(labels) if p.mode == "reassigntiny" else labels.withColumn("curated", F.col("cluster"))
        rows = cut(curated.select("chunk_id", "seq_ord", F.col("curated").alias("cluster")).join(merged, "chunk_id"))
        scores = cut(post.silhouettes(rows).join(spec.select("chunk_id", "seq_ord"), "chunk_id"))
        verdict = cut(post.verdicts(scores))
        if reports:
            report("clusters", curated.select("chunk_id", "cluster", "curated"))
            report("mustlink", post.must_link_report(curated.select("contig_id", F.col("curated").alias("cluster"))))
            report("verdicts", verdict)
            report("boxes", post.box_stats(scores))
            report("coordinates", reduce.coordinates(merged))
        good = verdict.where("accepted").count()
        if not good:
            return left(scores, F.concat(F.lit("badbinned_"), F.col("cluster").cast("string"))), None, 0
        kept, rest = post.extract_validated(scores, verdict)
        order = kept.groupBy("cluster").agg(F.min("seq_ord").alias("first")).withColumn("k", F.row_number().over(W.orderBy("first")) - 1 + number)  # a row a cluster
        named = kept.join(F.broadcast(order), "cluster")
        return named.select("chunk_id", F.col("k").cast("string").alias("cluster"), F.lit(n).alias("iter"), F.lit("validated").alias("status")), rest, good

    while remaining is not None and remaining.limit(1).count():
        with scope(spark) as keep:
            decided, rest, good = iteration()
            done.append(keep(cut(decided)))
            rest = None if rest is None else keep(cut(rest.select("chunk_id")))
        number, clusters_left = number + good, clusters_left - good
        if log:
            log.commit(n, done[-1], rest, number, clusters_left)
        remaining, n = rest, n + 1
    if not done:
        return remaining.select("chunk_id", F.lit(None).cast("string").alias("cluster"), F.lit(0).alias("iter"), F.lit("left").alias("status"))
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out
