"""After clustering: must-link counts and purity, tiny-cluster reassignment, silhouettes and their verdicts."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, numbered

MIN_TINY = 50
MANY_GROUPS = 100_000
UNBINNED = -1


def must_link_matrix(labels: DataFrame) -> DataFrame:
    """``ci, cj, n``: must-link pairs between clusters, from counts by contig; no pair is formed.

    ``labels``: ``contig_id, cluster``. Pairs are ordered and include a chunk with itself.
    """
    counts = labels.groupBy("contig_id", "cluster").agg(F.count("*").alias("n"))
    left = counts.select("contig_id", F.col("cluster").alias("ci"), F.col("n").alias("a"))
    right = counts.select("contig_id", F.col("cluster").alias("cj"), F.col("n").alias("b"))
    return left.join(right, "contig_id").groupBy("ci", "cj").agg(F.sum(F.col("a") * F.col("b")).cast("long").alias("n"))


def must_link_purity(labels: DataFrame) -> DataFrame:
    """``cluster, purity``: the share of a cluster's must-link pairs that stay inside it."""
    m = must_link_matrix(labels)
    return m.groupBy(F.col("cj").alias("cluster")).agg((F.sum(F.when(F.col("ci") == F.col("cj"), F.col("n")).otherwise(0)) / F.sum("n")).alias("purity"))


def must_link_report(labels: DataFrame) -> DataFrame:
    """``ci, cj, n, perc``: the matrix, and in each row the share of column ``ci``'s pairs that stay inside it."""
    purity = must_link_purity(labels).select(F.col("cluster").alias("ci"), F.col("purity").alias("perc"))
    return must_link_matrix(labels).join(purity, "ci").select("ci", "cj", "n", "perc")


def pure_clusters(labels: DataFrame, tolerance: float = 0.9) -> DataFrame:
    """The rows of clusters whose purity reaches the tolerance."""
    return labels.join(must_link_purity(labels).where(F.col("purity") >= tolerance), "cluster", "left_semi")


def tiny_threshold(labels: DataFrame) -> float:
    """The 15th percentile of the cluster sizes, ``MIN_TINY`` at least."""
    p = labels.groupBy("cluster").count().agg(F.percentile("count", 0.15)).first()[0]
    return max(float(p or 0), MIN_TINY)


def reassign_tiny(labels: DataFrame) -> DataFrame:
    """``labels`` (``chunk_id, seq_ord, contig_id, cluster``) with ``curated``.

    Members of clusters of threshold size or less, in row order, take the commonest label among their contig's
    chunks, themselves included, with earlier reassignments seen and ties to the label met first; a chunk alone on its contig
    becomes ``UNBINNED``. Votes stay within a contig, which is the unit of parallel work; contigs without a tiny member aren't grouped.
    """
    limit = tiny_threshold(labels)
    tiny = labels.groupBy("cluster").count().where(F.col("count") <= limit).select("cluster", F.lit(True).alias("tiny"))
    marked = labels.select("chunk_id", "seq_ord", "contig_id", "cluster").join(F.broadcast(tiny), "cluster", "left").withColumn("tiny", F.coalesce("tiny", F.lit(False)))
    touched = marked.where("tiny").select("contig_id").distinct()
    same = marked.join(touched, "contig_id", "left_anti").select("chunk_id", "seq_ord", "contig_id", "cluster", F.col("cluster").alias("curated"))

    def vote(group: pa.Table) -> pa.Table:
        group = group.sort_by("seq_ord")
        label = group.column("cluster").to_pylist()
        n = Counter(label)
        for i, t in enumerate(group.column("tiny").to_pylist()):
            if not t:
                continue
            if len(label) < 2:
                label[i] = UNBINNED
                continue
            most = max(n.values())
            best = [x for x, c in n.items() if c == most]
            new = best[0] if len(best) == 1 else next(x for x in label if x in best)
            n[label[i]] -= 1
            n[new] += 1
            label[i] = new
        return group.drop_columns(["tiny"]).append_column("curated", pa.array(label, pa.int32())).select(["chunk_id", "seq_ord", "contig_id", "cluster", "curated"])

    voted = marked.join(touched, "contig_id", "left_semi").select("chunk_id", "seq_ord", "contig_id", "cluster", "tiny").groupBy("contig_id").applyInArrow(vote, "chunk_id string, seq_ord long, contig_id string, cluster int, curated int")
    return same.unionByName(voted)


def silhouettes(rows: DataFrame) -> DataFrame:
    """``chunk_id, cluster, silhouette``: cosine silhouettes in linear time.

    With unit vectors u, cluster sums S and sizes n: a = (n - u.S)/(n - 1), b = min over other clusters of 1 - u.S'/n'.
    Singletons, and everything if there is one cluster only, get 0. ``rows``: ``chunk_id, cluster, features``.
    """
    f = F.col("features")
    norm = F.sqrt(F.aggregate(f, F.lit(0.0), lambda a, x: a + x * x))
    units = rows.select("chunk_id", "cluster", F.when(norm > 0, F.transform(f, lambda x: x / norm)).otherwise(f).alias("u"))
    sums = units.select("cluster", F.posexplode("u").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    flat = {}
    for r in sums.collect():  # clusters by width
        flat.setdefault(r["cluster"], {})[r["i"]] = (r["s"], r["n"])
    names = sorted(flat)
    total = np.array([[flat[c][i][0] for i in range(len(flat[c]))] for c in names])
    size = np.array([flat[c][0][1] for c in names], float)

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            u = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            own = np.searchsorted(names, batch.column(1).to_numpy())
            dots = u @ total.T
            at = np.arange(len(u))
            n = size[own]
            a = (n - dots[at, own]) / np.maximum(n - 1, 1)
            other = 1 - dots / size
            other[at, own] = np.inf
            b = other.min(1)
            with np.errstate(invalid="ignore", divide="ignore"):
                s = (b - a) / np.maximum(a, b)
            s = np.where((n < 2) | ~np.isfinite(b) | ~np.isfinite(s), 0.0, s)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(s)], names=["chunk_id", "cluster", "silhouette"])

    return units.mapInArrow(work, f"chunk_id string, cluster {rows.schema['cluster'].dataType.simpleString()}, silhouette double")


def percentiles(scores: DataFrame, shares: dict[str, float], by: str | None = None, value: str = "silhouette") -> DataFrame:
    """Exact percentiles with linear interpolation, of all rows or by group: a distributed sort, then the rows of the ranks asked for.

    No task holds more than its range of the sorted values. Columns: ``by``, ``n``, and those named by ``shares``.
    """
    group = F.col(by) if by else F.lit(0)
    ranked = numbered(scores.select(group.alias("_g"), F.col(value).alias("_v")).where("_v IS NOT NULL"), "_g", "_v", name="_at")
    sizes = cut(ranked.groupBy("_g").agg(F.count("*").alias("n"), F.min("_at").alias("_first")))
    asked = F.array(*(F.struct(F.lit(k).alias("name"), (F.lit(float(q)) * (F.col("n") - 1)).alias("rank")) for k, q in shares.items()))
    ranks = sizes.select("_g", "n", "_first", F.explode(asked).alias("e")).select("_g", "n", "e.name", "e.rank", (F.col("_first") + F.floor("e.rank")).alias("low"), (F.col("_first") + F.ceil("e.rank")).alias("high"))
    ends = ranks.select("_g", F.explode(F.array("low", "high")).alias("_at")).distinct()
    values = cut(ranked.join(F.broadcast(ends) if sizes.count() <= MANY_GROUPS else ends, ["_g", "_at"]).select("_at", "_v"))  # two rows a percentile
    low, high = (values.select(F.col("_at").alias(c), F.col("_v").alias(f"_{c}")) for c in ("low", "high"))
    told = ranks.join(low, "low").join(high, "high").withColumn("_p", F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("rank") - F.floor("rank")))
    out = told.groupBy("_g", "n").agg(*(F.max(F.when(F.col("name") == k, F.col("_p"))).alias(k) for k in shares))
    return out.select(F.col("_g").alias(by), "n", *shares) if by else out.select("n", *shares)


def verdicts(scores: DataFrame, keep_unbinned: bool = False, min_cluster_size: int = 0) -> DataFrame:
    """``cluster, n, p10, q1, accepted``: a cluster needs its first quartile at the global median or above and its 10th percentile at 0 or above."""
    scores = cut(scores.select("cluster", "silhouette"))
    middle = percentiles(scores, {"global_median": 0.5}).first()
    by = percentiles(scores, {"p10": 0.10, "q1": 0.25}, "cluster")
    good = (F.col("q1") >= F.lit(middle["global_median"] if middle else None)) & (F.col("p10") >= 0) & (F.col("n") >= min_cluster_size)
    if not keep_unbinned:
        good = good & (F.col("cluster") != UNBINNED)
    return by.select("cluster", "n", "p10", "q1", good.alias("accepted"))


def box_stats(scores: DataFrame, min_size: int = 25) -> DataFrame:
    """The numbers of a box plot for each cluster of ``min_size`` rows or more: percentiles 10, 25, 50, 75, 90."""
    parts = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}
    return percentiles(scores, parts, "cluster").where(F.col("n") >= min_size)


def extract_validated(scores: DataFrame, verdict: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of accepted clusters, the ids that remain)."""
    good = verdict.where("accepted").select("cluster")
    return scores.join(good, "cluster", "left_semi"), scores.join(good, "cluster", "left_anti").select("chunk_id")
