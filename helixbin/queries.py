"""The reference operators' registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dna import BASES_OF_LETTERS, LETTERS, letters_as_dna
from .operators import bank as banks
from .operators import coding, contig2vec, coverage, ind, kmer, post, reduce, vbgmm
from .operators.bank import BankSpec
from .plans import pipeline
from .scratch import cut
from .session import ship

AUTO = BankSpec(1000, 2000, "auto")
MERGE0 = BankSpec(500, 2000, 0)
MERGE100 = BankSpec(500, 2000, 100)
K_IND = 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("contig_id"), F.col("doc_id").alias("contig_ord"), letters_as_dna(F.col("text")).alias("seq"))


def bank(spark: SparkSession, sf_dir: str, spec: BankSpec = AUTO) -> DataFrame:
    return banks.build(contigs(spark, sf_dir), spec)


def _chunks(spark, sf_dir, spec):
    return bank(spark, sf_dir, spec).select("contig_id", "chunk_ix", "chunk_id", F.length("seq").alias("length"), F.md5("seq").alias("seq_md5"))


def bank_chunks_auto(spark, sf_dir):
    return _chunks(spark, sf_dir, AUTO)


def bank_chunks_merge(spark, sf_dir):
    return _chunks(spark, sf_dir, MERGE0)


def bank_chunks_merge_overlap(spark, sf_dir):
    return _chunks(spark, sf_dir, MERGE100)


def bank_limit(spark, sf_dir):
    """The first contigs that are long enough; the limit is the operator."""
    return _chunks(spark, sf_dir, BankSpec(1000, 2000, "auto", max_contigs=50))


def mustlink_stats(spark, sf_dir):
    return banks.must_link_stats(bank(spark, sf_dir)).select("n_chunks", "nnz", F.round("density_percent", 9).alias("density_percent"))


def mustlink_groups(spark, sf_dir):
    g = banks.must_link_groups(bank(spark, sf_dir))
    return g.select("contig_id", F.size("members").alias("n"), F.array_join("members", ",").alias("members"))


def mustlink_pairs(spark, sf_dir):
    return banks.must_link_pairs(bank(spark, sf_dir))


def _kmers(mask, sql=False):
    def query(spark, sf_dir):
        return (kmer.count_sql if sql else kmer.count)(bank(spark, sf_dir), mask)

    return query


def kmer3_matrix(spark, sf_dir):
    b = bank(spark, sf_dir)
    return kmer.matrix(b, kmer.count(b, "111"), kmer.full_vocabulary("111"))


def ind_profile(spark, sf_dir):
    long = ind.long_form(ind.vectors(bank(spark, sf_dir), K_IND), K_IND)
    return long.select("chunk_id", "feature", F.round("value", 9).alias("value"))


def coverage_join(spark, sf_dir):
    """Events of a user stand for the coverage of the chunks of a document."""
    b = bank(spark, sf_dir)
    per = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("contig_id")).agg(F.count("*").cast("double").alias("value"))
    own = b.join(per, "contig_id").select("chunk_id", "value")
    low = b.join(per.where("value >= 2"), "contig_id").select("chunk_id", (F.col("value") / 2).alias("value"))
    return coverage.by_id(b, [own, low])


def coding_density(spark, sf_dir):
    """Order lines stand for genes of an order: quantity letters long, one after the other part number."""
    li = table(spark, sf_dir, "lineitem")
    genes = li.select(F.col("l_orderkey").cast("string").alias("seqid"), "l_linenumber", (F.col("l_partkey") % 1000 + 1).cast("int").alias("start"), (F.col("l_partkey") % 1000 + F.col("l_quantity")).cast("int").alias("end"))
    odd = genes.where("l_linenumber % 2 = 1")
    d = coding.across_tools({"all_lines": coding.density(genes), "odd_lines": coding.density(odd, "compat")})
    return d.select("seqid", F.round("all_lines", 9).alias("all_lines"), F.round("odd_lines", 9).alias("odd_lines"))


def tokens_sif(spark, sf_dir):
    """Weighted word shares before the common component goes: the vector of a word is its own weight."""
    b = bank(spark, sf_dir)
    p = cut(contig2vec.frequencies(contig2vec.word_totals(b, 3)))  # 64 words
    w = contig2vec.means(b, 3, p.select("word", (1e-3 / (1e-3 + F.col("p"))).alias("weight"), F.array(F.lit(1.0)).alias("vector")))
    return w.select("chunk_id", F.round(F.get("features", F.lit(0)), 9).alias("w"))


def _labelled_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("features"))


def _scores(spark, sf_dir):
    return post.silhouettes(_labelled_vectors(spark, sf_dir))


def cluster_silhouette(spark, sf_dir):
    return _scores(spark, sf_dir).select("chunk_id", "cluster", (F.round("silhouette", 6) + 0.0).alias("silhouette"))


def silhouette_verdicts(spark, sf_dir):
    v = post.verdicts(_scores(spark, sf_dir))
    return v.select("cluster", "n", (F.round("p10", 6) + 0.0).alias("p10"), (F.round("q1", 6) + 0.0).alias("q1"), "accepted")


def remaining_ids(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return post.extract_validated(s, post.verdicts(s))[1]


def silhouette_boxes(spark, sf_dir):
    b = post.box_stats(_scores(spark, sf_dir))
    return b.select("cluster", "n", *((F.round(c, 6) + 0.0).alias(c) for c in ("p10", "p25", "p50", "p75", "p90")))


def _turns(spark, sf_dir):
    """Turns stand for chunks of a conversation; their cluster is a bucket of their length."""
    t = table(spark, sf_dir, "conversations")
    return t.select(F.concat_ws("__", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq_ord"), F.col("conv_id").cast("string").alias("contig_id"), (F.length(F.coalesce("text", F.lit(""))) % 7).cast("int").alias("cluster"))


def mustlink_counts(spark, sf_dir):
    return post.must_link_matrix(_turns(spark, sf_dir))


def mustlink_purity(spark, sf_dir):
    return post.must_link_purity(_turns(spark, sf_dir)).select("cluster", F.round("purity", 9).alias("purity"))


def pure_clusters(spark, sf_dir):
    return post.pure_clusters(_turns(spark, sf_dir), 0.2).select("chunk_id", "cluster")


def reassign_tiny(spark, sf_dir):
    return post.reassign_tiny(_turns(spark, sf_dir)).select("chunk_id", "cluster", "curated")


def component_origin(spark, sf_dir):
    """Correlation of the first two coordinates with all coordinates of the vectors."""
    v = _labelled_vectors(spark, sf_dir)
    o = reduce.component_origins(v, {"embeddings": v}, 2)
    return o.select("component", "model", "feature_ix", (F.round("r", 6) + 0.0).alias("r"), (F.round("abs_r", 6) + 0.0).alias("abs_r"))


def _models(spark, sf_dir):
    b = cut(bank(spark, sf_dir))
    return b, {"kmers4": pipeline.DEFAULT_MODELS["kmers4"](b), "kmers3": pipeline.DEFAULT_MODELS["kmers3"](b)}


def cosine_kpca(spark, sf_dir):
    rows, _ = reduce.cosine_kpca(_models(spark, sf_dir)[1]["kmers4"], t=0.25)
    return rows.select("chunk_id", F.posexplode("features").alias("component", "value"))


def merge_models(spark, sf_dir):
    b, models = _models(spark, sf_dir)
    rows, _ = reduce.merge_models(models, b.select("chunk_id"), 0.99, {"inertia": 0.85, "t": 0.25})
    return rows.select("chunk_id", F.posexplode("features").alias("component", "value"))


def contig2vec_embed(spark, sf_dir):
    rows = contig2vec.embed(bank(spark, sf_dir), 4, size=20)
    return rows.select("chunk_id", F.posexplode("features").alias("component", "value"))


def vbgmm_bins(spark, sf_dir):
    b, models = _models(spark, sf_dir)
    rows, _ = reduce.cosine_kpca(models["kmers4"], t=0.25)
    return vbgmm.fit(rows, 20, restarts=4, max_iter=100, epsilon=1e-2)[0]


def extract_pipeline(spark, sf_dir):
    b, models = _models(spark, sf_dir)
    models = {k: cut(v) for k, v in models.items()}
    return pipeline.extract(spark, b, models, pipeline.Extraction(max_iter=3, max_cluster=20, restarts=4, vb_iter=100))


def _dna_sql(spec: BankSpec) -> str:
    c, o, m = spec.chunk_size, spec.letters, spec.min_length
    limit = f"ORDER BY contig_ord LIMIT {spec.max_contigs}" if spec.max_contigs else ""
    return f"""dna AS (SELECT CAST(doc_id AS VARCHAR) AS contig_id, doc_id AS contig_ord, translate(upper(regexp_replace(text, '[^a-zA-Z]', '', 'g')), '{LETTERS}', '{BASES_OF_LETTERS}') AS s FROM documents),
kept AS (SELECT *, length(s) AS len FROM dna WHERE length(s) >= {m} {limit}),
sized AS (SELECT *, CASE WHEN len <= {c} THEN 1 ELSE CAST(ceil((len - {c}) / {c - o}) AS INTEGER) + 1 END AS n FROM kept),
tails AS (SELECT *, n > 1 AND len - (n - 1) * {c - o} < {m} AS mg FROM sized),
cut AS (SELECT *, unnest(range(0, n - CASE WHEN mg THEN 1 ELSE 0 END)) AS j FROM tails),
bank AS (SELECT contig_id, contig_ord, CAST(j AS INTEGER) AS chunk_ix, contig_id || '__' || j AS chunk_id, CASE WHEN mg AND j = n - 2 THEN substr(s, j * {c - o} + 1, {c}) || substr(s, (j + 1) * {c - o} + 1, {c}) ELSE substr(s, j * {c - o} + 1, {c}) END AS seq FROM cut)"""


def _chunks_sql(spec: BankSpec) -> str:
    return f"WITH {_dna_sql(spec)} SELECT contig_id, chunk_ix, chunk_id, CAST(length(seq) AS INTEGER) AS length, md5(seq) AS seq_md5 FROM bank"


def _kmer_sql(mask: str) -> str:
    parts, at = [], 0
    import re

    for m in re.finditer(r"1+|0+", mask):
        parts.append(f"substr(k, {at + 1}, {len(m[0])})" if m[0][0] == "1" else f"'{'x' * len(m[0])}'")
        at += len(m[0])
    masked = " || ".join(parts)
    w = len(mask)
    return f"""WITH {_dna_sql(AUTO)}, w AS (SELECT chunk_id, seq, unnest(range(1, length(seq) - {w} + 2)) AS i FROM bank WHERE length(seq) >= {w}),
r AS (SELECT chunk_id, substr(seq, i, {w}) AS k, count(*) AS c FROM w GROUP BY 1, 2), q AS (SELECT chunk_id, {masked} AS k, c FROM r)
SELECT chunk_id, least(k, reverse(translate(k, 'ATGC', 'TACG'))) AS feature, CAST(sum(c) AS BIGINT) AS n FROM q WHERE NOT contains(k, 'N') GROUP BY 1, 2"""


def _matrix_sql() -> str:
    cols = ", ".join(f"CAST(coalesce(sum(n) FILTER (feature = '{v}'), 0) AS BIGINT) AS \"{v}\"" for v in kmer.full_vocabulary("111"))
    return f"WITH c AS ({_kmer_sql('111')}), b AS (SELECT chunk_id FROM (WITH {_dna_sql(AUTO)} SELECT chunk_id FROM bank)) SELECT b.chunk_id, {cols} FROM b LEFT JOIN c USING (chunk_id) GROUP BY 1"


def _ind_sql() -> str:
    ks = K_IND
    last = ", ".join(f"max(CASE WHEN ch = '{e}' THEN p END) OVER w AS l{e}" for e in "ATGC")
    dist = " UNION ALL ".join(f"SELECT chunk_id, '{e}' || ch AS pair, p - l{e} AS d FROM l WHERE ch IN ('A','T','G','C') AND l{e} IS NOT NULL AND (ch = '{e}' OR l{e} > coalesce(CASE ch WHEN 'A' THEN lA WHEN 'T' THEN lT WHEN 'G' THEN lG WHEN 'C' THEN lC END, 0))" for e in "ATGC")
    return f"""WITH {_dna_sql(AUTO)}, x AS (SELECT chunk_id, length(seq) AS len, p, substr(seq, p, 1) AS ch FROM (SELECT chunk_id, seq, unnest(range(1, length(seq) + 1)) AS p FROM bank)),
l AS (SELECT chunk_id, p, ch, {last} FROM x WINDOW w AS (PARTITION BY chunk_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS ({dist}), f0 AS (SELECT chunk_id, 'f0_' || pair AS stem, d AS k, count(*) AS c, sum(count(*)) OVER (PARTITION BY chunk_id, pair) AS t FROM d GROUP BY chunk_id, pair, d),
g AS (SELECT *, CASE WHEN ch = lag(ch) OVER (PARTITION BY chunk_id ORDER BY p) THEN 0 ELSE 1 END AS s FROM x), h AS (SELECT *, sum(s) OVER (PARTITION BY chunk_id ORDER BY p) AS run FROM g),
r AS (SELECT chunk_id, ch, CASE WHEN max(p) = max(len) THEN 1 ELSE count(*) END AS k FROM h WHERE ch IN ('A','T','G','C') GROUP BY chunk_id, ch, run),
f1 AS (SELECT chunk_id, 'f1_' || ch AS stem, k, count(*) AS c, sum(count(*)) OVER (PARTITION BY chunk_id, ch) AS t FROM r GROUP BY chunk_id, ch, k)
SELECT chunk_id, stem || '_' || k AS feature, round(c / t, 9) AS value FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f1) WHERE k <= {ks}"""


_SILHOUETTE = """v AS (SELECT CAST(vec_id AS VARCHAR) AS chunk_id, label AS cluster, CAST(embedding AS DOUBLE[]) AS f FROM embeddings),
d AS (SELECT a.chunk_id, a.cluster, b.cluster AS other, avg(1 - list_cosine_similarity(a.f, b.f)) AS m FROM v a JOIN v b ON a.chunk_id <> b.chunk_id GROUP BY 1, 2, 3),
s AS (SELECT chunk_id, cluster, CASE WHEN max(m) FILTER (other = cluster) IS NULL THEN 0 ELSE (min(m) FILTER (other <> cluster) - max(m) FILTER (other = cluster)) / greatest(min(m) FILTER (other <> cluster), max(m) FILTER (other = cluster)) END AS silhouette FROM d GROUP BY 1, 2),
q AS (SELECT cluster, count(*) AS n, quantile_cont(silhouette, 0.10) AS p10, quantile_cont(silhouette, 0.25) AS q1, quantile_cont(silhouette, 0.5) AS p50, quantile_cont(silhouette, 0.75) AS p75, quantile_cont(silhouette, 0.9) AS p90 FROM s GROUP BY 1),
g AS (SELECT cluster, n, p10, q1, q1 >= (SELECT median(silhouette) FROM s) AND p10 >= 0 AND cluster <> -1 AS accepted FROM q)"""

_TURNS = """t AS (SELECT CAST(conv_id AS VARCHAR) || '__' || turn AS chunk_id, conv_id * 1000 + turn AS seq_ord, CAST(conv_id AS VARCHAR) AS contig_id, CAST(length(coalesce(text, '')) % 7 AS INTEGER) AS cluster FROM conversations),
m AS (SELECT a.cluster AS ci, b.cluster AS cj, count(*) AS n FROM t a JOIN t b USING (contig_id) GROUP BY 1, 2),
u AS (SELECT cj AS cluster, coalesce(sum(n) FILTER (ci = cj), 0) / sum(n) AS purity FROM m GROUP BY 1)"""

QUERIES = {
    "bank_chunks_auto": bank_chunks_auto,
    "bank_chunks_merge": bank_chunks_merge,
    "bank_chunks_merge_overlap": bank_chunks_merge_overlap,
    "bank_limit": bank_limit,
    "mustlink_stats": mustlink_stats,
    "mustlink_groups": mustlink_groups,
    "mustlink_pairs": mustlink_pairs,
    "kmer4_counts": _kmers("1111"),
    "kmer4_counts_sql": _kmers("1111", sql=True),
    "spaced_110011_counts": _kmers("110011"),
    "spaced_1001001_counts": _kmers("1001001"),
    "spaced_11000100011_counts": _kmers("11000100011"),
    "kmer3_matrix": kmer3_matrix,
    "ind_profile": ind_profile,
    "coverage_join": coverage_join,
    "coding_density": coding_density,
    "tokens_sif": tokens_sif,
    "cluster_silhouette": cluster_silhouette,
    "silhouette_verdicts": silhouette_verdicts,
    "silhouette_boxes": silhouette_boxes,
    "remaining_ids": remaining_ids,
    "mustlink_counts": mustlink_counts,
    "mustlink_purity": mustlink_purity,
    "pure_clusters": pure_clusters,
    "reassign_tiny": reassign_tiny,
    "component_origin": component_origin,
    "cosine_kpca": cosine_kpca,
    "merge_models": merge_models,
    "contig2vec_embed": contig2vec_embed,
    "vbgmm_bins": vbgmm_bins,
    "extract_pipeline": extract_pipeline,
}

ORACLES = {
    "bank_chunks_auto": _chunks_sql(AUTO),
    "bank_chunks_merge": _chunks_sql(MERGE0),
    "bank_chunks_merge_overlap": _chunks_sql(MERGE100),
    "bank_limit": _chunks_sql(BankSpec(1000, 2000, "auto", max_contigs=50)),
    "mustlink_stats": f"WITH {_dna_sql(AUTO)}, g AS (SELECT contig_id, count(*) AS n FROM bank GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_chunks, CAST(sum(n * n) AS BIGINT) AS nnz, round(100 * sum(n * n) / (sum(n) * sum(n)), 9) AS density_percent FROM g",
    "mustlink_groups": f"WITH {_dna_sql(AUTO)} SELECT contig_id, CAST(count(*) AS INTEGER) AS n, string_agg(chunk_id, ',' ORDER BY chunk_ix) AS members FROM bank GROUP BY 1",
    "mustlink_pairs": f"WITH {_dna_sql(AUTO)} SELECT x.chunk_id AS a, y.chunk_id AS b FROM bank x JOIN bank y USING (contig_id)",
    "kmer4_counts": _kmer_sql("1111"),
    "kmer4_counts_sql": _kmer_sql("1111"),
    "spaced_110011_counts": _kmer_sql("110011"),
    "spaced_1001001_counts": _kmer_sql("1001001"),
    "spaced_11000100011_counts": _kmer_sql("11000100011"),
    "kmer3_matrix": _matrix_sql(),
    "ind_profile": _ind_sql(),
    "coverage_join": f"WITH {_dna_sql(AUTO)}, e AS (SELECT CAST(user_id AS VARCHAR) AS contig_id, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1) SELECT chunk_id, v AS cov_0, CASE WHEN v >= 2 THEN v / 2 END AS cov_1 FROM bank LEFT JOIN e USING (contig_id)",
    "coding_density": "WITH g AS (SELECT CAST(l_orderkey AS VARCHAR) AS seqid, l_linenumber AS ln, CAST(l_partkey % 1000 + 1 AS INTEGER) AS s, CAST(l_partkey % 1000 + l_quantity AS INTEGER) AS e FROM lineitem), "
    "a AS (SELECT seqid, sum(abs(e - (s - 1))) / max(e) AS d FROM g GROUP BY 1), b AS (SELECT seqid, sum(abs(e - (s - 1)) + 1) / max(e) AS d FROM g WHERE ln % 2 = 1 GROUP BY 1) SELECT seqid, round(coalesce(a.d, 0), 9) AS all_lines, round(coalesce(b.d, 0), 9) AS odd_lines FROM a FULL JOIN b USING (seqid)",
    "tokens_sif": f"WITH {_dna_sql(AUTO)}, k AS (SELECT chunk_id, substr(seq, i, 3) AS word FROM (SELECT chunk_id, seq, unnest(range(1, length(seq) - 1)) AS i FROM bank)), c AS (SELECT chunk_id, word, count(*) AS n FROM k WHERE NOT contains(word, 'N') GROUP BY 1, 2), "
    "p AS (SELECT word, sum(n) / (SELECT sum(n) FROM c) AS p FROM c GROUP BY 1) SELECT chunk_id, round(sum(n * 1e-3::DOUBLE / (1e-3::DOUBLE + p)) / sum(n), 9) AS w FROM c JOIN p USING (word) GROUP BY 1",
    "cluster_silhouette": f"WITH {_SILHOUETTE} SELECT chunk_id, cluster, round(silhouette, 6) + 0.0 AS silhouette FROM s",
    "silhouette_verdicts": f"WITH {_SILHOUETTE} SELECT cluster, n, round(p10, 6) + 0.0 AS p10, round(q1, 6) + 0.0 AS q1, accepted FROM g",
    "silhouette_boxes": f"WITH {_SILHOUETTE} SELECT cluster, n, round(p10, 6) + 0.0 AS p10, round(q1, 6) + 0.0 AS p25, round(p50, 6) + 0.0 AS p50, round(p75, 6) + 0.0 AS p75, round(p90, 6) + 0.0 AS p90 FROM q WHERE n >= 25",
    "remaining_ids": f"WITH {_SILHOUETTE} SELECT chunk_id FROM s JOIN g USING (cluster) WHERE NOT accepted",
    "mustlink_counts": f"WITH {_TURNS} SELECT ci, cj, n FROM m",
    "mustlink_purity": f"WITH {_TURNS} SELECT cluster, round(purity, 9) AS purity FROM u",
    "pure_clusters": f"WITH {_TURNS} SELECT chunk_id, cluster FROM t JOIN u USING (cluster) WHERE purity >= 0.2",
    "component_origin": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings), x AS (SELECT vec_id, f, unnest(range(0, len(f))) AS i FROM v) "
    "SELECT c AS component, 'embeddings' AS model, CAST(i AS INTEGER) AS feature_ix, round(corr(f[i + 1], f[c + 1]), 6) + 0.0 AS r, round(abs(corr(f[i + 1], f[c + 1])), 6) + 0.0 AS abs_r FROM x, (SELECT unnest([0, 1]) AS c) GROUP BY 1, 2, 3",
}
