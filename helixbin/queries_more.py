"""Further registered queries: files written and read again, models, invariants of what SQL can't compute, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sql
from .functions.dna import check_mask, sanitize
from .models import CoverageModel, KmerModel
from .operators import bank as banks
from .operators import coding, contig2vec, kmer, post, reduce, vbgmm
from .operators.bank import BankSpec
from .plans import pipeline
from .queries import _SILHOUETTE, _TURNS, AUTO, _dna_sql, _kmer_sql, _labelled_vectors, _models, _turns, bank, contigs, table
from .scratch import cut, folder
from .sources import fasta, tables
from .streaming import features

REPEATS = 400
MASKS = ("1111", "110011", "1101", "011", "1", "101", "12021", "")
BLUE = (("A", 1), ("C", 2), ("G", 3), ("T", 4))


def _at(spark: SparkSession) -> str:
    return f"{folder(spark)}/helixbin-query-{uuid.uuid4().hex}"


def repeated_ids(spark, sf_dir):
    """Documents whose id shares a remainder stand for contigs of one id; the last that is long enough stays."""
    c = contigs(spark, sf_dir).withColumn("contig_id", (F.col("contig_ord") % REPEATS).cast("string"))
    return banks.build(c, AUTO).select("contig_id", "chunk_ix", "chunk_id", F.md5("seq").alias("seq_md5"))


def fasta_round_trip(spark, sf_dir):
    path = fasta.write(bank(spark, sf_dir), _at(spark), compress=True)
    return fasta.read(spark, path).select(F.col("contig_id").alias("chunk_id"), F.length("seq").alias("length"), F.md5("seq").alias("seq_md5"))


def fasta_records(spark, sf_dir):
    """Records of 1500 letters or more, and those of a subset that is appended."""
    b = cut(bank(spark, sf_dir))
    path = fasta.write(b, _at(spark))
    fasta.write(b, path, ids=b.where("chunk_ix = 0").select("chunk_id"), append=True)
    return spark.createDataFrame([(fasta.count_records(spark, path), fasta.count_records(spark, path, 1500))], "records long, long_records long")


def store_round_trip(spark, sf_dir):
    store = pipeline.characterize(spark, contigs(spark, sf_dir), _at(spark), AUTO, {"kmers3": KmerModel("111").transform, "kmers1001001": KmerModel("1001001").transform})
    tables.rewrite(store)
    loaded = store.load_models(store.models())
    rows = [df.select(F.lit(name).alias("model"), "chunk_id", F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("total")) for name, df in loaded.items()]
    return rows[0].unionByName(rows[1]).join(store.bank()[0].select("chunk_id", F.length("seq").alias("length")), "chunk_id")


def coverage_files(spark, sf_dir):
    """A CSV file by position (chunk lengths) and a TSV file by id, where every second chunk has no value."""
    b, path = cut(bank(spark, sf_dir)), _at(spark)
    b.select("seq_ord", F.length("seq").alias("v")).orderBy("seq_ord").select("v").write.csv(f"{path}/a.csv")
    b.where("chunk_ix % 2 = 0").select("chunk_id", F.col("chunk_ix").alias("cov")).write.option("header", True).option("sep", "\t").csv(f"{path}/b.tsv")
    f = CoverageModel([f"{path}/a.csv", f"{path}/b.tsv", f"{path}/c.txt"]).fit_transform(b)
    return f.select("chunk_id", F.col("features")[0].alias("cov_0"), F.col("features")[1].alias("cov_1"))


def _genes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("s"), "l_orderkey").alias("seqid"), F.col("l_linenumber").alias("i"), (F.col("l_partkey") % 1000 + 1).cast("int").alias("start"), (F.col("l_partkey") % 1000 + F.col("l_quantity")).cast("int").alias("end"))


def gff_round_trip(spark, sf_dir):
    path = _at(spark)
    line = F.concat_ws("\t", "seqid", F.lit("tool"), F.lit("gene"), "start", "end", F.lit("."), F.lit("+"), F.lit("0"), F.concat(F.lit("ID="), "i"))
    _genes(spark, sf_dir).select(line.alias("value")).write.text(path)
    genes = tables.read_gff(spark, path)
    n = tables.count_sequences(genes)
    return coding.density(genes).select("seqid", F.round("density", 9).alias("density"), F.lit(n).alias("n_sequences"))


def gene_reports(spark, sf_dir):
    """A finder's text report: a header and two comments for each sequence, then its genes."""
    g = _genes(spark, sf_dir)
    head = g.groupBy("seqid").agg(F.max("i").alias("n")).select(F.substring("seqid", 2, 20).cast("long").alias("o"), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), t.alias("value")) for k, t in ((-3, F.concat(F.lit("# "), "seqid")), (-2, F.lit("# gc = 0.5")), (-1, F.lit("# self: -")))))).alias("e"))
    gene = F.concat_ws("\t", F.concat(F.lit("gene_"), "i"), "start", "end", F.lit("+"), F.lit("0"), F.lit("11"), F.lit("1.5"), F.lit("-"), F.lit("-"), F.lit("-"), F.lit("-"))
    rows = head.select("o", "e.k", "e.value").unionByName(g.select(F.substring("seqid", 2, 20).cast("long").alias("o"), F.col("i").alias("k"), gene.alias("value")))
    return coding.parse_mga(rows.select((F.col("o") * 16 + F.col("k")).alias("row_ord"), "value")).select("seqid", "start", "end", "score", "strand")


def clustering_round_trip(spark, sf_dir):
    path, turns = _at(spark), cut(_turns(spark, sf_dir))
    tables.write_clustering(turns.where("cluster <> 3").select("chunk_id", "cluster"), path)
    return tables.reindexed(turns, tables.read_clustering(spark, path))


def z_scores(spark, sf_dir):
    rows = reduce.z_scores(_labelled_vectors(spark, sf_dir).select("chunk_id", "features"))
    return rows.select("chunk_id", F.posexplode("features").alias("i", "z")).select("chunk_id", "i", (F.round("z", 6) + 0.0).alias("z"))


def kpca_norms(spark, sf_dir):
    """All components of cosine kernel PCA keep the centred kernel: its diagonal is the squared length of their scores."""
    rows = _labelled_vectors(spark, sf_dir).select("chunk_id", "features")
    scores = reduce.Projection.fit(rows, True).transform(rows)
    return scores.select("chunk_id", F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


def joined_models(spark, sf_dir):
    b, models = _models(spark, sf_dir)
    rows = reduce.joined(models, b)
    total = lambda at, n: F.aggregate(F.slice("features", at, n), F.lit(0.0), lambda a, x: a + x)
    return rows.select("chunk_id", F.size("features").alias("width"), total(1, 136).alias("kmers4"), total(137, 32).alias("kmers3"))


def row_sample(spark, sf_dir):
    v = _labelled_vectors(spark, sf_dir)
    n = v.count()
    some = reduce.sample(v, reduce.sample_size(n, 0.5) // 4)
    return some.join(v, ["chunk_id"], "left_semi").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("n_distinct"))


def sif_means(spark, sf_dir):
    """Weighted means of words whose vectors count their letters."""
    words = [(a + b + c, [float((a + b + c).count(x)) for x, _ in BLUE]) for a in "ACGT" for b in "ACGT" for c in "ACGT"]
    b = bank(spark, sf_dir)
    p = contig2vec.frequencies(contig2vec.word_counts(b, 3))
    vectors = spark.createDataFrame(words, "word string, vector array<double>")
    rows = contig2vec.means(b, 3, p.join(vectors, "word").select("word", (1e-3 / (1e-3 + F.col("p"))).alias("weight"), "vector"))
    return rows.select("chunk_id", *(F.round(F.col("features")[i], 9).alias(x) for i, (x, _) in enumerate(BLUE)))


def tokens(spark, sf_dir):
    t = contig2vec.tokens(bank(spark, sf_dir), 4)
    return t.select("chunk_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def observed_features(spark, sf_dir):
    words = kmer.observed_vocabulary(kmer.count(bank(spark, sf_dir), "101"))
    return spark.createDataFrame([(w, i) for i, w in enumerate(words)], "feature string, place long")


def sanitised(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    modes = {f"{m}_{c}": F.md5(sanitize(F.col("text"), m, c)) for m in ("strict", "iupac") for c in ("preserve",)} | {"strict_upper": F.md5(sanitize(F.translate("text", "éèêëçàâäöüßñíóúáïîôûœæÉÈÊÇÀÂÄÖÜÑÍÓÚÁÔÛ", ""), "strict"))}
    return d.select("doc_id", *(c.alias(k) for k, c in modes.items()))


def mask_validation(spark, sf_dir):
    out = []
    for m in MASKS:
        try:
            check_mask(m)
            out.append((m, True))
        except ValueError:
            out.append((m, False))
    return spark.createDataFrame(out, "mask string, valid boolean")


def sql_functions(spark, sf_dir):
    sql.register(spark)
    view = f"sql_functions_{uuid.uuid4().hex}"
    table(spark, sf_dir, "benchmark").createOrReplaceTempView(view)
    return spark.sql(f"SELECT item_id, md5(reverse_complement(dna_from_letters(text))) AS rc_md5, md5(dna_sanitize(regexp_replace(text, '[^ -~]', ''))) AS sanitized, md5(canonical_kmer(dna_from_letters(text))) AS strand, md5(array_join(kmers(dna_from_letters(text), 5), ',')) AS words FROM {view}")


def mustlink_report(spark, sf_dir):
    return post.must_link_report(_turns(spark, sf_dir)).select("ci", "cj", "n", F.round("perc", 9).alias("perc"))


def mixture_moments(spark, sf_dir):
    """Means and maximum-likelihood variances of the labelled vectors' clusters, as a mixture's M step has them."""
    p = vbgmm.parameters(_labelled_vectors(spark, sf_dir))
    z = p.select("cluster", "n", F.posexplode("mean").alias("i", "mean"), "covariance")
    return z.select("cluster", "n", "i", (F.round("mean", 6) + 0.0).alias("mean"), F.round(F.get(F.get("covariance", F.col("i")), F.col("i")), 6).alias("variance"))


def single_component(spark, sf_dir):
    """A mixture of one component holds every row."""
    labels, runs = vbgmm.fit(_labelled_vectors(spark, sf_dir).select("chunk_id", "features"), 1, restarts=2, max_iter=5)
    return labels.crossJoin(F.broadcast(runs.agg(F.count("*").alias("restarts"), F.max("n_clusters").alias("n_clusters"))))


def silhouette_extraction(spark, sf_dir):
    s = post.silhouettes(_labelled_vectors(spark, sf_dir))
    kept, rest = post.extract_validated(s, post.verdicts(s))
    return kept.select("chunk_id", F.lit(True).alias("validated")).unionByName(rest.select("chunk_id", F.lit(False).alias("validated")))


def stream_counts(spark, sf_dir):
    """k-mer counts of a stream of files."""
    path = _at(spark)
    contigs(spark, sf_dir).select("contig_id", "contig_ord", "seq").repartition(4).write.parquet(f"{path}/in")
    stream = features.kmer_stream(features.read_contigs(spark, f"{path}/in", 2), AUTO, "111")
    features.write_counts(stream, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out")


def plot_coordinates(spark, sf_dir):
    """Squared lengths in the two plot coordinates never exceed those of the z-scores, and both have mean 0."""
    v = _labelled_vectors(spark, sf_dir).select("chunk_id", "features")
    path = _at(spark)
    xy = reduce.coordinates(reduce.coordinates(v, path).select("chunk_id", F.array("x", "y").alias("features")), path)  # the second call reads what the first wrote
    return xy.agg(F.count("*").alias("n"), (F.abs(F.round(F.avg("x"), 6)) + 0.0).alias("x"), (F.abs(F.round(F.avg("y"), 6)) + 0.0).alias("y"), (F.stddev_pop("x") >= F.stddev_pop("y")).alias("ordered"))


def extract_once(spark, sf_dir):
    """Iterative extraction gives every chunk one cluster, and its reports one row for each of an iteration's chunks."""
    b, models = _models(spark, sf_dir)
    path = _at(spark)
    models = {"kmers3": cut(models["kmers3"])}
    out = cut(pipeline.extract(spark, b, models, pipeline.Extraction(max_iter=2, max_cluster=8, restarts=2, vb_iter=30), path))
    first = spark.read.parquet(f"{path}/clusters").where("iter = 0").select("chunk_id", F.lit(True).alias("reported"))
    return out.groupBy("chunk_id").agg(F.count("cluster").alias("n")).join(first, "chunk_id", "left")


_WORDS = "'[^ATGCYRSWKMBDHVN]'"

QUERIES = {f.__name__: f for f in (
    repeated_ids, fasta_round_trip, fasta_records, store_round_trip, coverage_files, gff_round_trip, gene_reports, clustering_round_trip, z_scores, kpca_norms, joined_models, row_sample, sif_means,
    tokens, observed_features, sanitised, mask_validation, sql_functions, mustlink_report, mixture_moments, single_component, silhouette_extraction, stream_counts, plot_coordinates, extract_once,
)}

_BANK = f"WITH {_dna_sql(AUTO)}"
_V = "v AS (SELECT CAST(vec_id AS VARCHAR) AS chunk_id, label, CAST(embedding AS DOUBLE[]) AS f FROM embeddings), x AS (SELECT chunk_id, label, f, CAST(i AS INTEGER) AS i, f[i + 1] AS x FROM (SELECT *, unnest(range(0, len(f))) AS i FROM v))"
_GENES = "g AS (SELECT 's' || l_orderkey AS seqid, l_linenumber AS i, CAST(l_partkey % 1000 + 1 AS INTEGER) AS s, CAST(l_partkey % 1000 + l_quantity AS INTEGER) AS e FROM lineitem)"
_DNA = "translate(upper(regexp_replace(text, '[^a-zA-Z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ATGCATGCATGCATGCATGCATGCAN')"
_RC = lambda x: f"reverse(translate({x}, 'ATGCYRSWKMBDHVN', 'TACGRYSWMKVHDBN'))"
_ACCENTS = "éèêëçàâäöüßñíóúáïîôûœæÉÈÊÇÀÂÄÖÜÑÍÓÚÁÔÛ"

ORACLES = {
    "repeated_ids": _BANK.replace("CAST(doc_id AS VARCHAR) AS contig_id", f"CAST(doc_id % {REPEATS} AS VARCHAR) AS contig_id").replace("kept AS (SELECT *, length(s) AS len FROM dna WHERE length(s) >= 1000 )", "kept AS (SELECT *, length(s) AS len FROM dna WHERE length(s) >= 1000 QUALIFY contig_ord = max(contig_ord) OVER (PARTITION BY contig_id))")
    + " SELECT contig_id, chunk_ix, chunk_id, md5(seq) AS seq_md5 FROM bank",
    "fasta_round_trip": f"{_BANK} SELECT chunk_id, CAST(length(seq) AS INTEGER) AS length, md5(seq) AS seq_md5 FROM bank",
    "fasta_records": f"{_BANK} SELECT count(*) + count(*) FILTER (chunk_ix = 0) AS records, count(*) FILTER (length(seq) >= 1500) + count(*) FILTER (length(seq) >= 1500 AND chunk_ix = 0) AS long_records FROM bank",
    "store_round_trip": " UNION ALL ".join(f"SELECT chunk_id, '{name}' AS model, CAST(coalesce(t, 0) AS DOUBLE) AS total, length FROM (WITH {_dna_sql(AUTO)} SELECT chunk_id, CAST(length(seq) AS INTEGER) AS length FROM bank) LEFT JOIN (SELECT chunk_id, sum(n) AS t FROM ({_kmer_sql(mask)}) GROUP BY 1) USING (chunk_id)" for name, mask in (("kmers3", "111"), ("kmers1001001", "1001001"))),
    "coverage_files": f"{_BANK} SELECT chunk_id, CAST(length(seq) AS DOUBLE) AS cov_0, CASE WHEN chunk_ix % 2 = 0 THEN CAST(chunk_ix AS DOUBLE) END AS cov_1 FROM bank",
    "gff_round_trip": f"WITH {_GENES} SELECT seqid, round(sum(abs(e - (s - 1))) / max(e), 9) AS density, (SELECT count(DISTINCT seqid) FROM g) AS n_sequences FROM g GROUP BY 1",
    "gene_reports": f"WITH {_GENES} SELECT seqid, s AS start, e AS \"end\", CAST(1.5 AS DOUBLE) AS score, '+' AS strand FROM g",
    "clustering_round_trip": f"WITH {_TURNS} SELECT chunk_id, CASE WHEN cluster <> 3 THEN CAST(cluster AS VARCHAR) END AS cluster FROM t",
    "z_scores": f"WITH {_V}, s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS d FROM x GROUP BY 1) SELECT chunk_id, i, round((x - m) / d, 6) + 0.0 AS z FROM x JOIN s USING (i)",
    "kpca_norms": f"WITH {_V}, u AS (SELECT chunk_id, i, x / sqrt(list_sum(list_transform(f, lambda e: e * e))) AS u FROM x), m AS (SELECT i, avg(u) AS m FROM u GROUP BY 1) SELECT chunk_id, round(sum((u - m) * (u - m)), 6) AS norm FROM u JOIN m USING (i) GROUP BY 1",
    "joined_models": f"SELECT chunk_id, CAST(168 AS INTEGER) AS width, CAST(coalesce(a, 0) AS DOUBLE) AS kmers4, CAST(coalesce(b, 0) AS DOUBLE) AS kmers3 FROM (WITH {_dna_sql(AUTO)} SELECT chunk_id FROM bank) LEFT JOIN (SELECT chunk_id, sum(n) AS a FROM ({_kmer_sql('1111')}) GROUP BY 1) USING (chunk_id) LEFT JOIN (SELECT chunk_id, sum(n) AS b FROM ({_kmer_sql('111')}) GROUP BY 1) USING (chunk_id)",
    "row_sample": "SELECT CAST(k AS BIGINT) AS n, CAST(k AS BIGINT) AS n_distinct FROM (SELECT least(greatest(count(*) // 2, 3333), count(*)) // 4 AS k FROM embeddings)",
    "sif_means": f"{_BANK}, k AS (SELECT chunk_id, substr(seq, i, 3) AS word FROM (SELECT chunk_id, seq, unnest(range(1, length(seq) - 1)) AS i FROM bank)), c AS (SELECT chunk_id, word, count(*) AS n FROM k WHERE NOT contains(word, 'N') GROUP BY 1, 2), "
    "p AS (SELECT word, sum(n) / (SELECT sum(n) FROM c) AS p FROM c GROUP BY 1), w AS (SELECT chunk_id, word, n, n * 1e-3::DOUBLE / (1e-3::DOUBLE + p) AS w FROM c JOIN p USING (word)) SELECT chunk_id, "
    + ", ".join(f"round(sum(w * (3 - length(replace(word, '{x}', '')))) / sum(n), 9) AS \"{x}\"" for x, _ in BLUE) + " FROM w GROUP BY 1",
    "tokens": f"{_BANK}, w AS (SELECT chunk_id, list_filter(list_transform(range(1, length(seq) - 2), lambda i: substr(seq, i, 4)), lambda x: NOT contains(x, 'N')) AS t FROM bank) SELECT chunk_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM w",
    "observed_features": f"SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS place FROM (SELECT DISTINCT feature FROM ({_kmer_sql('101')}))",
    "sanitised": f"SELECT doc_id, md5(regexp_replace(text, '[^ATGCatgc]', 'N', 'g')) AS strict_preserve, md5(regexp_replace(text, '[^ATGCYRSWKMBDHVNatgcyrswkmbdhvn]', 'N', 'g')) AS iupac_preserve, md5(regexp_replace(upper(translate(text, '{_ACCENTS}', '')), '[^ATGC]', 'N', 'g')) AS strict_upper FROM documents",
    "mask_validation": "SELECT m AS mask, regexp_full_match(m, '1[01]*1') AND m = reverse(m) AS valid FROM (SELECT unnest([" + ", ".join(f"'{m}'" for m in MASKS) + "]) AS m)",
    "sql_functions": f"SELECT item_id, md5({_RC(_DNA)}) AS rc_md5, md5(regexp_replace(upper(regexp_replace(text, '[^ -~]', '', 'g')), '[^ATGC]', 'N', 'g')) AS sanitized, md5(least({_DNA}, {_RC(_DNA)})) AS strand, md5(array_to_string(list_transform(range(1, length({_DNA}) - 3), lambda i: substr({_DNA}, i, 5)), ',')) AS words FROM benchmark",
    "mustlink_report": f"WITH {_TURNS} SELECT ci, cj, n, round(purity, 9) AS perc FROM m JOIN u ON u.cluster = m.ci",
    "mixture_moments": f"WITH {_V} SELECT label AS cluster, count(*) AS n, i, round(avg(x), 6) + 0.0 AS mean, round(var_pop(x) + 1e-3::DOUBLE / count(*), 6) AS variance FROM x GROUP BY label, i",
    "single_component": "SELECT CAST(vec_id AS VARCHAR) AS chunk_id, CAST(0 AS INTEGER) AS cluster, CAST(2 AS BIGINT) AS restarts, CAST(1 AS INTEGER) AS n_clusters FROM embeddings",
    "silhouette_extraction": f"WITH {_SILHOUETTE} SELECT chunk_id, accepted AS validated FROM s JOIN g USING (cluster)",
    "stream_counts": _kmer_sql("111"),
    "plot_coordinates": "SELECT count(*) AS n, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, true AS ordered FROM embeddings",
    "extract_once": f"{_BANK} SELECT chunk_id, CAST(1 AS BIGINT) AS n, true AS reported FROM bank",
    "reassign_tiny": f"""WITH RECURSIVE {_TURNS}, sz AS (SELECT cluster, count(*) AS c FROM t GROUP BY 1), lim AS (SELECT greatest(quantile_cont(c, 0.15), {post.MIN_TINY}) AS l FROM sz),
o AS (SELECT contig_id, list(chunk_id ORDER BY seq_ord) AS ids, list(cluster ORDER BY seq_ord) AS labels, list(c <= l ORDER BY seq_ord) AS tiny FROM t JOIN sz USING (cluster), lim GROUP BY 1),
r(contig_id, ids, old, tiny, i, labels) AS (SELECT contig_id, ids, labels, tiny, 0, labels FROM o UNION ALL
 SELECT contig_id, ids, old, tiny, i + 1, CASE WHEN NOT tiny[i + 1] THEN labels WHEN len(labels) < 2 THEN [{post.UNBINNED}] ELSE list_slice(labels, 1, i) || [(SELECT x FROM (SELECT unnest(labels) AS x, generate_subscripts(labels, 1) AS place) GROUP BY x ORDER BY count(*) DESC, min(place) LIMIT 1)] || list_slice(labels, i + 2, len(labels)) END FROM r WHERE i < len(labels))
SELECT unnest(ids) AS chunk_id, unnest(old) AS cluster, unnest(labels) AS curated FROM r WHERE i = len(labels)""",
}
