"""Queries over the mixture's steps, and the same steps in SQL: three components over three features from a hashed start."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .operators import vbgmm
from .queries import table

D = K = 3
STEPS = 3
WAYS = {"cluster": True, "task": False}


def _points(spark, sf_dir):
    """Each feature sums every third number of a whole vector."""
    x = F.col("embedding").cast("array<double>")
    third = lambda j: F.aggregate(F.filter(x, lambda v, i: i % 3 == j), F.lit(0.0), lambda a, v: a + v)
    key = F.col("vec_id").cast("string")
    start = F.pmod(F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("long"), F.lit(K)).cast("int")
    return table(spark, sf_dir, "embeddings").select(key.alias("chunk_id"), F.array(*map(third, range(D))).alias("features"), start.alias("start"))


def mixture_steps(spark, sf_dir):
    """The components before each E step, and the bound that it reaches, both ways."""
    out = []
    for way, in_cluster in WAYS.items():
        for step, (s, bound) in enumerate(vbgmm.trace(_points(spark, sf_dir), K, STEPS, in_cluster)):
            for j in range(K):
                out.append((way, step, j, *(float(v) for v in (s.n[j], s.pi[j], s.nu[j], s.beta[j], *s.mean[j], s.log_lambda[j], bound))))
    numbers = ["n", "pi", "nu", "beta", *(f"mean_{i}" for i in range(D)), "log_lambda", "bound"]
    rows = spark.createDataFrame(out, f"way string, step int, component int, {', '.join(f'{c} double' for c in numbers)}")
    return rows.select("way", "step", "component", *((F.round(c, 5) + 0.0).alias(c) for c in numbers))


def mixture_responsibilities(spark, sf_dir):
    """Each row's share in each component at each E step, both ways."""
    rows, parts = _points(spark, sf_dir), []
    for way, in_cluster in WAYS.items():
        for step, (state, _) in enumerate(vbgmm.trace(rows, K, STEPS, in_cluster)):
            parts.append(vbgmm.responsibilities(rows, state).select(F.lit(way).alias("way"), F.lit(step).alias("step"), "chunk_id", F.posexplode("z").alias("component", "z")))
    return reduce(lambda a, b: a.unionByName(b), parts).select("way", "step", "chunk_id", "component", (F.round("z", 6) + 0.0).alias("z"))


PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


def _digamma(x: str) -> str:
    """The asymptotic series, which holds for large arguments."""
    return f"(ln({x}) - 1/(2*({x})) - 1/(12*({x})^2) + 1/(120*({x})^4) - 1/(252*({x})^6))"


def _steps_sql() -> str:
    sums = ", ".join([f"sum(z*x{i}) AS f{i}" for i in range(D)] + [f"sum(z*x{i}*x{j}) AS s{i}{j}" for i, j in PAIRS])
    own = lambda i, j: f"w{min(i, j)}{max(i, j)}"
    v = lambda i, j: f"v{min(i, j)}{max(i, j)}"
    minor = {(0, 0): "v11*v22-v12*v12", (0, 1): "v02*v12-v01*v22", (0, 2): "v01*v12-v02*v11", (1, 1): "v00*v22-v02*v02", (1, 2): "v01*v02-v00*v12", (2, 2): "v00*v11-v01*v01"}
    quad = lambda a: "(" + " + ".join(f"{own(i, j)}*{a(i)}*{a(j)}" for i in range(D) for j in range(D)) + ")"
    out = [f"""
r AS MATERIALIZED (SELECT CAST(vec_id AS VARCHAR) AS chunk_id, {', '.join(f"list_sum(list_filter(CAST(embedding AS DOUBLE[]), lambda v, i: (i - 1) % 3 = {j})) AS x{j}" for j in range(D))},
  CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 7) AS BIGINT) % {K} AS g FROM embeddings),
prior AS MATERIALIZED (SELECT {', '.join(f'{D}*var_samp(x{j}) AS p{j}' for j in range(D))} FROM r),
k AS (SELECT unnest(range({K})) AS component),
z0 AS MATERIALIZED (SELECT r.*, component, CASE WHEN g = component THEN 1.0 ELSE 0.0 END AS z FROM r, k)"""]
    for s in range(STEPS):
        out.append(f"""
m{s} AS MATERIALIZED (SELECT component, sum(z) AS n, sum(CASE WHEN z > 0 THEN z*ln(z) ELSE 0 END) AS e, {sums} FROM z{s} GROUP BY 1),
a{s} AS (SELECT m{s}.*, n+0.001 AS beta, n+{D} AS nu, n/sum(n) OVER () AS pi, {', '.join(f'f{i}/n AS b{i}, f{i}/(n+0.001) AS mean_{i}' for i in range(D))},
  {', '.join(f"{'p%d + ' % i if i == j else ''}s{i}{j} - f{i}*f{j}/n + 0.001*f{i}*f{j}/n/(n+0.001) AS v{i}{j}" for i, j in PAIRS)} FROM m{s}, prior),
d{s} AS (SELECT *, v00*({minor[0, 0]}) + v01*({minor[0, 1]}) + v02*({minor[0, 2]}) AS det FROM a{s}),
q{s} AS MATERIALIZED (SELECT *, {', '.join(f'({m})/det AS w{i}{j}' for (i, j), m in minor.items())}, -ln(det) AS logdet,
  {D}*ln(2) - ln(det) + {' + '.join(_digamma(f'(nu-{i})/2') for i in range(D))} AS ll FROM d{s}),
t{s} AS (SELECT r.*, q.component, q.pi, q.nu*{quad(lambda i: f'(x{i}-mean_{i})')} - q.ll + {D}/q.beta AS dist FROM r, q{s} q),
l{s} AS (SELECT *, ln(pi) - dist/2 AS score FROM t{s}),
o{s} AS (SELECT *, exp(score - (max(score) OVER (PARTITION BY chunk_id) + ln(sum(exp(score - top)) OVER (PARTITION BY chunk_id)))) AS y
  FROM (SELECT *, max(score) OVER (PARTITION BY chunk_id) AS top FROM l{s})),
z{s + 1} AS MATERIALIZED (SELECT chunk_id, x0, x1, x2, component, u/sum(u) OVER (PARTITION BY chunk_id) AS z FROM (SELECT *, CASE WHEN y < 1e-6 THEN 0 ELSE y END AS u FROM o{s}))""")
    out.append(f"m{STEPS} AS MATERIALIZED (SELECT component, sum(z) AS n, sum(CASE WHEN z > 0 THEN z*ln(z) ELSE 0 END) AS e, {sums} FROM z{STEPS} GROUP BY 1)")
    for s in range(STEPS):
        trace_sw = " + ".join(f"(h.s{min(i, j)}{max(i, j)}/h.n - h.f{i}*h.f{j}/h.n/h.n)*{own(i, j)}" for i in range(D) for j in range(D))
        log_b = f"({D}/2.0*ln(p0*p1*p2) - {D}*{D}/2.0*ln(2) - {D * (D - 1)}/4.0*ln(pi()) - (" + " + ".join(f"lgamma(({D}-{i})/2.0)" for i in range(D)) + "))"
        prior_w = " + ".join(f"p{i}*w{i}{i}" for i in range(D))
        out.append(f"""
e{s} AS (SELECT sum(0.5*h.n*(ll - {D}/q.beta - nu*({trace_sw}) - nu*{quad(lambda i: f'(h.f{i}/h.n-mean_{i})')} - {D}*ln(2*pi())) + h.n*ln(q.pi)
  + 0.5*({D}*ln(0.001/(2*pi())) + ll - {D}*0.001/q.beta - 0.001*nu*{quad(lambda i: f'mean_{i}')}) + {log_b} + 0.5*({D}-{D}-1)*ll - 0.5*nu*({prior_w})
  - h.e - (0.5*ll + 0.5*{D}*ln(q.beta/(2*pi())) - 0.5*{D} - ll)) AS bound FROM q{s} q JOIN m{s + 1} h ON h.component = q.component, prior)""")
    return "WITH " + ",".join(out)


def _both(sql: str) -> str:
    return f"SELECT w.way, x.* FROM ({sql}) x, (VALUES ('cluster'), ('task')) w(way)"


def _numbers(s: int) -> str:
    columns = [("n", "n"), ("pi", "pi"), ("nu", "nu"), ("beta", "beta"), *((f"mean_{i}", f"mean_{i}") for i in range(D)), ("ll", "log_lambda"), ("bound", "bound")]
    return f"SELECT {s} AS step, CAST(component AS INTEGER) AS component, {', '.join(f'round({a}, 5) + 0.0 AS {b}' for a, b in columns)} FROM q{s}, e{s}"


QUERIES = {"mixture_steps": mixture_steps, "mixture_responsibilities": mixture_responsibilities}

ORACLES = {
    "mixture_steps": f"{_steps_sql()}\n{_both(' UNION ALL '.join(_numbers(s) for s in range(STEPS)))}",
    "mixture_responsibilities": f"{_steps_sql()}\n{_both(' UNION ALL '.join(f'SELECT {s} AS step, chunk_id, CAST(component AS INTEGER) AS component, round(z, 6) + 0.0 AS z FROM z{s + 1}' for s in range(STEPS)))}",
}
