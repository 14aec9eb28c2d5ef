"""Distributions of every supplier's own lines, and the levels at which they are reached."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distributions as D
from ..session import table
from .define import query
from .series_sql import beta_sql, gamma_sql, student_sql

#: Of each supplier: mean and spread of quantity and discount, the share of its variance in returned lines.
_SUPPLIERS = """m AS MATERIALIZED (SELECT l_suppkey AS id, CAST(count(*) AS DOUBLE) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v, avg(l_discount) * 10 AS dm, var_samp(l_discount) * 100 AS dv,
   var_samp(l_quantity) FILTER (l_returnflag = 'R') AS v1, var_samp(l_quantity) FILTER (l_returnflag <> 'R') AS v2, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS n1, CAST(count(*) FILTER (l_returnflag <> 'R') AS DOUBLE) AS n2,
   0.05 + 0.05 * (l_suppkey % 19) AS p FROM lineitem GROUP BY l_suppkey)"""
#: family, x, first and second parameter.
_ROWS = [
    ("normal", "m", "25.5", "sqrt(v / n)"),
    ("student_t", "(m - 25.5) / sqrt(v / n)", "n - 1", "NULL"),
    ("chi_squared", "(n - 1) * v / 208.25", "n - 1", "NULL"),
    ("f", "v1 / v2", "n1 - 1", "n2 - 1"),
    ("gamma", "m * 1.1", "m * m / v", "v / m"),
    ("beta", "dm * 0.9", "dm * (dm * (1 - dm) / dv - 1)", "(1 - dm) * (dm * (1 - dm) / dv - 1)"),
    ("weibull", "m * 0.8", "1 + dm", "m"),
    ("poisson", "floor(m + 3)", "m", "NULL"),
]
_LONG = f"{_SUPPLIERS}, r AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT id, '{f}' AS family, CAST({x} AS DOUBLE) AS x, CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b, p FROM m" for f, x, a, b in _ROWS) + ")"


def _cdf_sql(x: str) -> str:
    half = lambda inside: f"(0.5 + sign({x} - 0) / 2 * {inside})"
    f = f"(a * ({x}) / (a * ({x}) + b))"
    return f"""CASE family WHEN 'normal' THEN 0.5 + sign({x} - a) / 2 * {gamma_sql("0.5", f"(pow((({x}) - a) / b, 2) / 2)")} WHEN 'student_t' THEN {half(student_sql(x, "a"))}
   WHEN 'chi_squared' THEN {gamma_sql("(a / 2)", f"(({x}) / 2)")} WHEN 'f' THEN {beta_sql("(a / 2)", "(b / 2)", f)} WHEN 'gamma' THEN {gamma_sql("a", f"(({x}) / b)")}
   WHEN 'beta' THEN {beta_sql("a", "b", x)} WHEN 'weibull' THEN 1 - exp(-pow(greatest({x}, 0) / b, a)) WHEN 'poisson' THEN list_sum(list_transform(range(0, CAST(floor({x}) AS INT) + 1), lambda k: exp(k * ln(a) - a - lgamma(k + 1)))) END"""


_PDF = """CASE family WHEN 'normal' THEN exp(-pow((x - a) / b, 2) / 2) / (b * sqrt(2 * pi())) WHEN 'student_t' THEN exp(lgamma((a + 1) / 2) - lgamma(a / 2)) / sqrt(a * pi()) * pow(1 + x * x / a, -(a + 1) / 2)
   WHEN 'chi_squared' THEN exp((a / 2 - 1) * ln(x) - x / 2 - a / 2 * ln(2) - lgamma(a / 2)) WHEN 'f' THEN exp(a / 2 * ln(a * x / (a * x + b)) + b / 2 * ln(b / (a * x + b)) - ln(x) + lgamma((a + b) / 2) - lgamma(a / 2) - lgamma(b / 2))
   WHEN 'gamma' THEN exp((a - 1) * ln(x) - x / b - a * ln(b) - lgamma(a)) WHEN 'beta' THEN exp(lgamma(a + b) - lgamma(a) - lgamma(b) + (a - 1) * ln(x) + (b - 1) * ln(1 - x))
   WHEN 'weibull' THEN a / b * pow(x / b, a - 1) * exp(-pow(x / b, a)) WHEN 'poisson' THEN exp(x * ln(a) - a - lgamma(x + 1)) END"""

#: A bracket for each family's quantiles between 5 and 95 %.
_BRACKET = """CASE family WHEN 'normal' THEN a - 4 * b WHEN 'student_t' THEN -4.0 ELSE 0.0 END AS low,
   CASE family WHEN 'normal' THEN a + 4 * b WHEN 'student_t' THEN 4.0 WHEN 'chi_squared' THEN a + 4 * sqrt(2 * a) WHEN 'f' THEN 3.0 WHEN 'gamma' THEN a * b + 5 * sqrt(a) * b WHEN 'beta' THEN 1.0 WHEN 'weibull' THEN 4 * b END AS high"""


def _suppliers(spark, sf_dir):
    q, d, back = F.col("l_quantity"), F.col("l_discount"), F.col("l_returnflag") == "R"
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(
        F.count("*").cast("double").alias("n"), F.avg(q).alias("m"), F.var_samp(q).alias("v"), (F.avg(d) * 10).alias("dm"), (F.var_samp(d) * 100).alias("dv"),
        F.var_samp(F.when(back, q)).alias("v1"), F.var_samp(F.when(~back, q)).alias("v2"), F.count_if(back).cast("double").alias("n1"), F.count_if(~back).cast("double").alias("n2"),
    )
    return m.withColumn("p", 0.05 + 0.05 * (F.col("id") % 19))


@query(f"""WITH {_LONG} SELECT id, family, round(x, 6) AS x, round({_cdf_sql("x")}, 8) AS cdf, round({_PDF}, 8) AS pdf FROM r""")
def distribution_functions(spark, sf_dir):
    """Eight families fitted to every supplier's lines: where its figure lies, and how dense they are there."""
    m, out = _suppliers(spark, sf_dir), None
    for family, x, a, b in _ROWS:
        ps = [F.expr(p).cast("double") for p in (a, b) if p != "NULL"]
        v = F.expr(x).cast("double")
        r = m.select("id", F.lit(family).alias("family"), F.round(v, 6).alias("x"), F.round(D.cdf(family, v, *ps), 8).alias("cdf"), F.round(D.pdf(family, v, *ps), 8).alias("pdf"))
        out = r if out is None else out.unionByName(r)
    return out


@query(f"""WITH RECURSIVE {_LONG}, q AS (SELECT id, family, a, b, p, {_BRACKET}, 0 AS k FROM r WHERE family <> 'poisson'
  UNION ALL SELECT id, family, a, b, p, CASE WHEN below THEN mid ELSE low END, CASE WHEN below THEN high ELSE mid END, k + 1 FROM
   (SELECT *, {_cdf_sql("mid")} < p AS below FROM (SELECT *, (low + high) / 2 AS mid FROM q WHERE k < 48)))
 SELECT id, family, round((low + high) / 2, 6) AS x FROM q WHERE k = 48
 UNION ALL SELECT id, family, list_min(list_filter(range(0, 200), lambda c: list_sum(list_transform(range(0, c + 1), lambda k: exp(k * ln(a) - a - lgamma(k + 1)))) >= p)) FROM r WHERE family = 'poisson'""")
def distribution_quantiles(spark, sf_dir):
    """The same families' quantiles at a level of the supplier's own."""
    m, out = _suppliers(spark, sf_dir), None
    for family, _, a, b in _ROWS:
        ps = [F.expr(p).cast("double") for p in (a, b) if p != "NULL"]
        r = m.select("id", F.lit(family).alias("family"), F.round(D.quantile(family, F.col("p"), *ps), 6).alias("x"))
        out = r if out is None else out.unionByName(r)
    return out
