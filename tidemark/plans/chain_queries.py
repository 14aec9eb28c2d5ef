"""Volatilities of recent contracts, and two versions of nested orders compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, volatility
from ..session import table
from .define import query
from .study_queries import _cdf_sql

#: Parts are contracts on their brand, lines are their bars; a brand's close is its parts' mean price of the day.
_CHAIN = f"""z AS (SELECT CAST(max(l_shipdate) AS DATE) AS newest FROM lineitem),
 c AS (SELECT 'P' || p_partkey AS contract, p_brand AS root, p_retailprice * (0.8 + (p_partkey % 41) / 100.0) AS strike, newest + CAST(7 * (p_size - 5) AS INT) AS expiration, p_partkey % 2 = 0 AS call FROM part, z),
 l AS (SELECT 'P' || l_partkey AS contract, CAST(l_shipdate AS DATE) AS day, l_orderkey AS o, l_linenumber AS n, l_extendedprice AS e, l_discount, l_tax, p_retailprice, p_brand AS root, p_retailprice * (0.8 + (p_partkey % 41) / 100.0) AS k, p_partkey % 2 = 0 AS call FROM lineitem JOIN part ON p_partkey = l_partkey),
 u AS MATERIALIZED (SELECT root, day, avg(p_retailprice) AS s FROM l GROUP BY root, day),
 b AS MATERIALIZED (SELECT l.contract, l.root, l.day, o, n, e, greatest(0.0, CASE WHEN call THEN s - k ELSE k - s END) * CASE WHEN l_tax = 0 THEN 0.95 ELSE 1 END + s * l_discount * 0.6 AS close FROM l JOIN u ON u.root = l.root AND u.day = l.day)"""
_D1 = "((ln(s / k) + (0.05 + {x} * {x} / 2) * t) / ({x} * sqrt(t)))"


def _price_sql(x: str) -> str:
    d1 = _D1.format(x=x)
    d2 = f"({d1} - {x} * sqrt(t))"
    return f"(CASE WHEN call THEN s * {_cdf_sql(d1)} - k * exp(-0.05 * t) * {_cdf_sql(d2)} ELSE k * exp(-0.05 * t) * {_cdf_sql(f'-{d2}')} - s * {_cdf_sql(f'-{d1}')} END)"


#: CTE y: what is asked for (id ..., s, k, t, call, close) -> CTE v: its volatility by halving.
_SOLVED = f"""h AS (SELECT *, 1e-6::DOUBLE AS lo, 5.0::DOUBLE AS hi, 0 AS step FROM y WHERE close > {_price_sql("1e-6::DOUBLE")} AND close < {_price_sql("5.0::DOUBLE")}
   UNION ALL SELECT * EXCLUDE (under, x) REPLACE (CASE WHEN under THEN x ELSE lo END AS lo, CASE WHEN under THEN hi ELSE x END AS hi, step + 1 AS step) FROM (SELECT *, {_price_sql("x")} < close AS under FROM (SELECT *, (lo + hi) / 2 AS x FROM h WHERE step < 50))),
 v AS (SELECT *, (lo + hi) / 2 AS iv FROM h WHERE step = 50)"""


def _market(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", F.to_date("l_shipdate").alias("day"))
    newest = F.to_date(F.lit(l.agg(F.max("day").cast("string")).first()[0]))  # one value
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.concat(F.lit("P"), key)
    p = p.select(key, name.alias("contract"), F.col("p_brand").alias("root"), "p_retailprice", (F.col("p_retailprice") * (0.8 + (key % 41) / 100.0)).alias("strike"), F.date_add(newest, ((F.col("p_size") - 5) * 7).cast("int")).alias("expiration"), (key % 2 == 0).alias("call"))
    x = l.join(p, F.col("l_partkey") == key)
    u = x.groupBy("root", "day").agg(F.avg("p_retailprice").alias("close"))
    x = x.join(u.withColumnRenamed("close", "s"), ["root", "day"])
    own = F.greatest(F.lit(0.0), F.when(F.col("call"), F.col("s") - F.col("strike")).otherwise(F.col("strike") - F.col("s")))
    close = own * F.when(F.col("l_tax") == 0, 0.95).otherwise(1.0) + F.col("s") * F.col("l_discount") * 0.6
    bars = x.select("contract", F.struct("day", "l_orderkey", "l_linenumber", "l_extendedprice").alias("ts"), "day", close.alias("close"))
    return bars, p.select("contract", "root", "strike", "expiration", "call"), u


@query(f"""WITH RECURSIVE {_CHAIN}, days AS (SELECT DISTINCT day FROM b ORDER BY day DESC LIMIT 10), r AS (SELECT DISTINCT contract FROM b JOIN days USING (day)),
 a AS (SELECT contract, count(DISTINCT day) AS files, count(*) AS bars, max(day) AS day, arg_max(close, (day, o, n, e)) AS close FROM b, z WHERE day >= newest - 30 GROUP BY contract),
 q AS (SELECT contract, files, bars, a.day, close, c.root, c.strike AS k, call, u.s, (expiration - a.day) / 365.0 AS t FROM r JOIN a USING (contract) JOIN c USING (contract) JOIN u ON u.root = c.root AND u.day = a.day),
 w AS MATERIALIZED (SELECT *, greatest(0.0, CASE WHEN call THEN s - k * exp(-0.05 * t) ELSE k * exp(-0.05 * t) - s END) AS worth FROM q),
 g AS MATERIALIZED (SELECT *, CASE WHEN t <= 0 THEN 'expired' WHEN close < worth THEN 'below intrinsic' WHEN close - worth < 0.01 * s THEN 'little time value' END AS why FROM w),
 y AS (SELECT * FROM g WHERE why IS NULL), {_SOLVED}
 SELECT g.contract, g.root, CAST(g.day AS VARCHAR) AS day, g.files, g.bars, round(g.close, 4) AS close, round(g.s, 4) AS underlying, round(v.iv, 3) AS iv, CASE WHEN v.iv IS NULL THEN coalesce(g.why, 'beyond bounds') END AS reason
 FROM g LEFT JOIN v ON v.contract = g.contract""")
def volatility_chain(spark, sf_dir):
    """Every contract of the ten newest files: its trace over thirty days, newest close, and volatility or reason."""
    bars, contracts, underlying = _market(spark, sf_dir)
    d = volatility.chain(bars, contracts, underlying)
    return d.select("contract", "root", F.col("day").cast("string").alias("day"), "files", "bars", F.round("close", 4).alias("close"), F.round("underlying", 4).alias("underlying"), F.round("iv", 3).alias("iv"), "reason")


@query(f"""WITH RECURSIVE {_CHAIN}, e AS (SELECT contract, root, day, arg_max(close, (o, n, e)) AS close FROM b GROUP BY ALL),
 q AS (SELECT e.root, e.day, close, strike AS k, call, s, (expiration - e.day) / 365.0 AS t FROM e JOIN c USING (contract) JOIN u ON u.root = e.root AND u.day = e.day),
 y AS (SELECT * FROM q WHERE t > 0 AND close - greatest(0.0, CASE WHEN call THEN s - k * exp(-0.05 * t) ELSE k * exp(-0.05 * t) - s END) >= 0.01 * s), {_SOLVED}
 SELECT root, CAST(day AS VARCHAR) AS day, count(*) AS contracts, round(avg(iv), 3) AS iv FROM v GROUP BY root, day""")
def volatility_daily(spark, sf_dir):
    """The mean volatility of each brand's contracts on every day."""
    d = volatility.daily_series(*_market(spark, sf_dir))
    return d.select("root", F.col("day").cast("string").alias("day"), "contracts", F.round("iv", 3).alias("iv"))


@query("""WITH l AS (SELECT l_orderkey AS k, l_partkey AS p, l_quantity AS q, l_extendedprice AS e, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem
   WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice)),
 j AS (SELECT l.* FROM l JOIN orders ON o_orderkey = k WHERE k % 101 <> 0), s AS (SELECT *, k % 11 = 0 AND i = n - 1 AS gone FROM j)
 SELECT k AS o_orderkey, 'lines[' || i || '].quantity' AS path, CAST(q AS VARCHAR) AS old, CAST(q + 1 AS VARCHAR) AS new, 'value' AS kind FROM s WHERE NOT gone AND p % 13 = 0
 UNION ALL SELECT k, 'lines[' || i || '].price', CAST(e AS VARCHAR), CAST(e + 1.5 AS VARCHAR), 'value' FROM s WHERE NOT gone AND p % 17 = 0
 UNION ALL SELECT k, 'lines[' || i || ']', NULL, NULL, 'removed' FROM s WHERE gone
 UNION ALL SELECT o_orderkey, 'head.status', NULL, NULL, 'null' FROM orders WHERE o_orderkey % 19 = 0 AND o_orderkey % 101 <> 0
 UNION ALL SELECT o_orderkey, '', NULL, NULL, 'removed' FROM orders WHERE o_orderkey % 101 = 0""")
def nested_differences(spark, sf_dir):
    """Orders with their lines, and a version in which some changed by more or less than the tolerance, went or lost a field."""
    c = F.col
    lines = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct(c("l_linenumber").alias("line"), c("l_partkey").alias("part"), c("l_quantity").alias("quantity"), c("l_extendedprice").alias("price")))).alias("lines"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(c("o_orderstatus").alias("status"), c("o_totalprice").alias("total")).alias("head"))
    old = o.join(lines, "o_orderkey", "left")

    def changed(x):
        part, price = x["part"], x["price"] + F.when(x["part"] % 17 == 0, 1.5).when(x["part"] % 5 == 0, 0.004).otherwise(0.0)
        return F.struct(x["line"].alias("line"), part.alias("part"), (x["quantity"] + F.when(part % 13 == 0, 1.0).otherwise(0.0)).alias("quantity"), price.alias("price"))

    kept = F.when(c("o_orderkey") % 11 == 0, F.slice("lines", F.lit(1), F.greatest(F.size("lines") - 1, F.lit(0)))).otherwise(c("lines"))
    status = F.when(c("o_orderkey") % 19 != 0, c("head.status"))
    new = old.where("o_orderkey % 101 <> 0").select("o_orderkey", F.struct(status.alias("status"), (c("head.total") + 0.005).alias("total")).alias("head"), F.transform(kept, changed).alias("lines"))
    d = compare.differences(old, new, ["o_orderkey"], {"number": 0.01})
    value = lambda x: F.when(c("kind") == "value", c(x)).alias(x)
    return d.select("o_orderkey", "path", value("old"), value("new"), "kind")
