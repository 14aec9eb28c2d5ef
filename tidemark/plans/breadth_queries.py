"""Fused metrics, bounded sessions, frames, files and orders: what the other modules leave out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof, backtest, risk
from ..session import scratch, table
from ..sources import readers, writers
from .bar_queries import _bars
from .define import TICKS, bars_sql, query, stamp
from .more_queries import _C, _contracts
from .study_queries import _B, _deltas, _trades

_INF = "CAST('inf' AS DOUBLE)"


@query(f"""WITH {_B}, q AS (SELECT *, exp(sum(ln(1 + greatest(gain, -99.999999) / 100)) OVER w) AS bal FROM g WHERE isfinite(gain) WINDOW w AS (PARTITION BY symbol ORDER BY open_i)),
 k AS (SELECT *, greatest(1.0, max(bal) OVER (PARTITION BY symbol ORDER BY open_i)) AS peak FROM q),
 a AS (SELECT symbol, count(*) AS n, avg(gain / 100) AS m, stddev_pop(gain / 100) AS sd, sqrt(avg(pow(gain / 100, 2)) FILTER (gain < 0)) AS dn, max((peak - bal) / peak) AS dd,
   pow(arg_max(bal, open_i), 252.0 / greatest(1, max(close_i) - min(open_i))) - 1 AS cagr, avg(CASE WHEN gain > 0 THEN 100.0 ELSE 0.0 END) AS won FROM k GROUP BY symbol)
 SELECT symbol, n AS trades, round(CASE WHEN sd > 0 THEN (m - 0.02 / n) / sd WHEN m > 0.02 / n THEN {_INF} ELSE 0 END, 6) AS sharpe,
  round(CASE WHEN dn > 0 THEN (m - 0.02 / n) / dn WHEN m > 0.02 / n THEN {_INF} ELSE 0 END, 6) AS sortino, round(dd, 6) AS max_drawdown, round(cagr, 6) AS cagr,
  round(CASE WHEN dd = 0 THEN {_INF} ELSE cagr / dd END, 4) AS calmar, round(won, 4) AS win_rate FROM a""")
def fused_metrics(spark, sf_dir):
    """All scores of a symbol's trades in one aggregation, at a risk-free rate of 0.02; gains that are not finite are left out."""
    m = risk.all_metrics(backtest.balances(_trades(spark, sf_dir)), "symbol", rf=0.02)
    digits = {"calmar": 4, "win_rate": 4}
    return m.select("symbol", "trades", *[F.round(c, digits.get(c, 6)).alias(c) for c in m.columns[2:]])


@query(f"""WITH {_B}, money AS (SELECT symbol, (close_price - open_price) * side * (1 + open_i % 3) AS gain FROM tr), a AS (SELECT symbol, coalesce(sum(gain) FILTER (gain > 0), 0) AS won, coalesce(-sum(gain) FILTER (gain < 0), 0) AS lost FROM money GROUP BY symbol)
 SELECT symbol, round(CASE WHEN lost > 0 THEN won / lost WHEN won > 0 THEN {_INF} ELSE 0 END, 6) AS factor FROM a""")
def dollar_profit_factor(spark, sf_dir):
    t = _trades(spark, sf_dir).withColumns({"position": F.col("side") * (1 + F.col("open_i") % 3), "is_option": F.lit(False)})
    g = F.col("actual_gain")
    a = risk.dollar_columns(t).groupBy("symbol").agg(F.sum(F.when(g > 0, g).otherwise(0.0)).alias("won"), F.sum(F.when(g < 0, -g).otherwise(0.0)).alias("lost"))
    factor = F.when(F.col("lost") > 0, F.col("won") / F.nullif(F.col("lost"), F.lit(0.0))).when(F.col("won") > 0, float("inf")).otherwise(0.0)
    return a.select("symbol", F.round(factor, 6).alias("factor"))


@query(f"""WITH {bars_sql(60)}, a AS (SELECT symbol, arg_max(close, ts) / arg_min(close, ts) - 1 AS g, count(*) AS n FROM b GROUP BY symbol)
 SELECT symbol, round(g, 6) AS gain, round(pow(1 + g, 252.0 / n) - 1, 6) AS annual, round(pow(1 + g, n / 63.0) - 1, 4) AS extrapolated, round(g / (n / 720.0), 6) AS prorated FROM a""")
def annualised(spark, sf_dir):
    """A gain over n bars a year's bars on, as many more windows on, and by its share of the whole."""
    a = _bars(spark, sf_dir, 60).groupBy("symbol").agg((F.max_by("close", "ts") / F.min_by("close", "ts") - 1).alias("g"), F.count("*").alias("n"))
    on = lambda p: F.pow(1 + F.col("g"), p) - 1
    return a.select("symbol", F.round("g", 6).alias("gain"), F.round(on(252.0 / F.col("n")), 6).alias("annual"), F.round(on(F.col("n") / 63.0), 4).alias("extrapolated"), F.round(F.col("g") / (F.col("n") / 720.0), 6).alias("prorated"))


_SESSIONS = "v AS (SELECT DISTINCT o_custkey % 25 AS k, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority = '1-URGENT'), q AS (SELECT o_orderkey AS id, o_custkey % 25 AS k, CAST(o_orderdate AS DATE) AS day FROM orders)"


@query(f"""WITH {_SESSIONS} SELECT q.id, CASE WHEN q.day - v.day <= 14 THEN CAST(v.day AS VARCHAR) END AS session, CASE WHEN q.day - v.day <= 90 THEN CAST(v.day AS VARCHAR) END AS far
 FROM q ASOF LEFT JOIN v ON q.k = v.k AND q.day >= v.day""")
def session_before(spark, sf_dir):
    """The last session of a key at or before a day, no more than 14 days (and 90) back."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).alias("k"), F.to_date("o_orderdate").alias("day"), "o_orderpriority")
    v = o.where("o_orderpriority = '1-URGENT'").select("k", "day", F.col("day").alias("session")).distinct()
    d = asof.backward(o.select("id", "k", "day"), v, "k", "day", "session", slice_seconds=64 * asof.SLICE)
    within = lambda n: F.when(F.date_diff("day", "session") <= n, F.col("session").cast("string"))
    return d.select("id", within(14).alias("session"), within(90).alias("far"))


@query(f"""WITH {_C}, u AS (SELECT root, day, l_orderkey % 7 AS file, arg_max(price, (l_orderkey, l_linenumber)) AS close
   FROM (SELECT *, 'T' || (l_suppkey % 5) AS root, CAST(l_shipdate AS DATE) AS day, l_extendedprice / (l_quantity * 100) AS price FROM lineitem) GROUP BY ALL),
 n AS (SELECT root, day, max(file) AS file FROM u GROUP BY root, day), f AS (SELECT u.root, u.day, u.close FROM u JOIN n ON u.root = n.root AND u.day = n.day AND u.file = n.file)
 SELECT id, c.n, f.close AS underlying FROM c LEFT JOIN f ON f.root = c.root AND f.day = c.day""")
def contract_underlying_close(spark, sf_dir):
    """Each contract with its root's close of the day, as the newest file that has the day says; small days are joined, not searched.
    Of lines with the same order and number the dearer counts."""
    l = table(spark, sf_dir, "lineitem")
    u = l.select(
        F.concat(F.lit("T"), (F.col("l_suppkey") % 5).cast("string")).alias("root"), F.to_date("l_shipdate").alias("day"), (F.col("l_orderkey") % 7).alias("file"),
        (F.col("l_extendedprice") / (F.col("l_quantity") * 100)).alias("price"), "l_orderkey", "l_linenumber",
    )
    f = u.groupBy("root", "day").agg(F.max_by("price", F.struct("file", "l_orderkey", "l_linenumber", "price")).alias("underlying"))
    return _contracts(spark, sf_dir).join(f, ["root", "day"], "left").select("id", "n", "underlying")


@query(f"""WITH {_B}, f AS (SELECT event_type AS symbol, date_trunc('day', ts) + to_minutes(CAST((hour(ts) * 60 + minute(ts)) // 5 * 5 AS BIGINT)) AS ts FROM events WHERE value > 0 GROUP BY ALL),
 h AS (SELECT s.symbol, s.ts, d3.delta FROM d3 JOIN s ON s.symbol = d3.symbol AND s.i = d3.i)
 SELECT f.symbol, {stamp('f.ts')} AS ts, CAST(h.delta AS INT) AS delta FROM f ASOF LEFT JOIN h ON h.symbol = f.symbol AND f.ts >= h.ts""")
def frames_filled(spark, sf_dir):
    """Five-minute bars with the delta of the hour they are in, until the next hour has one."""
    fine = _bars(spark, sf_dir, 5).select("symbol", "ts")
    d = asof.backward(fine, _deltas(spark, sf_dir).select("symbol", "ts", F.col("delta").cast("int").alias("delta")), "symbol", "ts", "delta")
    return d.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "delta")


@query("""SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_custkey % 40, o_custkey, o_orderkey) AS place FROM orders""")
def transaction_order(spark, sf_dir):
    """Filing day, then ticker, then owner: the place of each transaction within its day."""
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    w = Window.partitionBy("day").orderBy(F.col("o_custkey") % 40, "o_custkey", "o_orderkey")
    return o.select(F.col("o_orderkey").alias("id"), F.col("day").cast("string").alias("day"), F.row_number().over(w).cast("long").alias("place"))


@query("""SELECT o_custkey AS owner, o_orderstatus AS code, CAST(o_totalprice / 1000 AS BIGINT) AS size, count(*) AS copies, min(o_orderkey) AS kept FROM orders GROUP BY ALL""")
def signals_deduplicated(spark, sf_dir):
    """One signal of each text key, the first; a size halfway between two goes to the even one."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("code"), F.rint(F.col("o_totalprice") / 1000).cast("long").alias("size")).agg(F.count("*").alias("copies"), F.min("o_orderkey").alias("kept"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: sin(x) + cos(x))), 5) AS trig, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), lambda p: abs(p[1] + p[2]))), 5) AS added FROM embeddings")
def vector_maps(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 5)
    return table(spark, sf_dir, "embeddings").select("vec_id", total(F.transform(e, lambda x: F.sin(x) + F.cos(x))).alias("trig"), total(F.zip_with(e, F.reverse(e), lambda a, b: F.abs(a + b))).alias("added"))


# -- files: written from the tables, read by the sources ----------------------------------------


@query(f"""WITH {bars_sql(60)} SELECT {stamp()} AS ts, round_even(open, 2) AS open, round_even(high, 2) AS high, round_even(low, 2) AS low, round_even(close, 2) AS close, CAST(volume AS DOUBLE) AS volume
 FROM b WHERE symbol = 'view'""")
def bars_through_json(spark, sf_dir):
    """Bars as JSON lines, newest day first, and read back: prices to two decimals, Eastern clock kept."""
    path = scratch(spark, "bars-json")
    writers.bars_json(_bars(spark, sf_dir, 60).where("symbol = 'view'"), path)
    r = readers.bars_json(spark, path, "view")
    return r.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "open", "high", "low", "close", "volume")


@query(f"""WITH {bars_sql(1440)} SELECT symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(close, 2) AS close, volume FROM b WHERE symbol = 'click'""")
def bars_through_daily_csv(spark, sf_dir):
    path = scratch(spark, "daily-csv")
    writers.daily_guide(_bars(spark, sf_dir, 1440).where("symbol = 'click'").withColumn("manufactured", F.lit(False)), path)
    r = readers.bars_daily_csv(spark, path, "click")
    return r.select("symbol", F.to_date("ts").cast("string").alias("day"), "close", F.col("volume").cast("long").alias("volume"))


@query("""WITH x AS (SELECT 'O:T' || (l_suppkey % 5) || strftime(l_shipdate, '%y%m%d') || CASE WHEN l_linenumber % 2 = 0 THEN 'C' ELSE 'P' END || lpad(CAST((90 + l_partkey % 21) * 1000 AS VARCHAR), 8, '0') AS symbol,
   CAST(l_quantity AS BIGINT) AS volume, (l_orderkey % 1440) AS minute FROM lineitem)
 SELECT symbol, count(*) AS bars, CAST(sum(volume) AS BIGINT) AS volume FROM x WHERE symbol LIKE 'O:T1%' AND (minute + 1140) % 1440 >= 570 AND (minute + 1140) % 1440 < 975 GROUP BY symbol""")
def contracts_through_vendor_csv(spark, sf_dir):
    """Minute aggregates of option contracts as the vendor's CSV, read for one underlying in regular Eastern hours."""
    l = table(spark, sf_dir, "lineitem")
    ticker = F.concat(
        F.lit("O:T"), (F.col("l_suppkey") % 5).cast("string"), F.date_format("l_shipdate", "yyMMdd"), F.when(F.col("l_linenumber") % 2 == 0, "C").otherwise("P"),
        F.lpad(((90 + F.col("l_partkey") % 21) * 1000).cast("string"), 8, "0"),
    )
    at = (F.unix_timestamp(F.lit("2024-01-10 00:00:00")) + (F.col("l_orderkey") % 1440) * 60) * 1_000_000_000
    price = F.col("l_extendedprice") / (F.col("l_quantity") * 100)
    rows = l.select(ticker.alias("ticker"), F.col("l_quantity").cast("long").alias("volume"), *[price.alias(c) for c in ("open", "close", "high", "low")], at.cast("long").alias("window_start"), F.lit(1).alias("transactions"))
    path = scratch(spark, "vendor-csv")
    rows.write.csv(path, header=True)
    r = readers.bars_vendor_csv(spark, path, "T1")
    return r.groupBy("symbol").agg(F.count("*").alias("bars"), F.sum("volume").alias("volume"))


@query(f"""WITH {TICKS}, m AS (SELECT symbol, count(*) AS n, round(sum(price), 4) AS total FROM t GROUP BY symbol) SELECT * FROM m WHERE symbol = 'purchase'""")
def contract_folder_scan(spark, sf_dir):
    """Ticks split into a folder a contract; a filter on the contract reads that folder only."""
    from ..operators.bars import ticks

    path = scratch(spark, "contracts")
    writers.by_contract(ticks(table(spark, sf_dir, "events").where("value > 0")), path)
    d = spark.read.parquet(path).where("contract = 'purchase'")
    return d.groupBy(F.col("symbol")).agg(F.count("*").alias("n"), F.round(F.sum("price"), 4).alias("total"))
