"""Files of several formats in one folder, trades as files, and bars with every fault a rule looks for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest, risk
from ..operators import bars as B
from ..session import scratch
from ..sources import readers, writers
from .define import bars_sql, query, stamp
from .indicator_queries import hourly
from .study_queries import _B, _trades

#: CTE d: daily bars, beside t and b.
_DAILY = bars_sql(1440, "d").partition(",\n")[2]
_GAINS = """m AS MATERIALIZED (SELECT *, (1 + open_i % 3) * side AS position, (close_price - open_price) * side AS dollar_gain, CASE WHEN open_price <> 0 THEN (close_price - open_price) * side / open_price * 100 ELSE 0 END AS percent_gain,
   (close_price - open_price) * side * (1 + open_i % 3) AS actual_gain FROM tr)"""


def _priced(spark, sf_dir):
    t = backtest.balances(_trades(spark, sf_dir))
    return risk.dollar_columns(t.withColumns({"position": F.col("side") * (1 + F.col("open_i") % 3), "is_option": F.lit(False)}))


@query(f"""WITH {bars_sql(60)}, {_DAILY} SELECT 'json' AS kind, symbol, {stamp()} AS ts, round_even(open, 2) AS open, round_even(close, 2) AS close, CAST(volume AS DOUBLE) AS volume FROM b WHERE symbol IN ('click', 'view')
 UNION ALL SELECT 'daily', symbol, {stamp()}, round(open, 2), round(close, 2), CAST(volume AS DOUBLE) FROM d WHERE symbol IN ('error', 'signup')
 UNION ALL SELECT 'vendor', symbol, {stamp("timezone('America/New_York', timezone('UTC', ts))")}, open, close, CAST(volume AS DOUBLE) FROM b WHERE symbol NOT IN ('click', 'view', 'error', 'signup')""")
def sniffed_files(spark, sf_dir):
    """Every symbol in one of three formats, a placeholder among them, read back by what the files say."""
    root = scratch(spark, "sniffed")
    b, d = hourly(spark, sf_dir).drop("i"), hourly(spark, sf_dir, 1440).drop("i").withColumn("manufactured", F.lit(False))
    for s in ("click", "view"):
        writers.bars_json(b.where(F.col("symbol") == s), f"{root}/json/{s}")
    for s in ("error", "signup"):
        writers.daily_guide(d.where(F.col("symbol") == s), f"{root}/daily/{s}")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    rest = b.where(~F.col("symbol").isin("click", "view", "error", "signup"))
    rest.select(F.col("symbol").alias("ticker"), "volume", "open", "close", "high", "low", ns.alias("window_start"), F.col("count").alias("transactions")).write.csv(f"{root}/vendor", header=True)
    spark.createDataFrame([("# fetch the file of this day",), ("ticker,volume,window_start",)], "value string").coalesce(1).write.text(f"{root}/placeholder")
    r = readers.sniffed(spark, root)
    return r.select("kind", "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "open", "close", "volume")


@query(f"""WITH {_B}, {_GAINS} SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY open_i) AS trade, CASE WHEN side > 0 THEN 'Buy' ELSE 'Sell' END AS kind, open_i, close_i, round(open_price, 4) AS open_price, round(close_price, 4) AS close_price,
  CAST(position AS DOUBLE) AS position, round(dollar_gain, 4) + 0.0 AS dollar_gain FROM m""")
def trades_through_csv(spark, sf_dir):
    path = scratch(spark, "trades-csv")
    writers.trades_csv(_priced(spark, sf_dir), path)
    d = spark.read.csv(path, header=True, inferSchema=True)
    return d.select("symbol", F.col("TradeIndex").cast("long").alias("trade"), F.col("TradeType").alias("kind"), F.col("OpenIndex").alias("open_i"), F.col("CloseIndex").alias("close_i"), F.col("OpenPrice").alias("open_price"), F.col("ClosePrice").alias("close_price"), F.col("Position").alias("position"), (F.col("DollarGain") + 0.0).alias("dollar_gain"))


@query(f"""WITH {_B}, {_GAINS} SELECT symbol, count(*) AS trades, count(*) FILTER (actual_gain > 0) AS wins, count(*) FILTER (actual_gain < 0) AS losses, round(avg(CASE WHEN actual_gain > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate,
  round(avg(actual_gain), 4) AS mean, round(avg(percent_gain), 4) AS mean_percent, round(max(actual_gain), 4) AS largest_win, round(min(actual_gain), 4) AS largest_loss, round(avg(close_i - open_i), 6) AS holding,
  round(sum(CASE WHEN side > 0 THEN open_price ELSE close_price END * abs(position)), 2) AS bought, round(sum(CASE WHEN side > 0 THEN close_price ELSE open_price END * abs(position)), 2) AS sold FROM m GROUP BY symbol""")
def pnl_summary(spark, sf_dir):
    """Closed trades of every symbol: how many won, what they made, how long they were held, what was bought and sold."""
    return risk.summary(_priced(spark, sf_dir), "symbol")


@query(f"""WITH {bars_sql(60)}, s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM b),
 x AS (SELECT symbol, i, CASE WHEN i % 19 = 1 THEN NULL WHEN i % 19 = 2 THEN TIMESTAMP '1850-01-01' ELSE ts END AS ts, CASE i % 19 WHEN 3 THEN -open WHEN 4 THEN high + 1 ELSE open END AS open, CASE i % 19 WHEN 5 THEN 0 WHEN 6 THEN low / 2 WHEN 7 THEN 2e6 WHEN 8 THEN low * 4 ELSE high END AS high,
   CASE i % 19 WHEN 9 THEN -1 WHEN 10 THEN 0.0005 ELSE low END AS low, CASE i % 19 WHEN 11 THEN 0 WHEN 12 THEN low / 3 WHEN 13 THEN NULL ELSE close END AS close, CASE WHEN i % 19 = 14 THEN -volume ELSE volume END AS volume FROM s),
 r AS (SELECT *, [CASE WHEN ts IS NULL THEN 'time missing' END, CASE WHEN NOT coalesce(open > 0, false) THEN 'open not positive' END, CASE WHEN NOT coalesce(high > 0, false) THEN 'high not positive' END, CASE WHEN NOT coalesce(low > 0, false) THEN 'low not positive' END,
    CASE WHEN NOT coalesce(close > 0, false) THEN 'close not positive' END, CASE WHEN high < low THEN 'high below low' END] AS e,
   [CASE WHEN open > high OR open < low THEN 'open outside range' END, CASE WHEN close > high OR close < low THEN 'close outside range' END, CASE WHEN high - low > high + low THEN 'range over twice the middle' END, CASE WHEN high > 1e6 THEN 'price above 1000000' END,
    CASE WHEN low < 0.001 THEN 'price below 0.001' END, CASE WHEN year(ts) NOT BETWEEN 1900 AND 2100 THEN 'year out of range' END, CASE WHEN volume < 0 THEN 'negative volume' END] AS w FROM x)
 SELECT symbol, i, array_to_string(list_filter(e, lambda v: v IS NOT NULL), '; ') AS errors, array_to_string(list_filter(w, lambda v: v IS NOT NULL), '; ') AS warnings, CAST(greatest(volume, 0) AS BIGINT) AS volume FROM r""")
def validate_bars(spark, sf_dir):
    """Hourly bars of which a share has one fault each, so that every rule of both tiers finds some."""
    b = hourly(spark, sf_dir)
    k, c = F.col("i") % 19, F.col
    b = b.select(
        "symbol", c("i").cast("long").alias("i"), F.when(k == 1, F.lit(None)).when(k == 2, F.lit("1850-01-01").cast("timestamp_ntz")).otherwise(c("ts")).alias("ts"),
        F.when(k == 3, -c("open")).when(k == 4, c("high") + 1).otherwise(c("open")).alias("open"), F.when(k == 5, 0.0).when(k == 6, c("low") / 2).when(k == 7, 2e6).when(k == 8, c("low") * 4).otherwise(c("high")).alias("high"),
        F.when(k == 9, -1.0).when(k == 10, 0.0005).otherwise(c("low")).alias("low"), F.when(k == 11, 0.0).when(k == 12, c("low") / 3).when(k == 13, F.lit(None)).otherwise(c("close")).alias("close"), F.when(k == 14, -c("volume")).otherwise(c("volume")).alias("volume"),
    )
    return B.validate(b).select("symbol", "i", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), c("volume").cast("long").alias("volume"))


_PAIRS = [(3, 12), (5, 20), (8, 34), (13, 55)]


@query(f"""WITH {bars_sql(60)}, s AS (SELECT symbol, close, lead(close) OVER o AS next, row_number() OVER o - 1 AS i, sum(close) OVER (PARTITION BY symbol ORDER BY ts) AS upto FROM b WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
 p(fast, slow) AS (VALUES {", ".join(map(str, _PAIRS))}),
 m AS (SELECT symbol, i, close, next, fast, slow, (upto - coalesce(lag(upto, fast) OVER w, 0)) / fast - (upto - coalesce(lag(upto, slow) OVER w, 0)) / slow AS gap FROM s, p WINDOW w AS (PARTITION BY symbol, fast, slow ORDER BY i)),
 d AS (SELECT *, CASE WHEN i >= slow - 1 AND abs(gap) > 1e-9 THEN sign(gap) ELSE 0 END AS side FROM m),
 e AS (SELECT *, CASE WHEN side <> coalesce(lag(side) OVER (PARTITION BY symbol, fast, slow ORDER BY i), 0) THEN 1 ELSE 0 END AS turn, (next / close - 1) * side AS ret FROM d)
 SELECT fast, slow, i // 200 AS fold, count(*) AS bars, CAST(sum(turn) AS BIGINT) AS turns, round(avg(ret), 4) + 0.0 AS mean, round(stddev_pop(ret), 3) AS sd FROM e GROUP BY ALL""")
def parameter_folds(spark, sf_dir):
    """Four pairs of averages on every fold of 200 bars: indicator x bar x fold in one job."""
    d = backtest.parameter_folds(hourly(spark, sf_dir), _PAIRS, 200)
    return d.select("fast", "slow", "fold", "bars", "turns", (F.round("mean", 4) + 0.0).alias("mean"), F.round("sd", 3).alias("sd"))
