"""Roll-ups of studies: robustness, regimes, exposure, sessions, volatility surfaces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import backtest, clock
from ..session import table
from .bar_queries import _bars
from .define import bars_sql, query, stamp
from .indicator_queries import hourly
from .study_queries import _WINDOWS, _signals, _T, _cdf_sql

_P = f"""{_WINDOWS},
 p AS (SELECT symbol, window_, arg_max(close, i) FILTER (part = 'train') / arg_min(close, i) FILTER (part = 'train') - 1 AS train, arg_max(close, i) FILTER (part = 'test') / arg_min(close, i) FILTER (part = 'test') - 1 AS test FROM j GROUP BY ALL)"""


def _windows(spark, sf_dir):
    return _performance(backtest.in_all_windows(hourly(spark, sf_dir), 252, 63, 63))


def _performance(d):
    perf = lambda part: F.max_by("close", F.when(F.col("part") == part, F.col("i"))) / F.min_by("close", F.when(F.col("part") == part, F.col("i"))) - 1
    return d.groupBy("symbol", "window").agg(perf("train").alias("train"), perf("test").alias("test"))


@query(f"""WITH {_P}, r AS (SELECT symbol, avg(train) AS train, avg(test) AS test, stddev_pop(test) AS sigma, avg(CASE WHEN train > test THEN 1.0 ELSE 0.0 END) * 100 AS overfit FROM p GROUP BY symbol)
 SELECT symbol, round(train, 6) AS train, round(test, 6) AS test, round(sigma, 6) AS sigma, round(overfit, 4) AS overfit, abs(train - test) < 0.1 AND sigma < 0.15 AND overfit < 30 AND test > 0 AS robust,
  round(0.4 * CASE WHEN test > 0 THEN 1.0 ELSE 0.0 END + 0.3 / (1 + sigma) + 0.2 * greatest(0.0, 1 - overfit / 100) + 0.1 * least(1.0, greatest(0.0, test)), 6) AS score FROM r""")
def robustness(spark, sf_dir):
    """Mean performance, its spread, how often training looked better, and a composite."""
    return _robustness(_windows(spark, sf_dir))


def _robustness(p):
    r = p.groupBy("symbol").agg(
        F.avg("train").alias("train"), F.avg("test").alias("test"), F.stddev_pop("test").alias("sigma"), (F.avg(F.when(F.col("train") > F.col("test"), 1.0).otherwise(0.0)) * 100).alias("overfit")
    )
    train, test, sigma, over = (F.col(c) for c in ("train", "test", "sigma", "overfit"))
    score = 0.4 * F.when(test > 0, 1.0).otherwise(0.0) + 0.3 / (1 + sigma) + 0.2 * F.greatest(F.lit(0.0), 1 - over / 100) + 0.1 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), test))
    robust = (F.abs(train - test) < 0.1) & (sigma < 0.15) & (over < 30) & (test > 0)
    return r.select("symbol", *[F.round(c, 6).alias(c) for c in ("train", "test", "sigma")], F.round(over, 4).alias("overfit"), robust.alias("robust"), F.round(score, 6).alias("score"))


@query(f"""WITH {_P}, m AS (SELECT *, test - 2 * abs(train - test) AS merit FROM p) SELECT symbol, arg_max(window_, (merit, -window_)) AS best, round(max(merit), 6) AS merit FROM m GROUP BY symbol""")
def model_choice(spark, sf_dir):
    return _model_choice(_windows(spark, sf_dir))


def _model_choice(p):
    m = p.withColumn("merit", F.col("test") - 2 * F.abs(F.col("train") - F.col("test")))
    return m.groupBy("symbol").agg(F.max_by("window", F.struct("merit", -F.col("window"))).alias("best"), F.round(F.max("merit"), 6).alias("merit"))


@query(f"""WITH {bars_sql(1440)}, f AS (SELECT symbol, ts, close, close / avg(close) OVER w - 1 AS trend, stddev_samp(close) OVER w / avg(close) OVER w AS vol FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
 SELECT symbol, {stamp()} AS ts, CASE WHEN trend > 0.08 AND vol < 0.3 THEN 'bull' WHEN trend < -0.08 THEN 'defensive' ELSE 'neutral' END AS regime,
  CASE WHEN trend > 0.08 AND vol < 0.3 THEN 0.9 WHEN trend < -0.08 THEN 0.4 ELSE 0.65 END::DOUBLE AS exposure FROM f""")
def regimes(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-4, 0)
    d = _bars(spark, sf_dir, 1440).select("symbol", "ts", (F.col("close") / F.avg("close").over(w) - 1).alias("t"), (F.stddev_samp("close").over(w) / F.avg("close").over(w)).alias("v"))
    bull, bear = (F.col("t") > 0.08) & (F.col("v") < 0.3), F.col("t") < -0.08
    return d.select(
        "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.when(bull, "bull").when(bear, "defensive").otherwise("neutral").alias("regime"), F.when(bull, 0.9).when(bear, 0.4).otherwise(0.65).alias("exposure")
    )


@query(f"""WITH {bars_sql(60)}, d AS (SELECT CAST(ts AS DATE) AS day, count(DISTINCT symbol) AS k FROM b GROUP BY CAST(ts AS DATE)), v AS (SELECT day FROM d WHERE k = (SELECT count(DISTINCT symbol) FROM b)),
 q AS (SELECT CAST(unnest(generate_series((SELECT min(day) - 7 FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS x)
 SELECT CAST(x AS VARCHAR) AS day, CAST((SELECT min(day) FROM v WHERE day > x AND day <= x + 30) AS VARCHAR) AS session FROM q""")
def next_common_session(spark, sf_dir):
    """The first later day, within 30, on which every symbol has a bar."""
    b = _bars(spark, sf_dir, 60).select("symbol", F.to_date("ts").alias("s"))
    n = b.select("symbol").distinct().count()
    v = b.distinct().groupBy("s").agg(F.count("*").alias("k")).where(F.col("k") == n).select("s")
    q = b.agg(F.min("s").alias("a"), F.max("s").alias("z")).select(F.explode(F.sequence(F.date_sub("a", 7), F.col("z"))).alias("x"))
    # each day looks thirty days ahead by an equality on the day, not by comparing all pairs
    ahead = q.select("x", F.explode(F.sequence(F.date_add("x", 1), F.date_add("x", 30))).alias("s")).join(v.withColumn("ok", F.lit(True)), "s", "left")
    return ahead.groupBy("x").agg(F.min(F.when(F.col("ok"), F.col("s"))).alias("n")).select(F.col("x").cast("string").alias("day"), F.col("n").cast("string").alias("session"))


@query(f"""WITH {bars_sql(5)}, l AS (SELECT symbol, timezone('America/New_York', timezone('UTC', ts)) AS ts, open FROM b)
 SELECT symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, arg_min(open, ts) AS open, {stamp('min(ts)')} AS at_ FROM l WHERE hour(ts) * 60 + minute(ts) >= 570 GROUP BY symbol, CAST(ts AS DATE)""")
def session_open(spark, sf_dir):
    """The first price at or after 09:30 of each day, by New York's clock."""
    b = _bars(spark, sf_dir, 5).withColumn("ts", clock.local(F.col("ts"))).where(F.hour("ts") * 60 + F.minute("ts") >= 570)
    return b.groupBy("symbol", F.to_date("ts").cast("string").alias("day")).agg(F.min_by("open", "ts").alias("open"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("at_"))


@query(f"""WITH {_T}, x AS (SELECT day, value, weight, sum(value) OVER (ORDER BY day, id ROWS UNBOUNDED PRECEDING) AS spent, owner % 8 AS book, id FROM ws)
 SELECT book, count(*) AS n, round(sum(value) FILTER (weight >= 3), 2) AS senior, round(sum(value) FILTER (weight < 3), 2) AS junior FROM x GROUP BY book""")
def exposure_by_book(spark, sf_dir):
    s = _signals(spark, sf_dir)
    senior = F.col("weight") >= 3
    return s.groupBy((F.col("owner") % 8).alias("book")).agg(F.count("*").alias("n"), F.round(F.sum(F.when(senior, F.col("value"))), 2).alias("senior"), F.round(F.sum(F.when(~senior, F.col("value"))), 2).alias("junior"))


def _price_sql(s, k, t, v):
    d1 = f"((ln({s} / {k}) + (0.05 + {v} * {v} / 2) * {t}) / ({v} * sqrt({t})))"
    return f"{s} * {_cdf_sql(d1)} - {k} * exp(-0.05 * {t}) * {_cdf_sql(f'({d1} - {v} * sqrt({t}))')}"


@query(f"""WITH {bars_sql(1440)}, h AS (SELECT symbol, stddev_samp(r) * sqrt(252) AS sigma, max(c) AS spot FROM (SELECT symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r, close AS c FROM b) GROUP BY symbol),
 g AS (SELECT symbol, sigma, spot, unnest([0.9, 1.0, 1.1])::DOUBLE AS m FROM h), e AS (SELECT *, unnest([7, 30, 90]) AS dte FROM g), q AS (SELECT symbol, dte, spot AS s, spot * m AS k, dte / 365 AS t, least(sigma, 3.0) AS v, m FROM e)
 SELECT symbol, dte, m AS moneyness, round({_price_sql('s', 'k', 't', 'v')}, 3) AS price FROM q""")
def simulated_price_grid(spark, sf_dir):
    """Strikes by expiries at historical volatility, a long table."""
    r = F.ln(F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("ts")))
    h = _bars(spark, sf_dir, 1440).select("symbol", "close", r.alias("r")).groupBy("symbol").agg((F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("sigma"), F.max("close").alias("spot"))
    e = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    g = h.select("*", e([0.9, 1.0, 1.1]).alias("m")).select("*", e([7, 30, 90]).alias("dte"))
    price = S.black_scholes(F.col("spot"), F.col("spot") * F.col("m"), F.col("dte") / 365, F.lit(0.05), F.lit(0.0), F.least("sigma", F.lit(3.0)), F.lit(True))
    return g.select("symbol", "dte", F.col("m").alias("moneyness"), F.round(price, 3).alias("price"))


@query("""WITH e AS (SELECT label, unnest(range(0, 64)) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings) SELECT label, pos, round(avg(x), 6) AS mean FROM e GROUP BY ALL""")
def averaged_model(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query(f"""WITH {bars_sql(60)}, s AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, row_number() OVER (PARTITION BY symbol ORDER BY ts) = count(*) OVER (PARTITION BY symbol) AS final FROM b)
 SELECT symbol, round(sum(close * CASE WHEN final THEN CASE i % 4 WHEN 0 THEN 0 WHEN 2 THEN -2 ELSE -1 END WHEN i % 4 < 2 THEN 1 ELSE -1 END), 4) AS haar,
  round(sum(close * CASE WHEN i % 2 = 1 THEN -1 WHEN final THEN 0 ELSE 1 END), 4) AS fine FROM s GROUP BY symbol""")
def haar_details(spark, sf_dir):
    """The details of every quad and pair; the last close is repeated until the last quad is full."""
    s = hourly(spark, sf_dir).withColumn("final", F.col("i") + 1 == F.count("*").over(Window.partitionBy("symbol")))
    i, total = F.col("i"), lambda w: F.round(F.sum(F.col("close") * w), 4)
    last = F.when(i % 4 == 0, 0).when(i % 4 == 2, -2).otherwise(-1)
    quad = F.when(F.col("final"), last).when(i % 4 < 2, 1).otherwise(-1)
    pair = F.when(i % 2 == 1, -1).when(F.col("final"), 0).otherwise(1)
    return s.groupBy("symbol").agg(total(quad).alias("haar"), total(pair).alias("fine"))


@query(f"""WITH {bars_sql(60)}, m AS (SELECT symbol, ts, close, high, low, max(high) OVER w AS hh, min(low) OVER w AS ll, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM b
   WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 63 PRECEDING AND CURRENT ROW))
 SELECT symbol, {stamp()} AS ts, round(ll + (hh - ll) * 0.25, 6) AS level_2, round(ll + (hh - ll) * 0.5, 6) AS level_4, round(ll + (hh - ll) * 0.75, 6) AS level_6 FROM m WHERE k >= 64""")
def octave_levels(spark, sf_dir):
    """Eighths of the range of the last 64 bars."""
    w = Window.partitionBy("symbol").orderBy("i").rowsBetween(-63, 0)
    d = hourly(spark, sf_dir).select("symbol", "ts", "i", F.max("high").over(w).alias("hh"), F.min("low").over(w).alias("ll")).where("i >= 63")
    at = lambda x, n: F.round(F.col("ll") + (F.col("hh") - F.col("ll")) * x, 6).alias(n)
    return d.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), at(0.25, "level_2"), at(0.5, "level_4"), at(0.75, "level_6"))
