"""Bars, validation, coverage, time joins and set operations over the event stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof, bars as B
from ..session import table
from .define import TICKS, bars_sql, query, stamp


def _ticks(spark, sf_dir):
    return B.ticks(table(spark, sf_dir, "events").where("value > 0"))


def _bars(spark, sf_dir, minutes):
    return B.from_ticks(_ticks(spark, sf_dir), minutes)


def _out(df, *more):
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")
    return df.select("symbol", at, *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], F.col("volume").cast("long"), *more)


_ROUND = "round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, CAST(volume AS BIGINT) AS volume"


@query(f"""WITH {bars_sql(5)},
 s AS (SELECT *, row_number() OVER w AS k, avg(close) OVER w20 AS m FROM b
   WINDOW w AS (PARTITION BY symbol ORDER BY ts), w20 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 d AS (SELECT *, CASE WHEN k > 20 THEN stddev_pop(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) ELSE 0.0 END AS sd FROM s)
SELECT symbol, {stamp()} AS ts, round(close, 6) AS close, CASE WHEN k >= 20 THEN round(m, 6) ELSE 0.0 END AS sma,
 CASE WHEN k >= 20 THEN round(m + 2 * sd, 6) ELSE 0.0 END AS upper, CASE WHEN k >= 20 THEN round(m - 2 * sd, 6) ELSE 0.0 END AS lower FROM d""")
def bars_sma_bollinger(spark, sf_dir):
    """The flagship: ticks to five-minute bars, one sort per symbol for mean and bands."""
    w = Window.partitionBy("symbol").orderBy("ts")
    w20 = w.rowsBetween(-19, 0)
    d = _bars(spark, sf_dir, 5).withColumns({"k": F.row_number().over(w), "m": F.avg("close").over(w20), "s": F.stddev_pop("close").over(w20)})
    sd = F.when(F.col("k") > 20, F.col("s")).otherwise(0.0)
    full = lambda x: F.when(F.col("k") >= 20, F.round(x, 6)).otherwise(0.0)
    return d.select(
        "symbol",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.round("close", 6).alias("close"),
        full(F.col("m")).alias("sma"),
        full(F.col("m") + 2 * sd).alias("upper"),
        full(F.col("m") - 2 * sd).alias("lower"),
    )


def _resampled(minutes):
    @query(f"WITH {bars_sql(minutes)} SELECT symbol, {stamp()} AS ts, {_ROUND}, round(wap, 6) AS wap FROM b", f"resample_{minutes}")
    def run(spark, sf_dir):
        return _out(B.resample(_bars(spark, sf_dir, 1), minutes), F.round("wap", 6).alias("wap"))


for _m in (5, 10, 15, 30, 60, 240, 1440):
    _resampled(_m)


@query(f"""WITH {TICKS.replace(' WHERE value > 0', '')} SELECT symbol, id, CASE WHEN price > 0 THEN 0 ELSE 4 END AS n_errors,
  CASE WHEN price < 0.001 THEN 1 ELSE 0 END AS n_warnings FROM t""")
def validate_ticks(spark, sf_dir):
    t = B.ticks(table(spark, sf_dir, "events"))
    b = t.select("symbol", "ts", "id", *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], "volume")
    return B.validate(b).select("symbol", "id", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"))


@query(f"""WITH {TICKS} SELECT symbol, count(*) AS n, count(*) FILTER (minute(ts) % 15 = 0 AND second(ts) = 0 AND microsecond(ts) % 1000000 = 0) AS aligned
  FROM t GROUP BY symbol""")
def time_frame_alignment(spark, sf_dir):
    return B.aligned(_ticks(spark, sf_dir), 15).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if("is_aligned").alias("aligned"))


@query(f"WITH {bars_sql(60)} SELECT symbol, {stamp()} AS ts, {_ROUND} FROM b WHERE ts >= '2024-01-05' AND ts < '2024-01-08'")
def range_exclusive_end(spark, sf_dir):
    d = _bars(spark, sf_dir, 60)
    return _out(B.in_range(d, "2024-01-05", "2024-01-08"))


@query(f"""WITH {bars_sql(60)}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM b WHERE ts < '2024-01-08')
 SELECT symbol, {stamp()} AS ts, {_ROUND} FROM r WHERE k <= 14""")
def range_last_period(spark, sf_dir):
    return _out(B.in_range(_bars(spark, sf_dir, 60), None, "2024-01-08", period=14))


@query("""WITH d AS (SELECT DISTINCT l_suppkey AS s, CAST(l_shipdate AS DATE) AS day FROM lineitem),
 g AS (SELECT s, day, lag(day) OVER (PARTITION BY s ORDER BY day) AS prev FROM d),
 n AS (SELECT s, day, prev, len(list_filter(generate_series(prev + INTERVAL 1 DAY, day - INTERVAL 1 DAY, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) AS gap FROM g WHERE prev IS NOT NULL)
 SELECT CAST(s AS VARCHAR) AS symbol, CAST(day AS VARCHAR) AS day, CAST(gap AS INT) AS gap FROM n WHERE gap > 30""")
def business_day_gaps(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), F.to_date("l_shipdate").alias("ts")).distinct()
    return B.gaps(d, most=30).select("symbol", F.col("ts").cast("string").alias("day"), "gap")


@query(f"""WITH {bars_sql(60)}, e AS (SELECT symbol, min(ts) AS a, max(ts) AS z FROM b GROUP BY symbol),
 g AS (SELECT symbol, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS ts FROM e),
 j AS (SELECT g.symbol, g.ts, open, high, low, close, volume FROM g LEFT JOIN b USING (symbol, ts)),
 f AS (SELECT *, count(close) OVER (PARTITION BY symbol ORDER BY ts) AS k FROM j),
 c AS (SELECT *, max(close) OVER (PARTITION BY symbol, k) AS last FROM f)
SELECT symbol, {stamp()} AS ts, round(coalesce(open, last), 6) AS open, round(coalesce(high, last), 6) AS high, round(coalesce(low, last), 6) AS low,
 round(coalesce(close, last), 6) AS close, CAST(coalesce(volume, 0) AS BIGINT) AS volume, close IS NULL AS manufactured FROM c""")
def fill_forward(spark, sf_dir):
    return _out(B.fill_forward(_bars(spark, sf_dir, 60), 60), "manufactured")


@query(f"""WITH {bars_sql(60)}, n AS (SELECT *, lead(ts) OVER w AS nts, lead(open) OVER w AS nopen FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 a AS (SELECT symbol, ts, open, high, low, close, volume, false AS manufactured FROM b UNION ALL
  SELECT symbol, date_trunc('day', ts) + INTERVAL '16 hours 15 minutes', close, greatest(close, nopen), least(close, nopen), nopen, 1, true FROM n
  WHERE CAST(nts AS DATE) > CAST(ts AS DATE))
 SELECT symbol, {stamp()} AS ts, {_ROUND}, manufactured FROM a""")
def bridge_bars(spark, sf_dir):
    return _out(B.bridges(_bars(spark, sf_dir, 60)), "manufactured")


@query("SELECT event_type AS symbol, user_id, arg_max(value, event_id) AS value FROM events GROUP BY event_type, user_id")
def upsert_last_write(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("user_id").alias("ts"), "value", "event_id")
    return B.upsert(e, "event_id").select("symbol", F.col("ts").alias("user_id"), "value")


@query(f"""WITH {bars_sql(60)}, c AS (SELECT symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS bars, {stamp('min(ts)')} AS first, {stamp('max(ts)')} AS last FROM b GROUP BY ALL)
 SELECT *, CASE WHEN bars / 24 >= 0.95 THEN 'full' WHEN bars / 24 >= 0.75 THEN 'good' WHEN bars / 24 >= 0.25 THEN 'partial' ELSE 'sparse' END AS band FROM c""".replace("GROUP BY ALL", "GROUP BY symbol, CAST(ts AS DATE)"))
def day_coverage(spark, sf_dir):
    d = B.coverage(_bars(spark, sf_dir, 60), 24)
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return d.select("symbol", F.col("day").cast("string").alias("day"), "bars", at("first"), at("last"), "band")


@query(f"""WITH {TICKS} SELECT symbol, CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS month, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n
  FROM t GROUP BY ROLLUP (symbol, date_trunc('month', ts), CAST(ts AS DATE))""")
def coverage_rollup(spark, sf_dir):
    t = _ticks(spark, sf_dir).select("symbol", F.trunc("ts", "MM").cast("string").alias("month"), F.to_date("ts").cast("string").alias("day"))
    return t.rollup("symbol", "month", "day").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return B.duplicates(table(spark, sf_dir, "events").select("user_id", "event_type"), ["user_id", "event_type"])


@query(f"""WITH {bars_sql(60)} SELECT symbol, count(*) AS bars, count(*) FILTER (high < low) AS range_errors, count(*) FILTER (close > high OR close < low) AS close_errors,
  {stamp('min(ts)')} AS first, {stamp('max(ts)')} AS last FROM b GROUP BY symbol""")
def integrity_summary(spark, sf_dir):
    d = B.integrity(_bars(spark, sf_dir, 60))
    return d.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first", "last")})


def _asof_sides(spark, sf_dir):
    t = _ticks(spark, sf_dir)
    left = t.where("symbol = 'purchase'").select(F.lit("x").alias("k"), "id", "ts")
    right = t.where("symbol = 'view'").select(F.lit("x").alias("k"), "ts", "price")
    return left, right


@query(f"""WITH {TICKS}, l AS (SELECT id, ts FROM t WHERE symbol = 'purchase'), r AS (SELECT ts, price FROM t WHERE symbol = 'view')
 SELECT l.id, CASE WHEN date_diff('second', date_trunc('second', r.ts), date_trunc('second', l.ts)) <= 600 THEN round(r.price, 6) END AS price FROM l ASOF LEFT JOIN r ON l.ts >= r.ts""")
def asof_backward(spark, sf_dir):
    left, right = _asof_sides(spark, sf_dir)
    return asof.backward(left, right, "k", "ts", "price", within_seconds=600).select("id", F.round("price", 6).alias("price"))


@query(f"""WITH {TICKS}, l AS (SELECT id, ts FROM t WHERE symbol = 'purchase'), r AS (SELECT ts, price FROM t WHERE symbol = 'view')
 SELECT l.id, round(r.price, 6) AS price FROM l ASOF LEFT JOIN r ON l.ts <= r.ts""")
def asof_forward(spark, sf_dir):
    left, right = _asof_sides(spark, sf_dir)
    return asof.forward(left, right, "k", "ts", "price").select("id", F.round("price", 6).alias("price"))


@query(f"""WITH {bars_sql(1440)}, p AS (SELECT symbol, CAST(ts AS DATE) AS day, close AS price FROM b),
 s AS (SELECT o_orderkey AS id, ['click','view','error','signup','purchase'][1 + CAST(o_orderkey % 5 AS INT)] AS symbol, CAST('2024-01-01' AS DATE) + CAST(o_orderkey % 30 AS INT) AS day FROM orders),
 h AS (SELECT s.*, unnest([1, 7, 14, 30]) AS horizon FROM s),
 j AS (SELECT h.*, (SELECT arg_min(price, p.day) FROM p WHERE p.symbol = h.symbol AND p.day >= h.day + 1) AS entry,
   (SELECT arg_min(price, p.day) FROM p WHERE p.symbol = h.symbol AND p.day >= h.day + h.horizon) AS exit FROM h)
 SELECT id, horizon, round(entry, 6) AS entry, round(exit, 6) AS exit, round(exit / entry - 1, 6) AS ret FROM j""")
def horizon_returns(spark, sf_dir):
    p = _bars(spark, sf_dir, 1440).select("symbol", F.to_date("ts").alias("day"), "close")
    names = F.array(*[F.lit(x) for x in ("click", "view", "error", "signup", "purchase")])
    o = table(spark, sf_dir, "orders")
    s = o.select(
        F.col("o_orderkey").alias("id"),
        F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("symbol"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 30).cast("int")).alias("day"),
    )
    r = asof.horizon_returns(s, p, days=(1, 7, 14, 30))
    return r.select("id", "horizon", *[F.round(c, 6).alias(c) for c in ("entry", "exit", "ret")])


@query(f"""WITH {bars_sql(60)}, {bars_sql(60, 'b2').split('),', 1)[1].strip()},
 a AS (SELECT symbol, ts, close FROM b WHERE hour(ts) % 3 <> 0), c AS (SELECT symbol, ts, close + CASE WHEN hour(ts) % 5 = 0 THEN 1 ELSE 0 END AS close FROM b2 WHERE hour(ts) % 4 <> 0)
 SELECT symbol, {stamp('coalesce(a.ts, c.ts)')} AS ts, CASE WHEN c.ts IS NULL THEN 'only_a' WHEN a.ts IS NULL THEN 'only_b' WHEN abs(a.close - c.close) <= 0.01 THEN 'equal' ELSE 'differs' END AS status
 FROM a FULL JOIN c USING (symbol, ts)""".replace("coalesce(a.ts, c.ts)", "ts"))
def reconcile_sources(spark, sf_dir):
    b = _bars(spark, sf_dir, 60).select("symbol", "ts", "close")
    a = b.where(F.hour("ts") % 3 != 0)
    c = b.where(F.hour("ts") % 4 != 0).withColumn("close", F.col("close") + F.when(F.hour("ts") % 5 == 0, 1).otherwise(0))
    return asof.reconcile(a, c, ["symbol", "ts"], ["close"]).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH l AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer), r AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier),
 j AS (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(s_acctbal - c_acctbal), s_acctbal) AS k
   FROM l JOIN r ON c_nationkey = s_nationkey AND abs(s_acctbal - c_acctbal) <= 500)
 SELECT c_custkey, s_suppkey FROM j WHERE k = 1""")
def nearest_in_range(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), "c_acctbal")
    right = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("x"), "s_suppkey")
    return asof.nearest_in_range(left, right, "k", "c_acctbal", "x", 500.0).select("c_custkey", "s_suppkey")


@query("SELECT count(*) AS missing FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def split_completeness(spark, sf_dir):
    o, l = (table(spark, sf_dir, t) for t in ("orders", "lineitem"))
    return o.join(l, o.o_orderkey == l.l_orderkey, "left_anti").agg(F.count("*").alias("missing"))


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
 SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both_, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either,
  (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b""")
def set_algebra(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type IN ('view', 'purchase')").groupBy("user_id").agg(
        F.max(F.col("event_type") == "view").alias("a"), F.max(F.col("event_type") == "purchase").alias("b")
    )
    a, b = F.col("a"), F.col("b")
    return e.agg(F.count_if(a & b).alias("both_"), F.count("*").alias("either"), F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"))


@query(f"""WITH {TICKS}, r AS (SELECT symbol, strftime(date_trunc('hour', ts) + to_minutes(CAST(minute(ts) // 30 * 30 AS BIGINT)), '%H:%M') AS slot, price FROM t)
 SELECT symbol, slot, count(*) AS n, round(sum(price), 6) AS total FROM r GROUP BY ALL""")
def half_hour_histogram(spark, sf_dir):
    t = _ticks(spark, sf_dir)
    return t.groupBy("symbol", F.date_format(B.bucket(F.col("ts"), 30), "HH:mm").alias("slot")).agg(F.count("*").alias("n"), F.round(F.sum("price"), 6).alias("total"))


@query(f"""WITH {bars_sql(60)} SELECT symbol, round(min(close), 6) AS lo, round(max(close), 6) AS hi, round(avg(close), 6) AS mean, round(stddev_pop(close), 6) AS sd,
 round(stddev_samp(close), 6) AS sd_sample, round(median(close), 6) AS med FROM b GROUP BY symbol""")
def normalisation_stats(spark, sf_dir):
    r = lambda x, n: F.round(x, 6).alias(n)
    return _bars(spark, sf_dir, 60).groupBy("symbol").agg(
        r(F.min("close"), "lo"), r(F.max("close"), "hi"), r(F.avg("close"), "mean"), r(F.stddev_pop("close"), "sd"), r(F.stddev_samp("close"), "sd_sample"), r(F.median("close"), "med")
    )


@query(f"""WITH {bars_sql(60)}, x AS (SELECT symbol, CAST(ts AS DATE) AS day, unnest(generate_series(CAST(floor(low / 5) AS BIGINT), CAST(floor(high / 5) AS BIGINT))) AS tick,
  CASE WHEN hour(ts) < 8 THEN 'asia' WHEN hour(ts) < 16 THEN 'europe' ELSE 'america' END AS session FROM b)
 SELECT symbol, CAST(day AS VARCHAR) AS day, session, tick, count(*) AS n FROM x GROUP BY ALL""")
def market_profile(spark, sf_dir):
    b = _bars(spark, sf_dir, 60)
    session = F.when(F.hour("ts") < 8, "asia").when(F.hour("ts") < 16, "europe").otherwise("america")
    ticks = F.explode(F.sequence(F.floor(F.col("low") / 5), F.floor(F.col("high") / 5)))
    d = b.select("symbol", F.to_date("ts").cast("string").alias("day"), session.alias("session"), ticks.alias("tick"))
    return d.groupBy("symbol", "day", "session", "tick").agg(F.count("*").alias("n"))


@query(f"""WITH {bars_sql(60)}, d AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY n, ts) AS prev FROM b)
 SELECT symbol, count(*) FILTER (prev > ts) AS violations FROM d GROUP BY symbol""")
def order_violations(spark, sf_dir):
    b = _bars(spark, sf_dir, 60)
    prev = F.lag("ts").over(Window.partitionBy("symbol").orderBy("count", "ts"))
    return b.withColumn("prev", prev).groupBy("symbol").agg(F.count_if(F.col("prev") > F.col("ts")).alias("violations"))


@query("SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)[1] AS first_link, len(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS links FROM pages")
def link_extraction(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.get(links, F.lit(0)).alias("first_link"), F.size(links).cast("long").alias("links"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
