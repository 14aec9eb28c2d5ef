"""The market's calendar and clock over the tables' own days, and durations counted by it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest, clock, intervals
from ..operators import bars as B
from ..session import table, written
from .define import TICKS, bars_sql, query, stamp
from .indicator_queries import hourly
from .study_queries import _B, _trades


def calendar_sql(days: str) -> str:
    """CTEs d (days), k (with holiday, half_day, minutes), by rules of weekday and date alone."""
    moved = lambda m, d: f"x = CASE isodow(make_date(y, {m}, {d})) WHEN 6 THEN make_date(y, {m}, {d}) - 1 WHEN 7 THEN make_date(y, {m}, {d}) + 1 ELSE make_date(y, {m}, {d}) END"
    monday = lambda m, a, z: f"month(x) = {m} AND isodow(x) = 1 AND day(x) BETWEEN {a} AND {z}"
    return f"""d AS ({days}),
 y AS (SELECT x, CAST(year(x) AS INT) AS y, CAST(year(x) % 19 AS INT) AS a, CAST(year(x) // 100 AS INT) AS b, CAST(year(x) % 100 AS INT) AS c FROM d),
 e1 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM y),
 e2 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e1),
 e3 AS (SELECT *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS p FROM e2),
 h AS (SELECT x, y, CASE WHEN isodow(make_date(y, 1, 1)) <> 6 AND {moved(1, 1)} THEN 'New Year' WHEN {monday(1, 15, 21)} THEN 'Martin Luther King' WHEN {monday(2, 15, 21)} THEN 'Presidents'
   WHEN x = make_date(y, p // 31, p % 31 + 1) - 2 THEN 'Good Friday' WHEN {monday(5, 25, 31)} THEN 'Memorial' WHEN y >= 2022 AND {moved(6, 19)} THEN 'Juneteenth' WHEN {moved(7, 4)} THEN 'Independence'
   WHEN {monday(9, 1, 7)} THEN 'Labor' WHEN month(x) = 11 AND isodow(x) = 4 AND day(x) BETWEEN 22 AND 28 THEN 'Thanksgiving' WHEN {moved(12, 25)} THEN 'Christmas' END AS holiday FROM e3),
 f AS (SELECT x, holiday, CASE WHEN isodow(x) > 5 OR holiday IS NOT NULL THEN NULL WHEN month(x) = 7 AND day(x) = 3 AND isodow(x + 1) < 6 THEN 'Independence Eve'
   WHEN month(x) = 11 AND isodow(x) = 5 AND day(x) BETWEEN 23 AND 29 THEN 'Day after Thanksgiving' WHEN month(x) = 12 AND day(x) = 24 AND isodow(x + 1) < 6 THEN 'Christmas Eve'
   WHEN month(x) = 12 AND day(x) = 31 AND isodow(x + 1) < 6 THEN 'New Year''s Eve' END AS half_day FROM h),
 k AS MATERIALIZED (SELECT *, CASE WHEN isodow(x) > 5 OR holiday IS NOT NULL THEN 0 WHEN half_day IS NOT NULL THEN 210 ELSE 390 END AS minutes FROM f)"""


_ORDERS = "SELECT CAST(unnest(generate_series((SELECT min(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders), INTERVAL 1 DAY)) AS DATE) AS x"
_EVENTS = "SELECT CAST(unnest(generate_series((SELECT min(CAST(lt AS DATE)) FROM l), (SELECT max(CAST(lt AS DATE)) FROM l), INTERVAL 1 DAY)) AS DATE) AS x"
#: CTE l: events by New York's clock.
_LOCAL = f"{TICKS}, l AS MATERIALIZED (SELECT symbol, id, timezone('America/New_York', timezone('UTC', ts)) AS lt FROM t)"


@query(f"""WITH {calendar_sql(_ORDERS)}, o AS (SELECT CAST(o_orderdate AS DATE) AS x, count(*) AS n FROM orders GROUP BY 1)
 SELECT CAST(x AS VARCHAR) AS day, holiday, half_day, CAST(minutes AS INT) AS minutes, coalesce(n, 0) AS orders FROM k LEFT JOIN o USING (x)""")
def market_calendar(spark, sf_dir):
    """Every day from the first order to the last: closed, half or whole, and the orders that fell on it."""
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    n = o.groupBy("day").agg(F.count("*").alias("orders"))
    d = clock.sessions(o, F.col("day")).join(n, "day", "left")
    return d.select(F.col("day").cast("string").alias("day"), "holiday", "half_day", "minutes", F.coalesce("orders", F.lit(0)).alias("orders"))


def _local(spark, sf_dir):
    t = B.ticks(table(spark, sf_dir, "events").where("value > 0"))
    return t.select("symbol", "id", clock.local(F.col("ts")).alias("ts"))


def _minutes(spark, sf_dir):
    return written(clock.local_minutes(B.ticks(table(spark, sf_dir, "events").where("value > 0"))), "minutes")


_COVERED = f"""{_LOCAL}, {calendar_sql(_EVENTS)}, m AS (SELECT DISTINCT symbol, CAST(lt AS DATE) AS x, hour(lt) * 60 + minute(lt) AS m FROM l),
 g AS (SELECT symbol, x, half_day, minutes AS expected, count(*) FILTER (m >= 570 AND m < 570 + minutes) AS seen, min(m) AS a, max(m) AS z, CASE WHEN half_day IS NULL THEN 959 ELSE 780 END AS last, CASE WHEN half_day IS NULL THEN 30 ELSE 5 END AS tol
   FROM m JOIN k USING (x) WHERE minutes > 0 GROUP BY ALL),
 cv AS MATERIALIZED (SELECT *, a > 571 AS late_open, z < last - tol AS early_close, a < 510 AS before_hours, z > last + 180 AS after_hours FROM g)"""


@query(f"""WITH {_COVERED} SELECT symbol, CAST(x AS VARCHAR) AS day, seen AS minutes, CAST(expected AS INT) AS expected, round(seen / expected, 6) AS share,
 CASE WHEN seen / expected >= 0.95 THEN 'near full' WHEN seen / expected >= 0.75 THEN 'good' WHEN seen / expected >= 0.25 THEN 'partial' ELSE 'low' END AS band, late_open, early_close, before_hours, after_hours, NOT late_open AND NOT early_close AS perfect FROM cv""")
def session_coverage(spark, sf_dir):
    """Minutes of every symbol and session, against 390 or 210, and whether the day begins and ends on time."""
    b = _minutes(spark, sf_dir)
    d = clock.coverage(b, clock.sessions(b, F.col("ts"))).drop("half_day")
    return d.withColumns({"day": F.col("day").cast("string"), "share": F.round("share", 6)})


@query(f"""WITH {_COVERED} SELECT symbol, count(*) AS days, count(half_day) AS half_days, count(*) FILTER (NOT late_open AND NOT early_close) AS perfect, round(100 * avg(CASE WHEN NOT late_open AND NOT early_close THEN 1.0 ELSE 0.0 END), 4) AS percent_perfect FROM cv GROUP BY symbol""")
def session_summary(spark, sf_dir):
    b = _minutes(spark, sf_dir)
    d = clock.coverage(b, clock.sessions(b, F.col("ts")))
    return d.groupBy("symbol").agg(F.count("*").alias("days"), F.count("half_day").alias("half_days"), F.count_if("perfect").alias("perfect"), F.round(100 * F.avg(F.when(F.col("perfect"), 1.0).otherwise(0.0)), 4).alias("percent_perfect"))


@query(f"""WITH {_LOCAL}, w AS (SELECT max(lt) AS now FROM l), b AS (SELECT DISTINCT symbol, date_trunc('day', lt) AS day, (hour(lt) * 60 + minute(lt)) // 15 * 15 AS m FROM l)
 SELECT symbol, {stamp("day + to_minutes(CAST(m AS BIGINT))")} AS ts, m = 570 AS first_, m = 960 AS last_,
   now >= day + to_minutes(CAST(m + 15 AS BIGINT)) AND (now >= day + INTERVAL 570 MINUTE OR m + 15 <= 570) AS complete, now >= day + INTERVAL 975 MINUTE AS day_complete FROM b, w""")
def clock_flags(spark, sf_dir):
    """Quarter-hour bars: first or last of their day by the clock, complete as of the last tick, and their day."""
    t = _local(spark, sf_dir)
    b = t.select("symbol", B.bucket(F.col("ts"), 15).alias("ts")).distinct()
    last = t.agg(F.max("ts").cast("string")).first()[0]  # one value
    ts, now = F.col("ts"), F.lit(last).cast("timestamp_ntz")
    return b.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), clock.first_of_day(ts, 15).alias("first_"), clock.last_of_day(ts, 15).alias("last_"), clock.complete(ts, 15, now).alias("complete"), clock.complete(ts, 1440, now).alias("day_complete"))


@query(f"""WITH {_B}, w AS (SELECT tr.symbol, a.ts AS opened, z.ts AS closed FROM tr JOIN s a ON a.symbol = tr.symbol AND a.i = open_i JOIN s z ON z.symbol = tr.symbol AND z.i = close_i),
 p AS (SELECT symbol, opened, closed, count(s.ts) AS bars, coalesce(sum(s.volume), 0) AS volume FROM w LEFT JOIN s USING (symbol) WHERE s.ts >= opened AND s.ts < closed GROUP BY ALL)
 SELECT symbol, count(*) AS trades, round(avg(bars), 6) AS real_bars, round(avg((epoch(closed) - epoch(opened)) / 3600), 6) AS hours, round(avg(volume), 6) AS volume FROM p GROUP BY symbol""")
def trade_durations(spark, sf_dir):
    """A trade's length in bars that were really there, and in hours, filled ones included: counted over
    the filled series by prefix sums, without a join of bars to trades."""
    b = hourly(spark, sf_dir)
    filled = B.fill_forward(b.drop("i"), 60)
    t = _trades(spark, sf_dir)
    at = lambda i, name: b.select("symbol", F.col("i").alias(i), F.unix_seconds(F.col("ts").cast("timestamp")).alias(name))
    t = t.join(at("open_i", "opens"), ["symbol", "open_i"]).join(at("close_i", "closes"), ["symbol", "close_i"]).select("symbol", "opens", "closes")
    p = filled.select("symbol", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), (~F.col("manufactured")).cast("int").alias("real"), F.coalesce("volume", F.lit(0)).alias("v"))
    d = intervals.count_in(p, t, "symbol", "at", "opens", "closes", {"real_bars": F.col("real"), "hours": F.lit(1), "volume": F.col("v")}, 7 * 86_400)
    return d.groupBy("symbol").agg(F.count("*").alias("trades"), *[F.round(F.avg(c), 6).alias(c) for c in ("real_bars", "hours", "volume")])


@query(f"""WITH {_B}, c AS (SELECT symbol, open_i, max(CASE WHEN gain <= -100 THEN 1 ELSE 0 END) OVER w AS flat, exp(sum(ln(1 + greatest(gain, -99.999999) / 100)) OVER w) * 100000 AS grown FROM g WINDOW w AS (PARTITION BY symbol ORDER BY open_i)),
 l AS (SELECT symbol, open_i, CASE WHEN flat = 1 THEN 0 ELSE grown END AS balance FROM c), k AS (SELECT *, round(balance - lag(balance, 1, 100000.0) OVER (PARTITION BY symbol ORDER BY open_i)) AS dollars FROM l),
 u AS (SELECT *, 100000 + sum(dollars) OVER (PARTITION BY symbol ORDER BY open_i) AS progress FROM k)
 SELECT symbol, count(*) AS trades, count(*) FILTER (abs(progress - balance) > 0.01) AS off, round(arg_max(balance, open_i) - 100000 - sum(dollars), 2) + 0.0 AS discrepancy, abs(arg_max(balance, open_i) - 100000 - sum(dollars)) > 1000 AS alarm FROM u GROUP BY symbol""")
def balance_discrepancy(spark, sf_dir):
    """Gains booked in whole dollars against the balance that compounds: trades where they part by a cent, and by how much at the end."""
    d = backtest.discrepancy(_trades(spark, sf_dir), 100_000.0, 0)
    return d.withColumn("discrepancy", F.round("discrepancy", 2) + 0.0)
