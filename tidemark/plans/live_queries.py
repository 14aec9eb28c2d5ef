"""Streams that run as streams: files arrive, the query stops and starts again, the sink is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..session import scratch, table
from ..streaming import bars as SB
from ..streaming import trades as ST
from .define import TICKS, query

#: Ticks come in so many deliveries, by time; every LATE-th comes one delivery late.
DELIVERIES, LATE = 4, 29
_DELIVERED = f"""{TICKS}, r AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) + 1 AS z FROM t),
 d AS (SELECT t.*, epoch_us(ts) AS us, least({DELIVERIES - 1}, (epoch_us(ts) - a) * {DELIVERIES} // (z - a) + CASE WHEN id % {LATE} = 0 THEN 1 ELSE 0 END) AS delivery FROM t, r),
 m AS (SELECT delivery, max(us) // 1000 - 600000 AS upto FROM d GROUP BY delivery),
 k AS (SELECT delivery, coalesce(max(upto) OVER (ORDER BY delivery ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed, max(upto) OVER () AS final FROM m)"""


def _deliveries(spark, sf_dir):
    """The ticks of every delivery, and their schema."""
    t = B.ticks(table(spark, sf_dir, "events").where("value > 0")).withColumn("ts", F.col("ts").cast("timestamp"))
    us = F.unix_micros("ts")
    r = t.agg(F.min(us).alias("a"), (F.max(us) + 1).alias("z")).first()
    first = F.expr(f"(unix_micros(ts) - {r['a'] or 0}L) * {DELIVERIES} div {(r['z'] or 1) - (r['a'] or 0)}L")
    d = t.withColumn("delivery", F.least(F.lit(DELIVERIES - 1), first + F.when(F.col("id") % LATE == 0, 1).otherwise(0)))
    return (d.where(F.col("delivery") == k).drop("delivery") for k in range(DELIVERIES)), t.schema


def _run(spark, sf_dir, plan, name):
    rows, schema = _deliveries(spark, sf_dir)
    return ST.deliver(spark, rows, schema, plan, scratch(spark, name))


@query(f"""WITH {_DELIVERED}, ok AS (SELECT symbol, id, price, us, us // 86400000000 AS day FROM d JOIN k USING (delivery) WHERE us >= passed * 1000 AND us < final * 1000),
 g AS (SELECT *, nullif(sign(price - lag(price) OVER (PARTITION BY symbol, day ORDER BY us, id)), 0) AS turn FROM ok),
 h AS (SELECT *, turn AS side, lag(turn) OVER (PARTITION BY symbol, day ORDER BY us, id) AS before FROM g WHERE turn IS NOT NULL),
 o AS (SELECT symbol, day, us, id, price, side FROM h WHERE before IS NULL OR before <> side),
 e AS (SELECT symbol, day, arg_max(price, (us, id)) AS price FROM ok GROUP BY symbol, day),
 n AS (SELECT *, lead(us) OVER w AS next_us, lead(price) OVER w AS next_price FROM o WINDOW w AS (PARTITION BY symbol, day ORDER BY us, id)),
 x AS (SELECT symbol, 'opened' AS event, us, price, side, 'switch' AS reason FROM n
   UNION ALL SELECT symbol, 'closed', next_us, next_price, side, 'switch' FROM n WHERE next_us IS NOT NULL
   UNION ALL SELECT n.symbol, 'closed', (n.day + 1) * 86400000000, e.price, side, 'session' FROM n JOIN e USING (symbol, day) WHERE next_us IS NULL AND (n.day + 1) * 86400000 <= (SELECT max(final) FROM k))
 SELECT symbol, event, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S.%f') AS ts, price, CAST(side AS INT) AS side, reason FROM x""")
def stream_positions(spark, sf_dir):
    """Opened and closed trades of a stream that is stopped three times, late ticks dropped."""
    ST.with_state(spark)
    x = _run(spark, sf_dir, ST.positions, "positions")
    return x.select("symbol", "event", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "price", "side", "reason")


@query(f"""WITH {_DELIVERED}, ok AS (SELECT *, us // 1800000000 * 1800000000 AS bar FROM d JOIN k USING (delivery) WHERE us // 1800000000 * 1800000000 + 1800000000 > passed * 1000 AND us // 1800000000 * 1800000000 + 1800000000 <= final * 1000)
 SELECT symbol, strftime(make_timestamp(bar), '%Y-%m-%d %H:%M:%S') AS ts, arg_min(price, (us, id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (us, id)) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM ok GROUP BY symbol, bar""")
def stream_bars_restarted(spark, sf_dir):
    """Half-hour bars of the same deliveries: windows that the watermark has closed, without ticks that came after."""
    x = _run(spark, sf_dir, lambda t: SB.bars(t, 30), "bars")
    return x.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "open", "high", "low", "close", "volume")
