"""The streaming plans over a finished stream, which must equal their batch statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bars as B
from ..session import table
from ..streaming import bars as SB
from .define import TICKS, bars_sql, query, stamp


def _ticks(spark, sf_dir):
    return B.ticks(table(spark, sf_dir, "events").where("value > 0")).withColumn("ts", F.col("ts").cast("timestamp"))


def _at(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query(f"WITH {bars_sql(30)} SELECT symbol, {stamp()} AS ts, open, high, low, close, volume FROM b")
def stream_bars(spark, sf_dir):
    d = SB.bars(_ticks(spark, sf_dir), 30)
    return d.select("symbol", _at("ts"), "open", "high", "low", "close", "volume")


@query(f"""WITH {TICKS}, w AS (SELECT symbol, price, time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(CAST(15 * k AS BIGINT)) AS start FROM t, (SELECT unnest([0, 1, 2, 3]) AS k))
 SELECT symbol, {stamp('start')} AS ts, count(*) AS n, round(avg(price), 6) AS mean FROM w GROUP BY symbol, start""")
def stream_sliding_windows(spark, sf_dir):
    return SB.sliding_mean(_ticks(spark, sf_dir)).select("symbol", _at("ts"), "n", F.round("mean", 6).alias("mean"))


@query(f"""WITH {TICKS}, g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY symbol ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS new_ FROM t),
 s AS (SELECT *, sum(new_) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
 SELECT symbol, {stamp('min(ts)')} AS start, count(*) AS n, round(sum(price), 4) AS total FROM s GROUP BY symbol, session""")
def stream_sessions(spark, sf_dir):
    return SB.sessions(_ticks(spark, sf_dir)).select("symbol", _at("start"), "n", F.round("total", 4).alias("total"))


@query("""SELECT event_id, strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') AS eastern FROM events""")
def eastern_time(spark, sf_dir):
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return table(spark, sf_dir, "events").select("event_id", F.date_format(S.epoch_ns_to_eastern(ns), "yyyy-MM-dd HH:mm:ss").alias("eastern"))


_RAW = ["Chief Executive Officer", "EVP, CFO", "", "Director of Sales", "Executive Chairman", "Chief Operating Off.", "Sr. Vice-President", "President & Founder", "C.T.O. (CTO)", "Chief Medical Officer", "CIO", "VP, General Counsel", "See Remarks", "Treasurer", "Advisor"]
_LABELS = ["CEO", "CFO", "Unknown", "Director", "Chair", "COO", "VP", "President", "CTO", "Other C-Suite", "CIO", "General Counsel", "Unknown", "CFO", "Other"]


@query(f"SELECT c_custkey, {_LABELS}[1 + c_custkey % {len(_RAW)}] AS title FROM customer")
def officer_titles(spark, sf_dir):
    """Titles of every label, one to a customer in turn."""
    raw = F.element_at(F.array(*[F.lit(x) for x in _RAW]), (F.col("c_custkey") % len(_RAW) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.title(raw).alias("title"))
