"""A store of bars, merged three times: by half, with conflicts, and with nothing new."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..session import scratch, table
from ..sources import store
from .define import bars_sql, query, stamp

_COLS = ["open", "high", "low", "close"]
#: First come the bars before noon; then all, of which some are off by too much and the others by little.
_MERGED = f"""{bars_sql(60)}, s AS MATERIALIZED (SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, ts, open, high, low, close, volume, hour(ts) < 12 AS first_, hour(ts) % 7 = 0 AS off FROM b)"""


def _merges(spark, sf_dir):
    bars = B.from_ticks(B.ticks(table(spark, sf_dir, "events").where("value > 0")), 60)
    bars = bars.select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("ts").cast("timestamp").alias("ts"), *_COLS, "volume")
    other = bars.withColumn("close", F.col("close") + F.when(F.hour("ts") % 7 == 0, 1.0).otherwise(0.03125))
    path = f"{scratch(spark, 'store')}/bars"
    reports = [store.merge(x, path, ["symbol", "ts"], "day", _COLS) for x in (bars.where(F.hour("ts") < 12), other, other)]
    return bars.schema, path, reports


@query(f"""WITH {_MERGED}, f AS (SELECT day, count(*) AS n FROM s WHERE first_ GROUP BY day),
 a AS (SELECT day, count(*) AS n, count(*) FILTER (first_) AS before_, count(*) FILTER (first_ AND off) AS conflicts, count(*) FILTER (off) AS all_off FROM s GROUP BY day)
 SELECT 1 AS merge, day, 0 AS rows_before, n AS added, 0 AS conflicts, n AS rows_after, true AS rewritten FROM f
 UNION ALL SELECT 2, day, before_, n - before_, conflicts, n, n > before_ FROM a
 UNION ALL SELECT 3, day, n, 0, conflicts, n, false FROM a""")
def merge_report(spark, sf_dir):
    """Which days each merge met, what it added, where it met conflicts, and which days it rewrote."""
    out = None
    for k, r in enumerate(_merges(spark, sf_dir)[2]):
        r = r.select(F.lit(k + 1).alias("merge"), "day", "rows_before", "added", "conflicts", "rows_after", "rewritten")
        out = r if out is None else out.unionByName(r)
    return out


@query(f"""WITH {_MERGED} SELECT symbol, day, {stamp()} AS ts, open, high, low, round(CASE WHEN first_ THEN close WHEN off THEN close + 1 ELSE close + 0.03125 END, 6) AS close, CAST(volume AS BIGINT) AS volume FROM s""")
def merged_store(spark, sf_dir):
    schema, path, _ = _merges(spark, sf_dir)
    d = spark.read.schema(schema).parquet(path)
    return d.select("symbol", "day", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "open", "high", "low", F.round("close", 6).alias("close"), "volume")


@query(f"WITH {_MERGED} SELECT day, count(*) AS rows, true AS intact FROM s GROUP BY day")
def store_verified(spark, sf_dir):
    schema, path, _ = _merges(spark, sf_dir)
    return store.verify(spark, path, schema, "day").select("day", "rows", "intact")
