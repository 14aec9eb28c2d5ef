import pytest
from pyspark.sql import functions as F

from tidemark.streaming import bars as SB

SCHEMA = "symbol string, ts timestamp, price double, volume long, id long"


@pytest.fixture()
def ticks(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    t = e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), (F.col("user_id") % 10 + 1).alias("volume"), F.col("event_id").alias("id"))
    for k in range(3):
        t.where(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return t, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(spark, df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def key(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_bars_equal_the_batch(spark, ticks):
    batch, stream = ticks
    cols = ["symbol", "ts", "open", "high", "low", "close", "volume"]
    want = key(SB.bars(batch, 60, "60 days"), *cols)
    assert key(run(spark, SB.bars(stream, 60, "60 days"), "complete", "bars_out"), *cols) == want and want


def test_windows_and_sessions(spark, ticks):
    batch, stream = ticks
    assert key(run(spark, SB.sliding_mean(stream, late="60 days"), "complete", "slide_out"), "symbol", "ts", "n") == key(SB.sliding_mean(batch), "symbol", "ts", "n")
    assert key(run(spark, SB.sessions(stream, late="60 days"), "complete", "session_out"), "symbol", "start", "n") == key(SB.sessions(batch), "symbol", "start", "n")


def test_repeats_are_dropped_and_switches_kept(spark, ticks):
    batch, stream = ticks
    assert run(spark, SB.distinct_ticks(stream, "60 days"), "append", "distinct_out").count() == batch.count()
    got = run(spark, SB.switches(stream), "append", "switch_out")
    assert got.where("delta not in (-1, 1)").count() == 0 and got.count() > 50


def test_upsert_batches(spark, ticks):
    batch, stream = ticks
    seen = {}
    q = stream.writeStream.foreachBatch(SB.upsert(lambda df, epoch: seen.update({r.symbol: r.price for r in df.collect()}))).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert set(seen) == {r.symbol for r in batch.select("symbol").distinct().collect()}
