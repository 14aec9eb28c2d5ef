"""Price bars: from ticks, validated, resampled, filled, bridged and covered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TIMEFRAMES = {"M1": 1, "M5": 5, "M10": 10, "M15": 15, "M30": 30, "H1": 60, "H4": 240, "D1": 1440}


def ticks(events: DataFrame) -> DataFrame:
    """events as a tick stream: symbol, ts, price, volume, id."""
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("value").alias("price"),
        (F.col("user_id") % 10 + 1).alias("volume"),
        F.col("event_id").alias("id"),
    )


def bucket(ts, minutes: int):
    """The start of the bar that holds ts: minutes of the day rounded down; from 1440 on the day."""
    day = F.date_trunc("day", ts).cast("timestamp_ntz")
    if minutes >= 1440:
        return day
    of_day = F.hour(ts) * 60 + F.minute(ts)
    return day + F.make_dt_interval(F.lit(0), F.lit(0), (F.floor(of_day / minutes) * minutes).cast("int"))


def from_ticks(t: DataFrame, minutes: int) -> DataFrame:
    """One shuffle: per symbol and bucket open, high, low, close, volume, wap, count."""
    first = F.struct("ts", "id")
    return (
        t.groupBy("symbol", bucket(F.col("ts"), minutes).alias("bar"))
        .agg(
            F.min_by("price", first).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", first).alias("close"),
            F.sum("volume").alias("volume"),
            (F.sum(F.col("price") * F.col("volume")) / F.sum("volume")).alias("wap"),
            F.count("*").alias("count"),
        )
        .withColumnRenamed("bar", "ts")
    )


def resample(bars: DataFrame, minutes: int) -> DataFrame:
    """Bars to a longer frame; wap is weighted by volume, or the close if there is none."""
    v = F.sum("volume")
    return (
        bars.groupBy("symbol", bucket(F.col("ts"), minutes).alias("bar"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            v.alias("volume"),
            F.when(v == 0, F.max_by("close", "ts")).otherwise(F.try_divide(F.sum(F.col("wap") * F.col("volume")), v)).alias("wap"),
            F.sum("count").alias("count"),
        )
        .withColumnRenamed("bar", "ts")
    )


def numbered(bars: DataFrame) -> DataFrame:
    """bars with i, their place from 0 within the symbol."""
    return bars.withColumn("i", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1)


def validate(bars: DataFrame) -> DataFrame:
    """bars with arrays errors (which reject a bar) and warnings; negative volume becomes 0."""
    bad = [
        ("time missing", F.col("ts").isNull()),
        ("open not positive", ~(F.col("open") > 0)),
        ("high not positive", ~(F.col("high") > 0)),
        ("low not positive", ~(F.col("low") > 0)),
        ("close not positive", ~(F.col("close") > 0)),
        ("high below low", F.col("high") < F.col("low")),
    ]
    odd = [
        ("open outside range", (F.col("open") > F.col("high")) | (F.col("open") < F.col("low"))),
        ("close outside range", (F.col("close") > F.col("high")) | (F.col("close") < F.col("low"))),
        ("range over twice the middle", (F.col("high") - F.col("low")) > (F.col("high") + F.col("low"))),
        ("price above 1000000", F.col("high") > 1e6),
        ("price below 0.001", F.col("low") < 0.001),
        ("year out of range", ~F.year("ts").between(1900, 2100)),
        ("negative volume", F.col("volume") < 0),
    ]
    notes = lambda rules: F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(n.endswith("positive"))), n) for n, c in rules]))
    return bars.withColumns({"errors": notes(bad), "warnings": notes(odd)}).withColumn("volume", F.greatest("volume", F.lit(0)))


def aligned(bars: DataFrame, minutes: int) -> DataFrame:
    """bars with is_aligned: the time is the start of a bar of that frame."""
    return bars.withColumn("is_aligned", F.col("ts") == bucket(F.col("ts"), minutes))


def in_range(bars: DataFrame, start, end, period: int = 0) -> DataFrame:
    """start <= ts < end; with a period the last so many bars before end instead."""
    before = bars.where(F.col("ts") < F.lit(end))
    if not period:
        return before.where(F.col("ts") >= F.lit(start))
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ts").desc()))
    return before.withColumn("__back", back).where(F.col("__back") <= period).drop("__back")


def business_gap(a, b):
    """Weekdays strictly between two dates."""
    days = F.when(F.date_diff(b, a) < 2, F.array().cast("array<date>")).otherwise(F.sequence(F.date_add(a, 1), F.greatest(F.date_sub(b, 1), F.date_add(a, 1))))
    return F.size(F.filter(days, lambda d: F.weekday(d) < 5))


def gaps(bars: DataFrame, most: int = 3) -> DataFrame:
    """Bars after a gap of more than `most` business days: symbol, ts, previous, gap."""
    d = bars.select("symbol", "ts", F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts")).alias("previous"))
    d = d.withColumn("gap", business_gap(F.to_date("previous"), F.to_date("ts")))
    return d.where(F.col("previous").isNotNull() & (F.col("gap") > most))


def fill_forward(bars: DataFrame, minutes: int = 1) -> DataFrame:
    """A bar for every step between a symbol's first and last: missing ones repeat the last close
    with volume 0 and manufactured true."""
    ends = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    step = F.expr(f"interval {minutes} minutes")
    grid = ends.select("symbol", F.explode(F.sequence("a", "b", step)).alias("ts"))
    d = grid.join(bars.select("symbol", "ts", "open", "high", "low", "close", "volume"), ["symbol", "ts"], "left")
    upto = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("close", ignorenulls=True).over(upto)
    d = d.withColumn("__c", last).withColumn("manufactured", F.col("close").isNull())
    prices = {c: F.coalesce(c, "__c") for c in ("open", "high", "low", "close")}
    return d.withColumns(prices).withColumn("volume", F.coalesce("volume", F.lit(0))).drop("__c")


def bridges(bars: DataFrame) -> DataFrame:
    """bars and, between a day's last bar and the next day's first, a manufactured one at 16:15:
    open = last close, close = next open, volume 1, wap their mean."""
    w = Window.partitionBy("symbol").orderBy("ts")
    d = bars.withColumn("__ts", F.lead("ts").over(w)).withColumn("__o", F.lead("open").over(w))
    d = d.where(F.to_date("__ts") > F.to_date("ts"))
    at = F.date_trunc("day", "ts").cast("timestamp_ntz") + F.expr("interval 16 hours 15 minutes")
    made = d.select(
        "symbol",
        at.alias("ts"),
        F.col("close").alias("open"),
        F.greatest("close", "__o").alias("high"),
        F.least("close", "__o").alias("low"),
        F.col("__o").alias("close"),
        F.lit(1).cast("long").alias("volume"),
        ((F.col("close") + F.col("__o")) / 2).alias("wap"),
        F.lit(True).alias("manufactured"),
    )
    own = bars.select("symbol", "ts", "open", "high", "low", "close", "volume", "wap", F.lit(False).alias("manufactured"))
    return own.unionByName(made)


def upsert(bars: DataFrame, arrival: str) -> DataFrame:
    """The last to arrive of each symbol and time; pre-aggregated, so a hot key is no one's burden."""
    rest = [c for c in bars.columns if c not in ("symbol", "ts")]
    best = bars.groupBy("symbol", "ts").agg(F.max_by(F.struct(*rest), F.col(arrival)).alias("r"))
    return best.select("symbol", "ts", "r.*")


def coverage(bars: DataFrame, expected: int) -> DataFrame:
    """Per symbol and day: bars, first, last and the band of their share of `expected`."""
    d = bars.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count("*").alias("bars"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    share = F.col("bars") / F.lit(expected)
    band = F.when(share >= 0.95, "full").when(share >= 0.75, "good").when(share >= 0.25, "partial").otherwise("sparse")
    return d.withColumn("band", band)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def integrity(bars: DataFrame) -> DataFrame:
    """One row a symbol: bars, range errors, first and last time."""
    return bars.groupBy("symbol").agg(
        F.count("*").alias("bars"),
        F.count_if(F.col("high") < F.col("low")).alias("range_errors"),
        F.count_if((F.col("close") > F.col("high")) | (F.col("close") < F.col("low"))).alias("close_errors"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
    )
