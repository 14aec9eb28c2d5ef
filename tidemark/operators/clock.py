"""The market's clock: a dimension of sessions made for the days that data span, and what bars look like by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

ZONE = "America/New_York"
#: Minutes of the day: open, the last minute of a regular and of a half day, the end of the evening.
OPEN, LAST, HALF_LAST, EVENING = 570, 959, 780, 975
#: Minutes of a regular and of a half session, and how early the last bar may be.
WHOLE, HALF = 390, 210
EARLY, HALF_EARLY = 30, 5


def local(ts: Column, zone: str = ZONE) -> Column:
    """A UTC time by the zone's clock."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def local_minutes(bars: DataFrame) -> DataFrame:
    """symbol, ts of bars (symbol, ts in UTC) by New York's clock, once each minute: only different minutes
    are converted. Before 1884, when the offset was no whole number of minutes, once each second."""
    utc = F.col("ts").cast("timestamp_ntz")
    second = F.when(F.year(utc) < 1884, F.second(utc)).otherwise(0)
    d = bars.select("symbol", F.to_date(utc).alias("day"), F.hour(utc).alias("h"), F.minute(utc).alias("m"), second.alias("s")).distinct()
    return d.select("symbol", local(F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("h"), F.col("m"), F.col("s"))).alias("ts"))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def sessions(df: DataFrame, day: Column) -> DataFrame:
    """day, holiday, half_day, minutes (390, 210 or 0), last (minute of the day) for every day from the first to
    the last of df: a row a day, so joins to it are broadcast. No days, no rows."""
    ends = df.agg(F.min(day.cast("date")).alias("a"), F.max(day.cast("date")).alias("z")).where("a is not null")
    d = ends.select(F.explode(F.sequence("a", "z")).alias("day"))
    d = d.withColumns({"holiday": S.us_market_holiday(F.col("day")), "half_day": S.us_market_half_day(F.col("day"))})
    d = d.withColumn("half_day", F.when(F.col("holiday").isNull(), F.col("half_day")))
    closed = (F.weekday("day") > 4) | F.col("holiday").isNotNull()
    half = F.col("half_day").isNotNull()
    return d.withColumns({"minutes": F.when(closed, 0).when(half, HALF).otherwise(WHOLE), "last": F.when(closed, F.lit(None)).when(half, HALF_LAST).otherwise(LAST)})


def coverage(bars: DataFrame, days: DataFrame) -> DataFrame:
    """What every symbol shows of each open day: symbol, day, minutes, expected, share, band, late_open,
    early_close, before_hours, after_hours, perfect.

    bars: symbol, ts (by the exchange's clock). minutes: different minutes in the session. A day is perfect
    if the first bar is at most a minute after the open and the last no earlier than the last minute less the
    tolerance (half an hour; five minutes of a half day). Bars before 8:30, or three hours past
    the close, are noted. Days without a bar have no row; bars of closed days are left out.
    """
    b = bars.select("symbol", F.to_date("ts").alias("day"), minute_of_day(F.col("ts")).alias("m"))
    d = b.distinct().join(F.broadcast(days.where("minutes > 0")), "day")
    inside = (F.col("m") >= OPEN) & (F.col("m") < OPEN + F.col("minutes"))
    d = d.groupBy("symbol", "day").agg(
        F.count_if(inside).alias("minutes"), F.first(F.col("minutes")).alias("expected"), F.min("m").alias("first_"), F.max("m").alias("last_"), F.first("last").alias("last"), F.first("half_day").alias("half_day")
    )
    share = F.col("minutes") / F.col("expected")
    band = F.when(share >= 0.95, "near full").when(share >= 0.75, "good").when(share >= 0.25, "partial").otherwise("low")
    late, early = F.col("first_") > OPEN + 1, F.col("last_") < F.col("last") - F.when(F.col("half_day").isNull(), EARLY).otherwise(HALF_EARLY)
    return d.select(
        "symbol", "day", "half_day", "minutes", "expected", share.alias("share"), band.alias("band"), late.alias("late_open"), early.alias("early_close"),
        (F.col("first_") < OPEN - 60).alias("before_hours"), (F.col("last_") > F.col("last") + 180).alias("after_hours"), (~late & ~early).alias("perfect"),
    )


def complete(ts: Column, minutes: int, now: Column) -> Column:
    """Whether the bar that starts at ts is complete at `now`, both by the exchange's clock.

    A daily bar is from 16:15 of its day on. Any other is once it has ended, if now is past 16:15 of its day or at or after the
    open of its day, or if it ended before that open.
    """
    day = F.date_trunc("day", ts).cast("timestamp_ntz")
    at = lambda m: day + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(m))
    if minutes >= 1440:
        return now >= at(EVENING)
    end = ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    return (now >= end) & ((now >= at(OPEN)) | (end <= at(OPEN)))


#: The first and the last bar of a day start at these minutes, by the frame's length.
FIRST = {1: 570, 5: 570, 10: 570, 15: 570, 30: 570, 60: 540, 240: 540}
FINAL = {1: 974, 5: 970, 10: 970, 15: 960, 30: 960, 60: 960, 240: 960}


def first_of_day(ts: Column, minutes: int) -> Column:
    return F.lit(True) if minutes >= 1440 else minute_of_day(ts) == FIRST[minutes]


def last_of_day(ts: Column, minutes: int) -> Column:
    return F.lit(True) if minutes >= 1440 else minute_of_day(ts) == FINAL[minutes]
