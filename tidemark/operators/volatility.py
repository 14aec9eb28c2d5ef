"""From the files of option bars to a volatility for every recent contract, or the reason why it has none."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import black_scholes_of, over_arrays

#: The range of volatilities, and the steps after which a search is given up (a bracket halves in one at worst).
LOW, HIGH, STEPS = 1e-6, 5.0, 60


def implied(price: Column, s: Column, k: Column, t: Column, r: Column, q: Column, call: Column) -> Column:
    """The volatility at which the option costs `price`: Newton steps kept inside a bracket that each of them
    narrows, a batch of rows at a time; rows that have settled take no more part. Null beyond LOW to HIGH."""
    return over_arrays(_implied, price, s, k, t, r, q, call)


def _implied(*given: np.ndarray) -> np.ndarray:
    price, *option = given
    at = lambda x: black_scholes_of(*option[:5], x, option[5])
    out = np.full(len(price), np.nan)
    left = np.flatnonzero((price > at(np.full(len(price), LOW))) & (price < at(np.full(len(price), HIGH))))
    x, lo, hi = np.full(len(left), 0.3), np.full(len(left), LOW), np.full(len(left), HIGH)
    for _ in range(STEPS):
        if not len(left):
            break
        price, s, k, t, r, q, call = (c[left] for c in given)
        off = black_scholes_of(s, k, t, r, q, x, call) - price
        d1 = (np.log(s / k) + (r - q + x * x / 2) * t) / (x * np.sqrt(t))
        vega = s * np.exp(-q * t) * np.sqrt(t) * np.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi)
        lo, hi = np.where(off < 0, x, lo), np.where(off < 0, hi, x)
        with np.errstate(all="ignore"):
            newton = x - off / vega
        new = np.where(off == 0, x, np.where((newton > lo) & (newton < hi), newton, (lo + hi) / 2))
        out[left], go = new, np.abs(new - x) >= 1e-10
        left, x, lo, hi = left[go], new[go], lo[go], hi[go]
    return out


def recent_contracts(bars: DataFrame, files: int = 10) -> DataFrame:
    """contract: those with a bar in the `files` newest days that have any. A number of days comes to no more than `files` rows."""
    days = bars.select("day").where("day is not null").distinct().orderBy(F.col("day").desc()).limit(files)
    return bars.join(F.broadcast(days), "day", "left_semi").select("contract").distinct()


def chain(bars: DataFrame, contracts: DataFrame, underlying: DataFrame, days: int = 30, rate: float = 0.05, least_time_value: float = 0.01) -> DataFrame:
    """One row for each contract: files and bars of its trace, day and close of its newest bar, its underlying's close, iv and reason.

    bars: contract, ts, day, close; contracts: contract, root, strike, expiration, call, of which the recent
    are asked for; underlying: root, day, close. The trace goes `days` back from the newest file. reason is
    null where there is an iv, else the first that holds of: no bars, no underlying, expired, below intrinsic,
    little time value (less than the share `least_time_value` of the underlying), beyond bounds.
    A contract that bars know and contracts do not has the reason `unknown contract`.
    """
    newest = bars.agg(F.max("day").alias("newest"))
    b = bars.join(F.broadcast(newest), F.col("day") >= F.date_sub("newest", days)).drop("newest")
    trace = b.groupBy("contract").agg(F.countDistinct("day").alias("files"), F.count("*").alias("bars"), F.max_by(F.struct("day", "close"), "ts").alias("last"))
    d = recent_contracts(bars).join(trace, "contract", "left").join(contracts, "contract", "left")
    d = d.select("*", F.col("last.day").alias("day"), F.col("last.close").alias("close")).drop("last")
    d = d.join(underlying.withColumnRenamed("close", "underlying"), ["root", "day"], "left")
    s, k, price = F.col("underlying"), F.col("strike"), F.col("close")
    t = F.datediff("expiration", "day") / 365.0
    still = F.when(F.col("call"), s - k * F.exp(-rate * t)).otherwise(k * F.exp(-rate * t) - s)
    worth = F.greatest(still, F.lit(0.0))
    reason = (
        F.when(F.col("bars").isNull() | price.isNull(), "no bars")
        .when(k.isNull(), "unknown contract")
        .when(s.isNull(), "no underlying")
        .when(t <= 0, "expired")
        .when(price < worth, "below intrinsic")
        .when(price - worth < least_time_value * s, "little time value")
    )
    d = d.withColumn("reason", reason)
    iv = F.when(F.col("reason").isNull(), implied(price, s, k, t, F.lit(rate), F.lit(0.0), F.col("call")))
    d = d.withColumn("iv", iv)
    return d.withColumn("reason", F.when(F.col("iv").isNull(), F.coalesce("reason", F.lit("beyond bounds"))))


def daily_series(bars: DataFrame, contracts: DataFrame, underlying: DataFrame, rate: float = 0.05, least_time_value: float = 0.01) -> DataFrame:
    """root, day, contracts, iv: the mean volatility of a root's contracts at their closes of every day."""
    w = Window.partitionBy("contract", "day").orderBy(F.col("ts").desc())
    closes = bars.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    d = closes.join(contracts, "contract").join(underlying.withColumnRenamed("close", "underlying"), ["root", "day"])
    s, k, price, t = F.col("underlying"), F.col("strike"), F.col("close"), F.datediff("expiration", "day") / 365.0
    worth = F.greatest(F.when(F.col("call"), s - k * F.exp(-rate * t)).otherwise(k * F.exp(-rate * t) - s), F.lit(0.0))
    d = d.where((t > 0) & (price - worth >= least_time_value * s))
    d = d.withColumn("iv", implied(price, s, k, t, F.lit(rate), F.lit(0.0), F.col("call"))).where("iv is not null")
    return d.groupBy("root", "day").agg(F.count("*").alias("contracts"), F.avg("iv").alias("iv"))
