"""What the market was like at a bar: eleven features over bounded windows, ranks and streaks.

A symbol's bars are cut into blocks; each block borrows the bars before it that its windows reach back to, so
windows of one long symbol run in as many tasks as it has blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
#: Trading days of a year, by which a deviation is made annual.
DAYS = 252
#: Volatility above which a market is nervous, and trends that are none.
NERVOUS, FLAT = 0.20, 0.05


def overlapped(df: DataFrame, reach: int, block: int | None = None) -> DataFrame:
    """df (symbol, i, ...) with `block`, and `own`: false for rows lent to the block after theirs,
    of which there are as many as windows reach back."""
    block = max(block or BLOCK, reach)
    here = F.floor(F.col("i") / block).cast("long")
    lent = F.col("i") % block >= block - reach
    blocks = F.when(lent, F.array(here, here + 1)).otherwise(F.array(here))
    d = df.withColumn("block", F.explode(blocks))
    return d.withColumn("own", F.col("block") == F.floor(F.col("i") / block))


def counted_below(v: np.ndarray, far: int, near: int) -> tuple[np.ndarray, np.ndarray]:
    """For every place i: how many of v[i - far] ... v[i - near] are there, and how many lie below v[i].

    Runs of about the root of the window's length are sorted once; a run that lies whole inside a window
    is searched, and the few numbers at the window's ends are compared one by one. NaN is not there.
    """
    n, width = len(v), far - near + 1
    run = max(1, math.isqrt(width))
    i = np.arange(n)
    lo, hi = np.maximum(0, i - far), np.maximum(0, i - near + 1)
    below, there = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for a in range(0, n, run):
        b = min(n, a + run)
        own = np.sort(v[a:b][~np.isnan(v[a:b])])
        first, last = b + near - 1, min(n, a + far + 1)
        if first < last:
            below[first:last] += np.searchsorted(own, v[first:last])
            there[first:last] += len(own)
    inner = np.minimum(hi, -(-lo // run) * run)  # from here on runs are whole, up to `outer`
    outer = np.maximum(inner, hi // run * run)
    outer = np.where(outer > hi, hi, outer)
    whole_from = -(-inner // run) * run
    for start, end in ((lo, inner), (np.where(whole_from > outer, inner, outer), hi)):
        for k in range(run):
            at = start + k
            ok = at < end
            x = v[np.minimum(at, n - 1)]
            there += ok & ~np.isnan(x)
            below += ok & (x < v)
    return below, there


def rolling_rank(df: DataFrame, x: str, far: int, near: int, out: str) -> DataFrame:
    """df (symbol, i, ...) with the share of x at the bars i - far ... i - near that lies below x now; null if none is there.

    Null x is not counted and gets no rank.
    """
    d = overlapped(df.select("symbol", "i", F.col(x).cast("double").alias("x")), far)

    def ranks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        first = int(pdf["i"].iloc[0])
        v = np.full(int(pdf["i"].iloc[-1]) - first + 1, np.nan)
        at = pdf["i"].to_numpy() - first
        v[at] = pdf["x"].to_numpy(float)
        below, there = counted_below(v, far, near)
        with np.errstate(all="ignore"):
            share = np.where((there > 0) & ~np.isnan(v), below / there, np.nan)[at]
        made = pd.DataFrame({"symbol": pdf["symbol"], "i": pdf["i"], out: pd.Series(share).astype(object).where(~np.isnan(share), None)})
        return made[pdf["own"]]

    kinds = dict(df.dtypes)
    made = d.groupBy("symbol", "block").applyInPandas(ranks, f"symbol {kinds['symbol']}, i {kinds['i']}, {out} double")
    return df.join(made, ["symbol", "i"])


def streaks(df: DataFrame, state: str, out: str) -> DataFrame:
    """df with the length of the run of equal states that a bar stands in, from the run's start to the bar.

    The last change of a block is found in it; blocks hand it on, one row each. df must have every i.
    """
    d = overlapped(df, 1)
    w = Window.partitionBy("symbol", "block").orderBy("i")
    change = F.when((F.col("i") == 0) | ~F.col(state).eqNullSafe(F.lag(state).over(w)), F.col("i"))
    d = d.withColumn("_change", F.when(F.col("own"), change)).where("own")
    ends = d.groupBy("symbol", "block").agg(F.max("_change").alias("_last"))
    before = Window.partitionBy("symbol").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("symbol", "block", F.max("_last").over(before).alias("_carried"))
    d = d.join(ends, ["symbol", "block"])
    here = F.max("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn(out, (F.col("i") - F.coalesce(here, "_carried") + 1).cast("int")).drop("_change", "_carried", "own", "block")


def features(bars: DataFrame) -> DataFrame:
    """symbol, i and the context of every bar: null where too few bars lie before.

    bars: symbol, i (from 0, without gaps), open, high, low, close, volume. volatility: annual deviation of
    the last 20 moves; volatility_rank: share of those of 99 to 20 bars before that were lower (from bar 100);
    trend: mean close of the 25 bars before now over that of the 25 before them; short_trend: 5-bar over 20-bar
    mean; relative_volume: over the mean of the 20 bars before; momentum: gains and losses of 14 moves as
    0 to 100; gap and intraday: moves in percent from the close before and from the open; streak: bars of one direction,
    10 at most, negative if not up; atr: mean true range of 14; drawdown: of 10 bars, in percent, from the
    first highest high to the lowest low since.
    """
    b = bars.select("symbol", "i", "open", "high", "low", "close", "volume")
    d = overlapped(b, 64)
    o = Window.partitionBy("symbol", "block").orderBy("i")
    last = F.lag("close").over(o)
    d = d.withColumns({"prev": last, "move": F.col("close") / last - 1})
    over = lambda f, a, z: f.over(o.rowsBetween(a, z))
    since = lambda n, x: F.when(F.col("i") >= n, x)
    step = F.col("close") - F.col("prev")
    gains, losses = over(F.sum(F.greatest(step, F.lit(0.0))), -13, 0), over(F.sum(F.greatest(-step, F.lit(0.0))), -13, 0)
    rs = F.when(losses > 0, gains / losses).otherwise(100.0)
    old, new = over(F.avg("close"), -50, -26), over(F.avg("close"), -25, -1)
    mean5, mean20 = over(F.avg("close"), -4, 0), over(F.avg("close"), -19, 0)
    usual = over(F.avg("volume"), -20, -1)
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev")), F.abs(F.col("low") - F.col("prev")))
    highs, lows = over(F.collect_list("high"), -9, 0), over(F.collect_list("low"), -9, 0)
    d = d.withColumns({"_highs": highs, "_lows": lows})
    top = F.array_max("_highs")
    bottom = F.array_min(F.slice("_lows", F.array_position("_highs", top).cast("int"), F.lit(10)))
    d = d.select(
        "symbol",
        "i",
        "own",
        since(20, F.sqrt(over(F.var_pop("move"), -19, 0) * DAYS)).alias("volatility"),
        since(50, (new - old) / old).alias("trend"),
        since(50, (mean5 - mean20) / mean20).alias("short_trend"),
        since(20, F.when((F.col("volume") > 0) & (usual > 0), F.col("volume") / usual)).alias("relative_volume"),
        since(14, 100 - 100 / (1 + rs)).alias("momentum"),
        since(1, (F.col("open") - F.col("prev")) / F.col("prev") * 100).alias("gap"),
        ((F.col("close") - F.col("open")) / F.col("open") * 100).alias("intraday"),
        since(14, over(F.avg(true_range), -13, 0)).alias("atr"),
        since(10, (bottom - top) / top * 100).alias("drawdown"),
        (F.col("close") > F.col("prev")).alias("up"),
    ).where("own").drop("own")
    d = streaks(d, "up", "run")
    # a run of bars begins at bar 1: bar 0 has no direction
    run = F.least(F.col("run"), F.lit(10))
    d = d.withColumn("streak", since(5, F.when(F.col("up"), run).otherwise(-run))).drop("run", "up")
    d = rolling_rank(d, "volatility", 99, 20, "rank_")
    return d.withColumn("volatility_rank", since(100, F.col("rank_"))).drop("rank_")


def regime(d: DataFrame, nervous: float = NERVOUS, flat: float = FLAT) -> DataFrame:
    """d (volatility, trend) with `regime`; unknown features count as 0."""
    t = F.coalesce("trend", F.lit(0.0))
    r = F.when(F.col("volatility") > nervous, "HighVol").when(t > flat, "Uptrend").when(t < -flat, "Downtrend").otherwise("Sideways")
    return d.withColumn("regime", r)
