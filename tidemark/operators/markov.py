"""Order-two Markov patterns of daily moves, with back-off."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BAND = 0.003


def states(bars: DataFrame, band: float = BAND) -> DataFrame:
    """U, D or F by the close's relative move, and the pattern of the two before."""
    w = Window.partitionBy("symbol").orderBy("i")
    r = F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1
    d = bars.select("symbol", "i", r.alias("ret"))
    d = d.withColumn("state", F.when(F.col("ret") > band, "U").when(F.col("ret") < -band, "D").when(F.col("ret").isNotNull(), "F"))
    return d.withColumn("pattern", F.concat(F.lag("state", 2).over(w), F.lag("state").over(w)))


def transitions(s: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pattern, state -> n and its share p of the pattern."""
    t = s.where("pattern is not null and state is not null").groupBy(*keys, "pattern", "state").agg(F.count("*").alias("n"))
    return t.withColumn("total", F.sum("n").over(Window.partitionBy(*keys, "pattern"))).withColumn("p", F.col("n") / F.col("total"))


def known_before(s: DataFrame, block: str) -> DataFrame:
    """symbol, block, pattern, state -> n, total and p over all blocks of the symbol before the block.

    Counts by block are few; each (pattern, state) that was seen is carried over all later blocks.
    """
    t = s.where("pattern is not null and state is not null").groupBy("symbol", "pattern", "state", block).agg(F.count("*").alias("own"))
    ends = s.groupBy("symbol").agg(F.max(block).alias("__last"))
    seen = t.groupBy("symbol", "pattern", "state").agg(F.min(block).alias("__first")).join(ends, "symbol")
    grid = seen.select("symbol", "pattern", "state", F.explode(F.sequence("__first", "__last")).alias(block))
    before = Window.partitionBy("symbol", "pattern", "state").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    d = grid.join(t, ["symbol", "pattern", "state", block], "left").withColumn("n", F.sum("own").over(before)).where("n > 0")
    d = d.withColumn("total", F.sum("n").over(Window.partitionBy("symbol", "pattern", block))).withColumn("p", F.col("n") / F.col("total"))
    return d.drop("own")


def confidence(t: DataFrame, keys: list[str]) -> DataFrame:
    """Per pattern: best next state, n and 0.5 min(1, n/30) + 0.3 (1 - H/log2 3) + 0.2 (pmax - 0.33)/0.67."""
    h = -F.sum(F.col("p") * F.log2("p"))
    a = t.groupBy(*keys, "pattern").agg(F.max("total").alias("n"), h.alias("h"), F.max("p").alias("pmax"), F.max(F.struct("p", "state"))["state"].alias("next"))
    c = 0.5 * F.least(F.lit(1.0), F.col("n") / 30) + 0.3 * (1 - F.col("h") / F.log2(F.lit(3.0))) + 0.2 * (F.col("pmax") - 0.33) / 0.67
    return a.withColumn("confidence", c)


def predict(s: DataFrame, by_key: DataFrame, of_all: DataFrame, least: int = 15) -> DataFrame:
    """The symbol's pattern if seen `least` times, else that of all symbols, else F."""
    k = by_key.where(F.col("n") >= least).select("symbol", "pattern", F.col("next").alias("own"))
    a = of_all.select("pattern", F.col("next").alias("common"))
    d = s.where("pattern is not null").join(k, ["symbol", "pattern"], "left").join(a, "pattern", "left")
    return d.select("symbol", "i", "pattern", F.coalesce("own", "common", F.lit("F")).alias("predicted"))


def top(c: DataFrame, keys: list[str], least: int = 15, count: int = 20) -> DataFrame:
    """The `count` surest patterns of each key among those seen `least` times, with their place from 1."""
    w = Window.partitionBy(*keys).orderBy(F.round("confidence", 9).desc(), F.col("n").desc(), "pattern")
    return c.where(F.col("n") >= least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= count)
