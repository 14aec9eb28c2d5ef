"""Recurrences over ordered rows: y = a * y_before + b, in blocks that run side by side."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, and levels of blocks of blocks before what is left of a key is folded at once:
#: a key of a hundred million rows is a million blocks, then 24,000 states in one fold.
BLOCK, LEVELS = 64, 2


def affine_scan(df: DataFrame, a: str, b: str, out: str, key: str = "symbol", index: str = "i", block: int = BLOCK, levels: int = LEVELS) -> DataFrame:
    """df with column `out`: y_0 = b_0 and y_i = a_i * y_(i-1) + b_i along index within key.

    a, b: SQL expressions. Every exponential, smoothed or adaptive average is such a recurrence.
    Affine maps compose, so each block is folded from zero with the product of its a's, in the
    JVM; the blocks' ends are a recurrence again, `levels` times, and y = local + product *
    carried. So one key of a third of all rows is spread. index counts from 0 without gaps
    within key.
    """
    first = F.col(index) == 0
    d = df.select(
        F.col(key).alias("__key"),
        F.floor(F.col(index) / (block if levels else 1 << 62)).alias("__block"),
        F.struct(
            F.col(index).alias("at"),
            F.when(first, 0.0).otherwise(F.expr(f"cast({a} as double)")).alias("a"),
            F.expr(f"cast({b} as double)").alias("b"),
            F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        ).alias("__r"),
    )
    g = d.groupBy("__key", "__block").agg(F.sort_array(F.collect_list("__r")).alias("__rows"))
    start = F.struct(F.lit(None).cast("array<struct<y:double,p:double>>").alias("done"), F.lit(0.0).alias("y"), F.lit(1.0).alias("p"))

    def step(s, r):
        y, p = r["a"] * s["y"] + r["b"], r["a"] * s["p"]
        here = F.array(F.struct(y.alias("y"), p.alias("p")))
        return F.struct(F.when(s["done"].isNull(), here).otherwise(F.concat(s["done"], here)).alias("done"), y.alias("y"), p.alias("p"))

    g = g.select("__key", "__block", "__rows", F.aggregate("__rows", start, step).alias("__s"))
    total = F.col("x.s.y")
    if levels:
        ends = g.select("__key", F.col("__block").alias("__n"), F.col("__s.y").alias("__y"), F.col("__s.p").alias("__p"))
        ends = affine_scan(ends, "__p", "__y", "__end", "__key", "__n", block, levels - 1)
        ends = ends.select("__key", (F.col("__n") + 1).alias("__block"), "__end")
        g = g.join(ends, ["__key", "__block"], "left").withColumn("__end", F.coalesce("__end", F.lit(0.0)))
        total = total + F.col("x.s.p") * F.col("__end")
    pairs = F.arrays_zip(F.col("__rows").alias("r"), F.col("__s.done").alias("s"))
    rows = g.select(*(["__end"] if levels else []), F.explode(pairs).alias("x"))
    return rows.select("x.r.row.*", total.alias(out))


def grouped(df: DataFrame, run, schema: str, key: str = "symbol", index: str = "i") -> DataFrame:
    """For state machines that do not compose: run(pdf sorted by index) -> pdf, once a key."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        return run(pdf.sort_values(index, kind="stable").reset_index(drop=True))

    return df.groupBy(key).applyInPandas(each, schema)
