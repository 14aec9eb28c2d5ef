"""Points counted over intervals without joining them: a difference of two prefix counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_in(points: DataFrame, intervals: DataFrame, key: str, at: str, opens: str, closes: str, weights: dict[str, Column], slice_: int) -> DataFrame:
    """intervals with, for every weight, its sum over the key's points in [opens, closes).

    at, opens and closes are whole numbers. Points and ends of intervals meet in slices of `slice_`
    of them, so a key of any share of the rows is spread; sums of slices are carried on, a row each. The sum up
    to an end is its slice's sum before it and what was carried; an interval is the difference of two. An interval of
    no length, or that ends before it begins, has 0; null ends give null; keys without points 0; repeated intervals a row each.
    """
    names = list(weights)
    i = intervals.withColumn("_id", F.monotonically_increasing_id())
    where = F.floor(F.col("_at") / slice_)
    p = points.where(F.col(at).isNotNull()).select(F.col(key).alias("_key"), F.col(at).cast("long").alias("_at"), F.lit(1).alias("_turn"), *[w.cast("double").alias(n) for n, w in weights.items()])
    ends = F.array(F.struct(F.col(opens).cast("long").alias("_at"), F.lit(-1).alias("_sign")), F.struct(F.greatest(opens, closes).cast("long").alias("_at"), F.lit(1).alias("_sign")))
    e = i.where(F.col(opens).isNotNull() & F.col(closes).isNotNull()).select(F.struct(*i.columns).alias("_row"), F.col(key).alias("_key"), F.explode(ends).alias("_e"))
    e = e.select("_row", "_key", "_e.*")
    both = p.withColumn("_slice", where).unionByName(e.withColumns({"_slice": where, "_turn": F.lit(0)}), allowMissingColumns=True)
    # what the slices before hold, one row a slice
    each = p.withColumn("_slice", where).unionByName(e.select("_key", where.alias("_slice")), allowMissingColumns=True)
    sums = each.groupBy("_key", "_slice").agg(*[F.sum(n).alias(n) for n in names])
    before = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    c = sums.withColumnsRenamed({"_key": "_k", "_slice": "_s"})
    c = c.select("_k", "_s", *[F.coalesce(F.sum(n).over(before), F.lit(0.0)).alias(f"_{n}") for n in names])
    # an end sees the points before it: at one time ends come first
    here = Window.partitionBy("_key", "_slice").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    upto = both.withColumns({n: F.coalesce(F.sum(n).over(here), F.lit(0.0)) for n in names}).where("_turn = 0")
    upto = upto.join(c, upto["_key"].eqNullSafe(c["_k"]) & (upto["_slice"] == c["_s"]))
    made = upto.groupBy("_row").agg(*[F.sum(F.col("_sign") * (F.col(n) + F.col(f"_{n}"))).alias(n) for n in names])
    none = i.where(F.col(opens).isNull() | F.col(closes).isNull()).select(*intervals.columns, *[F.lit(None).cast("double").alias(n) for n in names])
    return made.select(*[F.col(f"_row.{c}").alias(c) for c in intervals.columns], *names).unionByName(none)
