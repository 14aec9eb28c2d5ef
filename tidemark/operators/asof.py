"""Joins in time: the last or next row before or after, horizons, ranges, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Seconds of a time slice: rows of one key are sorted by slices, not all in one task.
SLICE = 86_400


def _seconds(ts: str):
    return F.col(ts).cast("timestamp").cast("long")


def _carried(d: DataFrame, by: str, ts: str, seconds: int, later: bool) -> DataFrame:
    """d (__side 0: rows that carry __v) with __got: struct (t, v) of the last carrying row at or before each
    row's time, or of the next at or after it.

    Every (by, slice of time) is sorted alone; the last (first) carrying row of each slice, one small
    row, is handed on over the slices that have none.
    """
    d = d.withColumn("__slice", F.floor(_seconds(ts) / F.lit(seconds)))
    own = F.when(F.col("__side") == 0, F.struct(F.col(ts).alias("t"), F.col("__v").alias("v")))
    order = [F.col(ts).desc(), F.col("__side"), F.col("__v").desc()] if later else [F.col(ts), F.col("__side"), F.col("__v")]
    inside = Window.partitionBy(by, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = d.groupBy(by, "__slice").agg((F.min(own) if later else F.max(own)).alias("__edge"))
    along = Window.partitionBy(by).orderBy(F.col("__slice").desc() if later else F.col("__slice")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(by).alias("__by"), F.col("__slice").alias("__s"), F.last("__edge", ignorenulls=True).over(along).alias("__before"))
    d = d.withColumn("__in", F.last(own, ignorenulls=True).over(inside))
    d = d.join(ends, F.col(by).eqNullSafe(F.col("__by")) & F.col("__slice").eqNullSafe(F.col("__s")))
    return d.withColumn("__got", F.coalesce("__in", "__before")).where("__side = 1")


def _both(left: DataFrame, right: DataFrame, by: str, ts: str, value: str) -> DataFrame:
    empty = {c: F.lit(None).cast(left.schema[c].dataType) for c in left.columns if c not in (by, ts)}
    l = left.withColumns({"__v": F.lit(None).cast(right.schema[value].dataType), "__side": F.lit(1)})
    return l.unionByName(right.select(F.col(by), F.col(ts), F.col(value).alias("__v"), F.lit(0).alias("__side")).withColumns(empty))


def backward(left: DataFrame, right: DataFrame, by: str, ts: str, value: str, within_seconds: int | None = None, slice_seconds: int = SLICE) -> DataFrame:
    """left with the `value` of right's last row at or before its time, null if older than allowed.

    A union, a sort by slices of time and one row a slice handed on: no pair of rows is formed and a
    key with any share of the rows is spread over its slices. Of rows of one time the largest value counts.
    """
    d = _carried(_both(left, right, by, ts, value), by, ts, slice_seconds, False)
    v = F.col("__got.v")
    if within_seconds is not None:
        v = F.when(_seconds(ts) - F.col("__got.t").cast("timestamp").cast("long") <= within_seconds, v)
    return d.select(*left.columns, v.alias(value))


def forward(left: DataFrame, right: DataFrame, by: str, ts: str, value: str, slice_seconds: int = SLICE) -> DataFrame:
    """left with the `value` of right's first row at or after its time; of rows of one time the smallest."""
    d = _carried(_both(left, right, by, ts, value), by, ts, slice_seconds, True)
    return d.select(*left.columns, F.col("__got.v").alias(value))


def horizon_returns(signals: DataFrame, prices: DataFrame, days=(1, 7, 14, 30, 45, 60, 90)) -> DataFrame:
    """signals (id, symbol, day) and daily prices (symbol, day, close): entry is the first close
    after the signal's day, each exit the first at or after the day plus a horizon. One row per
    signal and horizon: id, symbol, day, horizon, entry, exit, ret."""
    h = signals.select("id", "symbol", "day", F.explode(F.array(F.lit(0), *[F.lit(d) for d in days])).alias("horizon"))
    h = h.withColumnRenamed("day", "signal_day").withColumn("day", F.expr("date_add(signal_day, greatest(horizon, 1))"))
    got = forward(h, prices.select("symbol", "day", F.col("close").alias("price")), "symbol", "day", "price", 64 * SLICE)
    entry = F.max(F.when(F.col("horizon") == 0, F.col("price"))).over(Window.partitionBy("id"))
    d = got.withColumn("entry", entry).where("horizon > 0")
    ret = F.when(F.col("entry") != 0, F.col("price") / F.col("entry") - 1)
    return d.select("id", "symbol", F.col("signal_day").alias("day"), "horizon", "entry", F.col("price").alias("exit"), ret.alias("ret"))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 0.01) -> DataFrame:
    """Full outer comparison: keys, status (equal, differs, only_a, only_b)."""
    l = a.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("__a"))
    r = b.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("__b"))
    near = F.lit(True)
    for v in values:
        near = near & (F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")) <= tolerance)
    status = F.when(F.col("__b").isNull(), "only_a").when(F.col("__a").isNull(), "only_b").when(near, "equal").otherwise("differs")
    return l.join(r, keys, "full").select(*keys, status.alias("status"))


#: Cells beyond this many from zero are one, so that their numbers fit a long.
CELLS = 2.0**62


def nearest_in_range(left: DataFrame, right: DataFrame, key: str, at: str, x: str, reach: float) -> DataFrame:
    """For each different left row (key, at) the right row (key, x) of smallest |x - at| <= reach.

    Of rows equally near the smaller x counts, then the smallest by the other columns in their order. Columns
    are doubles or decimals; rows without key or place, or whose place is no number, meet nothing.

    A union and two sorts by cells of twice the reach: the right's values, one row each, go to their own cell and
    its neighbours, and each left row is handed the last at or before it and the next at or after; no pair of rows
    is formed. A right value brings along those below it so close (reach * 2**-51) that subtraction may round both
    to one distance. One key's rows of one cell are sorted in one task.
    """
    cell = lambda c: F.floor(F.greatest(F.least(F.col(c) / (2 * reach), F.lit(CELLS)), F.lit(-CELLS)))
    usable = lambda c: F.col(key).isNotNull() & F.col(c).isNotNull() & ~F.isnan(c)
    match = F.struct(*[c for c in right.columns if c != key])
    r = right.where(usable(x)).groupBy(key, x).agg(F.min(match).alias("__match"))
    r = r.select(key, F.col(x).alias("__at"), F.explode(F.array(cell(x) - 1, cell(x), cell(x) + 1)).alias("__cell"), "__match")
    close = f"PARTITION BY `{key}`, __cell ORDER BY double(__at) RANGE BETWEEN {reach * 2.0**-51!r}D PRECEDING AND CURRENT ROW"
    r = r.select(key, "__at", "__cell", F.expr(f"collect_list(__match) OVER ({close})").alias("__near"))
    l = left.where(usable(at)).distinct().withColumns({"__at": F.col(at), "__cell": cell(at)})
    d = l.unionByName(r, allowMissingColumns=True)
    inside = Window.partitionBy(key, "__cell").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last("__near", ignorenulls=True)
    asks = F.col("__near").isNull()  # of one place, the right's row comes first
    d = d.withColumns({"__below": held.over(inside.orderBy("__at", asks)), "__above": held.over(inside.orderBy(F.desc("__at"), asks))}).where(asks)
    near = F.flatten(F.array_compact(F.array("__below", "__above")))
    best = F.array_min(F.transform(near, lambda m: F.struct(F.abs(m[x] - F.col(at)).alias("far"), m[x], m.alias("match"))))
    return d.withColumn("__best", best).where(F.col("__best.far") <= reach).select(*left.columns, "__best.match.*")
