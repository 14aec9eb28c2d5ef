"""Levels of the day before and patterns of candles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Formulas of the levels from the last day's open (o), high (h), low (l), close (c).
_DEMARK = "(CASE WHEN c < o THEN h + 2 * l + c WHEN c > o THEN 2 * h + l + c ELSE h + l + 2 * c END)"
LEVELS = {
    "pivot_camarilla": {
        **{f"{s}{k}": f"c {'+' if s == 'r' else '-'} (h - l) * 1.1 / {d}" for s in "rs" for k, d in ((1, 12), (2, 6), (3, 4), (4, 2))},
        "r5": "h / l * c",
        "s5": "c - (h / l * c - c)",
    },
    "pivot_classic": {
        "pp": "(h + l + c) / 3",
        "r1": "2 * ((h + l + c) / 3) - l",
        "s1": "2 * ((h + l + c) / 3) - h",
        "r2": "(h + l + c) / 3 + (h - l)",
        "s2": "(h + l + c) / 3 - (h - l)",
    },
    "pivot_fibonacci": {"pp": "(h + l + c) / 3", **{f"{s}{k}": f"(h + l + c) / 3 {o} {f} * (h - l)" for s, o in (("r", "+"), ("s", "-")) for k, f in ((1, 0.382), (2, 0.618), (3, 1.0), (4, 1.618))}},
    "pivot_woodie": {
        "pp": "(h + l + 2 * c) / 4",
        "r1": "(h + l + 2 * c) / 2 - l",
        "s1": "(h + l + 2 * c) / 2 - h",
        "r2": "(h + l + 2 * c) / 4 + (h - l)",
        "s2": "(h + l + 2 * c) / 4 - (h - l)",
        "r3": "(h + l + 2 * c) / 2 - l + (h - l)",
        "s3": "(h + l + 2 * c) / 2 - h - (h - l)",
        "r4": "(h + l + 2 * c) / 2 - l + 2 * (h - l)",
        "s4": "(h + l + 2 * c) / 2 - h - 2 * (h - l)",
    },
    "pivot_demark": {"pp": f"{_DEMARK} / 4", "r1": f"{_DEMARK} / 2 - l", "s1": f"{_DEMARK} / 2 - h"},
}
#: Levels half way between two others.
BETWEEN = {"pivot_classic": {"m1": ("s1", "s2"), "m2": ("s1", "pp"), "m3": ("r1", "pp"), "m4": ("r1", "r2")}}


def outputs(name: str) -> list[str]:
    return [*LEVELS[name], *BETWEEN.get(name, {})]


def pivots(bars: DataFrame, name: str) -> DataFrame:
    """symbol, ts, i and the levels that hold on a bar's day, by the last day before it that has bars; 0 on the first.

    One small row a symbol and day is made and joined back, whatever the frame of the bars.
    """
    d = bars.withColumn("day", F.to_date("ts"))
    daily = d.groupBy("symbol", "day").agg(
        F.min_by("open", "ts").alias("o"), F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "ts").alias("c")
    )
    before = F.lag(F.struct("o", "h", "l", "c")).over(Window.partitionBy("symbol").orderBy("day"))
    daily = daily.select("symbol", "day", before.alias("p")).select("symbol", "day", "p.*")
    daily = daily.selectExpr("symbol", "day", *[f"coalesce({e}, 0.0) AS {k}" for k, e in LEVELS[name].items()])
    for k, (a, b) in BETWEEN.get(name, {}).items():
        daily = daily.withColumn(k, (F.col(a) + F.col(b)) / 2)
    return d.join(daily, ["symbol", "day"]).select("symbol", "ts", "i", *outputs(name))


# -- candles -------------------------------------------------------------------------------
# A pattern is said once, of a market that turns up; mirrored, it says that the market turns down. Bars are
# named by how long ago they closed: 0 the last. `body` is the mean body of twelve bars up to the last,
# `level1` the mean close of five bars up to the one before.

UP, DOWN = 1, -1


def above(x: str, y: str, way: int) -> str:
    """x lies beyond y in the way of the turn."""
    return f"({x}) > ({y})" if way == UP else f"({x}) < ({y})"


def long(k: int, way: int) -> str:
    """Bar k has a long body in that direction."""
    return f"{f'c{k} - o{k}' if way == UP else f'o{k} - c{k}'} > body"


def middle(k: int) -> str:
    return f"(h{k} + l{k}) / 2"


def heart(k: int) -> str:
    """The middle of a body."""
    return f"(o{k} + c{k}) / 2"


def after_a_move(x: str, k: int, way: int) -> str:
    """The market came from the other side: x lies there of the mean close k bars ago."""
    return above(f"level{k}", x, way)


def between(k: int, j: int, way: int) -> list[str]:
    """Bar k's body lies within that of bar j, which goes the other way."""
    return [above(f"o{j}", f"c{k}", way), above(f"o{k}", f"c{j}", way)]


def far(k: int, way: int) -> str:
    """The end of bar k that faces the move before: its low in a turn up."""
    return f"l{k}" if way == UP else f"h{k}"


def engulfing(w):
    return [above("o1", "c1", w), long(0, w), *between(1, 0, -w)[::-1], after_a_move(heart(1), 1, w)]


def harami(w):
    return [long(1, -w), above("c0", "o0", w), *between(0, 1, w), after_a_move(middle(1), 1, w)]


def two_sided_line(w):
    """Piercing line; mirrored, dark cloud cover, which asks for no long last bar."""
    return [long(1, -w), *([long(0, w)] if w == UP else []), above("c0", "c1", w), above("o1", "c0", w), after_a_move(heart(1), 1, w), above(far(1, w), "o0", w)]


def three_in_a_row(w):
    return [long(2, w), long(1, w), long(0, w), above(middle(1), middle(2), w), above(middle(0), middle(1), w)]


def meeting_lines(w):
    return [long(1, -w), long(0, w), "abs(c0 - c1) < 0.1 * body"]


def star(w):
    return [long(2, -w), "abs(c1 - o1) < 0.5 * body", above("c2", "c1", w), above("o2", "o1", w), above("c0", heart(2), w)]


def doji_star(w):
    return [long(2, -w), "abs(c1 - o1) < 0.1 * body", above("c2", "c1", w), above("o2", "o1", w), above("o0", "c1", w), above("c0", "c1", w)]


def hammer(w):
    """A small body at the top after a fall; mirrored, the hanging man after a rise, its body at the top, too."""
    gap = ["c0 < c1", "o0 < o1"] if w == UP else ["c0 > c1", "o0 > o1"]
    return [after_a_move(middle(0), 1, w), "least(o0, c0) > h0 - (h0 - l0) / 3.0", *gap]


PATTERNS = {
    "candle_bullish_engulfing": (engulfing, UP),
    "candle_bearish_engulfing": (engulfing, DOWN),
    "candle_bullish_harami": (harami, UP),
    "candle_bearish_harami": (harami, DOWN),
    "candle_piercing_line": (two_sided_line, UP),
    "candle_dark_cloud": (two_sided_line, DOWN),
    "candle_three_soldiers": (three_in_a_row, UP),
    "candle_three_crows": (three_in_a_row, DOWN),
    "candle_meeting_lines_bullish": (meeting_lines, UP),
    "candle_meeting_lines_bearish": (meeting_lines, DOWN),
    "candle_morning_star": (star, UP),
    "candle_evening_star": (star, DOWN),
    "candle_morning_doji": (doji_star, UP),
    "candle_evening_doji": (doji_star, DOWN),
    "candle_hammer": (hammer, UP),
    "candle_hanging_man": (hammer, DOWN),
}


def candles(bars: DataFrame, name: str) -> DataFrame:
    """symbol, ts, i, hit: 1 where the pattern ends with the bar; 0 on the first twelve."""
    pattern, way = PATTERNS[name]
    w = Window.partitionBy("symbol").orderBy("i")
    last = lambda c, k: F.lag(c, k).over(w) if k else F.col(c)
    d = bars.select("symbol", "ts", "i", *[last(c, k).alias(f"{c[0]}{k}") for c in ("open", "high", "low", "close") for k in range(3)])
    d = d.withColumn("body", F.avg(F.abs(F.col("c0") - F.col("o0"))).over(w.rowsBetween(-11, 0))).withColumn("level", F.avg("c0").over(w.rowsBetween(-4, 0)))
    d = d.withColumn("level1", last("level", 1))
    test = " AND ".join(f"({x})" for x in pattern(way))
    return d.selectExpr("symbol", "ts", "i", f"CASE WHEN i >= 12 AND {test} THEN 1 ELSE 0 END AS hit")
