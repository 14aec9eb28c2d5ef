"""From indicator values to trades, and trades to balances, without a loop over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ordered():
    return Window.partitionBy("symbol").orderBy("i")


def switches(values: DataFrame, value: str, polarity: int = 1) -> DataFrame:
    """delta: the sign of the value's change times polarity, where it is not 0 and differs from
    the last that was not 0; else 0."""
    w = _ordered()
    d = values.withColumn("__d", F.signum(F.col(value) - F.lag(value).over(w)) * polarity)
    d = d.withColumn("__nz", F.when(F.col("__d") != 0, F.col("__d")))
    last = F.last("__nz", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    delta = F.when(F.col("__nz").isNotNull() & ~F.col("__nz").eqNullSafe(last), F.col("__nz")).otherwise(0.0)
    return d.withColumn("delta", delta).drop("__d", "__nz")


def combine(signals, how: str, weights: list[float] | None = None):
    """An array column of -1, 0, 1: their sum, majority, consensus or weighted sum (half away from 0)."""
    total = F.aggregate(signals, F.lit(0.0), lambda a, x: a + x)
    if how == "sum":
        return total
    if how == "majority":
        return F.signum(total)
    if how == "consensus":
        first = F.get(signals, F.lit(0))
        return F.when(F.forall(signals, lambda x: x == first), first).otherwise(0.0)
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.round(F.aggregate(F.zip_with(signals, w, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x), 0)


def trades(d: DataFrame, price: str = "close") -> DataFrame:
    """Switches to round trips: a delta opens a position on its side, the next one closes it;
    the last bar closes what is open. symbol, open_i, close_i, side, open_price, close_price."""
    last = F.max(F.struct("i", price)).over(Window.partitionBy("symbol"))
    x = d.withColumn("__end", last).where("delta <> 0")
    nxt = F.lead(F.struct(F.col("i"), F.col(price))).over(_ordered())
    x = x.withColumn("__exit", F.coalesce(nxt, F.col("__end")))
    return x.select(
        "symbol",
        F.col("i").alias("open_i"),
        F.col("__exit.i").alias("close_i"),
        F.col("delta").cast("int").alias("side"),
        F.col(price).alias("open_price"),
        F.col(f"__exit.{price}").alias("close_price"),
    ).where("close_i > open_i")


def balances(t: DataFrame, start: float = 100_000.0) -> DataFrame:
    """Each trade's gain in percent and the compounded balance after it."""
    gain = F.when(F.col("open_price") != 0, (F.col("close_price") / F.col("open_price") - 1) * F.col("side")).otherwise(0.0)
    w = Window.partitionBy("symbol").orderBy("open_i").rowsBetween(Window.unboundedPreceding, 0)
    d = t.withColumn("gain", gain * 100)
    flat = F.max(F.when(F.col("gain") <= -100, 1).otherwise(0)).over(w)
    grown = F.exp(F.sum(F.ln(1 + F.greatest(F.col("gain"), F.lit(-99.999999)) / 100)).over(w))
    return d.withColumn("balance", F.when(flat == 1, 0.0).otherwise(grown * start))


def walk_forward(n: int, train: int, test: int, step: int) -> list[tuple[int, int, int]]:
    """(train_start, test_start, test_end) of each window; none if n is too short."""
    return [(s, s + train, s + train + test) for s in range(0, n - train - test + 1, step)]


def in_windows(rows: DataFrame, windows: list[tuple[int, int, int]], index: str = "i") -> DataFrame:
    """rows, once for each window and part (train, test) that holds them; the window list is small."""
    w = F.array(*[F.struct(F.lit(k).alias("window"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for k, (a, b, c) in enumerate(windows)])
    d = rows.withColumn("__w", F.explode(F.filter(w, lambda x: (F.col(index) >= x["a"]) & (F.col(index) < x["c"]))))
    part = F.when(F.col(index) < F.col("__w.b"), "train").otherwise("test")
    return d.withColumn("window", F.col("__w.window")).withColumn("part", part).drop("__w")


def in_all_windows(rows: DataFrame, train: int, test: int, step: int, index: str = "i") -> DataFrame:
    """rows, once for each walk-forward window and part that holds them: the windows of `walk_forward`
    for each symbol's own number of rows. A row's windows follow from its index; none are joined."""
    i, n = F.col(index), F.count("*").over(Window.partitionBy("symbol"))
    d = rows.withColumn("__n", n)
    first = F.greatest(F.lit(0), F.floor((i - (train + test)) / step).cast("int") + 1)
    final = F.least(F.floor(i / step), F.floor((F.col("__n") - train - test) / step)).cast("int")
    d = d.withColumn("window", F.explode(F.when(final >= first, F.sequence(first, final))))
    part = F.when(i < F.col("window") * step + train, "train").otherwise("test")
    return d.withColumn("part", part).drop("__n")


def expanding_folds(n: int, folds: int = 5, purge: int = 0) -> list[tuple[int, int, int, int]]:
    """(train_start, train_end, test_start, test_end): train grows, tests half a fold; purge rows go between."""
    size = n // (folds + 1)
    return [(0, size * (k + 1), size * (k + 1) + purge, min(n, size * (k + 1) + purge + size // 2)) for k in range(folds)]


def position_size(method: str, capital, price, volatility, win_rate=None, win_loss=None, drawdown=None, momentum=None):
    """The share count of one of seven sizing rules, as a column."""
    risk = {
        "fixed": F.lit(0.1),
        "kelly": F.greatest(F.lit(0.0), F.least(F.lit(0.25), (win_rate - (1 - win_rate) / win_loss) / 2)) if win_rate is not None else F.lit(0.1),
        "volatility": F.least(F.lit(0.25), 0.02 / F.greatest(volatility, F.lit(0.005))),
        "atr": F.least(F.lit(0.25), 0.01 * price / F.greatest(2.5 * volatility * price, F.lit(1e-9))),
        "drawdown": F.lit(0.1) * F.greatest(F.lit(0.25), 1 - 2 * drawdown) if drawdown is not None else F.lit(0.1),
        "momentum": F.lit(0.1) * F.greatest(F.lit(0.5), F.least(F.lit(1.5), 1 + momentum)) if momentum is not None else F.lit(0.1),
        "regime": F.lit(0.1) * F.when(volatility > 0.03, 0.7).when(volatility < 0.01, 1.3).otherwise(1.0),
    }[method]
    return F.floor(capital * risk / price)


def discrepancy(trades: DataFrame, start: float = 100_000.0, decimals: int = 2, near: float = 0.01, alarm: float = 1000.0) -> DataFrame:
    """Per symbol: trades, how many leave start and the gains booked so far (rounded to `decimals`) off
    the balance by more than `near`, the last balance less start and all gains, and whether that is over `alarm`."""
    w = Window.partitionBy("symbol").orderBy("open_i")
    d = balances(trades, start)
    d = d.withColumn("dollars", F.round(F.col("balance") - F.coalesce(F.lag("balance").over(w), F.lit(start)), decimals))
    d = d.withColumn("progress", F.lit(start) + F.sum("dollars").over(w))
    last = F.max_by("balance", "open_i") - start - F.sum("dollars")
    return d.groupBy("symbol").agg(F.count("*").alias("trades"), F.count_if(F.abs(F.col("progress") - F.col("balance")) > near).alias("off"), last.alias("discrepancy"), (F.abs(last) > alarm).alias("alarm"))


def parameter_folds(bars: DataFrame, pairs: list[tuple[int, int]], fold: int) -> DataFrame:
    """fast, slow, fold, bars, turns, mean, sd: the sign of fast less slow mean close held for a bar, for every
    pair of lengths on every fold of so many bars of every symbol.

    Running sums make any mean two lags apart, so all pairs share one sort; the pair is part of every later
    key, so one symbol's work is spread. The list of pairs is part of the program. A pair holds
    nothing before its longer length is there.
    """
    w = Window.partitionBy("symbol").orderBy("i")
    n = sorted({x for p in pairs for x in p})
    upto = F.sum("close").over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = bars.select("symbol", "i", "close", F.lead("close").over(w).alias("next"), upto.alias("upto"))
    past = lambda x: F.coalesce(F.lag("upto", x).over(w), F.lit(0.0))
    b = b.withColumn("means", F.create_map(*[v for x in n for v in (F.lit(x), (F.col("upto") - past(x)) / x)]))
    g = F.array(*[F.struct(F.lit(a).alias("fast"), F.lit(c).alias("slow")) for a, c in pairs])
    d = b.withColumn("g", F.explode(g)).select("symbol", "i", "close", "next", "means", "g.*")
    ready = F.col("i") >= F.greatest("fast", "slow") - 1
    gap = F.element_at("means", F.col("fast")) - F.element_at("means", F.col("slow"))
    d = d.withColumn("side", F.when(ready & (F.abs(gap) > 1e-9), F.signum(gap)).otherwise(0.0)).drop("means")
    before = F.coalesce(F.lag("side").over(Window.partitionBy("fast", "slow", "symbol").orderBy("i")), F.lit(0.0))
    d = d.withColumns({"turn": (F.col("side") != before).cast("int"), "ret": (F.col("next") / F.nullif(F.col("close"), F.lit(0.0)) - 1) * F.col("side"), "fold": F.floor(F.col("i") / fold)})
    return d.groupBy("fast", "slow", "fold").agg(F.count("*").alias("bars"), F.sum("turn").alias("turns"), F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("sd"))


#: Lengths of training in bars, tests as percent of them, and parts of a test that a step takes.
TRAIN, RATIO, PART = (252, 378, 504, 630, 756, 1008), (10, 15, 20, 25, 33), (1, 2, 3, 4, 5)


def configured_windows(lengths: DataFrame) -> DataFrame:
    """symbol, n (bars) -> symbol, train, test, step, start: the walk-forward windows that fit, of every different
    triple that the generator's lengths give. A row of lengths grows by the triples (150 at most), then by their windows."""
    triples = sorted({(t, t * r // 100, max(1, t * r // 100 // p)) for t in TRAIN for r in RATIO for p in PART})
    c = F.explode(F.array(*[F.struct(F.lit(a).alias("train"), F.lit(b).alias("test"), F.lit(s).alias("step")) for a, b, s in triples]))
    d = lengths.select("symbol", "n", c.alias("c")).select("symbol", "n", "c.*").where("n >= train + test")
    return d.select("symbol", "train", "test", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - F.col("train") - F.col("test"), F.col("step").cast("long"))).alias("start"))
