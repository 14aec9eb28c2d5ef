"""Trade scoring: all metrics in one aggregation, drawdown by a running peak."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as D

INF = float("inf")


def _ratio(a, b, otherwise):
    return F.when(b == 0, otherwise).otherwise(a / F.nullif(b, F.lit(0.0)))


def metrics(trades: DataFrame, key: str, gain: str = "gain", rf: float = 0.0) -> DataFrame:
    """trades (key, gain in percent) -> per key trades, sharpe, sortino, win_rate, win_loss, profit_factor.

    Deviations are of the population; the downside one is over losing trades only. A ratio over
    nothing is infinite where the numerator is positive, else 0.
    """
    g = F.col(gain) / 100
    mean, sd = F.avg(g), F.stddev_pop(g)
    down = F.sqrt(F.avg(F.when(g < 0, g * g)))
    won, lost = F.sum(F.when(g > 0, g).otherwise(0.0)), -F.sum(F.when(g < 0, g).otherwise(0.0))
    n_won, n_lost = F.count_if(g > 0), F.count_if(g < 0)
    edge = lambda x: F.when(x > 0, INF).otherwise(0.0)
    a = trades.groupBy(key).agg(
        F.count("*").alias("trades"), mean.alias("m"), sd.alias("sd"), F.coalesce(down, F.lit(0.0)).alias("dn"), won.alias("won"), lost.alias("lost"), n_won.alias("nw"), n_lost.alias("nl")
    )
    excess = F.col("m") - rf / F.col("trades")
    avg_win, avg_loss = _ratio(F.col("won"), F.col("nw").cast("double"), 0.0), _ratio(F.col("lost"), F.col("nl").cast("double"), 0.0)
    return a.select(
        key,
        "trades",
        _ratio(excess, F.col("sd"), edge(excess)).alias("sharpe"),
        _ratio(excess, F.col("dn"), edge(excess)).alias("sortino"),
        (F.col("nw") / F.col("trades")).alias("win_rate"),
        _ratio(avg_win, avg_loss, edge(avg_win)).alias("win_loss"),
        _ratio(F.col("won"), F.col("lost"), edge(F.col("won"))).alias("profit_factor"),
    )


def all_metrics(trades: DataFrame, key: str, gain: str = "gain", order: str = "open_i", opened: str = "open_i", closed: str = "close_i", rf: float = 0.02, year: int = 252) -> DataFrame:
    """Every score of a key's trades in one aggregation over one running peak: trades, sharpe, sortino,
    max_drawdown (of the compounded equity, from its start), cagr (by bars), calmar, win_rate in percent.

    Gains in percent; those that are not finite count for nothing, a loss of all counts as nearly all.
    The risk-free rate is spread over the trades. A ratio over no deviation or drawdown is infinite
    where its numerator is positive (calmar: always), else 0.
    """
    g = F.col(gain) / 100
    finite = trades.where(F.col(gain).isNotNull() & ~F.isnan(gain) & (F.abs(F.col(gain).cast("double")) != INF))
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = finite.withColumn("__b", F.exp(F.sum(F.ln(1 + F.greatest(g, F.lit(-0.99999999)))).over(upto)))
    d = d.withColumn("__peak", F.greatest(F.lit(1.0), F.max("__b").over(upto)))
    a = d.groupBy(key).agg(
        F.count("*").alias("trades"),
        F.avg(g).alias("m"),
        F.stddev_pop(g).alias("sd"),
        F.coalesce(F.sqrt(F.avg(F.when(g < 0, g * g))), F.lit(0.0)).alias("dn"),
        F.max((F.col("__peak") - F.col("__b")) / F.col("__peak")).alias("max_drawdown"),
        F.max_by("__b", order).alias("end"),
        F.greatest(F.lit(1), F.max(closed) - F.min(opened)).alias("bars"),
        (100 * F.avg(F.when(g > 0, 1.0).otherwise(0.0))).alias("win_rate"),
    )
    excess = F.col("m") - rf / F.col("trades")
    edge = F.when(excess > 0, INF).otherwise(0.0)
    cagr = F.pow("end", F.lit(float(year)) / F.col("bars")) - 1
    return a.select(
        key,
        "trades",
        _ratio(excess, F.col("sd"), edge).alias("sharpe"),
        _ratio(excess, F.col("dn"), edge).alias("sortino"),
        "max_drawdown",
        cagr.alias("cagr"),
        _ratio(cagr, F.col("max_drawdown"), F.lit(INF)).alias("calmar"),
        "win_rate",
    )


def max_drawdown(equity: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The largest fall from a running peak, as a share of the peak."""
    peak = F.max(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    d = equity.withColumn("__peak", peak)
    return d.groupBy(key).agg(F.max((F.col("__peak") - F.col(value)) / F.nullif(F.col("__peak"), F.lit(0.0))).alias("max_drawdown"))


def growth(equity: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """First, last, years (365.25 days) and compound annual growth."""
    a = equity.groupBy(key).agg(F.min_by(value, day).alias("first"), F.max_by(value, day).alias("last"), F.date_diff(F.max(day), F.min(day)).alias("days"))
    years = F.greatest(F.col("days") / 365.25, F.lit(1 / 252))
    return a.withColumn("cagr", F.when(F.col("first") > 0, F.pow(F.col("last") / F.col("first"), 1 / years) - 1))


def dollar_columns(trades: DataFrame) -> DataFrame:
    """open_price, close_price, position (signed), is_option -> dollar_gain, percent_gain, actual_gain."""
    side = F.when(F.col("position") >= 0, 1).otherwise(-1)
    move = (F.col("close_price") - F.col("open_price")) * side
    return trades.withColumns(
        {
            "dollar_gain": move,
            "percent_gain": F.when(F.col("open_price") != 0, move / F.col("open_price") * 100).otherwise(0.0),
            "actual_gain": move * F.abs("position") * F.when(F.col("is_option"), 100).otherwise(1),
        }
    )


def student_t_tail(t, df):
    """Two-sided p of Student's t up to 200 degrees of freedom, the normal tail from there on."""
    from ..functions.scalars import normal_cdf

    return F.when(df >= 200, 2 * (1 - normal_cdf(F.abs(t)))).otherwise(2 * D.survival("student_t", F.abs(t), df))


def t_test(rows: DataFrame, key: str, x: str) -> DataFrame:
    """Mean against 0: n, mean, t, df and the two-sided p."""
    a = rows.groupBy(key).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    t = F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n")))
    d = a.select(key, "n", "mean", t.alias("t"), (F.col("n") - 1).alias("df"))
    return d.withColumn("p", student_t_tail(F.col("t"), F.col("df")))


def summary(trades: DataFrame, key: str) -> DataFrame:
    """What closed trades made, per key: trades, wins, losses, win_rate, mean, mean_percent, largest_win, largest_loss,
    holding (bars), bought and sold (dollars). trades: as `dollar_columns` leaves them, with open_i, close_i and side."""
    g, shares, long = F.col("actual_gain"), F.abs("position"), F.col("side") > 0
    at = lambda a, b: F.sum(F.when(long, F.col(a)).otherwise(F.col(b)) * shares)
    return trades.groupBy(key).agg(
        F.count("*").alias("trades"),
        F.count_if(g > 0).alias("wins"),
        F.count_if(g < 0).alias("losses"),
        F.round(F.avg(F.when(g > 0, 1.0).otherwise(0.0)), 6).alias("win_rate"),
        F.round(F.avg(g), 4).alias("mean"),
        F.round(F.avg("percent_gain"), 4).alias("mean_percent"),
        F.round(F.max(g), 4).alias("largest_win"),
        F.round(F.min(g), 4).alias("largest_loss"),
        F.round(F.avg(F.col("close_i") - F.col("open_i")), 6).alias("holding"),
        F.round(at("open_price", "close_price"), 2).alias("bought"),
        F.round(at("close_price", "open_price"), 2).alias("sold"),
    )
