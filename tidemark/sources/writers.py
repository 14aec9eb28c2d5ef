"""Sinks: bars as JSON lines or CSV, one folder a contract, and merged files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_name


def bars_json(bars: DataFrame, path: str) -> None:
    """Newest day first, times ascending within it; prices to two decimals, wap to three."""
    two = lambda c: F.bround(c, 2).alias(c.capitalize())
    d = bars.orderBy(F.to_date("ts").desc(), "ts").select(
        F.to_json(F.struct(F.date_format("ts", "yyyyMMdd HH:mm:ss 'America/New_York'").alias("Time"), *[two(c) for c in ("open", "high", "low", "close")], F.col("volume").alias("Volume"), F.bround("wap", 3).alias("WAP"))).alias("value")
    )
    d.write.mode("overwrite").text(path)


def by_contract(bars: DataFrame, path: str) -> None:
    """One folder a contract; rows meet by contract before they are written, so files stay few."""
    d = bars.withColumn("contract", safe_name(F.col("symbol")))
    d.repartition("contract").sortWithinPartitions("contract", "ts").write.mode("overwrite").partitionBy("contract").parquet(path)


def merged(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both, without exact repeats; the caller writes it beside the old and swaps."""
    return existing.unionByName(new).dropDuplicates(existing.columns).orderBy(*keys)


def daily_guide(bars: DataFrame, path: str) -> None:
    """Real bars only, prices with two decimals, as CSV with a header."""
    d = bars.where(~F.coalesce("manufactured", F.lit(False)))
    d.select(F.to_date("ts").alias("Date"), *[F.format_string("%.2f", c).alias(c.capitalize()) for c in ("open", "high", "low", "close")], "volume").orderBy("Date").write.mode("overwrite").csv(path, header=True)


def trades_csv(trades: DataFrame, path: str) -> None:
    """Trades as CSV with a header, a folder a symbol: prices and positions with four decimals, dollars with two.

    trades: symbol, open_i, close_i, side, open_price, close_price, position, dollar_gain, percent_gain,
    actual_gain, balance. A trade's index counts its symbol's trades from 1.
    """
    w = Window.partitionBy("symbol").orderBy("open_i")
    f = lambda c, n, name: F.format_string(f"%.{n}f", F.col(c).cast("double")).alias(name)
    d = trades.select(
        "symbol", F.row_number().over(w).alias("TradeIndex"), F.when(F.col("side") > 0, "Buy").otherwise("Sell").alias("TradeType"), F.col("open_i").alias("OpenIndex"), F.col("close_i").alias("CloseIndex"),
        f("open_price", 4, "OpenPrice"), f("close_price", 4, "ClosePrice"), f("position", 4, "Position"), f("dollar_gain", 4, "DollarGain"), f("percent_gain", 4, "PercentGain"), f("actual_gain", 2, "ActualDollarGain"), f("balance", 2, "Balance"),
    )
    d.repartition("symbol").sortWithinPartitions("symbol", "TradeIndex").write.mode("overwrite").partitionBy("symbol").csv(path, header=True)
