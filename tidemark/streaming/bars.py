"""Ticks as a stream: bars per window, last-write-wins updates, switches kept per symbol."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(ticks: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Open, high, low, close and volume of each window; a window is given up `late` after its end.

    The first and last price are those of the smallest and largest (ts, id), so a late tick
    corrects its bar and the order of arrival does not matter.
    """
    order = F.struct("ts", "id")
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", f"{minutes} minutes").alias("w"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def sliding_mean(ticks: DataFrame, length: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", length, step).alias("w")).agg(F.avg("price").alias("mean"), F.count("*").alias("n")).select("symbol", F.col("w.start").alias("ts"), "mean", "n")


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("price").alias("total")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def distinct_ticks(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "id"])


def upsert(target: Callable[[DataFrame, int], None]):
    """For foreachBatch: the last tick of each key of a micro-batch goes to `target`."""

    def run(batch: DataFrame, epoch: int) -> None:
        target(batch.groupBy("symbol").agg(F.max_by(F.struct("ts", "price", "volume"), F.struct("ts", "id")).alias("r")).select("symbol", "r.*"), epoch)

    return run


def switches(ticks: DataFrame) -> DataFrame:
    """symbol, id, delta: a tick's direction where it turns; the state is a price and a direction."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        price, held = state.get if state.exists else (None, 0)
        for pdf in frames:
            out = []
            for i, p in pdf.sort_values(["ts", "id"])[["id", "price"]].itertuples(index=False):
                d = 0 if price is None else (p > price) - (p < price)
                if d and d != held:
                    out.append((key[0], i, d))
                    held = d
                price = p
            yield pd.DataFrame(out, columns=["symbol", "id", "delta"])
        state.update((float(price), int(held)))

    return ticks.groupBy("symbol").applyInPandasWithState(step, "symbol string, id long, delta int", "price double, held int", "append", "NoTimeout")
