"""Trades opened and closed over a stream of ticks: keyed state, an event-time buffer and timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

EVENTS = "symbol string, event string, ts timestamp, price double, side int, reason string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000_000
#: Columns of a waiting tick, in the order in which ticks are taken, and ticks in one element of the state at most.
TICK, RUN = ["us", "id", "price"], 1000


def _runs(ticks: pd.DataFrame) -> list[tuple]:
    return [tuple(ticks[c].iloc[s : s + RUN].tolist() for c in TICK) for s in range(0, len(ticks), RUN)]


class Positions(StatefulProcessor):
    """One position a symbol: a tick that turns the direction of the price closes what is open and
    opens the other side; at the end of its day (UTC) a position closes at the last price.

    Ticks wait until the watermark has passed them and are taken in the order of (ts, id) then, so
    the events do not depend on how ticks are dealt to batches; a tick that arrives behind
    the watermark is dropped. One timer a symbol is set: to the first waiting tick, or to the end
    of the day while a position is open, whichever comes first. All times are microseconds, UTC.

    A symbol's waiting ticks (a micro-batch's and those within `late`) are in memory at once when
    its timer goes off; `files` of `deliver` bounds a micro-batch. They are kept as runs of at most
    RUN ticks, an array a column, as an element of the state costs the same whatever it holds.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us array<long>, id array<long>, price array<double>")
        self.held = handle.getValueState("held", "day long, last double, side int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        first = []
        for pdf in rows:
            new = pdf[["id", "price"]].assign(us=pdf["ts"].astype("datetime64[us]").astype("int64"))
            new = new[new["us"] >= passed]
            if len(new):
                self.waiting.appendList(_runs(new))
                first.append(int(new["us"].min()))
        if first:
            self._wake(min(first))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        runs = [pd.DataFrame(dict(zip(TICK, run))) for run in self.waiting.get()]
        waiting = pd.concat(runs).sort_values(TICK) if runs else pd.DataFrame({c: [] for c in TICK})
        due, rest = waiting[waiting["us"] < passed], waiting[waiting["us"] >= passed]
        day, last, side = self.held.get() if self.held.exists() else (-1, float("nan"), 0)
        # what is held comes first, like a tick of its day, and opens nothing
        t = pd.DataFrame({"us": np.append(day * DAY, due["us"].astype("int64")), "price": np.append(last, due["price"].astype("float64"))})
        t["day"] = t["us"] // DAY
        turn = np.sign(t.groupby("day")["price"].diff())
        turn[0] = side
        t["side"] = turn.where(turn != 0).groupby(t["day"]).ffill().fillna(0).astype("int32")
        t["before"] = t.groupby("day")["side"].shift(fill_value=0)
        switched = t[(t["side"] != t["before"]) & (t.index > 0)]
        ended = t[~t["day"].duplicated(keep="last") & (t["side"] != 0) & ((t["day"] + 1) * DAY <= passed)]
        out = pd.concat([
            switched[switched["before"] != 0].assign(event="closed", reason="switch", side=lambda x: x["before"]),
            switched.assign(event="opened", reason="switch"),
            ended.assign(event="closed", reason="session", us=lambda x: (x["day"] + 1) * DAY),
        ])
        day, last, side = (t[c].iloc[-1].item() for c in ("day", "price", "side"))
        if side and (day + 1) * DAY <= passed:
            last, side = float("nan"), 0
        if day >= 0:
            self.held.update((day, last, side))
        self.waiting.put(_runs(rest)) if len(rest) else self.waiting.clear()
        if nexts := [int(us) for us in rest["us"][:1]] + [(day + 1) * DAY] * bool(side):
            self._wake(min(nexts))
        if len(out):
            out = out.assign(symbol=key[0], ts=out["us"].to_numpy().astype("datetime64[us]"))
            yield out[["symbol", "event", "ts", "price", "side", "reason"]]

    def _wake(self, us: int) -> None:
        """Keep only the earliest timer."""
        at = us // 1000
        for t in list(self.handle.listTimers()):
            if t <= at:
                return
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def positions(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """symbol, event (opened, closed), ts, price, side, reason (switch, session) of streaming ticks.

    ticks: symbol, ts, id, price, without nulls. See Positions for the rules; the session
    needs the RocksDB state store (`with_state`).
    """
    t = ticks.select("symbol", "ts", "id", "price").withWatermark("ts", late)
    return t.groupBy("symbol").transformWithStateInPandas(Positions(), EVENTS, "Append", "EventTime")


def with_state(spark: SparkSession) -> None:
    """Keyed state with timers is kept in RocksDB, whose snapshots go to the query's checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def deliver(spark: SparkSession, deliveries: Iterator[DataFrame], schema: StructType, plan, folder: str, files: int = 1000) -> DataFrame:
    """What plan makes of tables that arrive one after the other, with a stop after each.

    Every delivery is written into the stream's source folder; the stream then runs until it has read
    all there is, at most `files` files at a time, ends, and is started anew from its checkpoint for the next one. The
    rows come back from the sink, which holds each once however often the stream was stopped.
    """
    for rows in deliveries:
        rows.write.mode("append").parquet(f"{folder}/source")
        stream = plan(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/source"))
        q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/sink")
        q.awaitTermination()
        out = stream.schema
    return spark.read.schema(out).parquet(f"{folder}/sink")
