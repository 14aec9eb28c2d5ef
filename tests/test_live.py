"""Streams that are stopped and started: the same events however ticks are dealt."""

import datetime as dt
import random

import pandas as pd

from tidemark.streaming import bars as SB
from tidemark.streaming import trades as ST

START = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, ts timestamp, id long, price double, volume long"


def some(n=400, seed=1):
    rng = random.Random(seed)
    at = sorted(rng.randrange(3 * 86_400 * 1000) for _ in range(n))
    return [(rng.choice("ab"), START + dt.timedelta(milliseconds=ms), i, float(rng.randrange(5)), 1) for i, ms in enumerate(at)]


def brute(rows):
    """The rules of Positions over ticks in order, up to the watermark that the last one leaves."""
    upto = max(r[1] for r in rows) - dt.timedelta(minutes=10)
    out = []
    for symbol in sorted({r[0] for r in rows}):
        day = last = None
        side = 0
        for _, ts, _, price, _ in sorted((r for r in rows if r[0] == symbol and r[1] < upto), key=lambda r: r[1:3]):
            if ts.date() != day:
                if side:
                    out.append((symbol, "closed", dt.datetime.combine(day, dt.time()) + dt.timedelta(1), last, side, "session"))
                day, last, side = ts.date(), None, 0
            turn = 0 if last is None else (price > last) - (price < last)
            if turn and turn != side:
                if side:
                    out.append((symbol, "closed", ts, price, side, "switch"))
                out.append((symbol, "opened", ts, price, turn, "switch"))
                side = turn
            last = price
        end = dt.datetime.combine(day, dt.time()) + dt.timedelta(1)
        if side and end <= upto:
            out.append((symbol, "closed", end, last, side, "session"))
    return sorted(out)


def run(spark, tmp_path, parts, plan, name):
    frames = [spark.createDataFrame(p, SCHEMA) for p in parts]
    return ST.deliver(spark, iter(frames), frames[0].schema, plan, f"file://{tmp_path}/{name}")


def events(spark, tmp_path, parts, name):
    got = run(spark, tmp_path, parts, ST.positions, name).collect()
    return sorted((r.symbol, r.event, r.ts, r.price, r.side, r.reason) for r in got)


def test_positions_do_not_depend_on_batches(spark, tmp_path):
    ST.with_state(spark)
    rows = some()
    assert events(spark, tmp_path, [rows], "one") == brute(rows)
    near = rows[:]  # out of order, but within the time that ticks may be late
    random.Random(2).shuffle(near)
    near.sort(key=lambda r: r[1] + dt.timedelta(seconds=r[2] % 500))
    cut = [near[:130], near[130:131], near[131:300], near[300:]]
    assert events(spark, tmp_path, cut, "four") == brute(rows)


def test_late_ticks_are_dropped(spark, tmp_path):
    ST.with_state(spark)
    rows = some(120, 3)
    late = [("a", START + dt.timedelta(seconds=1), 999, 77.0, 1), ("c", START, 1000, 1.0, 1), ("c", START, 1001, 2.0, 1)]
    assert events(spark, tmp_path, [rows[:100], rows[100:] + late], "late") == brute(rows)


def test_ticks_wait_as_runs_and_events_are_those_of_single_ticks():
    """The processor alone, with a state and a clock of its own: many ticks make few elements of state."""
    n = 2500
    us = [int((r[1] - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)) for r in some(n, 5)]
    state = {"waiting": [], "held": None, "timers": []}

    class Kept:
        appendList = staticmethod(state["waiting"].extend)
        clear = staticmethod(state["waiting"].clear)
        get = staticmethod(lambda: iter(state["waiting"][:]))

        def put(self, rows):
            state["waiting"][:] = rows

    class Held:
        exists = staticmethod(lambda: state["held"] is not None)
        get = staticmethod(lambda: state["held"])
        update = staticmethod(lambda v: state.update(held=v))

    class Handle:
        getListState = staticmethod(lambda *a: Kept())
        getValueState = staticmethod(lambda *a: Held())
        listTimers = staticmethod(lambda: list(state["timers"]))
        deleteTimer = staticmethod(state["timers"].remove)
        registerTimer = staticmethod(state["timers"].append)

    class Clock:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = lambda: at // 1000

    p = ST.Positions()
    p.init(Handle())
    rows = [("a", r[1], r[2], float("nan") if k % 100 == 7 else r[3], 1) for k, r in enumerate(some(n, 5))]
    rows += rows[:300]  # some come twice
    pdf = pd.DataFrame([(r[1], r[2], r[3]) for r in rows], columns=["ts", "id", "price"])
    assert list(p.handleInputRows(("a",), iter([pdf[:1200], pdf[1200:]]), Clock(0))) == []
    assert len(state["waiting"]) == 4 and sum(len(r[0]) for r in state["waiting"]) == len(rows)
    out = []
    for at in (us[700], us[700], us[1900], max(us) + 2 * ST.DAY):
        out += [t for f in p.handleExpiredTimer(("a",), Clock(at), None) for t in f.itertuples(index=False, name=None)]
    assert not state["waiting"] and state["held"][2] == 0
    assert sorted((s, e, ts.to_pydatetime(), price, side, why) for s, e, ts, price, side, why in out if price == price) == [r for r in brute(rows + [("b", START + dt.timedelta(d), 0, 1.0, 1) for d in (8, 9)]) if r[3] == r[3]]


def test_bars_over_restarts(spark, tmp_path):
    rows = some(200, 4)
    got = run(spark, tmp_path, [rows[:90], rows[90:150], rows[150:]], lambda t: SB.bars(t, 30), "bars").collect()
    last = max(r[1] for r in rows) - dt.timedelta(minutes=10)
    want = {}
    for s, ts, i, p, v in rows:
        bar = ts - (ts - START) % dt.timedelta(minutes=30)
        if bar + dt.timedelta(minutes=30) <= last:
            want.setdefault((s, bar), []).append((ts, i, p))
    assert sorted((r.symbol, r.ts, r.open, r.close, r.high, r.volume) for r in got) == sorted((*k, min(x)[2], max(x)[2], max(p for *_, p in x), len(x)) for k, x in want.items())
