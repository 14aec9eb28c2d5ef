import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import clock, intervals


def test_sessions(spark):
    d = spark.createDataFrame([(dt.date(2019, 1, 1),), (dt.date(2024, 12, 31),), (None,)], "d date")
    got = {str(r.day): r for r in clock.sessions(d, F.col("d")).collect()}
    assert len(got) == (dt.date(2024, 12, 31) - dt.date(2019, 1, 1)).days + 1
    half = {k for k, r in got.items() if r.half_day}
    want = {"2019-07-03", "2019-11-29", "2019-12-24", "2019-12-31", "2020-11-27", "2020-12-24", "2020-12-31", "2021-11-26", "2022-11-25", "2023-07-03", "2023-11-24", "2024-07-03", "2024-11-29", "2024-12-24", "2024-12-31"}
    assert half == want
    assert got["2024-03-29"].minutes == 0 and got["2024-03-28"].minutes == 390 and got["2024-07-03"].minutes == 210 and got["2024-07-06"].minutes == 0
    assert clock.sessions(d.where("false"), F.col("d")).count() == 0


def at(day, hour, minute):
    return dt.datetime.fromisoformat(f"{day} {hour:02}:{minute:02}:00")


def test_coverage(spark):
    full = [("a", at("2024-07-02", *divmod(m, 60))) for m in range(570, 960)]
    half = [("a", at("2024-07-03", 9, 31)), ("a", at("2024-07-03", 12, 55)), ("a", at("2024-07-03", 12, 55)), ("b", at("2024-07-03", 8, 0)), ("b", at("2024-07-03", 12, 54)), ("b", at("2024-07-03", 18, 0))]
    shut = [("a", at("2024-07-04", 10, 0))]
    b = spark.createDataFrame(full + half + shut, "symbol string, ts timestamp_ntz")
    got = {(r.symbol, str(r.day)): r for r in clock.coverage(b, clock.sessions(b, F.col("ts"))).collect()}
    assert set(got) == {("a", "2024-07-02"), ("a", "2024-07-03"), ("b", "2024-07-03")}
    r = got["a", "2024-07-02"]
    assert r.perfect and r.share == 1 and r.band == "near full" and not r.before_hours and not r.after_hours
    r = got["a", "2024-07-03"]
    assert r.perfect and r.minutes == 2 and r.expected == 210 and r.band == "low"
    r = got["b", "2024-07-03"]
    assert not r.late_open and not r.early_close and r.before_hours and r.after_hours and r.minutes == 1


def test_complete_and_clock_bars(spark):
    rows = [(at("2024-07-02", 10, 0), at("2024-07-02", 10, 4), False, False), (at("2024-07-02", 10, 0), at("2024-07-02", 10, 5), True, False), (at("2024-07-02", 16, 10), at("2024-07-02", 16, 15), True, True), (at("2024-07-02", 8, 0), at("2024-07-02", 8, 5), True, False), (at("2024-07-02", 9, 28), at("2024-07-02", 9, 30), False, False), (at("2024-07-02", 10, 0), at("2024-07-03", 1, 0), True, True)]
    d = spark.createDataFrame(rows, "ts timestamp_ntz, now timestamp_ntz, five boolean, day boolean")
    bad = d.where((clock.complete(F.col("ts"), 5, F.col("now")) != F.col("five")) | (clock.complete(F.col("ts"), 1440, F.col("now")) != F.col("day")))
    assert bad.count() == 0
    t = spark.createDataFrame([(at("2024-07-02", 9, 30),), (at("2024-07-02", 16, 10),), (at("2024-07-02", 16, 0),)], "ts timestamp_ntz")
    assert [tuple(r) for r in t.select(clock.first_of_day(F.col("ts"), 5), clock.last_of_day(F.col("ts"), 5), clock.last_of_day(F.col("ts"), 60), clock.first_of_day(F.col("ts"), 1440)).collect()] == [(True, False, False, True), (False, True, False, True), (False, False, True, True)]


def test_points_in_intervals(spark):
    rng = random.Random(5)
    points = [(rng.choice(["a", "b", None]), rng.randrange(-50, 200), rng.randrange(3)) for _ in range(400)] + [("a", None, 1)]
    spans = [(k, rng.choice(["a", "b", "c", None]), rng.randrange(-60, 210), rng.randrange(-60, 210)) for k in range(150)]
    spans += [(1, "a", 0, 10), (1, "a", 0, 10), (900, "a", None, 5), (901, "a", 7, 7), (902, "a", -50, 200)]
    p = spark.createDataFrame(points, "k string, t long, w int").repartition(3)
    s = spark.createDataFrame(spans, "id int, k string, a long, z long").repartition(3)
    for width in (1, 7, 1000):
        got = intervals.count_in(p, s, "k", "t", "a", "z", {"n": F.lit(1), "weight": F.col("w")}, width).collect()
        inside = lambda k, a, z: [w for q, t, w in points if q == k and t is not None and a <= t < z]
        want = [(i, k, a, z, *((None, None) if a is None or z is None else (float(len(x := inside(k, a, z))), float(sum(x))))) for i, k, a, z in spans]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert intervals.count_in(p.where("false"), s.where("id = 902"), "k", "t", "a", "z", {"n": F.lit(1)}, 9).collect()[0].n == 0


def test_minutes_are_told_apart_before_they_are_converted(spark):
    utc = [dt.datetime(2024, 7, 2, 13, 30, s, f) for s in range(60) for f in (0, 999_999)] + [dt.datetime(2024, 11, 3, h, 30, 5) for h in (4, 5, 6, 7)] + [dt.datetime(2024, 3, 10, h, 59, 59) for h in (6, 7)]
    old = [dt.datetime(1870, 1, 1, 12, 0, s) for s in (0, 1, 2, 30)]
    t = spark.createDataFrame([(k, ts) for ts in utc + old for k in "ab"] + [("a", None)], "symbol string, ts timestamp_ntz").repartition(5)
    c, b = t.select("symbol", clock.local(F.col("ts")).alias("ts")), clock.local_minutes(t)
    of = lambda d: {tuple(r) for r in d.select("symbol", F.to_date("ts").alias("day"), clock.minute_of_day(F.col("ts")).alias("m")).collect()}
    assert of(b) == of(c)
    assert b.where("ts >= '2024-07-01' AND ts < '2024-07-04'").count() == 2  # a row a symbol and minute, not one a tick
