import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import volatility as V

DAY = dt.date(2024, 5, 31)


def test_implied_inverts_the_price(spark):
    rows = [(100.0, k, t, v, c) for k in (70.0, 95.0, 100.0, 130.0) for t in (0.1, 1.0, 2.5) for v in (0.08, 0.3, 1.1) for c in (True, False)]
    d = spark.createDataFrame(rows, "s double, k double, t double, v double, call boolean")
    c, z = F.col, F.lit
    price = S.black_scholes(c("s"), c("k"), c("t"), z(0.05), z(0.01), c("v"), c("call"))
    d = d.withColumn("price", price).withColumn("iv", V.implied(c("price"), c("s"), c("k"), c("t"), z(0.05), z(0.01), c("call")))
    d = d.withColumn("again", S.black_scholes(c("s"), c("k"), c("t"), z(0.05), z(0.01), c("iv"), c("call")))
    for r in d.collect():
        if r.iv is not None:  # where the price hardly moves the volatility is not known, but the price is met
            assert r.again == pytest.approx(r.price, abs=2e-5)
        if abs(r.k - 100) <= 5:
            assert r.iv == pytest.approx(r.v, abs=1e-4)
    none = d.select(V.implied(z(200.0), c("s"), c("k"), c("t"), z(0.05), z(0.0), c("call")).alias("x")).where("x is not null")
    assert none.count() == 0


def test_chain_gives_every_contract_a_volatility_or_a_reason(spark):
    day = lambda n: DAY - dt.timedelta(n)
    at = lambda n, h: dt.datetime.combine(day(n), dt.time(h))
    bars = [("a", at(0, 10), day(0), 6.0), ("a", at(0, 12), day(0), 8.0), ("a", at(29, 9), day(29), 7.0), ("a", at(31, 9), day(31), 70.0)]
    bars += [(n, at(1, 9), day(1), p) for n, p in (("below", 1.0), ("none", 5.0), ("gone", 5.0), ("flat", 10.5), ("far", 99.9), ("strange", 5.0), ("null", None))] + [("old", at(20, 9), day(20), 5.0)]
    bars += [("x", at(n, 9), day(n), 5.0) for n in range(2, 10)]
    b = spark.createDataFrame(bars, "contract string, ts timestamp, day date, close double").repartition(3)
    later, past = DAY + dt.timedelta(365), DAY - dt.timedelta(5)
    contracts = [("a", "R", 100.0, later, True), ("below", "R", 80.0, later, True), ("none", "Q", 100.0, later, True), ("gone", "R", 100.0, past, True), ("flat", "R", 90.0, day(-9), True), ("far", "R", 100.0, later, True), ("null", "R", 1.0, later, True), ("old", "R", 100.0, later, True), ("x", "R", 100.0, later, False)]
    c = spark.createDataFrame(contracts, "contract string, root string, strike double, expiration date, call boolean")
    u = spark.createDataFrame([("R", day(n), 100.0) for n in range(60)], "root string, day date, close double")
    got = {r.contract: r for r in V.chain(b, c, u).collect()}
    assert {k: r.reason for k, r in got.items()} == {"a": None, "below": "below intrinsic", "none": "no underlying", "gone": "expired", "flat": "little time value", "far": "beyond bounds", "strange": "unknown contract", "null": "no bars", "x": None}
    a = got["a"]
    assert (a.files, a.bars, a.close, a.day) == (2, 3, 8.0, DAY)
    n = lambda x: (1 + math.erf(x / math.sqrt(2))) / 2
    d1 = (0.05 + a.iv**2 / 2) / a.iv
    assert 100 * n(d1) - 100 * math.exp(-0.05) * n(d1 - a.iv) == pytest.approx(8.0, abs=1e-4)
    series = V.daily_series(b, c, u).collect()
    assert all(0 < r.iv < 5 for r in series) and ("R", DAY, 1) in {(r.root, r.day, r.contracts) for r in series}
    assert V.chain(b.where("false"), c, u).count() == 0


def test_volatilities_are_solved_over_arrays(spark):
    rows = [(100.0, k, t, v, c) for k in (90.0, 100.0, 110.0) for t in (0.25, 1.0) for v in (0.1, 0.35) for c in (True, False)]
    d = spark.createDataFrame(rows + [(100.0, 100.0, None, 0.2, True), (None, 100.0, 1.0, 0.2, False)], "s double, k double, t double, v double, call boolean")
    c, z = F.col, F.lit
    d = d.withColumn("price", S.black_scholes(c("s"), c("k"), c("t"), z(0.05), z(0.01), c("v"), c("call")))
    for solve in (S.implied_volatility, V.implied):
        x = d.withColumn("iv", solve(c("price"), c("s"), c("k"), c("t"), z(0.05), z(0.01), c("call")))
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "aggregate(" not in plan  # not a fold of expressions row by row
        for r in x.collect():
            assert r.iv is None if r.s is None or r.t is None else r.iv == pytest.approx(r.v, abs=1e-6)
