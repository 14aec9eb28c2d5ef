import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import backtest, insider, risk


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_black_scholes_and_parity(spark):
    z = F.lit
    args = (z(100.0), z(100.0), z(1.0), z(0.05), z(0.0), z(0.2))
    r = one(spark, S.black_scholes(*args, z(True)).alias("c"), S.black_scholes(*args, z(False)).alias("p"))
    assert r.c == pytest.approx(10.4506, abs=1e-4) and r.p == pytest.approx(5.5735, abs=1e-4)
    assert r.c - r.p == pytest.approx(100 - 100 * math.exp(-0.05), abs=1e-6)
    iv = one(spark, S.implied_volatility(z(r.c), *args[:5], z(True)).alias("v"))
    assert iv.v == pytest.approx(0.2, abs=1e-6)
    still = one(spark, S.black_scholes(z(110.0), z(100.0), z(0.0), z(0.05), z(0.0), z(0.2), z(True)).alias("c"))
    assert still.c == 10.0


def test_contract_symbols(spark):
    d = spark.createDataFrame([("O:SPY240814C00390000",), ("AB12251219p00001500",), ("SPY",), (None,)], "s string")
    got = [r.o for r in d.select(S.occ(F.col("s")).alias("o")).collect()]
    assert (got[0].root, got[0].expiration, got[0].kind, got[0].strike) == ("SPY", date(2024, 8, 14), "C", 390.0)
    assert (got[1].root, got[1].kind, got[1].strike) == ("AB12", "P", 1.5)
    assert got[2] is None and got[3] is None


def test_calendar(spark):
    days = {
        "2024-01-01": "New Year", "2024-01-15": "Martin Luther King", "2024-03-29": "Good Friday", "2024-05-27": "Memorial", "2024-06-19": "Juneteenth", "2024-07-04": "Independence",
        "2024-09-02": "Labor", "2024-11-28": "Thanksgiving", "2024-12-25": "Christmas", "2022-12-26": "Christmas", "2021-12-31": None, "2025-04-18": "Good Friday", "2024-07-05": None,
    }
    d = spark.createDataFrame([(k,) for k in days], "d string").select("d", S.us_market_holiday(F.to_date("d")).alias("h"), S.third_friday(F.to_date("d")).alias("f"))
    got = {r.d: r for r in d.collect()}
    assert {k: r.h for k, r in got.items()} == days
    assert got["2024-03-29"].f == date(2024, 3, 15)


def test_titles_and_weights(spark):
    want = {"Chief Executive Officer": "CEO", "EVP & CFO": "CFO", "General Counsel": "General Counsel", "Director": "Director", "  ": "Unknown", "VP Sales": "VP", "Sr. Vice-President": "VP", "CTO": "CTO", "Chief Marketing Officer": "Other C-Suite", "Treasurer": "CFO", "Chairman": "Chair", "see remarks": "Unknown", "Advisor": "Other"}
    d = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.x for r in d.select("t", S.title(F.col("t")).alias("x")).collect()} == want
    w = one(spark, *[S.role_weight(F.lit(k)).alias(f"w{i}") for i, k in enumerate(S.ROLE_WEIGHTS)])
    assert list(w) == [4.0, 3.5, 3.0, 2.5, 1.25, 1.0]
    assert one(spark, S.money(F.lit(0.125)).alias("m")).m == 0.12


def test_risk_metrics(spark):
    d = spark.createDataFrame([("a", 10.0), ("a", -5.0), ("a", 5.0), ("b", 1.0), ("b", 1.0)], "k string, gain double")
    got = {r.k: r for r in risk.metrics(d, "k").collect()}
    assert got["a"].win_rate == pytest.approx(2 / 3) and got["a"].profit_factor == pytest.approx(3.0) and got["a"].win_loss == pytest.approx(1.5)
    assert got["a"].sortino == pytest.approx((0.1 / 3) / 0.05)
    assert got["b"].sharpe == math.inf and got["b"].profit_factor == math.inf


def test_switches_emit_turns_only(spark):
    v = [1, 2, 3, 3, 2, 1, 1, 2, 2]
    d = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(v)], "symbol string, i int, v double")
    got = [r.delta for r in backtest.switches(d, "v").orderBy("i").collect()]
    assert got == [0, 1, 0, 0, -1, 0, 0, 1, 0]
    t = backtest.trades(backtest.switches(d.withColumn("close", F.col("v")), "v")).orderBy("open_i").collect()
    assert [(r.open_i, r.close_i, r.side) for r in t] == [(1, 4, 1), (4, 7, -1), (7, 8, 1)]
    b = backtest.balances(backtest.trades(backtest.switches(d.withColumn("close", F.col("v")), "v")), 100.0).orderBy("open_i").collect()
    assert b[-1].balance == pytest.approx(100.0)


def test_windows_and_folds(spark):
    assert len(backtest.walk_forward(1500, 756, 252, 126)) == 4 and backtest.walk_forward(100, 90, 20, 5) == []
    assert backtest.expanding_folds(600, 5, 5)[0] == (0, 100, 105, 155)
    d = backtest.in_windows(spark.range(10).withColumnRenamed("id", "i"), [(0, 4, 6), (2, 6, 8)])
    assert {(r.window, r.part): r["count"] for r in d.groupBy("window", "part").count().collect()} == {(0, "train"): 4, (0, "test"): 2, (1, "train"): 4, (1, "test"): 2}


@pytest.mark.parametrize("method", ["fixed", "kelly", "volatility", "atr", "drawdown", "momentum", "regime"])
def test_position_sizes_are_bounded(spark, method):
    z = F.lit
    n = one(spark, backtest.position_size(method, z(100_000.0), z(50.0), z(0.02), z(0.55), z(1.5), z(0.1), z(0.2)).alias("n")).n
    assert 0 < n <= 500


def test_cluster_tiers(spark):
    s = spark.createDataFrame([("X", f"o{i}", 4.0, 2.5e6) for i in range(4)] + [("Y", "d", 1.25, 6e5)], "ticker string, owner string, weight double, value double")
    assert {r.ticker: r.tier for r in insider.clusters(s).collect()} == {"X": "A+", "Y": "B"}


def test_student_t_tail(spark):
    want = {(2.776445, 4): 0.05, (2.085963, 20): 0.05, (1.0, 1): 0.5, (1.959964, 500): 0.05, (0.0, 7): 1.0}
    d = spark.createDataFrame([(t, n) for t, n in want], "t double, n int")
    got = {(r.t, r.n): r.p for r in d.select("t", "n", risk.student_t_tail(F.col("t"), F.col("n")).alias("p")).collect()}
    assert all(got[k] == pytest.approx(p, abs=1e-5) for k, p in want.items())
