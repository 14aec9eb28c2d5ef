"""Queries that take every row, where a cut would leave some out."""

import numpy as np
import pytest

from tidemark.operators import backtest
from tidemark.plans import registry
from tidemark.plans.indicator_queries import hourly

SF = "/root/testdata/sf0.01"


def run(spark, name, sf_dir=SF):
    return registry.queries()[name](spark, sf_dir)


def test_every_contract_has_a_position(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    lost = rows.limit(1).selectExpr(*[f"null as {c}" if c in ("l_shipdate", "l_suppkey") else c for c in rows.columns])
    rows.limit(3000).unionByName(lost.withColumns({c: lost[c].cast(rows.schema[c].dataType) for c in ("l_shipdate", "l_suppkey")})).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = run(spark, "contract_order", tmp_path)
    assert sorted(r.pos for r in got.collect()) == list(range(1, 3002))


def closes(spark):
    d = hourly(spark, SF).select("symbol", "i", "close").toPandas().sort_values(["symbol", "i"])
    return {k: g["close"].to_numpy() for k, g in d.groupby("symbol")}


def test_every_bar_enters_the_spectrum(spark):
    got = {(r.symbol, r.block, r.k): r.magnitude for r in run(spark, "fourier_magnitudes").collect()}
    want = {}
    for symbol, x in closes(spark).items():
        assert len(x) > 64
        for b in range(-(-len(x) // 64)):
            want |= {(symbol, b, k): v for k, v in enumerate(np.abs(np.fft.rfft(x[64 * b : 64 * b + 64], 64)))}
    assert got == pytest.approx(want, abs=1e-4)


def test_every_bar_enters_the_haar_details(spark):
    got = {r.symbol: (r.haar, r.fine) for r in run(spark, "haar_details").collect()}
    for symbol, x in closes(spark).items():
        assert len(x) > 512
        q = np.concatenate([x, np.repeat(x[-1], -len(x) % 4)]).reshape(-1, 4)
        p = q.reshape(-1, 2)
        want = (q[:, :2].sum() - q[:, 2:].sum(), (p[:, 0] - p[:, 1]).sum())
        assert got[symbol] == pytest.approx(want, abs=1e-3)


def test_windows_reach_each_symbols_last_bars(spark):
    sizes = {"a": 40, "b": 17, "c": 8, "d": 9}
    d = spark.createDataFrame([(s, i) for s, n in sizes.items() for i in range(n)], "symbol string, i int")
    got = {(r.symbol, r.window, r.part, r.i) for r in backtest.in_all_windows(d, 6, 3, 4).collect()}
    want = {
        (s, k, "train" if i < b else "test", i) for s, n in sizes.items() for k, (a, b, c) in enumerate(backtest.walk_forward(n, 6, 3, 4)) for i in range(a, c)
    }
    assert got == want and ("a", 7, "test", 36) in got


def test_walk_forward_and_folds_use_every_symbols_own_bars(spark):
    x = closes(spark)
    got = {r.symbol: r.windows for r in run(spark, "walk_forward_score").collect()}
    assert got == {s: len(backtest.walk_forward(len(c), 252, 63, 63)) for s, c in x.items()}
    assert all(v > 5 for v in got.values())
    folds = {(r.symbol, r.fold): (r.train, r.test) for r in run(spark, "purged_folds").collect()}
    for s, c in x.items():
        for k, (a, b, t, z) in enumerate(backtest.expanding_folds(len(c), 5, 5)):
            assert folds[s, k] == pytest.approx((c[a:b].mean(), c[t:z].mean()), abs=1e-5)
