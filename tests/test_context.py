import numpy as np
import pytest

from tidemark.operators import context


@pytest.mark.parametrize("far,near", [(5, 0), (5, 1), (99, 20), (3, 3), (40, 2), (16, 1)])
def test_counted_below(far, near):
    rng = np.random.default_rng(far * 100 + near)
    v = np.round(rng.normal(size=300), 1)
    v[rng.random(300) < 0.1] = np.nan
    below, there = context.counted_below(v, far, near)
    for i in range(300):
        w = v[max(0, i - far) : max(0, i - near + 1)]
        assert there[i] == (~np.isnan(w)).sum()
        if not np.isnan(v[i]):
            assert below[i] == (w < v[i]).sum()


def bars(spark, n=500, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for s in "ab":
        c = 100 * np.exp(np.cumsum(rng.normal(size=n) / 50)).round(2)
        for i in range(n):
            o = float(c[i] * (1 + rng.normal() / 100))
            rows.append((s, i, o, max(o, float(c[i])) + 1, min(o, float(c[i])) - 1, float(c[i]), int(rng.integers(0, 50))))
    return spark.createDataFrame(rows, "symbol string, i long, open double, high double, low double, close double, volume long").repartition(3)


def plain(d, i):
    """The features of bar i by the sentences that define them."""
    c, out = [x.close for x in d], {}
    vol = lambda k: np.sqrt(np.var([c[j] / c[j - 1] - 1 for j in range(k - 19, k + 1)]) * 252) if k >= 20 else None
    out["volatility"] = vol(i)
    out["volatility_rank"] = np.mean([vol(k) < vol(i) for k in range(max(20, i - 99), i - 19)]) if i >= 100 else None
    out["trend"] = np.mean(c[i - 25 : i]) / np.mean(c[i - 50 : i - 25]) - 1 if i >= 50 else None
    out["short_trend"] = np.mean(c[i - 4 : i + 1]) / np.mean(c[i - 19 : i + 1]) - 1 if i >= 50 else None
    usual = np.mean([x.volume for x in d[i - 20 : i]]) if i >= 20 else 0
    out["relative_volume"] = d[i].volume / usual if i >= 20 and d[i].volume > 0 else None
    if i >= 14:
        steps = np.diff(c[i - 14 : i + 1])
        g, ls = steps[steps > 0].sum(), -steps[steps < 0].sum()
        out["momentum"] = 100 - 100 / (1 + (g / ls if ls > 0 else 100))
        out["atr"] = np.mean([max(d[j].high - d[j].low, abs(d[j].high - c[j - 1]), abs(d[j].low - c[j - 1])) for j in range(i - 13, i + 1)])
    out["gap"] = (d[i].open / c[i - 1] - 1) * 100 if i else None
    out["intraday"] = (c[i] / d[i].open - 1) * 100
    if i >= 5:
        up = [c[j] > c[j - 1] for j in range(1, i + 1)]
        n = 1
        while n < 10 and n < len(up) and up[-1 - n] == up[-1]:
            n += 1
        out["streak"] = n if up[-1] else -n
    if i >= 10:
        w = d[i - 9 : i + 1]
        top = max(x.high for x in w)
        at = next(k for k, x in enumerate(w) if x.high == top)
        out["drawdown"] = (min(x.low for x in w[at:]) / top - 1) * 100
    return out


@pytest.mark.parametrize("block", [4096, 64])
def test_features(spark, monkeypatch, block):
    monkeypatch.setattr(context, "BLOCK", block)
    b = bars(spark)
    of = {s: sorted((x for x in b.collect() if x.symbol == s), key=lambda x: x.i) for s in "ab"}
    got = context.features(b).collect()
    assert len(got) == 1000
    for r in got:
        want = plain(of[r.symbol], r.i)
        for k in ("volatility", "volatility_rank", "trend", "short_trend", "relative_volume", "momentum", "gap", "intraday", "streak", "atr", "drawdown"):
            assert r[k] == (pytest.approx(want[k], rel=1e-9, abs=1e-9) if want.get(k) is not None else None), (k, r.i)


def test_streaks_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(context, "BLOCK", 3)
    states = "aaaaaaaabaab" + "c" * 20
    d = spark.createDataFrame([("s", i, x) for i, x in enumerate(states)] + [("t", 0, None), ("t", 1, None)], "symbol string, i long, x string")
    got = {(r.symbol, r.i): r.n for r in context.streaks(d, "x", "n").collect()}
    n = 0
    for i, x in enumerate(states):
        n = n + 1 if i and x == states[i - 1] else 1
        assert got["s", i] == n
    assert got["t", 1] == 2 and context.streaks(d.where("false"), "x", "n").count() == 0
    assert context.features(bars(spark).where("false")).count() == 0
