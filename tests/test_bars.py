from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.operators import bars as B

SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long, wap double, count long"


def minutes(spark, n, start=datetime(2025, 8, 8, 9, 30)):
    rows = [("S", start + timedelta(minutes=k), 100.0 + k, 101.0 + k, 99.0 + k, 100.5 + k, 10, 100.2 + k, 1) for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("n,want", [(60, {5: 12, 15: 4, 60: 2}), (480, {1: 480, 5: 96, 10: 48, 15: 32, 30: 16, 60: 9, 240: 3, 1440: 1})])
def test_resample_counts(spark, n, want):
    b = minutes(spark, n)
    assert {m: B.resample(b, m).count() for m in want} == want


def test_resample_in_steps_equals_resample_at_once(spark):
    b = minutes(spark, 480)
    cols = ["symbol", "ts", "open", "high", "low", "close", "volume", "count"]
    key = lambda df: sorted(map(tuple, df.select(*cols).collect()))
    assert key(B.resample(B.resample(b, 5), 30)) == key(B.resample(b, 30))
    assert B.resample(b, 60).agg(F.sum("volume")).first()[0] == 4800


def test_fill_forward_makes_a_whole_session(spark):
    b = minutes(spark, 390).where("ts in (timestamp_ntz'2025-08-08 09:30:00', timestamp_ntz'2025-08-08 15:59:00')")
    got = B.fill_forward(b).collect()
    assert len(got) == 390 and sum(r.manufactured for r in got) == 388
    assert {r.close for r in got if r.manufactured} == {100.5}


def test_bridges_join_days(spark):
    b = minutes(spark, 3).unionByName(minutes(spark, 3, datetime(2025, 8, 11, 9, 30)))
    made = B.bridges(b).where("manufactured").collect()
    assert [(r.ts, r.open, r.close, r.wap) for r in made] == [(datetime(2025, 8, 8, 16, 15), 102.5, 100.0, 101.25)]


def test_validation_tiers(spark):
    rows = [
        ("S", datetime(2025, 1, 1), 1.0, 2.0, 0.5, 1.5, -3, 1.0, 1),
        ("S", None, 1.0, 2.0, 0.5, 1.5, 3, 1.0, 1),
        ("S", datetime(2025, 1, 1), 0.0, 2.0, 3.0, None, 3, 1.0, 1),
        ("S", datetime(2025, 1, 1), 9.0, 2.0, 0.0001, 1.5, 3, 1.0, 1),
    ]
    got = B.validate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert got[0].errors == [] and got[0].warnings == ["negative volume"] and got[0].volume == 0
    assert got[1].errors == ["time missing"]
    assert set(got[2].errors) == {"open not positive", "close not positive", "high below low"}
    assert set(got[3].warnings) == {"open outside range", "price below 0.001"}


@pytest.mark.parametrize("a,b,want", [("2025-08-08", "2025-08-11", 0), ("2025-08-08", "2025-08-12", 1), ("2025-08-08", "2025-08-18", 5), ("2025-08-08", "2025-08-08", 0)])
def test_business_gap(spark, a, b, want):
    d = spark.range(1).select(B.business_gap(F.lit(a).cast("date"), F.lit(b).cast("date")).alias("g"))
    assert d.first().g == want


def test_as_of_against_a_loop(spark):
    import random

    rng = random.Random(1)
    at = lambda: datetime(2025, 1, 1) + timedelta(seconds=rng.randrange(2000))
    left = [("ab"[rng.randrange(2)], at(), k) for k in range(200)]
    seen, right = set(), []
    for _ in range(80):
        r = ("ab"[rng.randrange(2)], at())
        if r not in seen:
            seen.add(r)
            right.append((*r, float(len(right))))
    l, r = spark.createDataFrame(left, "k string, ts timestamp_ntz, id int"), spark.createDataFrame(right, "k string, ts timestamp_ntz, x double")
    back = {q.id: q.x for q in asof.backward(l, r, "k", "ts", "x", within_seconds=100).collect()}
    ahead = {q.id: q.x for q in asof.forward(l, r, "k", "ts", "x").collect()}
    for k, t, i in left:
        before = max(((u, x) for s, u, x in right if s == k and u <= t), default=None)
        after = min(((u, x) for s, u, x in right if s == k and u >= t), default=None)
        assert back[i] == (before[1] if before and (t - before[0]).total_seconds() <= 100 else None)
        assert ahead[i] == (after[1] if after else None)
