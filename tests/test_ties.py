"""Halves and ties: what whole numbers halfway become, and which of equally good rows counts."""

import datetime as dt
import decimal
import random

from tidemark.operators import asof
from tidemark.plans import breadth_queries, more_queries

DAY = dt.datetime(1997, 2, 7)
LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_shipdate timestamp"


def test_halves_go_to_the_even_number(spark, tmp_path):
    rows = [(i, 1, "O", x) for i, x in enumerate((198_500.0, 198_000.0, 199_499.0, 199_500.0, 2_500.0, 3_500.0, 0.0, None))]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r["size"], r.copies, r.kept) for r in breadth_queries.signals_deduplicated(spark, str(tmp_path)).collect()}
    assert got == {(198, 2, 0), (199, 1, 2), (200, 1, 3), (2, 1, 4), (4, 1, 5), (0, 1, 6), (None, 1, 7)}
    spark.createDataFrame([(1, 1, 1, 1, 1.0, 1.0, t, DAY) for t in (0.0025, 0.0035)], LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(r.dte for r in more_queries._contracts(spark, str(tmp_path)).collect()) == [7, 9]


def test_the_dearer_of_two_equal_lines_is_the_close(spark, tmp_path):
    lines = [(13, 1, 5, 2, 1.0, p, 0.0, DAY) for p in (3345.0, 3216.0)] + [(6, 1, 5, 1, 1.0, 9000.0, 0.0, DAY)]
    for i, rows in enumerate((lines, lines[::-1])):
        spark.createDataFrame(rows, LINES).coalesce(1).write.parquet(f"{tmp_path}/{i}/lineitem.parquet")
        got = breadth_queries.contract_underlying_close(spark, f"{tmp_path}/{i}").collect()
        assert {r.underlying for r in got} == {33.45} and len(got) == 3


def test_equally_near_rows(spark):
    left = spark.createDataFrame([(1, "a", 10.0), (2, "a", 30.0), (3, "b", 10.0)], "id int, k string, at double")
    right = [("a", 12.0, 7), ("a", 8.0, 9), ("a", 8.0, 4), ("a", 8.0, 6), ("b", 10.0, 2), ("b", 10.0, 1)]
    for rows in (right, right[::-1]):
        r = spark.createDataFrame(rows, "k string, x double, other int").coalesce(1)
        got = asof.nearest_in_range(left, r, "k", "at", "x", 5.0).collect()
        assert sorted((g.id, g.x, g.other) for g in got) == [(1, 8.0, 4), (3, 10.0, 1)]


def test_nearest_equals_all_pairs_without_forming_them(spark):
    rnd, odd = random.Random(4), [float("nan"), float("inf"), float("-inf"), None, -1e-20, 0.0, -0.0, 5e-324, 500.0, -500.0, 1000.0, 999.9999999999999, 1e300, 2.0**63]
    number = lambda: rnd.choice([rnd.uniform(-2000, 2000), rnd.randint(-20, 20) * 100.0, rnd.choice(odd)])
    right = [(rnd.choice(["a", "b", None]), number(), rnd.randrange(50)) for _ in range(400)]
    right += [("c", x, 1) for x in (2e-20, -1e-20, 1e-20)]  # their distances from 1000 and 500 are rounded to one
    left = [(i, rnd.choice(["a", "a", "b", "c", None]), number()) for i in range(400)] * 2
    l = spark.createDataFrame(left, "id int, k string, at double")
    r = spark.createDataFrame(right, "k string, x double, other int")
    for reach in (500.0, 1000.0, 0.1):
        want = []
        for i, k, at in left[:400]:
            far = [(abs(x - at), x, o) for q, x, o in right if None not in (k, at, x) and q == k and abs(x - at) <= reach]
            want += [(i, *min(far)[1:])] if far else []
        d = asof.nearest_in_range(l, r, "k", "at", "x", reach)
        assert sorted((g.id, g.x, g.other) for g in d.collect()) == want
        assert "Join" not in d._jdf.queryExecution().executedPlan().toString()


def test_nearest_of_decimals_and_whole_numbers(spark):
    cents = lambda n: decimal.Decimal(n).scaleb(-2)
    left = spark.createDataFrame([(1, 1, cents(1010), 7), (2, 1, cents(3000), 30)], "id int, k int, at decimal(12,2), n int")
    right = spark.createDataFrame([(1, cents(1210), 13), (1, cents(810), 1), (1, cents(3501), 36)], "k int, x decimal(12,2), m int")
    got = asof.nearest_in_range(left, right, "k", "at", "x", 5.0).collect()
    assert [(g.id, g.x, g.m) for g in got] == [(1, cents(810), 1)]
    got = asof.nearest_in_range(left, right, "k", "n", "m", 6.0).collect()
    assert sorted((g.id, g.x, g.m) for g in got) == [(1, cents(810), 1), (2, cents(3501), 36)]
