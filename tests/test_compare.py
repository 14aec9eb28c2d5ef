import datetime as dt

from tidemark.operators.compare import differences

SCHEMA = "id int, p double, t timestamp, s struct<x:int,y:struct<z:string>>, a array<struct<q:double,r:array<int>>>, m map<string,int>"
NOW = dt.datetime(2024, 1, 1)


def row(i, p=1.0, t=NOW, s=(1, ("k",)), a=((1.0, [1, 2]), (2.0, [])), m=None):
    return (i, p, t, s, list(a) if a is not None else None, m if m is not None else {"k": 1})


def test_differences(spark):
    old = [row(1), row(2), row(3), row(4), row(5, a=None), row(6, s=None), row(7), row(8), row(None)]
    new = [
        row(1, p=1.005, t=NOW + dt.timedelta(milliseconds=400)), row(2, p=1.5, t=NOW + dt.timedelta(seconds=2)), row(3, s=(2, (None,))), row(4, a=((1.0, [1, 3, 4]),)),
        row(5, a=()), row(6), row(8, m={"k": 2, "l": 3}), row(9), row(None, p=None),
    ]
    d = differences(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA), ["id"], {"number": 0.01, "seconds": 0.5})
    got = {(r.id, r.path): (r.old, r.new, r.kind) for r in d.collect()}
    text = lambda k: (got[k][0] is not None, got[k][1] is not None, got[k][2])
    assert {k: v for k, v in got.items() if k[0] in (2, 3, None)} == {
        (2, "p"): ("1.0", "1.5", "value"), (2, "t"): ("2024-01-01 00:00:00", "2024-01-01 00:00:02", "value"),
        (3, "s.x"): ("1", "2", "value"), (3, "s.y.z"): ("k", None, "null"), (None, "p"): ("1.0", None, "null"),
    }
    assert {k: v for k, v in got.items() if k[0] == 4} == {(4, "a[0].r[1]"): ("2", "3", "value"), (4, "a[0].r[2]"): (None, "4", "added"), (4, "a[1]"): ('{"q":2.0,"r":[]}', None, "removed")}
    assert {k: v for k, v in got.items() if k[0] == 8} == {(8, "m{k}"): ("1", "2", "value"), (8, "m{l}"): (None, "3", "added")}
    assert got[5, "a"] == (None, "[]", "null") and text((6, "s")) == (False, True, "null")
    assert text((7, "")) == (True, False, "removed") and text((9, "")) == (False, True, "added")
    assert not any(k[0] == 1 for k in got) and len(got) == 14


def test_columns_that_one_version_lacks(spark):
    a = spark.createDataFrame([(1, 2, "x", 5)], "id int, v int, gone string, kind int")
    b = spark.createDataFrame([(1, 2, 7, "5"), (1, 2, 7, "5")], "id int, v int, came int, kind string").distinct()
    got = {tuple(r) for r in differences(a, b, ["id"]).collect()}
    assert got == {(1, "gone", "x", None, "null"), (1, "came", None, "7", "null")}
    assert differences(a, a, ["id"]).count() == 0 and differences(a.where("false"), b.where("false"), ["id"]).count() == 0
