import pytest

from tidemark.sources import store

SCHEMA = "sym string, day string, i int, x double, y double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(spark, path):
    return sorted(map(tuple, spark.read.schema(SCHEMA).parquet(path).select("sym", "day", "i", "x", "y").collect()), key=repr)


def merge(spark, rows, path, **kw):
    r = store.merge(frame(spark, rows), path, ["sym", "i"], "day", ["x", "y"], **kw)
    return {x.day: (x.rows_before, x.added, x.conflicts, x.rows_after, x.rewritten) for x in r.collect()}


def files(path):
    return {f"{p.parent.name}/{p.name}": p.stat().st_mtime_ns for p in path.glob("day=*/*.parquet")}


def test_merge_rewrites_only_what_changes(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    first = [("a", "d1", 1, 1.0, 2.0), ("a", "d1", 2, 1.0, None), ("b", "d2", 1, 5.0, 5.0), ("b", "d2", 1, 5.0, 5.0)]
    assert merge(spark, first, path) == {"d1": (0, 2, 0, 2, True), "d2": (0, 1, 0, 1, True)}
    before = files(tmp_path / "s")
    assert merge(spark, first, path) == {"d1": (2, 0, 0, 2, False), "d2": (1, 0, 0, 1, False)}
    assert files(tmp_path / "s") == before
    # little differences are none; a great one is a conflict, in which the old row stays
    more = [("a", "d1", 1, 1.05, 2.02), ("b", "d2", 1, 6.0, 5.0), ("b", "d2", 2, 7.0, 7.0), ("c", "d3", 1, None, None)]
    assert merge(spark, more, path) == {"d1": (2, 0, 0, 2, False), "d2": (1, 1, 1, 2, True), "d3": (0, 1, 0, 1, True)}
    assert rows_of(spark, path) == sorted([*first[:3], more[2], more[3]], key=repr)
    after = files(tmp_path / "s")
    assert {k: v for k, v in after.items() if k.startswith("day=d1")} == {k: v for k, v in before.items() if k.startswith("day=d1")}
    # replacing
    assert merge(spark, more, path, on_conflict="replace") == {"d1": (2, 0, 0, 2, False), "d2": (2, 0, 1, 2, True), "d3": (1, 0, 0, 1, False)}
    assert ("b", "d2", 1, 6.0, 5.0) in rows_of(spark, path)
    schema = frame(spark, []).schema
    assert {(r.day, r["rows"], r.intact) for r in store.verify(spark, path, schema, "day").collect()} == {("d1", 2, True), ("d2", 2, True), ("d3", 1, True)}
    # someone else's row
    frame(spark, [("z", "d3", 9, 9.0, 9.0)]).write.mode("append").partitionBy("day").parquet(path)
    assert {(r.day, r.intact) for r in store.verify(spark, path, schema, "day").collect()} == {("d1", True), ("d2", True), ("d3", False)}


def test_error_writes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    merge(spark, [("a", "d1", 1, 1.0, 2.0)], path)
    with pytest.raises(ValueError, match="d1"):
        merge(spark, [("a", "d1", 1, 2.0, 2.0), ("a", "d9", 1, 2.0, 2.0)], path, on_conflict="error")
    assert rows_of(spark, path) == [("a", "d1", 1, 1.0, 2.0)]
    with pytest.raises(ValueError):
        merge(spark, [], path, on_conflict="other")


def test_nulls_repeats_and_empty(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    assert merge(spark, [], path) == {}
    rows = [(None, None, None, None, None), (None, None, None, 1.0, None), (None, "d", None, 2.0, 2.0), (None, "d", None, 2.0, 2.0)]
    assert merge(spark, rows, path) == {None: (0, 1, 0, 1, True), "d": (0, 1, 0, 1, True)}
    assert merge(spark, rows[1:], path) == {None: (1, 0, 0, 1, False), "d": (1, 0, 0, 1, False)}
    assert merge(spark, [], path) == {}
    assert rows_of(spark, path) == sorted([(None, None, None, 1.0, None), (None, "d", None, 2.0, 2.0)], key=repr)


def test_untouched_folders_are_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    merge(spark, [("a", d, 1, 1.0, 2.0) for d in ("d1", "d2", "d3")], path)
    (next((tmp_path / "s/day=d3").glob("*.parquet"))).write_bytes(b"not parquet")
    (next((tmp_path / "s/day=d3").glob(".*.crc"))).unlink()
    assert merge(spark, [("a", "d2", 2, 1.0, 2.0)], path) == {"d2": (1, 1, 0, 2, True)}
