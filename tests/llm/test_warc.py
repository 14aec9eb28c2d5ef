import hashlib
import io

import pyarrow as pa
import pytest

from tidemark.llm import warc

from .helpers import relayout

BIG = "<p>é</p>" * 400
ROWS = [
    (1, "http://a/", BIG),
    (5, "http://b/x y\r\n", BIG),
    (3, None, BIG),
    (3, None, BIG),
    (4, "http://c", "small"),
    (6, "http://d", "small"),
    (7, "http://e", None),
    (8, "http://f", ""),
    (None, "http://g", BIG),
    (9, "http://h", "x" * 3_000_000),
]
SCHEMA = "page_id long, url string, html string, digest string, payload int, refers_to int"


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)


def brute(rows):
    best = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            best[b] = max(best.get(b, -1), -1 if p is None else p)
    out, used = [], set()
    for p, _, h in rows:
        b = (h or "").encode()
        first = len(b) < 1000 or (best[b] == (-1 if p is None else p) and b not in used)
        if len(b) >= 1000 and first:
            used.add(b)
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "response" if first else "revisit", None if first else best[b]))
    return out


@pytest.mark.parametrize("size", [1 << 20, 300])
def test_round_trip(spark, size):
    got = warc.round_trip(spark, frame(spark), size=size).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    mine = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(mine, key=key) == sorted(brute(ROWS), key=key)
    assert {r.payload.decode() for r in got if r.page_id == 9} == {"x" * 3_000_000}


def test_empty(spark):
    assert warc.round_trip(spark, frame(spark, [])).collect() == []


def test_real_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = warc.round_trip(spark, pages, size=10_000).collect()
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in got) == sorted(
        (*r[:4], r[4] or -1) for r in brute(rows)
    )


def member(payload: bytes, i: int, level=6) -> bytes:
    return warc._member([("WARC-Type", "response"), ("Page-Id", str(i))], payload, level)


@pytest.mark.parametrize("cut", [1, 7, 64, 333, 5000])
def test_every_cut_owns_each_record_once(cut):
    """Also where a payload is an archive of its own, stored as it is, or holds the magic."""
    inner = b"".join(member(b"inner" * 30, 100 + k) for k in range(4))
    data = b"".join(
        [member(b"a" * 50, 1), member(inner, 2, 0), member(b"\x1f\x8b\x08" * 20, 3, 0), member(inner * 2 + b"tail", 4, 0), member(b"", 5)]
    )
    f = pa.PythonFile(io.BytesIO(data), "r")
    got = [r["fields"]["Page-Id"] for s in range(0, len(data), cut) for _, r in warc.records_in(f, len(data), s, min(s + cut, len(data)))]
    assert got == ["1", "2", "3", "4", "5"]
    assert data.count(warc.MAGIC) == 5 + 4 + 8 + 20


def test_numbers_survive_another_layout(spark, monkeypatch, tmp_path):
    rows = [(i, f"u{i}", BIG + str(i % 40)) for i in range(300)]
    frame(spark, rows).repartition(6).write.parquet(str(tmp_path / "p"))
    relayout(spark, monkeypatch, warc)
    got = warc.round_trip(spark, spark.read.parquet(str(tmp_path / "p"))).collect()
    mine = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(mine) == sorted(brute(rows))


def test_many_revisits_come_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    got = warc.round_trip(spark, frame(spark)).collect()
    assert sum(r.record_type == "revisit" for r in got) == 4
