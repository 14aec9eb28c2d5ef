import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import resampling

from .helpers import ROWS, documents, relayout

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def parts(text, longest):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, share=(10, 100), least=20, longest=1):
    """rows: (doc_id, text) -> [(doc_id, n_features, weight, score, rank)], plainly."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    count = lambda texts: Counter(bucket(f) for t in texts for f in parts(t, longest)[1])
    s, t = count(x for _, x in rows), count(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out, can = [], []
    for k, (doc_id, text) in enumerate(rows):
        w, f = parts(text, longest)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        name = "null" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"2024:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(f), weight, score, None])
        if len(w) >= least:
            can.append((-score, doc_id is None, doc_id or 0, k))
    for place, x in enumerate(sorted(can)[: share[0] * len(can) // share[1]]):
        out[x[-1]][-1] = place + 1
    return sorted(map(tuple, out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, score int, row string, words int").repartition(7)


TARGET = ["alpha beta zeta", None, "Zeta 12 naïve zeta"]


def some(n=700):
    words = "Alpha beta GAMMA delta 12 naïve Ünder 日本 zeta eta".split()
    return [(i, " ".join(words[(i * k + k * k) % len(words)] for k in range(i % 61))) for i in range(n)]


@pytest.mark.parametrize("longest,ranges", [(1, 200_000), (3, 10)])
def test_equals_brute_force(spark, monkeypatch, longest, ranges):
    monkeypatch.setattr(resampling, "ROWS_A_RANGE", ranges)
    relayout(spark, monkeypatch, resampling)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    for share in ((10, 100), (1, 3), (1, 1), (0, 1)):
        assert got(resampling.draw(frame(spark, some()), target, share=share, longest=longest)) == brute(some(), TARGET, share, longest=longest)


def test_awkward(spark):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    none = target.where("false")
    for t, plain in ((target, TARGET), (none, [])):
        assert got(resampling.draw(documents(spark), t, share=(1, 2), least_words=1)) == brute([r[:2] for r in ROWS], plain, (1, 2), 1)
        assert got(resampling.draw(documents(spark, []), t)) == []


def test_equal_rows_get_ranks_of_their_own(spark, monkeypatch):
    """Half of all rows are one row, as are null ids; they are drawn each and split over ranges."""
    monkeypatch.setattr(resampling, "ROWS_A_RANGE", 20)
    text = " ".join(["alpha"] * 25)
    rows = [(3, text)] * 200 + [(None, text)] * 100 + [(i, text) for i in range(100)]
    target = spark.createDataFrame([("alpha",)], "text string")
    out = resampling.draw(frame(spark, rows), target, share=(1, 2)).collect()
    drawn = sorted((r["rank"], -r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in out if r["rank"])
    assert [d[0] for d in drawn] == list(range(1, 201))
    want = sorted((-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in out)[:200]
    assert [d[1:] for d in drawn] == want


def test_tournament():
    runs = [[(1,), (4,), (4,), (9,)], [], [(0,), (4,), (5,)], [(2,)], [(7,), (8,)]]
    for k in range(len(runs) + 1):
        assert list(resampling.tournament([iter(r) for r in runs[:k]])) == sorted(sum(runs[:k], []))
