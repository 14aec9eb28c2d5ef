import re
from collections import defaultdict

import pytest

from tidemark.llm import mixing

from .helpers import ROWS, documents, relayout


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return out


def check(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r["size"]) for r in got), key=key) == sorted(((r[0], size(r[1])) for r in rows), key=key)
    sizes, most = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
        most[r[3]] = max(most[r[3]], size(r[1]))
    want = brute_targets(sizes)
    assert sorted({(r.source_size, round(r.target, 6)) for r in got}) == sorted({(sizes[s], round(want[s], 6)) for s in want})
    taken = defaultdict(int)
    for r in got:
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
        taken[(r.source_size, round(r.target, 6))] += r.taken
    longest = {(sizes[s], round(want[s], 6)): most[s] for s in sizes}
    for k, x in taken.items():  # whole documents: what is off is less than one of them
        assert abs(x - k[1]) <= longest[k]
    return got


def brute_mix(rows, targets):
    """rows: (id, source, size, key, th), ids all different -> {id: copies}: plain Efraimidis-Spirakis."""
    out = {}
    for s, target in targets.items():
        own = sorted((k, n, th, i) for i, x, n, k, th in rows if x == s)
        whole = sum(n for _, n, _, _ in own)
        epochs = int(target // whole) if whole else 0
        rest, upto, cut = target - epochs * whole, 0, False
        out |= {i: epochs for *_, i in own}
        later = []
        for k, n, th, i in own:
            if whole and rest > 0 and not cut and upto + n <= rest:
                upto += n
                out[i] += 1
            else:
                cut = True
                later.append((k, n, th, i))
        gap = rest - upto
        close = [(abs(n - gap), k, th, i) for k, n, th, i in later if n and abs(n - gap) < gap]
        if close:
            out[min(close)[3]] += 1
    return out


def same_as_brute(spark, docs):
    """copies of mixing.mix(docs) beside those of the plain sample of the same keys; ids all different."""
    keys = [(r.doc_id, r.source, r["size"], r.key, r.th) for r in mixing.keyed(docs, 17).collect()]
    sizes = defaultdict(int)
    for _, s, n, _, _ in keys:
        sizes[s] += n
    want = brute_mix(keys, brute_targets(sizes))
    got = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    return got, want


def test_selection_equals_plain_sampling(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["doc_id"])
    got, want = same_as_brute(spark, docs)
    assert got == want and set(got.values()) == {1, 2} | set(got.values())


def test_wordless_texts_are_not_taken_beyond_the_epochs(spark):
    """A source whose target is twice its size is taken twice, and so are its texts of white space."""
    rows = [(i, "   " if i % 6 else "some words of a text", "en", "small") for i in range(60)]
    rows += [(100 + i, "w " * 400, "en", "tall") for i in range(40)]
    docs = documents(spark, rows)
    got, want = same_as_brute(spark, docs)
    assert got == want and max(got.values()) <= 2


def test_equal_rows_are_drawn_apart(spark):
    rows = [(None, "w " * 30, "en", "b")] * 400 + [(i, "one two three", "en", "a") for i in range(400)]
    got = [r.copies for r in mixing.mix(documents(spark, rows)).collect() if r.doc_id is None]
    assert len(set(got)) == 2


@pytest.mark.parametrize("weight", ["a ", "$ ", "$$$$$$$$$$$$$$$$$$$ "])
def test_no_bin_is_hot(spark, weight):
    """Whatever the quality weights, documents spread over the bins."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", f"repeat('{weight}', 9) AS text", "'s' AS source")
    top = mixing.keyed(docs, 17).groupBy("bin").count().agg({"count": "max"}).first()[0]
    assert top <= 0.002 * 20_000


def test_layout_does_not_matter(spark, monkeypatch, tmp_path):
    docs = documents(spark, [(i, f"text {i} " * (1 + i % 7), "en", "ab"[i % 2]) for i in range(300)])
    docs.repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    relayout(spark, monkeypatch, mixing)
    got, want = same_as_brute(spark, docs)
    assert got == want


def test_awkward_rows(spark):
    check(documents(spark), ROWS)


def test_targets_are_met_and_reruns_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    first = check(docs, rows)
    again = mixing.mix(docs.repartition(7)).collect()
    take = lambda x: sorted((r.doc_id, r.taken) for r in x)
    assert take(first) == take(again)


def test_empty(spark):
    assert mixing.mix(documents(spark, [])).collect() == []


def test_better_documents_come_sooner(spark):
    docs = spark.createDataFrame(
        [(i, ("good words here " if i % 2 else "%%%% $$$$ #### ") * 10, "ab"[i // 1000]) for i in range(2000)],
        "doc_id long, text string, source string",
    )
    got = [r for r in mixing.mix(docs, weights=(1, 9), share=1.0).collect() if r.target < r.source_size]
    good = sum(r.copies for r in got if r.doc_id % 2)
    assert good > 4 * sum(r.copies for r in got if not r.doc_id % 2)


def test_level(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), (None, 1000)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(s).collect()}
    assert got == pytest.approx(brute_targets({"a": 10, "b": 1000, None: 1000}))


def test_large_sources_come_close(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 50 as int)) as text", "if(id % 4 = 0, 'b', 'a') as source")
    taken, target = defaultdict(int), {}
    for r in mixing.mix(docs).collect():
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert all(abs(taken[s] - target[s]) <= 2 for s in target)


def test_many_equal_rows_are_numbered_apart_without_meeting(spark):
    """A third of all rows are one row: each gets a key of its own, and no window has them all."""
    rows = [(7, "the same words", "a")] * 3000 + [(i, f"text {i}", "b") for i in range(6000)] + [(None, None, None)] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(12)
    k = mixing.keyed(docs, 17)
    assert k.count() == len(rows)
    assert k.where("source = 'a'").select("key").distinct().count() == 3000
    assert k.where("doc_id is null").select("key").distinct().count() == 500
    plan = k._jdf.queryExecution().toString()
    assert "Window" not in plan  # what is read back is written
