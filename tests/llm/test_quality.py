import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality

from .helpers import ROWS, documents, relayout


def brute(trusted, texts, order):
    """Interpolated modified Kneser-Ney, every count in a dictionary."""
    grams = lambda t, k: [(b"\0" * (order - 1) + t)[i + order - k : i + order] for i in range(len(t))]
    level = Counter(g for t in trusted for g in grams(t, order))
    tables = {}
    for k in range(order, 0, -1):
        n = Counter(level.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = {i: min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i / 2, 0.05), 0.95 * i) for i in (1, 2, 3)}
        total, free = defaultdict(int), defaultdict(float)
        for g, c in level.items():
            total[g[:-1]] += c
            free[g[:-1]] += d[min(c, 3)]
        tables[k] = ({g: (c - d[min(c, 3)]) / total[g[:-1]] for g, c in level.items()}, {h: free[h] / total[h] for h in total})
        level = Counter(g[1:] for g in level)
    out = []
    for t in texts:
        s = 0.0
        for g in grams(t, order):
            p = 1 / 256
            for k in range(1, order + 1):
                share, gamma = tables[k]
                x = g[order - k :]
                p = share.get(x, 0.0) + gamma.get(x[:-1], 1.0) * p
            s += math.log(p)
        out.append(math.exp(-s / len(t)) if t else None)
    return out


@pytest.mark.parametrize("order", [2, 5])
def test_perplexities_equal_plain_counting(spark, order):
    trusted = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "naïve café", ""] * 2
    texts = ["the cat", "zzz", "", "dog the on cat é", "x" * 300, "a"]
    t = spark.createDataFrame([(x,) for x in trusted], "text string")
    docs = spark.createDataFrame([(x,) for x in texts], "text string").coalesce(1).withColumn("id", F.monotonically_increasing_id())
    tables = quality.model(quality.counts(t, order), order)
    got = {r.id: r.perplexity for r in quality.perplexities(docs, tables, order).collect()}
    want = brute([x.encode() for x in trusted], [x.encode() for x in texts], order)
    for i, w in enumerate(want):
        assert got[i] == (None if w is None else pytest.approx(w, rel=1e-5))


def test_chunks_do_not_matter(spark, sf_dir, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    one = {r.doc_id: (r.perplexity, r.kept) for r in quality.classify(docs, labels).collect()}
    monkeypatch.setattr(quality, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    two = {r.doc_id: (r.perplexity, r.kept) for r in quality.classify(docs, labels).collect()}
    assert one == two and len(one) == docs.count()


def brute_kept(rows, trusted, keep=0.99, slack=1.05, doubt=1.0):
    """rows: (id, lang, bytes, perplexity) -> {id: (threshold, kept)}, by sorting."""

    def limit(values):
        x = sorted(values)[math.ceil(len(values) * keep - 1e-9) - 1]
        return math.exp(math.ceil(math.log(x) * quality.BINS) / quality.BINS)

    by = defaultdict(list)
    for i, lang, n, p in rows:
        if i in trusted and p is not None:
            by[lang].append(p)
    every = [p for ps in by.values() for p in ps]
    out = {}
    for i, lang, n, p in rows:
        t = limit(by[lang] if len(by[lang]) >= quality.LEAST_DOCS else every) if every else None
        out[i] = (t, p is not None and (t is None or p <= t * slack * math.exp(doubt / math.sqrt(max(n, 1)))))
    return out


def test_thresholds_and_verdicts_equal_sorting(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(5)) == 0
    trusted = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").where(fold).collect()}
    got = quality.classify(docs, labels, columns=["doc_id", "lang"]).collect()
    want = brute_kept([(r.doc_id, r.lang, r.n_bytes, r.perplexity) for r in got], trusted)
    for r in got:
        assert r.threshold == pytest.approx(want[r.doc_id][0], rel=1e-9) and r.kept == want[r.doc_id][1]
    assert 0 < sum(r.kept for r in got) < len(got)


def test_layout_does_not_matter(spark, monkeypatch, tmp_path):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    docs.limit(300).repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    take = lambda: {r.doc_id: (r.text, r.perplexity, r.kept) for r in quality.classify(docs, labels).collect()}
    one = take()
    relayout(spark, monkeypatch, quality)
    assert take() == one


def test_clashing_names(spark):
    docs = documents(spark).withColumn("KEPT", F.lit(7)).withColumn("perplexity", F.lit("mine"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels)
    assert got.columns == [*docs.columns, "n_bytes", "perplexity_", "threshold", "kept_"]
    assert {(r["KEPT"], r["perplexity"]) for r in got.collect()} == {(7, "mine")}


def test_labels_are_met(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"))
    kept = {r.quality: r.k for r in got.collect()}
    assert kept[1] > 0.95 and kept[0] < 0.2


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (5, 1, 1), (6, 1, 0), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(documents(spark), labels).collect()
    assert len(got) == len(ROWS)
    assert all(r.perplexity is None and not r.kept for r in got if not r.n_bytes)
    assert all(r.kept for r in got if r.doc_id in (1, 6))
    assert all(r.threshold is None for r in got)  # none of the two trusted texts is held out


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(documents(spark, []), labels).collect() == []
    assert sum(r.kept for r in quality.classify(documents(spark), labels).collect()) == len(ROWS) - 2
