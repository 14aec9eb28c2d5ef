import random
import re

from pyspark.sql import functions as F

from tidemark.llm import licenses

from .helpers import ROWS, documents

SHORT = [("short", "alpha beta gamma delta epsilon"), ("long", " ".join(f"t{i}" for i in range(40))), ("none", "too few words")]


def split(t):
    return re.split(r"[\W_]+", (t or "").lower())


def runs(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(rows, templates):
    out, sets = [], [(name, set(runs([x for x in split(body) if x]))) for name, body in templates]
    for doc_id, text in rows:
        sh = runs(split(text))
        for name, own in sets:
            best = None
            if own.isdisjoint(sh):
                continue
            for p in [i for i, s in enumerate(sh) if s in own]:
                at = [i for i in range(p, min(len(sh), p + len(own) + 5)) if sh[i] in own]
                c = len({sh[i] for i in at}) / len(own)
                if c >= 0.8 - 1e-9 and (best is None or (c, -p) > best[:2]):
                    best = (c, -p, at[-1] + 4)
            if best:
                out.append((doc_id, name, best[0], -best[1], best[2]))
    return out


def check(docs, rows, templates):
    got = licenses.scan(docs, templates).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute(rows, templates), key=key)
    return got


def test_random_texts(spark):
    rng = random.Random(3)
    bodies = [b for _, b in SHORT[:2]]
    rows = []
    for i in range(300):
        w = [f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            b = rng.choice(bodies).split()
            for _ in range(rng.randint(0, 3)):
                if rng.random() < 0.5:
                    b[rng.randrange(len(b))] = "changed"
            w[rng.randint(0, len(w)) :] += b
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = check(df, rows, SHORT)
    assert len(got) > 100 and {r.license for r in got} == {"short", "long"}


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = check(docs, rows, licenses.TEMPLATES)
    found = {(r.doc_id, r.license) for r in got}
    assert all((i, n) in found for i, t in rows for n, b in licenses.TEMPLATES if b in (t or ""))


def test_awkward_rows(spark):
    rows = [(r[0], (r[1] or "") + " Released under the MIT License." * (r[0] in (5, 6, None))) if r[1] is not None else (r[0], None) for r in ROWS]
    df = documents(spark, [(*x, *r[2:]) for x, r in zip(rows, ROWS)])
    assert len(check(df, rows, licenses.TEMPLATES)) == 4
    assert licenses.scan(documents(spark, [])).collect() == []
    assert licenses.scan(documents(spark), [("none", "too few words")]).collect() == []


def test_no_python_and_no_shuffled_join(spark, sf_dir):
    plan = licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|SortMergeJoin|ShuffledHashJoin|Cartesian|NestedLoop", plan)


def test_hundreds_of_templates(spark):
    """Templates of all lengths, whole, altered up to a fifth of their shingles and over, in any place."""
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(900)]
    templates = [(f"t{i}", " ".join(rng.choices(vocab, k=rng.choice([5, 9, 15, 17, 40, 52, 60, 200])))) for i in range(300)]
    rows = []
    for i in range(260):
        w = rng.choices(vocab, k=rng.randint(0, 90))
        b = rng.choice(templates)[1].split()
        for _ in range(rng.choice([0, 0, 1, len(b) // 30, len(b) // 25])):
            b[rng.randrange(len(b))] = "changed"
        at = rng.randint(0, len(w))
        rows.append((i, " ".join(w[:at] + b + w[at:])))
    got = check(spark.createDataFrame(rows, "doc_id long, text string"), rows, templates)
    assert len(got) > 150 and any(r.containment < 1 for r in got)


def test_a_table_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)
    rows = [(1, "x " + licenses.TEMPLATES[0][1]), (2, "nothing here"), (3, dict(licenses.TEMPLATES)["mit-license"])]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, licenses.TEMPLATES)


def test_bands_find_windows_as_often_as_stated(spark):
    """A pair that shares one shingle, and the chance of rows and bands, over many random shingles."""
    n = 20_000
    df = spark.range(n).select(*[F.xxhash64("id", F.lit(k)).alias(f"x{k}") for k in range(4)])
    x = [F.col(f"x{k}") for k in range(4)]
    own = licenses._bands(x[0], x[0])
    missed = df.where(~F.arrays_overlap(own, licenses._bands(x[1], x[0])) & ~F.arrays_overlap(own, licenses._bands(x[0], x[2])))
    assert missed.count() <= 3
    both = df.where(F.arrays_overlap(licenses._bands(x[0], x[1]), licenses._bands(x[2], x[3])))
    assert both.count() == 0
    share = df.where(F.get(licenses._bands(x[0], x[1]), F.lit(0)) == F.get(licenses._bands(x[0], x[2]), F.lit(0))).count() / n
    assert abs(share - 1 / 3) < 0.02  # the Jaccard similarity of the two pairs


def test_more_templates_than_a_row_asks_by_itself(spark, monkeypatch):
    monkeypatch.setattr(licenses, "ROW_VALUES", 0)
    rows = [(1, "x " + licenses.TEMPLATES[0][1]), (2, "nothing here"), (3, dict(licenses.TEMPLATES)["mit-license"]), (3, None), (None, licenses.TEMPLATES[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, rows, licenses.TEMPLATES)
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)
    check(df, rows, licenses.TEMPLATES)
    assert licenses.scan(df.where("false")).collect() == []


def test_a_text_that_repeats_licenses(spark):
    """Memory follows the text, not the text times what it holds: 1.2 MB of licenses, one behind the other."""
    body = " ".join(b for _, b in licenses.TEMPLATES)
    text = " ".join([body] * 250)
    df = spark.createDataFrame([(1, text), (2, "plain words " * 5), (1, body)], "doc_id long, text string")
    got = licenses.scan(df).collect()
    once = {r.license: r for r in got if r.last_word < len(split(body))}
    assert {r.license for r in got if r.doc_id == 1} == {n for n, _ in licenses.TEMPLATES} == set(once)
    assert len(got) == 2 * len(licenses.TEMPLATES) and all(r.containment == 1 for r in got)
