import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, v int, copies int, class string, cell int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, "x", 3) for i, v in rows], SCHEMA)


def brute_links(rows, least=0.9):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = len(rows)
    x = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if ok(v) else None for _, v in rows]
    near = [[i != j and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and x[i] @ x[j] >= least for j in range(n)] for i in range(n)]
    comp = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if near[i][j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    first = {}
    for i in range(n):
        first.setdefault(comp[i], []).append(rows[i][0])
    out = []
    for i in range(n):
        c = min((y for y in first[comp[i]] if y is not None), default=None)
        out.append((rows[i][0], sum(near[i]), c, True if c is None else rows[i][0] == c))
    return out


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def clustered(seed, n, dims=8, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dims))
    x = centres[rng.integers(0, 9, n)] + spread * rng.normal(size=(n, dims))
    x[n // 2 : n // 2 + 20] = x[0]
    return [(int(i), [float(y) for y in v]) for i, v in zip(rng.permutation(n), x.astype(np.float32))]


@pytest.mark.parametrize("pivots,block,spread", [(1, 2000, 0.25), (6, 2000, 0.25), (6, 17, 0.25), (40, 25, 0.25), (6, 50, 0.02)])
def test_links_equal_all_pairs(spark, monkeypatch, pivots, block, spread):
    monkeypatch.setattr(vectors, "HOME_BLOCK", block)
    monkeypatch.setattr(vectors, "GUEST_BLOCK", block + 3)
    rows = clustered(pivots, 240, spread=spread)
    same(vectors.link(frame(spark, rows), "vec_id", "embedding", pivots=pivots).collect(), brute_links(rows))


def test_cores_settle_hot_groups(spark):
    """Two groups of near copies whose balls overlap in reach, stragglers around them, exact copies."""
    rng = np.random.default_rng(3)
    c = rng.normal(size=16)
    c /= np.linalg.norm(c)
    away = rng.normal(size=16)
    away -= c * (away @ c)
    away /= np.linalg.norm(away)
    at = lambda angle, n, noise: np.cos(angle) * c + np.sin(angle) * away + noise * rng.normal(size=(n, 16))
    x = np.concatenate([at(0, 120, 0.01), at(0.3, 100, 0.01), at(0.44, 20, 0.02), at(0.6, 20, 0.05), rng.normal(size=(60, 16))])
    x[200:220] = x[5]
    rows = [(int(i), [float(y) for y in v]) for i, v in zip(rng.permutation(len(x)), x.astype(np.float32))]
    same(vectors.link(frame(spark, rows), "vec_id", "embedding").collect(), brute_links(rows))
    sample = np.array([v for _, v in rows])
    assert len(vectors._cores(sample / np.linalg.norm(sample, axis=1)[:, None], np.sqrt(0.2))) >= 2


def test_cores_of_many_blocks(spark, monkeypatch):
    """A hot group whose home rows fill many blocks and whose visitors fill some: the links are all pairs'."""
    monkeypatch.setattr(vectors, "HOME_BLOCK", 17)
    monkeypatch.setattr(vectors, "GUEST_BLOCK", 20)
    rng = np.random.default_rng(4)
    c = np.eye(16)[0]
    x = np.concatenate([c + 0.02 * rng.normal(size=(150, 16)), c + 0.16 * rng.normal(size=(60, 16)), rng.normal(size=(50, 16))])
    rows = [(int(i), [float(y) for y in v]) for i, v in zip(rng.permutation(len(x)), x.astype(np.float32))]
    same(vectors.link(frame(spark, rows), "vec_id", "embedding").collect(), brute_links(rows))


def compared(spark, path):
    """(rows, pairs compared, cells used) for a table."""
    e = spark.read.parquet(path)
    classes = vectors.numbered(e.where("embedding IS NOT NULL").selectExpr("transform(embedding, x -> cast(x as double)) AS v", "cast(1 as long) AS copies"), "class")
    classes = classes.where(vectors.usable(classes["v"])).select("class", "copies", "v")
    used = []
    real = vectors._cells
    vectors._cells = lambda cores, reach, pivots, radius: used.append(len(cores) + len(pivots)) or real(cores, reach, pivots, radius)
    try:
        found = vectors._link_classes(classes, 0.9, None)
    finally:
        vectors._cells = real
    return classes.count(), found.agg({"compared": "sum"}).first()[0], used[0]


def test_cells_prune(spark):
    """More than one cell, a small share of all pairs, and growth below the square of the rows."""
    n1, c1, k1 = compared(spark, "/root/testdata/sf0.01/embeddings.parquet")
    n2, c2, k2 = compared(spark, "/root/testdata/sf0.1/embeddings.parquet")
    assert min(k1, k2) > 1
    assert c1 <= 0.5 * n1 * (n1 - 1) / 2 and c2 <= 0.35 * n2 * (n2 - 1) / 2
    assert c2 / c1 < 0.75 * (n2 / n1) ** 2


def test_units_are_cut_by_their_home_rows_alone():
    """Near pairs of home rows and of them with visitors, all of them; visitors are never compared with each other."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 12))
    x[600:660] = x[:60] + 0.05 * rng.normal(size=(60, 12))
    x[700:705] = x[0]  # visitors that equal a home row and each other
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    for own in (0, 3, 30, 500, 1500):
        for among in (True, False):
            *found, (_, _, pairs) = vectors._unit_pairs(x, own, among, 0.9, float(np.sqrt(0.2)))
            got = [(min(p), max(p)) for i, j, _ in found for p in zip(i.tolist(), j.tolist())]
            want = {(i, j) for i, j in zip(*np.nonzero(np.triu(near, 1))) if i < own and (among or j >= own)}
            assert len(got) == len(set(got)) and set(got) == want
            every = own * (1500 - own) + among * own * own
            assert pairs <= every and (own < 500 or not every or pairs < 0.7 * every)


def test_single_precision_travels_as_it_is(spark):
    """Vectors of floats are shuffled as floats; links are those of the same vectors in double precision."""
    rows = clustered(4, 240, spread=0.25) + [(900, None), (901, [0.0] * 8), (902, [-0.0, 0.0, *[1.0] * 6]), (903, [0.0, 0.0, *[1.0] * 6]), (904, [3.4e38] * 8)]
    d = frame(spark, rows)
    single = d.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    double = single.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    seen = []
    real = vectors._link_classes
    vectors._link_classes = lambda classes, *a: seen.append(classes.schema["v"].dataType.simpleString()) or real(classes, *a)
    try:
        got, want = (sorted(map(tuple, vectors.link(x, "vec_id", "embedding").collect())) for x in (single, double))
    finally:
        vectors._link_classes = real
    assert got == want and set(seen[: len(seen) // 2]) == {"array<float>"} and set(seen[len(seen) // 2 :]) == {"array<double>"}


AWKWARD = [
    (1, [1.0, 0.0]),
    (2, [2.0, 0.1]),
    (3, [0.0, 0.0]),
    (4, None),
    (5, [float("nan"), 1.0]),
    (6, [float("inf"), 1.0]),
    (7, [None, 1.0]),
    (8, [1.0, 0.0]),
    (8, [1.0, 0.0]),
    (9, []),
    (10, [1.0, 0.0, 0.0]),
    (11, [0.0, -1.0]),
]


def test_links_of_awkward_rows(spark):
    same(vectors.link(frame(spark, AWKWARD), "vec_id", "embedding").collect(), brute_links(AWKWARD))
    assert vectors.link(frame(spark, []), "vec_id", "embedding").collect() == []
    only = [r for r in AWKWARD if r[0] in (3, 4)]
    same(vectors.link(frame(spark, only), "vec_id", "embedding").collect(), brute_links(only))


def brute_nearest(rows, qids, k):
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    out = []
    for q in qids:
        d = sorted((float(np.sqrt(((x[i] - x[q]) ** 2).sum())), i) for i in x if i != q)[:k]
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(d)]
    return out


@pytest.mark.parametrize("list_rows,salt_rows", [(1000, 20_000), (20, 20_000), (20, 7)])
def test_neighbours(spark, list_rows, salt_rows):
    rows = clustered(7, 300)
    df = frame(spark, rows)
    got = vectors.nearest(df.where("vec_id % 10 = 0"), df, "vec_id", "embedding", list_rows=list_rows, salt_rows=salt_rows).collect()
    want = brute_nearest(rows, [i for i, _ in rows if i % 10 == 0], 10)
    mine = {(r.query_id, r.vec_id): r.score for r in got}
    hits = [(q, i) for q, _, i, _ in want if (q, i) in mine]
    assert len(hits) >= 0.95 * len(want)
    exact = {(q, i): s for q, _, i, s in brute_nearest(rows, [i for i, _ in rows if i % 10 == 0], 300)}
    assert all(s == pytest.approx(exact[p], abs=1e-12) for p, s in mine.items())
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert all(len(v) == 10 and v == sorted(v) for v in by.values())


def test_neighbours_of_awkward_rows(spark):
    got = vectors.nearest(frame(spark, AWKWARD), frame(spark, AWKWARD), "vec_id", "embedding", k=3).collect()
    assert {r.query_id for r in got} == {1, 2, 8, 11}
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 1] == [8, 2, 11]
    assert vectors.nearest(frame(spark, []), frame(spark, []), "vec_id", "embedding").collect() == []
    nameless = frame(spark, [(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.0])])
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in vectors.nearest(nameless, nameless, "vec_id", "embedding").collect() if r.query_id == 2)
    assert [g[2] for g in got] == [None, 1]


@pytest.mark.parametrize("n,times,list_rows", [(12, 2, 1000), (120, 3, 1000), (120, 3, 20)])
def test_neighbours_where_every_row_is_repeated(spark, n, times, list_rows):
    rows = clustered(11, n)[: n // 2] + [(1000 + i, v) for i, v in clustered(12, n)[: n - n // 2]]
    df = frame(spark, [r for r in rows for _ in range(times)])
    got = vectors.nearest(df, df, "vec_id", "embedding", list_rows=list_rows).collect()
    ids = [i for i, _ in rows]
    want = brute_nearest(rows, ids, 10)
    assert len(got) == len(want) and len({(r.query_id, r.vec_id) for r in got}) == len(want)
    mine = {(r.query_id, r.vec_id) for r in got}
    assert sum((q, i) in mine for q, _, i, _ in want) >= 0.95 * len(want)


def test_neighbours_of_every_length_and_of_far_more_lists_than_the_first_width(spark):
    rows = clustered(13, 300)
    short = [(1000 + i, v[:3]) for i, v in rows[:30]]
    df = frame(spark, rows + short)
    asked = df.where("vec_id % 30 = 0 or vec_id >= 1000")
    got = vectors.nearest(asked, df, "vec_id", "embedding", list_rows=10, ratio=1e9, width=4).collect()
    want = brute_nearest(rows, [i for i, _ in rows if i % 30 == 0], 10) + brute_nearest(short, [i for i, _ in short], 10)
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == {w[:3] for w in want}


def separated(groups, each, dims=24, seed=5):
    """Points in groups that lie far apart, and their group."""
    rng = np.random.default_rng(seed)
    c = 50 * rng.normal(size=(groups, dims))
    return np.concatenate([c[g] + rng.normal(size=(each, dims)) for g in range(groups)])


@pytest.mark.parametrize("groups", [10, 40, 100])
def test_graph_reaches_the_nearest_centroid(groups):
    c = separated(groups, 25)
    g = vectors.Graph(c)
    assert vectors.Graph._parts([set(map(int, x)) for x in g.near]).max() == 0
    rng = np.random.default_rng(1)
    hit = 0
    for i in range(0, len(c), 7):
        q = c[i] + 0.3 * rng.normal(size=c.shape[1])
        found, d = g.search(q, 8, 16)
        hit += int(((c - q) ** 2).sum(1).argmin()) == found[0]
        assert list(d) == sorted(d)
    assert hit >= 0.98 * len(range(0, len(c), 7))


@pytest.mark.parametrize("groups", [40, 100])
def test_recall_on_separated_groups(spark, groups):
    x = separated(groups, 30, seed=9)
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x.astype(np.float32))]
    df = frame(spark, rows)
    got = vectors.nearest(df.where("vec_id % 20 = 0"), df, "vec_id", "embedding", list_rows=4, width=8).collect()
    want = brute_nearest(rows, [i for i, _ in rows if i % 20 == 0], 10)
    mine = {(r.query_id, r.vec_id) for r in got}
    assert len(got) == len(want)
    assert sum((q, i) in mine for q, _, i, _ in want) >= 0.9 * len(want)


def test_recall_on_the_table(spark):
    """With the parameters of the query."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    assert len(vectors.fit_centres(e.selectExpr("cast(embedding as array<double>) as v"), "v", 400)) > 3
    got = vectors.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding").collect()
    want = brute_nearest(rows, [i for i, _ in rows if i % 100 == 0], 10)
    mine = {(r.query_id, r.vec_id) for r in got}
    assert sum((q, i) in mine for q, _, i, _ in want) >= 0.9 * len(want)
