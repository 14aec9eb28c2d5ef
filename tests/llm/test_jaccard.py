import random
import re

import numpy as np
import pytest

from tidemark.llm import jaccard

from .helpers import ROWS, documents, relayout


def words_of(t):
    return re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").lower().encode())


def plain(t):
    w = words_of(t)
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_shingles_are_those_of_plain_words():
    texts = ["a b c d e f", "A, b! c d e f", "", None, "...", "one two", "x" * 200 + " y", "é è ê ë e é è ê ë e", "\n\na b\n", "a b c d e a b c d e"]
    for t, s in zip(texts, jaccard.shingles(texts)):
        assert len(s) == len(plain(t))
    a, b = jaccard.shingles(texts[:2])
    assert (a == b).all()
    x, y = jaccard.shingles(["x" * 199 + "y", "x" * 198 + "yx"])
    assert x[0] != y[0]
    for t, s in zip(texts, jaccard.shingles(texts)):
        assert (jaccard.shingles([t])[0] == s).all()


def brute(rows):
    """rows: (id, text). Per row: class, links, component, in order."""
    sh = [plain(t) for _, t in rows]
    n = len(rows)
    near = [[i != j and bool(sh[i]) and len(sh[i] & sh[j]) >= 0.8 * len(sh[i] | sh[j]) for j in range(n)] for i in range(n)]
    comp = list(range(n))
    for _ in range(n):
        was = list(comp)
        for i in range(n):
            comp[i] = min([comp[i]] + [comp[j] for j in range(n) if near[i][j]])
        if comp == was:
            break
    low = lambda xs: min(xs, key=lambda x: (x is None, x or 0))
    out = []
    for i in range(n):
        same = [rows[j][0] for j in range(n) if j == i or (sh[i] and sh[j] == sh[i])]
        out.append((rows[i][0], low(same), sum(near[i]), low([rows[j][0] for j in range(n) if comp[j] == comp[i]])))
    return out


def check(df, rows, **more):
    got = jaccard.join(df, **more).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    mine = [(r.doc_id, r.class_id, r.n_links, r.component_id) for r in got]
    want = brute(rows)
    assert sorted(mine, key=key) == sorted(want, key=key)
    groups = {}
    for r, (_, _, n, _) in zip(sorted(got, key=lambda r: key((r.doc_id, r.class_id, r.n_links, r.component_id))), sorted(want, key=key)):
        groups.setdefault((r.component_id, n > 0), []).append(r.kept)
    for (_, linked), kept in groups.items():
        assert sum(kept) == 1 if linked else all(kept)


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(400)]
    passage = rng.choices(vocab, k=60)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.6:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(1, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
        else:
            w = rng.choices(vocab, k=rng.choice([3, 12, 60, 200]))
            texts.append(" ".join(w + passage if rng.random() < 0.4 else w))
    return list(enumerate(texts))


@pytest.mark.parametrize("small,block", [(1000, 250), (5, 20), (40, 5)])
def test_links_equal_all_pairs(spark, monkeypatch, small, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SKETCH_BLOCK", 3 * block)
    rows = corpus(small)
    check(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), rows, small=small)


def test_nodes_left_at_the_last_level(spark):
    """With one level all that is left is compared in blocks: every run keeps what it shares a node with."""
    rows = pairs_at(random.Random(2), 60, 104, 1)
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("id AS row", "id", "text")
    heads = df.mapInArrow(jaccard._sketches(5), "row long, id long, h1 long, h2 long, bytes long, sketch binary")
    sets = jaccard.written(heads.selectExpr("row AS set", "sketch"))
    found = {frozenset((r.u, r.v)) for r in jaccard.candidates(sets, depth=1, small=2).collect()}
    assert sum(frozenset((2 * i, 2 * i + 1)) in found for i in range(60)) >= 58


def pairs_at(rng, n, words, changed):
    """n pairs of texts that differ in so many words, far from each other."""
    rows = []
    for i in range(n):
        w = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        v = list(w)
        for k in range(changed):
            v[10 + k * (words - 20) // changed] = f"x{k}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    return rows


@pytest.mark.parametrize("least,words,changed", [(0.8, 104, 2), (0.6, 104, 5)])
def test_recall_near_the_threshold(spark, least, words, changed):
    """Pairs of similarity just over the threshold, which a run finds least often."""
    rows = pairs_at(random.Random(5), 150, words, changed)
    a, b = (plain(rows[i][1]) for i in (0, 1))
    assert least <= len(a & b) / len(a | b) < least + 0.03
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), least=least)
    assert got.where("n_links = 1").count() >= 0.99 * len(rows)


@pytest.mark.parametrize("least,changed", [(0.8, 2), (0.6, 5)])
def test_recall_through_many_levels(spark, least, changed):
    """All texts share a passage, so nodes stay large and pairs must survive several levels."""
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{passage} {t}") for i, t in pairs_at(rng, 200, 104, changed)]
    reached = []
    runs = jaccard._runs

    def watched(*args):
        edges, levels = runs(*args)
        reached.append(levels)
        return edges, levels

    jaccard._runs = watched
    try:
        got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), least=least, small=2)
        found = got.where("n_links >= 1").count()
    finally:
        jaccard._runs = runs
    assert max(reached) >= 4 and len(reached) * jaccard.AT_ONCE >= jaccard.runs_for(jaccard.RECALL, max(reached))
    assert found >= 0.99 * len(rows)


def test_more_rounds_until_the_target(spark, monkeypatch):
    """A higher target takes further rounds of runs."""
    made = []
    runs = jaccard._runs
    monkeypatch.setattr(jaccard, "_runs", lambda *a: made.append(list(a[2])) or runs(*a))
    monkeypatch.setattr(jaccard, "AT_ONCE", 4)
    df = spark.createDataFrame(pairs_at(random.Random(3), 20, 60, 1), "doc_id long, text string")
    jaccard.join(df, recall=0.999).count()
    assert [x for m in made for x in m] == list(range(4 * len(made))) and len(made) >= 2


def family(spark, n, alike, start=0, seed=7):
    """Sketches of n sets of which any two share about so large a part of their coordinates."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**32, jaccard.TOKENS, np.uint64)
    own = rng.integers(0, 2**32, (n, jaccard.TOKENS), np.uint64)
    mins = np.where(rng.random(own.shape) < alike**0.5, base, own).astype(np.uint32)
    rows = [(start + i, bytearray(m.tobytes())) for i, m in enumerate(mins)]
    return jaccard.written(spark.createDataFrame(rows, "set long, sketch binary"))


def crowded(sets, least=0.8, small=60):
    """Rows of all shared nodes of eight runs, and the sets that their edges join."""
    crowds = []
    edges, _ = jaccard._runs(sets, least, range(8), jaccard.DEPTH, small, crowds)
    return sum(c.count() for _, c in crowds), jaccard.connected_components(edges)


def test_rows_grow_as_a_group_of_like_sets(spark):
    """Sets alike a little less than lets them leave with the pivot: all linked to it, they need no further level."""
    few, joined = crowded(family(spark, 300, 0.75))
    many, more = crowded(family(spark, 1200, 0.75))
    assert many <= 4.5 * few
    for found, n in ((joined, 300), (more, 1200)):
        assert found.count() >= 0.99 * n and found.select("component").distinct().count() == 1


def mixed(spark, n, seed=3):
    """Sketches of n texts that hold one passage and up to 0.6 times as much of their own."""
    rng = np.random.default_rng(seed)
    passage = rng.integers(0, 2**32, jaccard.TOKENS, np.uint64)
    least = rng.exponential(1, jaccard.TOKENS)
    own = rng.exponential(1, (n, jaccard.TOKENS)) / rng.uniform(0.01, 0.6, (n, 1))
    mins = np.where(own > least, passage, rng.integers(0, 2**32, own.shape, np.uint64)).astype(np.uint32)
    rows = [(i, bytearray(m.tobytes())) for i, m in enumerate(mins)]
    return jaccard.written(spark.createDataFrame(rows, "set long, sketch binary")), mins


def test_a_group_ends_where_few_are_outside(spark):
    """Texts of one passage: those unlike the pivot are compared with all at once, not led through further levels."""
    sets, mins = mixed(spark, 800)
    crowds = []
    edges, levels = jaccard._runs(sets, 0.8, range(8), jaccard.DEPTH, 200, crowds)
    assert levels <= 3 and sum(c.count() for _, c in crowds) <= 3 * crowds[0][1].count()
    label = {r.node: r.component for r in jaccard.connected_components(edges).collect()}
    alike = np.argwhere(np.triu((mins[:, None] == mins[None]).mean(2) >= 0.8, 1)).tolist()
    assert len(alike) >= 1000 and all(label[a] == label[b] for a, b in alike)


@pytest.mark.parametrize("part", [20_000, 30])
def test_those_outside_are_compared_with_all(spark, monkeypatch, part):
    monkeypatch.setattr(jaccard, "BUCKET", part)
    sets, mins = mixed(spark, 120)
    likely, out = jaccard.limits(0.8)[0], [i % 8 == 0 for i in range(120)]
    rows = [(node, i, out[i], 120) for node in (5, 6) for i in range(120) if node == 5 or i % 8 < 2]
    found = jaccard._outside(spark.createDataFrame(rows, "node long, set long, out boolean, n long"), sets, likely)
    label = {r.node: r.component for r in jaccard.connected_components(found).collect()}
    like = (mins[:, None] == mins[None]).mean(2) >= likely
    pairs = [(i, j) for i in range(120) for j in range(i) if like[i, j] and (out[i] or out[j])]
    want = np.arange(120)
    for _ in range(120):
        want = jaccard.united(want, *np.array(pairs).T)
    assert pairs and all(label[i] == label[j] for i, j in pairs)
    assert {frozenset(i for i in label if label[i] == c) for c in set(label.values())} == {
        frozenset(np.flatnonzero(want == c)) for c in want if (want == c).sum() > 1
    }


def test_only_deep_sets_take_more_runs(spark, monkeypatch):
    """Of two groups one goes deeper than a round of runs suffices for; the other takes no part in the next."""
    monkeypatch.setattr(jaccard, "AT_ONCE", 8)
    given, runs = [], jaccard._runs

    def watched(sets, *more):
        given.append({r.set for r in sets.select("set").collect()})
        return runs(sets, *more)

    monkeypatch.setattr(jaccard, "_runs", watched)
    deep, flat = family(spark, 400, 0.5), family(spark, 200, 0.05, 1000, 8)
    pairs = family(spark, 2, 0.95, 2000, 9)
    got = {frozenset((r.u, r.v)) for r in jaccard.candidates(deep.union(flat).union(pairs), depth=3, small=20).collect()}
    assert len(given) >= 2 and len(given[0]) == 602
    assert len(given[1] & set(range(400))) >= 380 and not given[1] & set(range(1000, 2002))
    assert frozenset((2000, 2001)) in got


def test_runs_follow_target_and_depth():
    assert jaccard.survival(0) == 1 and abs(jaccard.survival(1) - 0.632) < 1e-3
    assert jaccard.runs_for(0.99, 1) == 5
    assert jaccard.runs_for(0.999, 1) < jaccard.runs_for(0.999, 4) < jaccard.runs_for(0.999, 12)


def test_numbers_survive_another_layout(spark, tmp_path, monkeypatch):
    """The table is read in other partitions by every job; the result is that of all pairs."""
    rows = corpus(9, 120)
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(path)
    relayout(spark, monkeypatch, jaccard)
    check(spark.read.parquet(path), rows)


def test_awkward_rows(spark):
    check(documents(spark), [(r[0], r[1]) for r in ROWS])


def test_empty(spark):
    assert jaccard.join(documents(spark, [])).collect() == []
    assert [r.kept for r in jaccard.join(documents(spark, ROWS[1:4])).collect()] == [True] * 3
