import hashlib
import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm import sharding

from .helpers import ROWS, documents, relayout


def brute(key, tree):
    """The shard by the draws alone, node by node."""
    weigh = lambda x: float(x) if isinstance(x, (int, float)) else sum(map(weigh, x))

    def best(nodes, path):
        draw = lambda i: math.log((int(hashlib.md5(f"{key}:{path}{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13) / weigh(nodes[i])
        return max((i for i in range(len(nodes)) if weigh(nodes[i]) > 0), key=draw)

    r = best(tree, "")
    k = best(tree[r], f"{r}/")
    s = best(tree[r][k], f"{r}/{k}/")
    return sum(len(y) for x in tree[:r] for y in x) + sum(map(len, tree[r][:k])) + s


def check(df, rows, tree=sharding.TREE):
    got = df.collect()
    want = []
    for r in rows:
        b, key = (r[1] or "").encode(), "null" if r[0] is None else r[0]
        want.append((r[0], len(b) + 8, zlib.crc32(b), "key", brute(key, tree), brute(key, sharding.grown(tree))))
    assert sorted(map(repr, want)) == sorted(repr((x.doc_id, x.size, x.text_crc32, x.law, x.shard, x.grown_shard)) for x in got)
    slots = defaultdict(list)
    for x in got:
        slots[x.shard].append(x)
    for own in slots.values():
        own.sort(key=lambda x: x.slot)
        assert [x.slot for x in own] == list(range(len(own)))
        order = [(x.doc_id is not None, x.doc_id or 0, x.text_crc32, x.size) for x in own]
        assert order == sorted(order)
    return got


def test_equals_brute_force_and_moves_into_the_new_shard_only(spark, monkeypatch):
    relayout(spark, monkeypatch, sharding)
    rows = [(i, f"text {i % 50}") for i in range(4000)]
    got = check(sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), rows)
    new = sum(map(len, (y for x in sharding.TREE for y in x)))
    assert all(x.grown_shard in (x.shard, new) for x in got)
    n = Counter(x.shard for x in got)
    assert set(n) == set(range(24)) and max(n.values()) < 1.4 * min(n.values())
    moved = sum(x.grown_shard == new for x in got)
    assert 0.6 < moved / (len(got) / 25) < 1.4


def test_weights_draw_and_confine_movement(spark):
    tree = (((1.0, 2.0), (1.0,)), ((3.0, 0.0, 1.0),))
    more = (((1.0, 4.0), (1.0,)), ((3.0, 0.0, 1.0),))
    d = spark.range(6000).select(F.col("id").cast("string").alias("key"))
    d = sharding.assign(sharding.assign(d, F.col("key"), tree, "a"), F.col("key"), more, "b")
    got = d.collect()
    n = Counter(x.a for x in got)
    assert 4 not in n
    for shard, weight in ((0, 1), (1, 2), (2, 1), (3, 3), (5, 1)):
        assert abs(n[shard] / 6000 - weight / 8) < 0.03
    assert [x.a for x in got] == [brute(x.key, tree) for x in got]
    for x in got:
        if x.a != x.b:  # into the region of the shard that grew, within it into its rack, within that to it
            assert x.b in (0, 1, 2) and (x.a >= 3 or x.b in (0, 1)) and (x.a != 0 or x.b == 1)


def test_awkward(spark):
    check(sharding.shard(documents(spark)), ROWS)
    assert sharding.shard(documents(spark, [])).count() == 0
    same = [(None, "equal")] * 300 + [(7, None)] * 200
    check(sharding.shard(spark.createDataFrame(same, "doc_id long, text string")), same)


def test_no_python_on_the_executors(spark):
    plan = sharding.shard(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
