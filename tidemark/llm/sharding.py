"""Documents dealt to shards by a weighted hash tree of regions, racks and shards, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered
from .mixing import positions

#: Regions of racks of shards' weights: 2 x 3 x 4 shards alike.
TREE = tuple(tuple((1.0,) * 4 for _ in range(3)) for _ in range(2))
#: Hexadecimal digits of a hash that make its number: 52 bits, which a double holds.
DIGITS = 13


def grown(tree, weight: float = 1.0):
    """The tree with one more shard, in a rack and a region of its own: no weight that was there
    changes, so only the new region's draws can take a document away."""
    return (*tree, ((weight,),))


def total(node) -> float:
    return float(node) if isinstance(node, (int, float)) else math.fsum(map(total, node))


def _draw(key: Column, path: Column, weight: Column) -> Column:
    """ln(u) / weight with u from the hash of key and node: the greatest of siblings wins each with a
    chance in proportion to its weight, and a weight that grows draws documents to its node alone."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", key, path).cast("binary")), 1, DIGITS), 16, 10).cast("double")
    return F.ln((h + 0.5) / F.lit(float(16**DIGITS))) / weight


def _nodes(nodes: list[tuple[str, float, int]]) -> Column:
    """Siblings (path, weight, place) as an array; a node of weight 0 takes nothing and is left out."""
    one = [F.struct(F.lit(p).alias("path"), F.lit(w).alias("weight"), F.lit(i).alias("place")) for p, w, i in nodes if w > 0]
    return F.array(*one) if one else F.array().cast("array<struct<path:string,weight:double,place:int>>")


def _best(key: Column, nodes: Column) -> Column:
    """The place of the sibling with the greatest draw; ties, if any, go to the first."""
    drawn = F.transform(nodes, lambda n: F.struct(_draw(key, n["path"], n["weight"]).alias("draw"), (-n["place"]).alias("back")))
    return -F.array_max(drawn)["back"]


def assign(df: DataFrame, key: Column, tree, shard: str) -> DataFrame:
    """df with the shard (numbered through the tree from 0) that the key's descent ends in.

    Three levels of draws, each among the children of the node chosen above: regions weigh as much
    as their racks, racks as much as their shards. A shard whose weight changes moves documents
    into or out of its own region only; within it, its rack's; all others stay.
    """
    regions = _nodes([(f"{r}", total(x), r) for r, x in enumerate(tree)])
    racks = F.array(*[_nodes([(f"{r}/{k}", total(y), k) for k, y in enumerate(x)]) for r, x in enumerate(tree)])
    leaves, first, n = [], [], 0
    for r, x in enumerate(tree):
        leaves.append(F.array(*[_nodes([(f"{r}/{k}/{s}", float(w), s) for s, w in enumerate(y)]) for k, y in enumerate(x)]))
        starts = []
        for y in x:
            starts.append(F.lit(n))
            n += len(y)
        first.append(F.array(*starts))
    a, b, c = (f"_{shard}_{x}" for x in ("region", "rack", "leaf"))
    d = df.withColumn(a, _best(key, regions))
    d = d.withColumn(b, _best(key, F.get(racks, F.col(a))))
    d = d.withColumn(c, _best(key, F.get(F.get(F.array(*leaves), F.col(a)), F.col(b))))
    return d.withColumn(shard, (F.get(F.get(F.array(*first), F.col(a)), F.col(b)) + F.col(c)).cast("int")).drop(a, b, c)


def shard(docs: DataFrame, tree=TREE) -> DataFrame:
    """doc_id, size, text_crc32, law (`key`), shard, slot, grown_shard.

    docs: doc_id, text. size is the text's UTF-8 bytes plus 8, text_crc32 the unsigned crc32 of those
    bytes; null text counts as empty in both. doc_id and the tree alone decide the shard: equal ids lie in one shard
    (null ids as `null`), equal texts of different ids need not. grown_shard is the shard under the
    tree with one more, which takes documents only into itself. Slots number a shard's documents
    from 0 without gaps, by doc_id (null first), text_crc32, size; rows equal in these in any order.

    Texts are read once and not shuffled; the rows of numbers are written and sorted by ranges of
    (shard, doc_id, ..., row number), so neither a large shard nor rows that are all equal
    meet in one task. A number a range and one a shard come to the driver. An empty table
    gives no rows; other columns are ignored.
    """
    text = docs["text"].cast("binary")
    d = docs.select(
        docs["doc_id"],
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0).cast("long")).alias("text_crc32"),
        F.coalesce(docs["doc_id"].cast("string"), F.lit("null")).alias("key"),
    )
    d = assign(assign(d, F.col("key"), tree, "shard"), F.col("key"), grown(tree), "grown_shard")
    rows = positions(numbered(d.drop("key"), "row"), "shard", "doc_id", "text_crc32", "size", "row")
    starts = {r["shard"]: r["p"] for r in rows.groupBy("shard").agg(F.min("position").alias("p")).collect()}
    start = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(starts.items()) for x in kv]), F.col("shard")) if starts else F.lit(0)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("position") - start).cast("long").alias("slot"), "grown_shard")
