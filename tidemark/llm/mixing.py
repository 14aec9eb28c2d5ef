"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, numbered, written

WORD = r"[^\x20\x09-\x0D]+"
#: Bins of the key's logarithm, per unit: whatever the weights, a bin holds no more than about
#: 0.37 / BINS of a source's documents, for that is the greatest density of such logarithms.
BINS = 2000


def placed(df: DataFrame, position: str) -> DataFrame:
    """df, written, with its rows' places from 0 in the order of partitions and of rows within them;
    the partitions' sizes alone (one number each) come to the driver."""
    at = free_name(df, "at")
    rows = numbered(df, at)
    part = F.shiftright(at, 33)
    sizes = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, upto = [], 0
    for p, n in sizes:
        before += [F.lit(p), F.lit(upto).cast("long")]
        upto += n
    base = F.element_at(F.create_map(*before), part) if before else F.lit(0).cast("long")
    return rows.withColumn(position, base + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at)


def positions(df: DataFrame, *order) -> DataFrame:
    """df with `position`, its rows' places from 0 in the given order: a range sort. Rows must differ in the order."""
    parts = max(1, df.sparkSession.sparkContext.defaultParallelism)
    return placed(df.repartitionByRange(parts, *order).sortWithinPartitions(*order), "position")


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> with `target`, the words that the mix takes of it.

    Sources in code-point order, null last, have the weights, repeating. Together they get
    `share` of all sizes; no target exceeds `most` times its source's size, and what is
    above goes to the others by weight. The level of that water filling is found by
    one-row aggregates, so no list of sources reaches the driver.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = positions(sizes, F.col("source").asc_nulls_last())
    s = written(s.withColumn("weight", F.element_at(w, (F.col("position") % len(weights) + 1).cast("int"))).drop("position"))
    total = s.agg(F.sum("source_size"), F.sum("weight")).first()
    all_words, level = total[0] or 0, 0.0
    if all_words:
        level, capped = share * all_words / total[1], -1
        while True:
            over = F.col("weight") * F.lit(level) > F.col("source_size") * F.lit(most)
            got = s.agg(
                F.coalesce(F.sum(F.when(over, F.col("source_size") * F.lit(most))), F.lit(0.0)),
                F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)),
                F.count_if(over),
            ).first()
            if got[2] == capped or not got[1]:
                break
            level, capped = (share * all_words - got[0]) / got[1], got[2]
    return s.withColumn("target", F.least(F.col("source_size") * F.lit(float(most)), F.col("weight") * F.lit(level)))


def quality_weight(text):
    """Share of letters, digits and white space in a text, from 0.05 to 1; 0.05 for null or empty."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", ""))
    return F.coalesce(F.greatest(F.lit(0.05), kept / F.nullif(F.length(text), F.lit(0))), F.lit(0.05))


def uniform(same, which, seed: int):
    """A number between 0 and 1 by a hash of a document and which of its equals it is."""
    return (F.xxhash64(same, which, F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)


def keyed(docs: DataFrame, seed: int, keep=(), row: str | None = None) -> DataFrame:
    """Each document's row, doc_id, columns of keep, source, skey, size, th, key and bin, written."""
    n = docs.columns
    text, doc_id = docs["text"], docs["doc_id"]
    nth = F.monotonically_increasing_id() if row is None else docs[row]
    base = docs.select(
        nth.alias("row"),
        doc_id.alias("doc_id"),
        *[docs[c].alias(c) for c in keep if c in n],
        docs["source"].alias("source"),
        F.when(docs["source"].isNull(), "n").otherwise(F.concat(F.lit("s"), docs["source"])).alias("skey"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text).alias("th"),
        quality_weight(text).alias("quality"),
    )
    # which of its equals a row is, by its number: within a partition, after those of the partitions before
    base = written(base.withColumns({"same": F.xxhash64("doc_id", "th", "skey"), "part": F.shiftright("row", 33)}))
    before = Window.partitionBy("same").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    equals = base.groupBy("same", "part").agg(F.count("*").alias("n")).select("same", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    base = base.join(equals, ["same", "part"])
    base = base.withColumn("which", F.col("before").cast("int") + F.row_number().over(Window.partitionBy("same", "part").orderBy("row")))
    base = base.withColumn("key", -F.ln(uniform(F.col("same"), F.col("which"), seed)) / F.col("quality"))
    return written(base.withColumn("bin", F.floor(F.ln("key") * BINS).cast("int")).drop("same", "part", "before", "which", "quality"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, keep=(), row: str | None = None) -> DataFrame:
    """How often each document goes into the mix.

    docs: doc_id, text, source. Returns one row per document: row (its number), doc_id, the
    columns of keep, size, source_size, target, copies, taken = copies * size.

    Every document is taken in as many complete epochs as its source's target holds. The
    rest of the target is a weighted sample without replacement: keys -ln(u) / quality,
    sorted within the source and summed up to the budget. The cut is found by the sums of
    bins of the key's logarithm, then in the one bin it falls into, so a source with any share
    of the rows never meets in one task. One closing document, whose size is nearest to what is
    left, follows. u hashes doc_id, text, source, seed and, of rows equal in those, which of them
    it is: reruns agree, and equal rows are drawn apart. Ties of keys go to the smaller size, then
    the hash of the text.

    Null text has size 0 and weight 0.05, null source is a source of its own, null doc_id
    hashes like any value, repeated rows count each; texts without a word are taken like others
    and count nothing; an empty table gives no rows. row: a column of a written table that
    numbers its rows; without one rows get numbers here.
    """
    n = docs.columns
    base = keyed(docs, seed, keep, row)
    sizes = base.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = plan.select("skey", "source_size", "target", "epochs", "rest")

    in_order = Window.partitionBy("skey").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = base.groupBy("skey", "bin").agg(F.sum("size").alias("words"))
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(in_order), F.lit(0)))
    cut = (
        bins.join(plan, "skey")
        .where("rest > 0 and before <= rest and rest < before + words")
        .select("skey", F.col("bin").alias("cut_bin"), "before")
    )
    plan = written(plan.join(cut, "skey", "left"))

    d = base.join(plan, "skey")
    by_key = Window.partitionBy("skey").orderBy("key", "size", "th", "row").rowsBetween(Window.unboundedPreceding, 0)
    edge = d.where("bin = cut_bin").withColumn("upto", F.col("before") + F.sum("size").over(by_key))
    edge = written(edge.select("skey", "row", (F.col("upto") <= F.col("rest")).alias("fits"), "size"))
    filled = edge.groupBy("skey").agg(F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).alias("edge_words"))
    d = d.join(filled, "skey", "left").join(edge.select("row", "fits"), "row", "left")
    # a rest of nothing takes nothing more, not even texts without words
    d = d.withColumn("sampled", F.coalesce("fits", F.col("bin") < F.col("cut_bin"), F.lit(False)) & (F.col("rest") > 0))
    gap = F.col("rest") - F.coalesce("before", F.lit(0)) - F.coalesce("edge_words", F.lit(0))
    closing = (
        d.where(~F.col("sampled") & (F.col("size") > 0) & (F.abs(F.col("size") - gap) < gap))
        .groupBy("skey")
        .agg(F.min(F.struct(F.abs(F.col("size") - gap).alias("off"), "key", "th", "row")).alias("c"))
        .select(F.col("c.row").alias("row"), F.lit(1).alias("closes"))
    )
    d = d.join(closing, "row", "left")
    copies = (F.col("epochs") + F.when(F.col("sampled") | F.col("closes").isNotNull(), 1).otherwise(0)).cast("long")
    return d.withColumn("copies", copies).select(
        "row",
        "doc_id",
        *[c for c in keep if c in n],
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )
