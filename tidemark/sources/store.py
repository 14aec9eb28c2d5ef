"""A partitioned store that new rows are merged into: what is unchanged is not rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

#: Partitions that a merge names one by one in its filters; more are found by a join.
NAMED = 10_000


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _hash(row, columns: list[str]):
    """A number for a set of rows, whatever their order: the sum of their hashes; nulls count nothing."""
    one = F.when(row.isNotNull(), F.xxhash64(*[row[c] for c in columns]).cast("decimal(38,0)"))
    return F.coalesce(F.sum(one), F.lit(0).cast("decimal(38,0)"))


def _those(rows: DataFrame, by: str, parts: DataFrame) -> DataFrame:
    """Rows of these partitions only; a filter on the folders if they are few."""
    names = [r[0] for r in parts.select(by).limit(NAMED + 1).collect()]
    if len(names) <= NAMED:
        known = [n for n in names if n is not None]
        null = F.col(by).isNull() if len(known) < len(names) else F.lit(False)
        return rows.where(F.col(by).isin(known) | null)
    p = parts.select(F.col(by).alias("_by")).distinct()
    return rows.join(p, F.col(by).eqNullSafe(F.col("_by")), "left_semi")


def merge(new: DataFrame, path: str, keys: list[str], by: str, compare: list[str] = (), tolerance: float = 0.08, on_conflict: str = "keep") -> DataFrame:
    """Merge rows into the store at path, one folder a value of `by`: a report, one row for each partition met.

    A row of a new key is added. A row of a key that is there is the same if its numbers `compare`
    differ by no more than `tolerance` in sum (nulls alike), and a conflict otherwise; the old row
    stays, or gives way if on_conflict is `replace`; with `error` nothing is written and
    ValueError is raised. Of new rows with one key the greatest counts. A partition is rewritten if
    its rows' hash changes, sorted by keys and swapped in by the writer's commit; others are neither
    written nor, unless new rows fall into them, read.

    Report: `by`, rows_before, added, conflicts, rows_after, hash, rewritten. It is appended to
    the ledger beside the store once the rows are there, so a merge that died is known by its absence
    and is repeated: merging the same rows again changes nothing. Keys may be null (alike); an
    empty table merges nothing. One merge at a time.
    """
    spark, columns = new.sparkSession, new.columns
    if on_conflict not in ("keep", "replace", "error"):
        raise ValueError(f"on_conflict is keep, replace or error, not {on_conflict}")
    whole = lambda name, when: F.max(F.when(when, F.struct(*columns))).alias(name)
    n = written(new, "merge-new")
    both = n.withColumn("_new", F.lit(True))
    if exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path).select(*columns)
        both = both.unionByName(_those(old, by, n.select(by).distinct()).withColumn("_new", F.lit(False)))
    key = [F.col(c).alias(f"_k{i}") for i, c in enumerate((by, *keys))]
    m = both.groupBy(*key).agg(whole("old", ~F.col("_new")), whole("new", F.col("_new")))
    o, w = F.col("old"), F.col("new")
    off = sum((F.when(o[c].eqNullSafe(w[c]), 0.0).otherwise(F.coalesce(F.abs(o[c] - w[c]), F.lit(float("inf")))) for c in compare), F.lit(0.0))
    conflict = o.isNotNull() & w.isNotNull() & (off > tolerance)
    row = F.when(o.isNull() | conflict, w).otherwise(o) if on_conflict == "replace" else F.coalesce(o, w)
    m = written(m.select(o, w, row.alias("row"), conflict.alias("conflict"), F.col("_k0").alias("_by")), "merge-rows")
    report = m.groupBy(F.col("_by").alias(by)).agg(
        F.count("old").alias("rows_before"),
        F.count_if(o.isNull()).alias("added"),
        F.count_if("conflict").alias("conflicts"),
        F.count("*").alias("rows_after"),
        _hash(F.col("row"), columns).alias("hash"),
        (_hash(F.col("row"), columns) != _hash(o, columns)).alias("rewritten"),
    )
    report = written(report, "merge-report")
    if on_conflict == "error" and not report.where("conflicts > 0").isEmpty():
        raise ValueError("rows conflict with the store: " + ", ".join(str(r[0]) for r in report.where("conflicts > 0").select(by).limit(10).collect()))
    changed = report.where("rewritten")
    if not changed.isEmpty():
        rows = _those(m.select("row.*"), by, changed).hint("rebalance", by)
        rows.sortWithinPartitions(by, *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    report.withColumn("merged_at", F.current_timestamp()).write.mode("append").parquet(ledger(path))
    return report


def ledger(path: str) -> str:
    return f"{path.rstrip('/')}_ledger"


def verify(spark: SparkSession, path: str, schema, by: str) -> DataFrame:
    """by, rows, hash and `intact`: whether each partition is as the last merge that met it left it;
    a partition that is there or in the ledger alone is not."""
    rows, columns = spark.read.schema(schema).parquet(path), schema.fieldNames()  # a reader moves `by` to the end
    now = rows.select(F.struct(*columns).alias("row")).groupBy(F.col(f"row.{by}").alias(by)).agg(F.count("*").alias("rows"), _hash(F.col("row"), columns).alias("hash"))
    last = spark.read.parquet(ledger(path)).groupBy(F.col(by).alias("_by")).agg(F.max_by(F.struct("hash", "rows_after"), "merged_at").alias("last"))
    d = now.join(last, F.col(by).eqNullSafe(F.col("_by")), "full_outer")
    intact = F.coalesce((F.col("hash") == F.col("last.hash")) & (F.col("rows") == F.col("last.rows_after")), F.lit(False))
    return d.select(F.coalesce(by, "_by").alias(by), F.coalesce("rows", F.lit(0)).alias("rows"), "hash", intact.alias("intact"))
