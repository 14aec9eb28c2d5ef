"""What the operators share: the shared folder, written and numbered tables, connected components."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of (long, long) that may be broadcast; a larger side is joined by shuffling.
BROADCAST_ROWS = 2_000_000

#: Bytes of a row group of written tables: what a writing task buffers, which is memory that Python's workers lack.
ROW_GROUP = 16 << 20


#: The folders that the work going on here has named: each thread, and each `owned` block, has its own.
_OWN: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("own", default=None)


@contextlib.contextmanager
def owned() -> Iterator[list[str]]:
    """The folders that are named inside the block; those still listed at its end belong to the block around it."""
    folders: list[str] = []
    token = _OWN.set(folders)
    try:
        yield folders
    finally:
        _OWN.reset(token)
        if (outer := _OWN.get()) is not None:
            outer.extend(folders)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors see, under spark.checkpoint.dir.

    Where the session sets none, a session on one machine uses /tmp/checkpoints and clears it at
    the end; a session on several has no folder that all its machines see, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    name = f"tidemark-{uuid.uuid4().hex}"
    if base:
        path = f"{base.rstrip('/')}/{name}"
        atexit.register(_clear, spark, path)
    elif spark.sparkContext.master.startswith("local"):
        path = f"file:///tmp/checkpoints/{name}"
        atexit.register(shutil.rmtree, f"/tmp/checkpoints/{name}", ignore_errors=True)
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    if (own := _OWN.get()) is not None:
        own.append(path)
    return path


def release(folders: list[str], docs: DataFrame) -> None:
    """Delete those folders of one's own that docs does not read; folders then lists what is left."""
    read = {part for f in docs.inputFiles() for part in f.split("/") if part.startswith("tidemark-")}
    keep = [f for f in folders if f.rpartition("/")[2] in read]
    for f in folders:
        if f not in keep:
            _clear(docs.sparkSession, f)
    folders[:] = keep


def _clear(spark: SparkSession, path: str) -> None:
    """Delete a folder of this program's, when the program ends and if its session still runs."""
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session or its gateway has ended; nothing can be deleted through it
        pass


def give_back() -> None:
    """Return what a task has freed to the system, as its worker lives on beside the next task's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder and read back.

    It cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores, so that no column of df is called so in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, row: str) -> DataFrame:
    """df with a column `row` that tells its rows apart, written once.

    A number is given by the job that writes it and never again: a plan that reads df twice
    may see its rows in other partitions when executors come or go, but reads this table alike.
    """
    return written(df.withColumn(row, F.monotonically_increasing_id()))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: (node, component), component its smallest node.

    edges: columns u, v (long). Alternates large-star and small-star joins; every round is
    written, and the loop ends when a round changes nothing, after some log(nodes) rounds.
    Nodes without an edge to another node are absent. A node of very high degree is only ever
    the join's skewed side or the key of a pre-aggregated minimum.
    """

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = (
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = written(e)
    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        e = written(small)
        now = mark(e)
        if now == before:
            break
        before = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()


def united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label (each node's smallest known fellow) after joining all pairs (i, j)."""
    a, b = label[i], label[j]
    while (a != b).any():
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        label, a, b = root[label], root[a], root[b]
    return label
