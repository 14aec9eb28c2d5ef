"""Session factory for tests and the bench; a cluster brings its own session."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | None = None, partitions: int = 8, memory: str = "8g") -> SparkSession:
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the input tables; a plain parquet scan, so filters and columns reach it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors see, under spark.checkpoint.dir; on one machine /tmp serves."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    path = f"{(base or 'file:///tmp/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_clear, spark, path)
    return path


def written(df, name: str):
    """The rows of df, written once to a scratch folder and read back: later plans start there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clear(spark: SparkSession, path: str) -> None:
    """Delete a folder of this program's, if its session still runs."""
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session or its gateway has ended; nothing can be deleted through it
        pass
