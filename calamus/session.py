"""Session helpers: lineage cuts in the shared folder, and sizes that decide a plan."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows below which a side may be broadcast after it has been counted.
BROADCAST_ROWS = 200_000
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session. Where it is unset, a temporary one if the
    session runs on one machine (tests), else an error: executors could not read each other's tables."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="calamus-shared-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", "file://" + found)
        found = "file://" + found
    return found.rstrip("/")


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system names it, where it lies in a mounted file system; else (an object store, HDFS) None.
    Hadoop says what a path without a scheme means."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def clear(spark: SparkSession) -> None:
    """Remove the tables that operators have written in this session. Frames that read them are of no use afterwards."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        at = jvm.org.apache.hadoop.fs.Path(_written.pop())
        at.getFileSystem(conf).delete(at, True)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below `shared_dir`; `clear` removes what is written there."""
    _written.append(f"{shared_dir(spark)}/calamus/{label}-{uuid.uuid4().hex[:12]}")
    return _written[-1]


def materialize(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write the rows as a Parquet table in the shared folder and read them back: the lineage ends there, and a lost
    executor costs a re-read, not a recomputation."""
    path = shared_path(df.sparkSession, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path) if not partition_by else df.sparkSession.read.parquet(path)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether the frame has at most so many rows; reads no more than that many and one."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only where a count proves the bound; else the frame as it is (a shuffled join, with AQE for skew)."""
    return F.broadcast(df) if small_enough(df, rows) else df
