"""Frames written once to the folder that all executors share, and joins whose small side is counted before it is broadcast."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of names or paths that are broadcast at most, about 25 MB.
SMALL = 100_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of this machine where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/quire"


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet and read back: whatever reads it sees the same rows in the same files, whoever is lost.

    discard() deletes it when nothing reads it any more; else it goes when the session ends.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, fs = _at(df.sparkSession, path)
    fs.deleteOnExit(at)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stage = path
    return out


def discard(*stages: DataFrame) -> None:
    for df in stages:
        at, fs = _at(df.sparkSession, df.stage)
        fs.delete(at, True)


def small_side(side: DataFrame, most: int = SMALL) -> DataFrame:
    """side with a broadcast hint if it has at most most rows, else as it is."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side
