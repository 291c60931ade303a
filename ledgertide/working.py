"""Working tables, and broadcasts behind a check of their size."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a broadcast table has at most.
MOST_BROADCAST = 100_000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under spark.checkpoint.dir, which every executor can reach. Only in local mode may that be unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/ledgertide/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, with no lineage and no executor's disk behind it. It lives as
    long as that folder does."""
    return stored_at(df, shared_dir(df.sparkSession, name))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table in a folder of shared_dir(), which discard() takes away again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder of shared_dir(), once nothing that is still to be computed reads it."""
    if "/ledgertide/" not in path:
        raise ValueError(f"{path} is no working table")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, to be broadcast where it has at most `most` rows, which are counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
