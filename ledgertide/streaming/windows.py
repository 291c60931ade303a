"""Event-time windows and sessions of events (event_id, ts, user_id, event_type, value). The same functions take tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, schema: StructType | str, files: int = 1000) -> DataFrame:
    """The Parquet files of a folder, or those that a pattern names, as a stream, `files` of them at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def timed(events: DataFrame, delay: str | None = None) -> DataFrame:
    """events with ts as an instant; as a stream, with a watermark that lags the latest ts by delay. Rows without ts are left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).where("ts IS NOT NULL")
    return rows.withWatermark("ts", delay) if delay else rows


def _exact_sum(value: Column) -> Column:
    """A sum that doesn't depend on the order of rows."""
    return F.sum(value.cast("decimal(28,6)")).cast("double")


def windowed(events: DataFrame, size: str, slide: str | None = None, keys: tuple[str, ...] = ("event_type",), delay: str | None = None) -> DataFrame:
    """(keys, start, end, n, open, high, low, close, total) of each window: tumbling, or sliding by `slide`.

    open and close are the values of the first and last row by (ts, event_id). Null values count in n only, unless a window's first or
    last row has one. Tasks merge their rows before the shuffle, so a hot key sends one row for a window and task. On a
    stream with a delay, rows whose windows the watermark has passed are dropped, and a window comes out once it is passed.
    """
    at, rank = F.window("ts", size, slide), F.struct("ts", "event_id")
    found = timed(events, delay).groupBy(at.alias("window"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("value", rank).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", rank).alias("close"), _exact_sum(F.col("value")).alias("total")
    )
    return found.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "open", "high", "low", "close", "total")


def session_stream(events: DataFrame, gap: str, delay: str, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """(keys, start, last, n, total) of each session of a stream: rows of a key at most `gap` apart. A session comes out once the watermark
    has passed its end by the gap; rows that come later than that are dropped."""
    found = timed(events, delay).groupBy(F.session_window("ts", gap).alias("window"), *keys)
    return found.agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"), _exact_sum(F.col("value")).alias("total")).select(*keys, "start", "last", "n", "total")


def sessions(events: DataFrame, gap_seconds: int, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """(keys, start, last, n, total) of each session of a table: rows of a key at most `gap_seconds` apart.

    Rows are first merged in bins as wide as the gap, which never hold two sessions, before the shuffle; only bins are
    ordered. So what one task orders of a hot key grows with the time it covers, not with its rows. Rows without ts are left out,
    a null key is a key of its own.
    """
    if gap_seconds < 1:
        raise ValueError("the gap needs a second at least")
    rows = timed(events)
    bin_ = F.floor(F.unix_micros("ts") / F.lit(gap_seconds * 1_000_000)).alias("bin")
    bins = rows.groupBy(*keys, bin_).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(28,6)")).alias("total"))
    by_key = Window.partitionBy(*keys).orderBy("bin")
    apart = F.unix_micros("start") - F.unix_micros(F.lag("last").over(by_key)) > gap_seconds * 1_000_000
    numbered = bins.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("session", F.sum("new").over(by_key))
    found = numbered.groupBy(*keys, "session").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"))
    return found.drop("session")


def drained(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Runs a stream over what its source holds now and appends to Parquet at target. With the same checkpoint the next run goes on
    where this one ended, with its state and watermark; files are in the result once, however often a run fails."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()
