"""Queries on event time: windows and sessions of events as a table, and as a stream that is read to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.catalog import table
from ledgertide.streaming import state as S
from ledgertide.streaming import windows as W
from ledgertide.working import shared_dir

DELAY, GAP_SECONDS = "2 hours", 6 * 3600


def _shown(windows: DataFrame) -> DataFrame:
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return windows.select("event_type", at("start"), at("end"), "n", "open", "high", "low", "close", "total")


def _shown_sessions(found: DataFrame) -> DataFrame:
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n", "total")


def event_windows(spark, sf_dir):
    return _shown(W.windowed(table(spark, sf_dir, "events"), "1 hour"))


def event_windows_sliding(spark, sf_dir):
    return _shown(W.windowed(table(spark, sf_dir, "events"), "1 hour", "15 minutes"))


def user_sessions(spark, sf_dir):
    return _shown_sessions(W.sessions(table(spark, sf_dir, "events"), GAP_SECONDS))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.event_stream(spark, f"{sf_dir}/events.{{parquet}}", table(spark, sf_dir, "events").schema)


def _read_to_end(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    target = shared_dir(spark, name)
    W.drained(stream, target, shared_dir(spark, f"{name}-progress"))
    return spark.read.schema(stream.schema).parquet(target)


def stream_windows(spark, sf_dir):
    """The windows that the watermark has passed when the stream ends."""
    return _shown(_read_to_end(W.windowed(_stream(spark, sf_dir), "1 hour", delay=DELAY), "stream-windows"))


def stream_sessions(spark, sf_dir):
    """The sessions that the watermark has passed when the stream ends."""
    return _shown_sessions(_read_to_end(W.session_stream(_stream(spark, sf_dir), f"{GAP_SECONDS} seconds", DELAY), "stream-sessions"))


def stream_volatility(spark, sf_dir):
    """Closes and volatility of the days that the watermark has passed when the stream ends."""
    with S.state_store(spark):
        found = _read_to_end(S.volatility_stream(_stream(spark, sf_dir), DELAY), "stream-volatility")
    return found.select("symbol", F.col("date").cast("string").alias("date"), "close", F.round("ret", 8).alias("ret"), F.round("volatility_5d", 8).alias("volatility_5d"))


QUERIES = {f.__name__: f for f in (event_windows, event_windows_sliding, user_sessions, stream_windows, stream_sessions, stream_volatility)}

_PASSED = "(SELECT max(ts) - INTERVAL 2 HOUR FROM events)"
_WINDOWS = """SELECT event_type, strftime(s, '%Y-%m-%d %H:%M:%S') AS "start", strftime(s + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n, arg_min(value, {{'ts': ts, 'id': event_id}}) AS open, max(value) AS high,
 min(value) AS low, arg_max(value, {{'ts': ts, 'id': event_id}}) AS close, CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS total FROM {rows} WHERE {where} GROUP BY event_type, s"""
_HOURS = "(SELECT *, date_trunc('hour', ts) AS s FROM events WHERE ts IS NOT NULL) e"
_SLIDING = "(SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS s FROM events, range(0, 4) t(k) WHERE ts IS NOT NULL) e"
_SESSIONS = """SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS total FROM
 (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new
 FROM events WHERE ts IS NOT NULL) a) b GROUP BY user_id, session"""

ORACLES = {
    "event_windows": _WINDOWS.format(rows=_HOURS, where="TRUE"),
    "event_windows_sliding": _WINDOWS.format(rows=_SLIDING, where="TRUE"),
    "user_sessions": _SESSIONS,
    "stream_windows": _WINDOWS.format(rows=_HOURS, where=f"s + INTERVAL 1 HOUR <= {_PASSED}"),
    "stream_sessions": _SESSIONS + f" HAVING max(ts) + INTERVAL 6 HOUR <= {_PASSED}",
    "stream_volatility": f"""WITH days AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS date, arg_max(value, {{'ts': ts, 'id': event_id}}) AS close FROM events WHERE ts IS NOT NULL GROUP BY 1, 2),
 returns AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS ret FROM days WHERE date + INTERVAL 1 DAY <= {_PASSED})
 SELECT symbol, CAST(date AS VARCHAR) AS date, close, round(ret, 8) AS ret, round(CASE WHEN count(ret) OVER w = 5 THEN stddev_samp(ret) OVER w ELSE 0 END, 8) AS volatility_5d FROM returns WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING)""",
}
