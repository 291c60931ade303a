"""The library in SQL: tables and derived tables as views, its rules as SQL functions, and its table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.functions import tables
from ledgertide.operators import market as M
from ledgertide.plans import corpus

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Rules as functions of SQL; Catalyst puts their bodies in place of the calls, so they are pushed down and generated like any expression.
FUNCTIONS = {
    "record_key(source STRING, id STRING, event_date STRING) RETURNS STRING": "substr(sha2(concat_ws(':', source, id, event_date), 256), 1, 16)",
    "pct_change(before DOUBLE, after DOUBLE) RETURNS DOUBLE": "try_divide(after, before) - 1",
    "on_scale(x DOUBLE, scale DOUBLE) RETURNS DOUBLE": "greatest(-1D, least(1D, x / scale))",
}


def series_days(series: DataFrame, tolerance: int = M.TOLERANCE_DAYS) -> DataFrame:
    """(symbol, day, date_used, close): of every day the latest row of a series on or before it, `tolerance` days back at most. So the as-of rule is
    an equality of symbol and day in SQL."""
    days = series.select("symbol", F.explode(F.sequence("date", F.date_add("date", tolerance))).alias("requested_date")).distinct()
    return M.asof(days, series.select("symbol", "date", "close"), tolerance).withColumnRenamed("requested_date", "day")


def register(spark: SparkSession, sf_dir: str) -> None:
    """Views of the tables under sf_dir, of registry, closes, and closes_by_day; and the functions, all temporary."""
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    corpus.registry(spark, sf_dir).createOrReplaceTempView("registry")
    closes = M.daily_closes(spark.table("events"))
    closes.createOrReplaceTempView("closes")
    series_days(closes).createOrReplaceTempView("closes_by_day")
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    tables.register(spark)


def query(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The result of a statement over the views and functions."""
    register(spark, sf_dir)
    return spark.sql(text)
