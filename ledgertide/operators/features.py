"""Feature vectors of market states, supervised windows, forecast bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEQUENCE, Z_80 = 5, 1.2816
NEAR_ZERO = 1e-12
VECTOR = ["date", "sentiment_score", "market_close", "market_volatility", "close_change_pct", "volatility_change"]


def _by_day() -> Window:
    return Window.partitionBy("symbol").orderBy("date")


def vectors(series: DataFrame) -> DataFrame:
    """(symbol, VECTOR...) from (symbol, date, close, volatility_5d, sentiment_score); rows without date are left out."""
    close, before = F.col("close"), F.lag("close").over(_by_day())
    change = F.when(F.abs(before) > NEAR_ZERO, (close - before) / before).otherwise(0.0)
    moved = F.coalesce(F.col("volatility_5d") - F.lag("volatility_5d").over(_by_day()), F.lit(0.0))
    rows = series.where("date IS NOT NULL")
    return rows.select("symbol", "date", "sentiment_score", close.alias("market_close"), F.col("volatility_5d").alias("market_volatility"), change.alias("close_change_pct"), moved.alias("volatility_change"))


def clamped(value: Column) -> Column:
    return F.greatest(F.least(value, F.lit(1.0)), F.lit(-1.0))


def scaled(vector: DataFrame) -> DataFrame:
    return vector.withColumns({"market_close": F.col("market_close") / 10000, "close_change_pct": clamped(F.col("close_change_pct")), "volatility_change": clamped(F.col("volatility_change"))})


def windows(vector: DataFrame) -> DataFrame:
    """(symbol, date, inputs, target_close, target_volatility): SEQUENCE rows before each row that has so many."""
    before = F.collect_list(F.struct(*VECTOR)).over(_by_day().rowsBetween(-SEQUENCE, -1))
    rows = vector.select("symbol", "date", before.alias("inputs"), F.col("market_close").alias("target_close"), F.col("market_volatility").alias("target_volatility"))
    return rows.where(F.size("inputs") == SEQUENCE)


def window_inventory(vector: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return vector.groupBy("symbol").agg(n.alias("records"), F.greatest(n - SEQUENCE, F.lit(0)).alias("windows")).withColumn("usable", F.col("records") > SEQUENCE)


def last_padded(vector: DataFrame) -> DataFrame:
    """(symbol, closes): the last SEQUENCE rows of each symbol, the first one repeated in front of fewer."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    last = vector.withColumn("back", back).where(F.col("back") <= SEQUENCE)
    rows = last.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("date", "market_close"))).alias("rows"))
    closes = F.transform("rows", lambda r: r["market_close"])
    return rows.select("symbol", F.concat(F.array_repeat(F.get(closes, F.lit(0)), F.lit(SEQUENCE) - F.size(closes)), closes).alias("closes"))


def train_val(rows: DataFrame, keys: list[str], order: list[str], share: float = 0.2) -> DataFrame:
    """rows with part: the last max(1, floor(n * share)) of each key validate; a single row does both."""
    w = Window.partitionBy(*keys)
    placed = rows.withColumns({"nth": F.row_number().over(w.orderBy(*order)), "n": F.count(F.lit(1)).over(w)})
    held = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(share)))
    return placed.withColumn("part", F.when(F.col("n") < 2, "both").when(F.col("nth") > F.col("n") - held, "validation").otherwise("train")).drop("nth", "n")


def spreads(vector: DataFrame) -> DataFrame:
    """(symbol, close_sigma, vol_sigma, last_volatility): deviations of changes, 0 for fewer than two."""
    before = F.lag("market_close").over(_by_day())
    ret = F.when(F.abs(before) > NEAR_ZERO, (F.col("market_close") - before) / before)
    moved = F.col("market_volatility") - F.lag("market_volatility").over(_by_day())
    rows = vector.select("symbol", "date", "market_volatility", ret.alias("ret"), moved.alias("moved"))
    return rows.groupBy("symbol").agg(F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("close_sigma"), F.coalesce(F.stddev_samp("moved"), F.lit(0.0)).alias("vol_sigma"), F.max_by("market_volatility", "date").alias("last_volatility"))


def bands(forecasts: DataFrame, spread: DataFrame) -> DataFrame:
    """forecasts (symbol, step, close, volatility) with bands that widen with the root of the step."""
    first = F.first("volatility").over(Window.partitionBy("symbol").orderBy("step"))
    joined = forecasts.withColumn("first_volatility", first).join(spread, "symbol")
    close_sigma = F.greatest("close_sigma", F.lit(0.0025))
    vol_sigma = F.greatest(F.col("vol_sigma"), F.greatest("last_volatility", "first_volatility") * 0.08, F.lit(0.00015))
    reach = F.lit(Z_80) * F.sqrt("step")
    close_width, vol_width = F.greatest(F.col("close"), F.lit(1.0)) * close_sigma * reach, vol_sigma * reach
    return joined.select(
        "symbol", "step", "close", "volatility", F.greatest(F.lit(0.0), F.col("close") - close_width).alias("close_lower"), (F.col("close") + close_width).alias("close_upper"),
        F.greatest(F.lit(0.0), F.col("volatility") - vol_width).alias("vol_lower"), (F.col("volatility") + vol_width).alias("vol_upper"),
    )


def axis_scale(values: DataFrame, column: str, keys: list[str]) -> DataFrame:
    low, high = F.min(column), F.max(column)
    pad = F.greatest(high - low, F.lit(1e-6)) * 0.15
    return values.groupBy(*keys).agg(F.greatest(F.lit(0.0), low - pad).alias("suggested_ymin"), (high + pad).alias("suggested_ymax"))
