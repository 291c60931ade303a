"""What a dashboard shows of a forecast: series on one time line, pairs, deltas and band checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.functions.text import error_tone, timestamp_day

SMALLEST = 1e-6


def unzip(payload: DataFrame, keys: list[str], **arrays: str) -> DataFrame:
    """Parallel arrays as rows (keys, pos, names...)."""
    zipped = F.arrays_zip(*[F.col(a).alias(n) for n, a in arrays.items()])
    return payload.select(*keys, F.posexplode(zipped).alias("pos", "x")).select(*keys, "pos", "x.*")


def last_by_day(points: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The last point of each day; stamps like day+1 fall on their day."""
    rows = points.withColumn("day", timestamp_day(F.col("ts"))).where("day <> ''")
    return rows.groupBy(*keys, "day").agg(F.max_by(F.struct(*values), "pos").alias("v")).select(*keys, "day", "v.*")


def aligned(history: DataFrame, forecast: DataFrame, realized: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each day that any series has; history and realized have `value`, forecast value, lower and upper."""
    none = F.lit(None).cast("double")
    parts = [
        last_by_day(history, keys, ["value"]).select(*keys, "day", F.col("value").alias("history"), *[none.alias(c) for c in ("forecast", "lower", "upper", "realized")]),
        last_by_day(forecast, keys, ["value", "lower", "upper"]).select(*keys, "day", none.alias("history"), F.col("value").alias("forecast"), "lower", "upper", none.alias("realized")),
        last_by_day(realized, keys, ["value"]).select(*keys, "day", *[none.alias(c) for c in ("history", "forecast", "lower", "upper")], F.col("value").alias("realized")),
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    out = both.groupBy(*keys, "day").agg(*[F.max(c).alias(c) for c in ("history", "forecast", "lower", "upper", "realized")])
    return out.withColumn("band", F.greatest(F.col("upper") - F.col("lower"), F.lit(0.0)))


def pairs(forecast: DataFrame, realized: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, day, forecast, realized) for every realized point whose day has a forecast."""
    last = last_by_day(forecast.where("value IS NOT NULL"), keys, ["value"]).withColumnRenamed("value", "forecast")
    own = realized.where("value IS NOT NULL").select(*keys, timestamp_day(F.col("ts")).alias("day"), F.col("value").alias("realized"))
    return own.join(last, [*keys, "day"])


def percent_change(now: Column, then: Column) -> Column:
    return F.coalesce(F.try_divide(now - then, then) * 100, F.lit(0.0))


def spot_delta(rows: DataFrame) -> DataFrame:
    delta = F.col("predicted") - F.col("current")
    tone = F.when(delta > 0, "up").when(delta < 0, "down").otherwise("flat")
    return rows.where("predicted IS NOT NULL AND current IS NOT NULL").withColumns({"delta": delta, "pct": percent_change(F.col("predicted"), F.col("current")), "tone": tone})


def error_badges(errors: DataFrame, baseline: str) -> DataFrame:
    """errors (mape, rmse, and a baseline column, ...) with tones of both, and rmse as a share of the baseline in per cent."""
    relative = F.when(F.col(baseline) > 0, F.try_divide(F.col("rmse"), F.col(baseline)) * 100)
    tone = lambda kind, c: error_tone(F.lit(kind), F.col(c), F.col(baseline)).alias(f"{c}_tone")
    return errors.select("*", tone("mape", "mape"), tone("rmse", "rmse"), relative.alias("rmse_pct"))


def band_check(rows: DataFrame, value: str, caution: float) -> DataFrame:
    """rows with within, distance, distance_pct and tone of a value against its band (lower, upper)."""
    v = F.col(value)
    within = v.between(F.col("lower"), F.col("upper"))
    distance = F.when(within, 0.0).when(v < F.col("lower"), F.col("lower") - v).otherwise(v - F.col("upper"))
    share = distance / F.greatest(F.abs(v), F.lit(SMALLEST))
    tone = F.when(within, "good").when(share <= caution, "caution").otherwise("danger")
    return rows.where(f"lower IS NOT NULL AND upper IS NOT NULL AND {value} IS NOT NULL").withColumns({"within": within, "distance": distance, "distance_pct": share * 100, "tone": tone})


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "day").alias("r")).select(*keys, "r.*")
