"""Mergeable sketches of events by day, kept as a table and rolled up; and mergeable moments, partial and final."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.sources.readers import exists

#: Sizes of the sketches: 2 ** LG_HLL registers of distinct counts, KLL_K of quantiles, TOP_ITEMS counters of frequent items.
LG_HLL, KLL_K, TOP_ITEMS = 12, 800, 4096
#: Relative standard error of a distinct count, and the error of a quantile's rank that is exceeded in one of a hundred sketches.
HLL_ERROR, KLL_ERROR = 1.04 / 2 ** (LG_HLL / 2), 2.296 / KLL_K**0.9021


def daily(events: DataFrame) -> DataFrame:
    """(day, event_type, n, users, values, top_users) of events (ts, event_type, user_id, value): binary sketches of the distinct users, of
    the values' quantiles and of the most frequent users. Nulls are in n only. Merged before the shuffle; a row has a bounded size."""
    rows = events.where("ts IS NOT NULL").select(F.to_date("ts").alias("day"), "event_type", F.col("user_id").cast("long").alias("user_id"), F.when(~F.isnan("value"), F.col("value")).alias("value"))
    return rows.groupBy("day", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("user_id", LG_HLL).alias("users"), F.kll_sketch_agg_double("value", KLL_K).alias("values"), F.expr(f"approx_top_k_accumulate(user_id, {TOP_ITEMS})").alias("top_users")
    )


def merged(sketches: DataFrame, *keys: str | Column) -> DataFrame:
    """Sketches of days, or of groups of days, merged by keys: as if their rows had been counted together."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("values").alias("values"), F.expr(f"approx_top_k_combine(top_users, {TOP_ITEMS})").alias("top_users"))


def estimates(sketches: DataFrame, quantiles: list[float], top: int = 5) -> DataFrame:
    """sketches with distinct_users, the values at the quantiles, and the most frequent users with their counts instead of the sketches."""
    at = F.when(F.kll_sketch_get_n_double("values") > 0, F.array(*[F.kll_sketch_get_quantile_double("values", F.lit(q)) for q in quantiles]))
    rest = [c for c in sketches.columns if c not in ("users", "values", "top_users")]
    return sketches.select(*rest, F.hll_sketch_estimate("users").alias("distinct_users"), at.alias("quantiles"), F.expr(f"approx_top_k_estimate(top_users, {top})").alias("frequent_users"))


def add_days(spark: SparkSession, events: DataFrame, path: str) -> int:
    """Adds the days of events that the sketch table at path lacks, and says how many; a day's rows are sketched once.

    The table is a folder for each day. Days that it has are left out before anything is read of them where events are
    laid out by day; a day must be complete when it is added.
    """
    days = events.where("ts IS NOT NULL").select(F.to_date("ts").alias("day")).distinct()
    if exists(spark, path):
        days = days.join(spark.read.parquet(path).select("day").distinct(), "day", "left_anti")
    new = [r["day"] for r in days.collect()]  # a row for each day that is added
    if new:
        rows = events.where(F.to_date("ts").isin(new))
        daily(rows).repartition("day").write.partitionBy("day").mode("append").parquet(path)
    return len(new)


#: Moments of pairs (x, y): how many, their means, and the sums of squares and products of distances from the means.
MOMENTS = "n long, mean_x double, mean_y double, m_xx double, m_yy double, m_xy double, sq_err double"


def _joined(a: tuple, b: tuple) -> tuple:
    """The moments of two sets of pairs together; stable where sums of squares are not."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n = a[0] + b[0]
    dx, dy, w = b[1] - a[1], b[2] - a[2], a[0] * b[0] / n
    return (n, a[1] + dx * b[0] / n, a[2] + dy * b[0] / n, a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w, a[6] + b[6])


def partial_moments(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, moments): of each key and task. Pairs with a null or a NaN don't count. A task keeps a row for each of its keys, no pairs."""
    own = rows.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    key_type = own.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, tuple] = {}
        key_arrow = None
        for batch in batches:
            coded = batch.column("key").dictionary_encode(null_encoding="encode")
            key_arrow, codes, kinds = batch.column("key").type, coded.indices.to_numpy(), coded.dictionary.to_pylist()
            xs, ys = batch.column("x").to_numpy(), batch.column("y").to_numpy()
            for code, name in enumerate(kinds):
                a, b = xs[codes == code], ys[codes == code]
                dx, dy = a - a.mean(), b - b.mean()
                held[name] = _joined(held.get(name, (0,)), (len(a), float(a.mean()), float(b.mean()), float(dx @ dx), float(dy @ dy), float(dx @ dy), float((a - b) @ (a - b))))
        if held:
            columns = list(zip(*held.values(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), type=key_arrow), pa.array(columns[0], type=pa.int64()), *[pa.array(c, type=pa.float64()) for c in columns[1:]]], names=["key", *[m.split()[0] for m in MOMENTS.split(", ")]])

    return own.mapInArrow(run, f"key {key_type}, {MOMENTS}").withColumnRenamed("key", key)


def merged_moments(parts: DataFrame, key: str) -> DataFrame:
    """(key, moments): partial moments of a key put together, a row for each task that has it. Parts of days may be stored and merged later."""
    key_type = parts.schema[key].dataType.simpleString()
    names = [m.split()[0] for m in MOMENTS.split(", ")]

    def final(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple = (0,)
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                out = _joined(out, row)
        yield pa.RecordBatch.from_arrays([pa.array([keys[0].as_py()], type=keys[0].type), pa.array([out[0]], type=pa.int64()), *[pa.array([v], type=pa.float64()) for v in out[1:]]], names=[key, *names])

    return parts.select(key, *names).groupBy(key).applyInArrow(final, f"`{key}` {key_type}, {MOMENTS}")


def agreement(moments: DataFrame, key: str) -> DataFrame:
    """(key, n, rmse, correlation, stddev_x): RMSE of y against x, Pearson's correlation (null where a side is constant) and the sample deviation of x."""
    corr = F.try_divide(F.col("m_xy"), F.sqrt(F.col("m_xx") * F.col("m_yy")))
    return moments.select(key, "n", F.sqrt(F.col("sq_err") / F.col("n")).alias("rmse"), corr.alias("correlation"), F.sqrt(F.try_divide(F.col("m_xx"), F.col("n") - 1)).alias("stddev_x"))
