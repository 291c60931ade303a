"""Evaluation of classifiers and forecasts."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgertide.working import small, stored

CLASSES = ("hawkish", "dovish", "neutral")
_ORDINAL = {"dovish": -1, "neutral": 0, "hawkish": 1}
NEAR_ZERO = 1e-12


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key accuracy, and macro and weighted precision, recall and F1 over all CLASSES, 0 where a share has no rows."""
    hits = lambda c: F.count_if((F.col("label") == c) & (F.col("pred") == c))
    counts = [f(c).alias(f"{n}_{c}") for c in CLASSES for n, f in (("hit", hits), ("sup", lambda c: F.count_if(F.col("label") == c)), ("out", lambda c: F.count_if(F.col("pred") == c)))]
    table = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("pred")).alias("right"), *counts)
    of = {c: (_share(F.col(f"hit_{c}"), F.col(f"out_{c}")), _share(F.col(f"hit_{c}"), F.col(f"sup_{c}"))) for c in CLASSES}
    f1 = {c: _share(2 * p * r, p + r) for c, (p, r) in of.items()}
    mean = lambda xs: sum(xs[1:], xs[0]) / len(CLASSES)
    weighted = _share(sum((f1[c] * F.col(f"sup_{c}") for c in CLASSES[1:]), f1[CLASSES[0]] * F.col(f"sup_{CLASSES[0]}")), sum((F.col(f"sup_{c}") for c in CLASSES[1:]), F.col(f"sup_{CLASSES[0]}")))
    return table.select(
        *keys, F.col("n").alias("records"), _share(F.col("right"), F.col("n")).alias("accuracy"), mean([of[c][0] for c in CLASSES]).alias("macro_precision"), mean([of[c][1] for c in CLASSES]).alias("macro_recall"),
        mean([f1[c] for c in CLASSES]).alias("macro_f1"), weighted.alias("weighted_f1"), F.least(*f1.values()).alias("worst_f1"),
    )


def ordinal(label: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, n in _ORDINAL.items():
        out = out.when(label == name, n)
    return out


def ordinal_error(rows: DataFrame, keys: list[str]) -> DataFrame:
    """RMSE and MAPE (denominator one at least, in per cent) of labels on a scale of -1, 0, 1."""
    off = ordinal(F.col("pred")) - ordinal(F.col("label"))
    return rows.groupBy(*keys).agg(F.sqrt(F.avg(off * off)).alias("rmse"), (F.avg(F.abs(off) / F.greatest(F.abs(ordinal(F.col("label"))), F.lit(1))) * 100).alias("mape"))


#: Accuracy of the quantile sketch that brackets a percentile: ranks are off by one in so many at most.
BRACKET = 10_000


def lower_percentiles(rows: DataFrame, column: str, shares: dict[str, float], keys: list[str]) -> DataFrame:
    """(keys, percentile, value): for each name of shares the element at floor((n - 1) * share) of each key's values in order; nulls don't count.

    One pass brackets the ranks between values of a mergeable sketch; a second one counts what is below each bracket and the
    distinct values inside, so only these are put in order, however many rows a key has.
    """
    own = rows.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("value"))
    ends = [x for s in shares.values() for x in (max(0.0, s - 2 / BRACKET), min(1.0, s + 2 / BRACKET))]
    bracket = own.groupBy(*[F.col(k).alias(f"of_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("total"), F.percentile_approx("value", ends, BRACKET).alias("q"), F.min("value").alias("least"), F.max("value").alias("most"))
    n, found = F.col("total"), []
    for i, (name, share) in enumerate(shares.items()):
        at = F.floor((n - 1) * F.lit(share))
        low = F.when((n < 4 * BRACKET) | (at < n * (2 / BRACKET)), F.col("least")).otherwise(F.col("q")[2 * i])
        high = F.when((n < 4 * BRACKET) | (at > n * (1 - 2 / BRACKET)), F.col("most")).otherwise(F.col("q")[2 * i + 1])
        found.append(F.struct(F.lit(name).alias("percentile"), at.alias("at"), low.alias("low"), high.alias("high")))
    bounds = stored(bracket.select(*[f"of_{k}" for k in keys], F.array(*found).alias("ranks")), "percentile-brackets")
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    near = own.join(small(bounds), same).select(*keys, "value", F.explode("ranks").alias("r")).select(*keys, "r.*", F.when(F.col("value") >= F.col("r.low"), F.col("value")).alias("value")).where("value IS NULL OR value <= high")
    counted = near.groupBy(*keys, "percentile", "at", "value").agg(F.count(F.lit(1)).alias("n"))  # those below the bracket together, as null
    upto = F.sum("n").over(Window.partitionBy(*keys, "percentile").orderBy(F.asc_nulls_first("value")))
    return counted.withColumn("upto", upto).where((F.col("upto") > F.col("at")) & F.col("value").isNotNull()).groupBy(*keys, "percentile").agg(F.min("value").alias("value"))


def lower_percentile(rows: DataFrame, column: str, share: float, keys: list[str]) -> DataFrame:
    """(keys, value): lower_percentiles() of one share."""
    return lower_percentiles(rows, column, {"": share}, keys).drop("percentile")


def combined_rmse(rows: DataFrame, keys: list[str]) -> DataFrame:
    """RMSE of closes, of volatilities, and of both together."""
    close, vol = F.sum(F.pow(F.col("close") - F.col("pred_close"), 2)), F.sum(F.pow(F.col("vol") - F.col("pred_vol"), 2))
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(F.sqrt(close / n).alias("close_rmse"), F.sqrt(vol / n).alias("vol_rmse"), F.sqrt((close + vol) / (2 * n)).alias("combined_rmse"))


def steady_mean(value: Column) -> Column:
    """The mean of doubles whatever the order of the rows: summed as decimals of 22 places, so a limit that a mean lies next to is not passed by the
    order of sums. Values or sums that are too large for these are summed as doubles."""
    exact = value.try_cast("decimal(38,22)")
    fits = F.count(exact) == F.count(value)
    return F.coalesce(F.when(fits, F.try_divide(F.try_sum(exact).cast("double"), F.count(value).cast("double"))), F.avg(value))


def forecast_error(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """RMSE, and MAPE over actual values that aren't zero, in per cent."""
    off = F.col("realized") - F.col("forecast")
    return pairs.groupBy(*keys).agg(F.sqrt(steady_mean(off * off)).alias("rmse"), (steady_mean(F.when(F.abs("realized") > NEAR_ZERO, F.abs(off / F.col("realized")))) * 100).alias("mape"))


def chunk_mean(scores: DataFrame) -> DataFrame:
    """(doc_id, label, score): sums over a document's chunks by their number, labels that a chunk lacks counting 0. Scores are stored, as two aggregates
    read them, which would each score all chunks anew."""
    scores = stored(scores, "chunk-scores")
    chunks = scores.groupBy("doc_id").agg(F.countDistinct("chunk").alias("n"))
    sums = scores.groupBy("doc_id", "label").agg(F.sum("score").alias("sum"))
    return sums.join(chunks, "doc_id").select("doc_id", "label", (F.col("sum") / F.col("n")).alias("score"))


def top_label(means: DataFrame, order: Column) -> DataFrame:
    """The best label of each document, the first in the order on a tie."""
    return means.groupBy("doc_id").agg(F.min_by("label", F.struct(-F.col("score"), order)).alias("label"), F.max("score").alias("score"))


def token_chunks(docs: DataFrame, size: int = 480, stride: int = 400) -> DataFrame:
    """(doc_id, chunk, tokens): windows of `size` tokens every `stride`, the last one reaching the end."""
    n = F.size("tokens")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride)), lambda s: (s == 0) | (s + (size - stride) < n))
    cut = docs.withColumn("starts", starts).select("doc_id", "tokens", F.posexplode("starts").alias("chunk", "start"))
    return cut.select("doc_id", "chunk", F.slice("tokens", F.col("start") + 1, F.lit(size)).alias("tokens"))


def sample_rows(rows: DataFrame, order: list[str], seed: int, cap: int) -> DataFrame:
    """`cap` rows without replacement, by the standard library's generator over positions in the order; all for fewer rows.

    The driver draws the positions, `cap` of them, which are joined to positions counted from a sort by the order.
    The sorted rows are stored, so their numbers stay as they are.
    """
    n = rows.count()
    if cap <= 0 or n <= cap:
        return rows
    picked = sorted(random.Random(seed).sample(range(n), cap))
    spark: SparkSession = rows.sparkSession
    place = F.monotonically_increasing_id()  # the part in the high bits, the place in it in the others
    parts = stored(rows.orderBy(*order).select(F.struct(*rows.columns).alias("row"), place.alias("place")), "sample").selectExpr("row", "shiftright(place, 33) AS part", f"place & {(1 << 33) - 1} AS at")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = parts.join(small(before), "part").withColumn("position", F.col("at") + F.col("before"))
    return placed.join(small(spark.createDataFrame([(k,) for k in picked], "position long")), "position").select("row.*")


def sweep_grid(spark: SparkSession, **values: list) -> DataFrame:
    """The product of lists of parameters, a row a candidate."""
    grid = spark.range(1).select()
    for name, own in values.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in own])).alias(name))
    return grid


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial of least combined RMSE, then loss, then number; trials without metrics don't count."""
    rank = F.struct("combined_rmse", "loss", "trial")
    return trials.where("combined_rmse IS NOT NULL AND loss IS NOT NULL").agg(F.min_by(F.struct(*trials.columns), rank).alias("best")).select("best.*")


def acceptance(runs: DataFrame) -> DataFrame:
    """Whether each run is complete: ids, metrics and artifacts there, checks passed (an extension by the documented contract)."""
    ok = (F.col("dataset_version") != "") & (F.col("model_version") != "") & F.col("macro_f1").isNotNull() & (F.col("artifacts") > 0) & (F.col("leakage") == "pass")
    return runs.select("run_id", F.coalesce(ok, F.lit(False)).alias("accepted"))


def seed_summary(metrics: DataFrame) -> DataFrame:
    """Mean and deviation of macro F1 over seeds, and the winner's rank: macro F1, then worst class, then latency."""
    by_model = metrics.groupBy("model").agg(F.avg("macro_f1").alias("mean_f1"), F.coalesce(F.stddev_samp("macro_f1"), F.lit(0.0)).alias("std_f1"), F.avg("worst_f1").alias("worst_f1"), F.avg("p95").alias("p95"))
    return by_model.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean_f1"), F.desc("worst_f1"), "p95", "model")))  # a row a model
