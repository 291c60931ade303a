"""Training packages: chronological splits and walk-forward folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgertide.working import small, stored

#: Distinct dates that the driver puts in order for folds; more are refused.
MOST_DATES = 1_000_000
#: Fewest supervised rows of a package.
LEAST_ROWS = 10

FOLD_SCHEMA = "fold_id string, train_start string, train_end string, val_start string, val_end string, test_start string, test_end string"


def supervised(labelled: DataFrame, include_unlabeled: bool = False) -> DataFrame:
    """Rows with a mapped label; include_unlabeled keeps all, as an untyped null check would."""
    return labelled if include_unlabeled else labelled.where("mapped_label IS NOT NULL")


def check_rows(rows: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """rows, of which there must be `least`."""
    if (n := rows.limit(least).count()) < least:
        raise ValueError(f"a package needs {least} labelled rows, there are {n}")
    return rows


def time_split(rows: DataFrame, train: float = 0.7, val: float = 0.85) -> DataFrame:
    """rows with split_tag by position in the order of event_date and record_id.

    Positions come from counts of dates; only the rows of dates that hold a cut are put in order.
    """
    dates = stored(rows.groupBy("event_date").agg(F.count(F.lit(1)).alias("n")), "split-dates")
    total = F.sum("n").over(Window.partitionBy())  # a row for each date
    before = F.coalesce(F.sum("n").over(Window.orderBy("event_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut_train = F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(train)))
    cut_val = F.least(F.greatest(F.col("cut_train") + 1, F.floor(F.col("total") * F.lit(val))), F.col("total"))
    placed = dates.select("event_date", "n", before.alias("before"), total.alias("total")).withColumn("cut_train", cut_train).withColumn("cut_val", cut_val)
    joined = rows.join(small(placed), "event_date")
    tag = lambda at: F.when(at < F.col("cut_train"), "train").when(at < F.col("cut_val"), "val").otherwise("test")
    whole = tag(F.col("before")) == tag(F.col("before") + F.col("n") - 1)
    inner = F.row_number().over(Window.partitionBy("event_date").orderBy("record_id"))
    sure = joined.where(whole).withColumn("split_tag", tag(F.col("before")))
    cut = joined.where(~whole).withColumn("at", F.col("before") + inner - 1).withColumn("split_tag", tag(F.col("at"))).drop("at")
    return sure.unionByName(cut).select(*rows.columns, "split_tag")


def boundary_ties(split: DataFrame) -> DataFrame:
    """(event_date, train_rows, val_rows, test_rows) of the dates that a cut divides: positions, not dates, are cut, so rows of one date may
    stand on both sides."""
    parts = [F.count_if(F.col("split_tag") == p).alias(f"{p}_rows") for p in ("train", "val", "test")]
    held = sum((F.col(f"{p}_rows") > 0).cast("int") for p in ("train", "val", "test"))
    return split.groupBy("event_date").agg(*parts).where(held > 1)


def _dates(rows: DataFrame) -> list[str]:
    """Distinct dates in order: as many as there are days, not rows."""
    dates = rows.where("event_date <> ''").select("event_date").distinct().limit(MOST_DATES + 1).collect()
    if len(dates) > MOST_DATES:
        raise ValueError(f"more than {MOST_DATES} distinct dates: event_date holds something else")
    return sorted(r["event_date"] for r in dates)


def walk_forward(spark: SparkSession, rows: DataFrame, min_train: float = 0.6, folds: int = 4) -> DataFrame:
    """Expanding folds over distinct dates; none for fewer than eight."""
    dates = _dates(rows)
    n, out = len(dates), []
    first = max(3, int(n * min_train))
    width = max(1, (n - first) // max(folds + 1, 2))
    for i in range(folds if n >= 8 else 0):
        train_end = first + i * width - 1
        bounds = [0, train_end, train_end + 1, train_end + width, train_end + width + 1, train_end + 2 * width]
        if bounds[-1] < n:
            out.append((f"wf_fold_{i + 1}", *[dates[k] for k in bounds]))
    return spark.createDataFrame(out, FOLD_SCHEMA)


def fallback(spark: SparkSession, rows: DataFrame, folds: int = 3) -> DataFrame:
    """Folds of equal blocks for packages without a manifest; none for fewer than twelve dates."""
    dates = _dates(rows)
    n, out = len(dates), []
    block = max(1, n // (folds + 2))
    for k in range(1, (folds if n >= 12 else 0) + 1):
        train_end = min(n - 3 * block, (k + 1) * block)
        val_end = min(train_end + block, n - block - 1)
        test_end = min(val_end + block, n - 1)
        if val_end + 1 < n:
            out.append((f"wf_fold_{k}", *[dates[x] for x in (0, train_end, train_end + 1, val_end, val_end + 1, test_end)]))
    return spark.createDataFrame(out, FOLD_SCHEMA)


def _daily(rows: DataFrame) -> DataFrame:
    return rows.groupBy("event_date", "mapped_label").agg(F.count(F.lit(1)).alias("n"))


def manifest(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """folds with the rows of each part, from counts of days."""
    inside = lambda part: F.coalesce(F.sum(F.when(F.col("event_date").between(F.col(f"{part}_start"), F.col(f"{part}_end")), F.col("n"))), F.lit(0)).alias(f"{part}_rows")
    near = F.col("event_date").between(F.col("train_start"), F.col("test_end"))
    return _daily(rows).join(F.broadcast(folds), near).groupBy(*folds.columns).agg(*[inside(p) for p in ("train", "val", "test")])


def class_distribution(rows: DataFrame, folds: DataFrame) -> DataFrame:
    tested = F.col("event_date").between(F.col("test_start"), F.col("test_end"))
    return _daily(rows).where("mapped_label IS NOT NULL").join(F.broadcast(folds), tested).groupBy("fold_id", "mapped_label").agg(F.sum("n").alias("records"))


def test_rows(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows with each fold that tests them; string dates, both ends included."""
    return rows.join(F.broadcast(folds.select("fold_id", "test_start", "test_end")), F.col("event_date").between(F.col("test_start"), F.col("test_end")))
