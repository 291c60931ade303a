"""Whole runs and what they leave on disk: sorted registries, summaries, scrapes, sweeps, evaluations, and the data preparation as one call."""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ledgertide.operators import evaluation as E
from ledgertide.operators import packaging as P
from ledgertide.operators import registry_ops as R
from ledgertide.sources.packages import write_package, write_reports, write_text
from ledgertide.working import small, stored

REGISTRY_ORDER = ["event_date", "source", "source_record_id"]
#: Files of a sorted table that one read names at most; more are read whole, behind the filter.
MOST_FILES = 10_000


def write_sorted(rows: DataFrame, path: str, order: list[str] = REGISTRY_ORDER, parts: int | None = None) -> DataFrame:
    """Writes rows in the order, by ranges of it, and returns the manifest: (file, least, most, records) by the first column of the order.

    Range partitioning samples the keys, so parts are about equal unless one key holds more than a part; all of order may then cut it. The manifest is
    stored beside the files as path.manifest.
    """
    spark, first = rows.sparkSession, order[0]
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    kept = spark.read.schema(rows.schema).parquet(path)
    found = kept.groupBy(F.input_file_name().alias("file")).agg(F.min(first).alias("least"), F.max(first).alias("most"), F.count(F.lit(1)).alias("records"))
    found.write.mode("overwrite").parquet(f"{path}.manifest")
    return spark.read.parquet(f"{path}.manifest")


def read_range(spark: SparkSession, path: str, column: str, least: object, most: object) -> DataFrame:
    """The rows of a sorted table whose first column of the order lies between least and most: only files whose range meets it are read."""
    manifest = spark.read.parquet(f"{path}.manifest")
    files = [r["file"] for r in manifest.where((F.col("most") >= F.lit(least)) & (F.col("least") <= F.lit(most))).limit(MOST_FILES + 1).collect()]
    table = spark.read.parquet(path)
    if len(files) <= MOST_FILES:
        table = spark.read.schema(table.schema).parquet(*files) if files else table.limit(0)
    return table.where(F.col(column).between(least, most))


def write_summary(registry: DataFrame, path: str) -> dict:
    """record_count, labeled_count and source_counts as JSON; a row for each source reaches the driver."""
    rows = R.ingestion_summary(registry).collect()
    payload = {"record_count": sum(r["records"] for r in rows), "labeled_count": sum(r["labelled"] for r in rows), "source_counts": {r["source"]: r["records"] for r in sorted(rows, key=lambda r: str(r["source"]))}}
    write_text(registry.sparkSession, path, json.dumps(payload, indent=2))
    return payload


def write_scrape(records: DataFrame, folder: str, prefix: str) -> None:
    """Document records as JSON lines and as CSV with names, in folders prefix.json and prefix.csv."""
    kept = stored(records, "scrape")
    kept.write.mode("overwrite").json(f"{folder}/{prefix}.json")
    kept.write.mode("overwrite").option("header", True).option("escape", '"').option("multiLine", True).csv(f"{folder}/{prefix}.csv")


def write_sweep(trials: DataFrame, path: str) -> None:
    """trials (summary struct<metrics, config>, trial) whole as JSON lines under path.json, and flat as CSV with names under path.csv, best first."""
    kept = stored(trials, "sweep")
    kept.write.mode("overwrite").json(f"{path}.json")
    flat = kept.select("trial", "summary.metrics.*", "summary.config.*")
    flat.orderBy(F.col("combined_rmse").asc_nulls_last(), F.col("loss").asc_nulls_last(), "trial").write.mode("overwrite").option("header", True).csv(f"{path}.csv")


def fold_samples(rows: DataFrame, folds: DataFrame, seeds: list[int], cap: int, key: str = "record_id", order: tuple[str, ...] = ("event_date", "record_id")) -> tuple[DataFrame, DataFrame]:
    """((fold_id, seed, key) of the rows to evaluate, (fold_id, test_rows) of each fold with rows). For each fold and seed `cap` of its rows in the order, drawn by the
    standard library's generator over positions; all where there are no more.

    Only keys are put in order; positions come from the sizes of sorted parts. Picks are cap a fold and seed.
    """
    if cap < 1:
        raise ValueError("the cap needs a row at least")
    spark = rows.sparkSession
    keys = P.test_rows(rows, folds).select("fold_id", key, F.struct(*order).alias("rank"))
    place = F.monotonically_increasing_id()
    laid = stored(keys.orderBy("fold_id", "rank").select("fold_id", key, place.alias("place")), "fold-order").selectExpr("fold_id", key, "shiftright(place, 33) AS part", "place")
    sizes = laid.groupBy("fold_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))  # a row for each part and fold
    before = F.coalesce(F.sum("n").over(Window.partitionBy("fold_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(sizes.select("fold_id", "part", "n", (before - F.col("first")).alias("shift")), "fold-starts")
    totals = {r["fold_id"]: r["n"] for r in starts.groupBy("fold_id").agg(F.sum("n").alias("n")).collect()}
    picks = [(f, s, k) for f, n in sorted(totals.items()) for s in seeds for k in (range(n) if n <= cap else random.Random(s).sample(range(n), cap)) if n > cap]
    placed = laid.join(small(starts.drop("n")), ["fold_id", "part"]).select("fold_id", key, (F.col("place") + F.col("shift")).alias("position"))
    drawn = placed.join(small(spark.createDataFrame(picks, "fold_id string, seed int, position long")), ["fold_id", "position"]).select("fold_id", "seed", key)
    whole = [f for f, n in totals.items() if n <= cap]
    all_ = placed.where(F.col("fold_id").isin(whole)).select("fold_id", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"), key)
    return drawn.unionByName(all_), spark.createDataFrame(sorted(totals.items()), "fold_id string, test_rows long")


def _reason(failure: Exception) -> str:
    """The last line that tells what went wrong, also of a failure in a worker."""
    lines = [x.strip() for x in str(failure).splitlines() if x.strip()]
    return next((x for x in reversed(lines) if re.match(r"[\w.]*(Error|Exception)\b", x)), lines[0] if lines else type(failure).__name__)[:500]


Classify = Callable[[list[str]], list[str]]


def predicted(rows: DataFrame, make: Callable[[], Classify], batch: int = 16) -> DataFrame:
    """rows (text, ...) with pred and latency_ms: the wall time of a batch over its size. A worker makes the classifier once for each task."""
    columns = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify = make()
        for frame in frames:
            preds, took = [], []
            for k in range(0, len(frame), batch):
                texts, began = frame["text"].iloc[k : k + batch].tolist(), time.perf_counter()
                preds += classify(texts)
                took += [(time.perf_counter() - began) * 1000 / len(texts)] * len(texts)
            yield frame.assign(pred=preds, latency_ms=took)[[*columns, "pred", "latency_ms"]]

    schema = StructType([*rows.schema, StructField("pred", StringType()), StructField("latency_ms", DoubleType())])
    return rows.mapInPandas(run, schema)


def evaluate(rows: DataFrame, folds: DataFrame, models: dict[str, Callable[[], Classify]], seeds: list[int], folder: str, cap: int = 300, batch: int = 16) -> dict:
    """Runs every model with every seed over the folds' test rows and writes a metrics.json for each run and a summary.json; returns the summary.

    rows: record_id, event_date, text, label. Rows are drawn once for all models; each model labels each drawn row once, in one job, and the metrics of all its seeds
    come from one pass over the predictions. A model that fails is listed under failures, and the others go on. No rows, no folds or no rows in
    any fold are an error.
    """
    spark = rows.sparkSession
    chosen, totals = fold_samples(rows, folds, seeds, cap)
    chosen = stored(chosen, "evaluation-rows")
    counts = {r["fold_id"]: r["test_rows"] for r in totals.collect()}
    if not counts:
        raise ValueError("no fold has rows to evaluate")
    bounds = {r["fold_id"]: r for r in folds.collect()}
    taken = {(r["seed"], r["fold_id"]): r["count"] for r in chosen.groupBy("seed", "fold_id").count().collect()}
    texts = stored(rows.join(small(chosen.select("record_id").distinct()), "record_id").select("record_id", "text", "label"), "evaluation-texts")
    results, failures = [], []
    for name, make in models.items():
        try:
            scored = stored(predicted(texts, make, batch), "predictions")
            joined = stored(chosen.join(scored, "record_id"), "evaluated")
            metrics = {r["seed"]: r.asDict() for r in E.classification(joined, ["seed"]).collect()}
            errors = {r["seed"]: r.asDict() for r in E.ordinal_error(joined, ["seed"]).collect()}
            latency: dict[int, dict] = {s: {} for s in seeds}
            for r in E.lower_percentiles(joined, "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95}, ["seed"]).collect():
                latency[r["seed"]][r["percentile"]] = r["value"]
        except Exception as e:  # whatever a model raises in a task
            failures += [{"model_key": name, "seed": s, "error": _reason(e)} for s in seeds]
            continue
        for seed in seeds:
            own = [{"fold_id": f, "test_start": bounds[f]["test_start"], "test_end": bounds[f]["test_end"], "test_rows_total": n, "test_rows_evaluated": taken[seed, f]} for f, n in sorted(counts.items())]
            scores, off = metrics[seed], errors[seed]
            result = {"model_key": name, "seed": seed, "evaluated_rows": scores["records"], "classification": {k: v for k, v in scores.items() if k not in ("seed", "records")}, "error_proxy": {"rmse": off["rmse"], "mape": off["mape"]}, "latency": latency[seed], "folds": own}
            write_text(spark, f"{folder}/run_{name}_s{seed}/metrics.json", json.dumps(result, indent=2))
            results.append({"run_id": f"run_{name}_s{seed}", **result})
    summary = {"started_at_utc": datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ"), "official_seeds": seeds, "results": results, "failures": failures}
    write_text(spark, f"{folder}/summary.json", json.dumps(summary, indent=2))
    return summary


def prepare(raw: DataFrame, root: str, dataset_version: str, feature_version: str, protocol: str, near_threshold: float = R.NEAR_THRESHOLD) -> dict[str, str]:
    """The data preparation in one call: raw records are ingested, labelled, freed of exact and near duplicates, checked, and packaged. Returns the folders and files.

    Under root: registry (sorted by date, source and id), registry_labeled, ingestion_summary.json, reports/ (exact and near duplicates, leakage, distribution) and the package.
    A failed leakage check is in its report and stops nothing. Fewer rows than a package needs are an error; nothing is packaged then, but what
    came before is there to look at.
    """
    spark = raw.sparkSession
    rows, rejects = R.ingest(raw)
    write_sorted(rows, f"{root}/registry")
    registry = spark.read.parquet(f"{root}/registry")
    write_summary(registry, f"{root}/ingestion_summary.json")
    R.with_labels(registry).write.mode("overwrite").parquet(f"{root}/registry_labeled")
    labelled = spark.read.parquet(f"{root}/registry_labeled")
    exact = stored(R.exact_dedup(labelled, ["event_date", "source", "source_record_id"]), "prepared-exact")
    judged = stored(R.near_dedup(exact, near_threshold), "prepared-near")
    blocked = judged.where("blocked_by IS NOT NULL")
    kept = exact.join(judged.where("blocked_by IS NULL").select("record_id", "event_date"), ["record_id", "event_date"], "left_semi")
    kept.write.mode("overwrite").parquet(f"{root}/registry_quality_passed")
    passed = spark.read.parquet(f"{root}/registry_quality_passed")
    dropped = R.exact_dropped(labelled, ["event_date", "source", "source_record_id"])
    n, m, k = labelled.count(), exact.count(), passed.count()
    dupes, bad = R.source_record_dupes(passed, ["record_id"]), R.invalid_dates(passed)
    status = R.leakage_status(passed, ["record_id"]).first().asDict()
    write_reports(spark, f"{root}/reports", {
        "exact_duplicates": ({"input_rows": n, "kept_rows": m, "dropped_rows": n - m}, dropped),
        "near_duplicates": ({"threshold": near_threshold, "input_rows": m, "kept_rows": k, "blocked_rows": m - k}, blocked),
        "leakage": (status, dupes.select("record_id", "first_record_id", "key").unionByName(bad.select("record_id"), allowMissingColumns=True)),
        "distribution": ({"records": k}, R.distribution(passed)),
        "label_exceptions": ({"rejected_rows": rejects.count()}, R.label_exceptions(labelled)),
    })
    package = write_package(passed, root, dataset_version, feature_version, protocol, f"{root}/reports")
    return {"registry": f"{root}/registry", "labelled": f"{root}/registry_labeled", "passed": f"{root}/registry_quality_passed", "reports": f"{root}/reports", "package": package}
