"""Training packages and prepared datasets on disk: what is written, and how evaluation reads it back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.operators import packaging as P
from ledgertide.operators.evaluation import CLASSES
from ledgertide.sources.readers import exists

FOLDS, PART_ROWS = "fold_manifest", ("train_rows", "val_rows", "test_rows")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small driver-side file, in whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def copy_files(spark: SparkSession, source: str, target: str, pattern: str = "*.json") -> int:
    """Copies the files of a folder that match, and says how many; a missing folder has none."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    src, dst = fs.Path(source), fs.Path(target)
    own, other = src.getFileSystem(conf), dst.getFileSystem(conf)
    found = own.globStatus(fs.Path(src, pattern)) if own.exists(src) else None
    other.mkdirs(dst)
    for status in found or []:
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(own, status.getPath(), other, fs.Path(dst, status.getPath().getName()), False, True, conf)
    return len(found or [])


def package_id(dataset_version: str, feature_version: str, protocol: str) -> str:
    return f"pkg_{dataset_version}_{feature_version}_{protocol}"


def package_counts(split: DataFrame) -> DataFrame:
    """(kind, name, records): rows of each split, source and label, counted in one pass."""
    sets = [[F.col(c)] for c in ("split_tag", "source", "mapped_label")]
    counted = split.groupingSets(sets, "split_tag", "source", "mapped_label").agg(F.grouping_id("split_tag", "source", "mapped_label").alias("g"), F.count(F.lit(1)).alias("records"))
    kind = F.when(F.col("g") == 3, "split").when(F.col("g") == 5, "source").otherwise("label")
    name = F.when(F.col("g") == 3, F.col("split_tag")).when(F.col("g") == 5, F.col("source")).otherwise(F.col("mapped_label"))
    return counted.select(kind.alias("kind"), F.coalesce(name, F.lit("")).alias("name"), "records")


def write_package(labelled: DataFrame, root: str, dataset_version: str, feature_version: str, protocol: str, reports: str | None = None) -> str:
    """Writes a package of labelled rows under root and returns its folder; fewer than LEAST_ROWS rows are an error.

    registry/ and splits/ as Parquet and JSON lines, the fold manifest with its row and class counts, the metadata, and the
    quality reports, if any. A failed write is an error, not a flag.
    """
    spark = labelled.sparkSession
    rows = P.check_rows(P.supervised(labelled))
    name = package_id(dataset_version, feature_version, protocol)
    folder = f"{root.rstrip('/')}/{name}"
    rows.write.mode("overwrite").parquet(f"{folder}/registry")
    kept = spark.read.parquet(f"{folder}/registry")
    kept.write.mode("overwrite").json(f"{folder}/registry_jsonl")
    P.time_split(kept).write.mode("overwrite").parquet(f"{folder}/splits")
    split = spark.read.parquet(f"{folder}/splits")
    split.write.mode("overwrite").json(f"{folder}/splits_jsonl")
    folds = P.walk_forward(spark, kept)
    classes = P.class_distribution(kept, folds).groupBy("fold_id").agg(F.map_from_entries(F.collect_list(F.struct("mapped_label", "records"))).alias("class_distribution"))
    manifest = [json.loads(r["fold"]) for r in P.manifest(kept, folds).join(classes, "fold_id", "left").orderBy("fold_id").select(F.to_json(F.struct("*")).alias("fold")).collect()]
    ids = {"evaluation_protocol": protocol, "dataset_version": dataset_version, "feature_version": feature_version, "training_package_id": name}
    write_text(spark, f"{folder}/{FOLDS}.json", json.dumps({**ids, "fold_count": len(manifest), "folds": manifest}, indent=2))
    counts: dict[str, dict[str, int]] = {"split": {}, "source": {}, "label": {}}
    for r in package_counts(split).collect():  # a row for each split, source and label
        counts[r["kind"]][r["name"]] = r["records"]
    copied = copy_files(spark, reports, f"{folder}/quality_reports") if reports else 0
    metadata = {**ids, "input_rows": labelled.count(), "supervised_rows": sum(counts["split"].values()), **{f"{k}_counts": dict(sorted(v.items())) for k, v in counts.items()}, "quality_reports": copied}
    write_text(spark, f"{folder}/dataset_metadata.json", json.dumps(metadata, indent=2))
    return folder


def evaluation_rows(registry: DataFrame) -> DataFrame:
    """(text, label, event_date) of rows with one of CLASSES, in any case, a text and a date."""
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rows = registry.select(clean("text").alias("text"), F.lower(clean("mapped_label")).alias("label"), clean("event_date").alias("event_date"))
    return rows.where(F.col("label").isin(*CLASSES) & (F.col("text") != "") & (F.col("event_date") != ""))


def load_evaluation(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows, folds) of a package; a missing registry or manifest, or one without a list of folds, has none."""
    path, manifest = f"{folder}/registry", f"{folder}/{FOLDS}.json"
    rows = spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], "text string, mapped_label string, event_date string")
    payload = json.loads(read_text(spark, manifest)) if exists(spark, manifest) else {}
    names = [c.split(" ")[0] for c in P.FOLD_SCHEMA.split(", ")]
    folds = [tuple(str(f[n]) for n in names) for f in payload.get("folds") or [] if isinstance(f, dict)] if isinstance(payload.get("folds"), list) else []
    return evaluation_rows(rows), spark.createDataFrame(folds, P.FOLD_SCHEMA)


def preparation_summary(documents: DataFrame, symbols: DataFrame, prepared: DataFrame) -> DataFrame:
    """One row of counts: documents, valid ones (with a date and a text), records after the last of a day won, documents
    skipped, and pairs of a valid document and a symbol that found no price. prepared has document, symbol, date."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    docs = documents.agg(F.count(F.lit(1)).alias("total_documents"), F.count_if(~(blank("date") | blank("text"))).alias("valid_documents"))
    found = prepared.agg(F.count(F.lit(1)).alias("pairs")).crossJoin(prepared.select("symbol", "date").distinct().agg(F.count(F.lit(1)).alias("prepared_records")))
    n = symbols.agg(F.count(F.lit(1)).alias("symbols"))
    both = docs.crossJoin(found).crossJoin(n)  # a row each
    return both.select("total_documents", "valid_documents", "prepared_records", (F.col("total_documents") - F.col("valid_documents")).alias("skipped_documents"), (F.col("valid_documents") * F.col("symbols") - F.col("pairs")).alias("skipped_symbol_pairs"))


def training_groups(prepared: DataFrame) -> DataFrame:
    """(symbol, records): each symbol's records in the order of dates; a symbol's days bound them."""
    rest = [c for c in prepared.columns if c not in ("symbol", "date")]
    return prepared.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("date", *rest))).alias("records"))


def write_training_dataset(prepared: DataFrame, summary: DataFrame, path: str, source_files: list[str]) -> None:
    """A folder with groups/, JSON lines of a symbol each, and metadata.json, the summary with symbols and files."""
    spark = prepared.sparkSession
    groups = training_groups(prepared)
    groups.write.mode("overwrite").json(f"{path}/groups")
    symbols = sorted(r["symbol"] for r in groups.select("symbol").collect())
    write_text(spark, f"{path}/metadata.json", json.dumps({**summary.first().asDict(), "symbols": symbols, "source_files": source_files}, indent=2))


def write_reports(spark: SparkSession, folder: str, reports: dict[str, tuple[dict, DataFrame]], most: int = 5000) -> None:
    """A JSON file for each report: its counts, which stay whole, and its first `most` rows."""
    for name, (counts, rows) in reports.items():
        listed = [json.loads(r["row"]) for r in rows.limit(most).select(F.to_json(F.struct("*")).alias("row")).collect()]
        write_text(spark, f"{folder}/{name}.json", json.dumps({**counts, "rows": listed}, indent=2))
