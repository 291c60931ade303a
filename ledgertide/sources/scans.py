"""Scans of collections of files into raw registry records, and the inventory of a folder of training files."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgertide.functions import text as T
from ledgertide.sources.readers import GROUP_KEYS, RECORD_KEYS, exists
from ledgertide.working import small, stored

#: Different headers of the CSV files of a folder, each of which is a scan, at most.
MOST_CSV_HEADERS = 1_000
#: Records that a task hands on at once; a frame for each file costs more than the file.
RECORDS_AT_ONCE = 10_000
#: Names under which records keep what the registry needs, in order of precedence (fixed values).
SPLIT_KEYS = {
    "event_date": ("date", "event_date", "published_date", "timestamp", "year"),
    "text": ("text", "sentence", "content", "document", "statement"),
    "label": ("label_text", "label", "stance", "class"),
    "title": ("title", "headline"),
    "document_type": ("document_type", "type"),
}
FOLDER_KEYS = {
    "event_date": ("date", "event_date", "published_date", "timestamp", "Date"),
    "text": ("text", "Text", "content", "statement", "minutes"),
    "label": ("label_text", "label", "stance", "class"),
    "title": ("title", "headline"),
    "document_type": ("document_type", "type", "Type"),
}
SCRAPED_KEYS = {
    "event_date": ("date", "event_date", "published_date"),
    "text": ("text", "content"),
    "label": ("label_text", "label"),
    "title": ("title",),
    "document_type": ("document_type", "type"),
}
ID_KEYS = ("id", "uid", "record_id")


@dataclass(frozen=True)
class Collection:
    """What a collection's records have in common."""

    source: str
    license_scope: str = ""
    citation_ref: str = ""
    keys: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: FOLDER_KEYS)


def numbered(rows: DataFrame, group: list[str]) -> DataFrame:
    """rows with idx, their number in the group by file name and place in the file; rows have `path` and `block`, the place of
    the stretch of the file that they come from.

    A task reads a stretch in order, so numbers in it are differences, and what comes before it is a sum over stretches.
    """
    held = stored(rows.withColumn("place", F.monotonically_increasing_id()), "numbered")
    stretch = held.groupBy(*dict.fromkeys([*group, "path", "block"])).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("begin"))
    before = Window.partitionBy(*group).orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = stretch.select("path", "block", "begin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return held.join(small(placed), ["path", "block"]).withColumn("idx", F.col("place") - F.col("begin") + F.col("before")).drop("place", "begin", "before", "block")


def _lines(spark: SparkSession, root: str, suffix: str, **options: object) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").options(**options)
    return reader.text(root).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def _csv_groups(spark: SparkSession, root: str) -> list[list[str]]:
    """Paths of the CSV files under root, those of equal first lines together, so that a scan reads all files of a header.

    A first line that may go on in the next one (an odd number of quotes, or an escape) makes its file a group of its own;
    files without a line have no records. The driver holds the paths, as it does for any scan of these files.
    """
    lines = _lines(spark, root, ".csv").where("block = 0 AND value <> ''").withColumn("place", F.monotonically_increasing_id())
    first = lines.groupBy("path").agg(F.min_by("value", "place").alias("value"))
    alone = F.col("value").contains("\\") | (F.regexp_count("value", F.lit('"')) % 2 == 1)
    header = F.when(alone, F.concat("value", F.lit("\n"), "path")).otherwise(F.col("value"))
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))  # paths of files are known as encoded URIs
    groups = first.groupBy(header.alias("header")).agg(F.sort_array(F.collect_list(path)).alias("paths")).limit(MOST_CSV_HEADERS + 1).collect()
    if len(groups) > MOST_CSV_HEADERS:
        raise ValueError(f"more than {MOST_CSV_HEADERS} headers of CSV files under {root}")
    return [g["paths"] for g in sorted(groups, key=lambda g: g["header"])]


def file_records(spark: SparkSession, root: str) -> DataFrame:
    """(path, block, record) of the JSON, JSON lines and CSV files under root, whatever their depth; other files have none.

    record is a JSON object. JSON files hold a list of records, or the first list under one of RECORD_KEYS; what is no
    object is left out. Lines and CSV files are split among tasks; a JSON file is read by one.
    """
    whole = _lines(spark, root, ".json", wholetext=True)
    listed = lambda c: F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>"))
    items = F.coalesce(listed(F.col("value")), *[listed(F.get_json_object("value", f"$.{k}")) for k in RECORD_KEYS])
    found = whole.select("path", "block", F.explode(items).alias("record"))
    found = found.unionByName(_lines(spark, root, ".jsonl").withColumnRenamed("value", "record"))
    for paths in _csv_groups(spark, root):
        rows = spark.read.csv(paths, header=True, inferSchema=False, multiLine=True)
        found = found.unionByName(rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("record")))
    return found.where(F.ltrim("record").startswith("{"))


def _field(keys: Iterable[str]) -> Column:
    return T.first_text([F.get_json_object("record", f"$['{k}']") for k in keys])


def _raw(records: DataFrame, kept: Collection, fallback: Column, date: Column, kind: Column) -> DataFrame:
    """The columns from which registry_ops.normalized_records makes the registry."""
    own_id = F.nullif(_field(ID_KEYS), F.lit(""))
    return records.select(
        F.lit(kept.source).alias("source"), F.coalesce(own_id, fallback).alias("source_record_id"), kind.alias("document_type"), date.alias("event_date"),
        _field(kept.keys["title"]).alias("title"), _field(kept.keys["text"]).alias("text"), _field(kept.keys["label"]).alias("label"), F.lit(kept.license_scope).alias("license_scope"), F.lit(kept.citation_ref).alias("citation_ref"),
    )


def _dated(kept: Collection) -> Column:
    return T.event_date(_field(kept.keys["event_date"]), _field(("year",)))


def _or(column: Column, default: str) -> Column:
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(default))


def scan_splits(spark: SparkSession, root: str, kept: Collection) -> DataFrame:
    """Records of an exported dataset, a folder for each split; one without an id is known by its split and number in it."""
    base = len(spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/").split("/"))
    split = F.get(F.split(F.regexp_replace("path", "^[a-zA-Z0-9]+:(//[^/]*)?", ""), "/"), F.lit(base))
    rows = numbered(file_records(spark, root).withColumn("split", split), ["split"])
    return _raw(rows, kept, F.concat_ws(":", "split", "idx"), _dated(kept), _or(_field(kept.keys["document_type"]), "statement"))


def scan_folder(spark: SparkSession, root: str, kept: Collection) -> DataFrame:
    """Records of all files under root; one without an id is known by its file's name and number in it."""
    rows = numbered(file_records(spark, root), ["path"])
    return _raw(rows, kept, F.concat_ws(":", _name(), "idx"), _dated(kept), T.document_type(_field(kept.keys["document_type"])))


def _name() -> Column:
    return F.url_decode(F.element_at(F.split("path", "/"), -1))


def scan_scraped(spark: SparkSession, root: str, names: list[str], kept: Collection) -> DataFrame:
    """Records of the named files of root, of which any may be missing. Dates are taken as they stand."""
    found = None
    for name in names:
        path = f"{root.rstrip('/')}/{name}"
        if exists(spark, path):
            own = numbered(file_records(spark, path), ["path"])
            rows = _raw(own, kept, F.concat_ws(":", F.lit(name), "idx"), _field(kept.keys["event_date"]), _or(_field(kept.keys["document_type"]), "unknown"))
            found = rows if found is None else found.unionByName(rows)
    return found if found is not None else spark.createDataFrame([], ", ".join(f"{c} string" for c in ("source", "source_record_id", "document_type", "event_date", "title", "text", "label", "license_scope", "citation_ref")))


def raw_documents(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """(date, text, title, document_type, source_file) of the named files in the order of dates, then files, then places."""
    found = None
    for k, name in enumerate(names):
        path = f"{root.rstrip('/')}/{name}"
        if exists(spark, path):
            own = numbered(file_records(spark, path), ["path"])
            get = lambda key, default="": F.coalesce(F.get_json_object("record", f"$.{key}"), F.lit(default)).alias(key)
            rows = own.select(get("date"), get("text"), get("title"), get("document_type", "Unknown"), F.lit(name).alias("source_file"), F.lit(k).alias("file_ord"), "idx")
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], "date string, text string, title string, document_type string, source_file string")
    return found.orderBy("date", "file_ord", "idx").drop("file_ord", "idx")


def groups_of(payload: object) -> list[list[dict]]:
    """Groups of records in a JSON document, at any depth: a list of objects is a group, or holds groups if any of its objects
    keeps records; an object holds those of its first list of groups that has any, or else its first list of records."""
    is_group = lambda x: isinstance(x, list) and all(isinstance(r, dict) for r in x)
    if is_group(payload):
        inner = [g for r in payload for g in groups_of(r)] if any(k in r for r in payload for k in RECORD_KEYS) else []
        return inner or [payload]
    if not isinstance(payload, dict):
        return []
    for key in GROUP_KEYS:
        entries = payload.get(key)
        if isinstance(entries, list) and (found := [g for e in entries for g in groups_of(e)]):
            return found
    return next(([payload[k]] for k in RECORD_KEYS if is_group(payload.get(k))), [])


def record_groups(files: DataFrame) -> DataFrame:
    """(path, grp, pos, record, message) of (path, value), the JSON documents of files: a row for each record, one without a
    record for an empty group, and one without a group and with a message for a file that can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda out: pd.DataFrame(out, columns=["path", "grp", "pos", "record", "message"]).astype({"grp": "Int64", "pos": "Int64"})
        for batch in batches:
            out = []
            for path, value in zip(batch["path"], batch["value"], strict=True):
                try:
                    groups = groups_of(json.loads(value or ""))
                except (ValueError, RecursionError) as failure:
                    out.append((path, None, None, None, str(failure)))
                else:
                    out += [(path, g, k, None if r is None else json.dumps(r), None) for g, own in enumerate(groups) for k, r in enumerate(own or [None])]
                if len(out) >= RECORDS_AT_ONCE:
                    yield frame(out)
                    out = []
            yield frame(out)

    return files.select("path", "value").mapInPandas(run, "path string, grp int, pos int, record string, message string")


def source_inventory(files: DataFrame, groups: DataFrame, least: int = 6) -> DataFrame:
    """(path, format, record_groups, records, vectors, usable_sequences, status, message), a row for each of files (path).

    groups is record_groups() of them. A record with a date makes a vector, and needs a close and a volatility: a
    file with records that lack them is an error, and so is one that can't be read; one without groups is ignored. A
    group of at least `least` vectors is usable.
    """
    get = lambda *keys: T.first_number([F.get_json_object("record", f"$.{k}") for k in keys])
    vector = F.col("record").isNotNull() & (T.first_text([F.get_json_object("record", "$.date")]) != "")
    good = get("close", "market_close").isNotNull() & get("volatility_5d", "market_volatility", "volatility").isNotNull()
    each = groups.groupBy("path", "grp").agg(F.count("record").alias("records"), F.count_if(vector).alias("vectors"), F.count_if(vector & ~good).alias("bad"), F.max("message").alias("failure"))
    sums = each.groupBy("path").agg(
        F.count("grp").alias("record_groups"), F.sum("records").alias("records"), F.sum("vectors").alias("vectors"), F.sum("bad").alias("bad"), F.count_if(F.col("vectors") >= least).alias("usable_sequences"), F.max("failure").alias("failure")
    )
    known = files.select("path").distinct().join(sums, "path", "left")
    status = F.when(F.col("failure").isNotNull() | (F.col("bad") > 0), "error").when(F.coalesce("record_groups", F.lit(0)) == 0, "ignored").when(F.col("usable_sequences") > 0, "usable").otherwise("insufficient")
    message = {"usable": "usable sequences", "insufficient": f"no sequence of {least} rows", "ignored": "no groups of market records"}
    told = F.element_at(F.create_map(*[F.lit(x) for pair in message.items() for x in pair]), F.col("status"))
    count = lambda c: F.when(F.col("status").isin("ignored", "error"), F.lit(0)).otherwise(F.col(c)).cast("long").alias(c)
    kind = F.coalesce(F.nullif(F.regexp_extract(_name(), r"\.([^.]+)$", 1), F.lit("")), F.lit("unknown"))
    return known.withColumn("status", status).select("path", kind.alias("format"), *[count(c) for c in ("record_groups", "records", "vectors", "usable_sequences")], "status", F.coalesce("failure", told, F.lit("a record lacks its close or volatility")).alias("message"))


def inspect_folder(spark: SparkSession, root: str) -> DataFrame:
    """source_inventory() of the files under root but those whose names begin with a dot; a missing root has none."""
    if not exists(spark, root):
        return spark.createDataFrame([], "path string, format string, record_groups long, records long, vectors long, usable_sequences long, status string, message string")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
    as_listed = lambda df: df.withColumn("path", F.regexp_replace("path", "^file:/+", "file:///"))
    groups = record_groups(as_listed(_lines(spark, root, ".json", wholetext=True)))
    flat = as_listed(file_records(spark, root)).where(~F.col("path").endswith(".json"))
    rows = flat.select("path", F.lit(0).alias("grp"), F.lit(0).alias("pos"), "record", F.when(F.try_parse_json("record").isNull(), "no JSON object").alias("message"))
    return source_inventory(listed.where(~_name().startswith(".")), groups.unionByName(rows))
