"""Queries over the registry that stands on documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.catalog import table
from ledgertide.functions import text as T
from ledgertide.operators import registry_ops as R

ORDER = ["source", "doc_id"]
#: Labels in the raw spelling for the four kinds of labelled documents.
_RAW_LABEL = """CASE WHEN quality = 1 AND toxic = 0 THEN 'Hawkish ' WHEN quality = 1 THEN 'Dovish-tone'
  WHEN quality = 0 AND toxic = 0 THEN 'balance  sheet' WHEN quality = 0 THEN 'other' ELSE '' END"""
_LANG_DATE = "CASE lang WHEN 'en' THEN '2024-01-02' WHEN 'fr' THEN '20240103' WHEN 'de' THEN '2024' WHEN 'es' THEN '2024-1-5' ELSE '' END"
_SPREAD = "date_format(date_add(DATE'2024-01-01', CAST(doc_id % 20 AS INT)), 'yyyy-MM-dd')"


def raw_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select(
        "doc_id", "source", F.col("doc_id").alias("source_record_id"), F.lit("statement").alias("document_type"), T.event_date(F.expr(_LANG_DATE)).alias("event_date"), F.lit("").alias("title"),
        "text", F.expr(_RAW_LABEL).alias("label"), F.lit("test").alias("license_scope"), F.lit("").alias("citation_ref"), F.expr(_SPREAD).alias("spread_date"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry with doc_id beside it, as the order of input."""
    raw = raw_registry(spark, sf_dir)
    rows = R.normalized_records(raw).withColumn("doc_id", F.col("source_record_id").cast("long"))
    return R.with_labels(rows.where("text <> '' AND event_date <> ''"))


def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("text"))


def text_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.text_hash(F.col("text")).alias("text_hash"))


def record_id(spark, sf_dir):
    return raw_registry(spark, sf_dir).select("doc_id", T.record_id(F.col("source"), F.col("doc_id"), F.col("spread_date")).alias("record_id"))


_DATES = """CASE doc_id % 7 WHEN 0 THEN '20240131' WHEN 1 THEN '2024' WHEN 2 THEN '01/31/2024' WHEN 3 THEN '2024-01-31'
  WHEN 4 THEN '2024-01-31T10:00:00' WHEN 5 THEN '' ELSE 'n.d.' END"""
_YEARS = "CASE doc_id % 3 WHEN 0 THEN '2023' WHEN 1 THEN '23' ELSE '' END"


def coerce_event_date(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.event_date(F.expr(_DATES), F.expr(_YEARS)).alias("event_date"))


_TYPES = "CASE doc_id % 6 WHEN 0 THEN '0' WHEN 1 THEN ' Minutes ' WHEN 2 THEN '1' WHEN 3 THEN 'STATEMENT' WHEN 4 THEN '' ELSE 'Press  Release' END"


def doc_type_map(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.document_type(F.expr(_TYPES)).alias("document_type"))


_LABELS = """CASE doc_id % 14 WHEN 0 THEN 'Hawkish' WHEN 1 THEN 'label-2' WHEN 2 THEN 'EASING' WHEN 3 THEN 'LABEL_1' WHEN 4 THEN 'increase' WHEN 5 THEN 'balance sheet'
  WHEN 6 THEN 'hawkish dovish' WHEN 7 THEN '' WHEN 8 THEN 'Positive' WHEN 9 THEN 'Negative' WHEN 10 THEN '  mixed ' WHEN 11 THEN 'unclear' WHEN 12 THEN 'very accommodative stance' ELSE '2' END"""


def label_map(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.map_label(F.expr(_LABELS)).alias("mapped_label"))


def prediction_label_map(spark, sf_dir):
    raw = F.expr(_LABELS)
    return table(spark, sf_dir, "documents").select("doc_id", T.map_prediction(raw).alias("label"), T.signal_label(raw).alias("signal"))


_CHECKED = """CASE doc_id % 6 WHEN 0 THEN '2024-01-31' WHEN 1 THEN '2024-1-5' WHEN 2 THEN '2024-02-30' WHEN 3 THEN '0131-20-24' WHEN 4 THEN '2024-01-31T10:00:00' ELSE '' END"""


def invalid_dates(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_CHECKED).alias("event_date"))
    return rows.where(~T.is_valid_date(F.col("event_date")))


def meeting_type(spark, sf_dir):
    title = F.expr("CASE doc_id % 3 WHEN 0 THEN 'Unscheduled call' WHEN 1 THEN 'SCHEDULED' ELSE 'Statement' END")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.meeting_type(title, F.col("text")).alias("meeting_type"))


def horizon_steps(spark, sf_dir):
    raw = F.expr("CASE doc_id % 5 WHEN 0 THEN '5d' WHEN 1 THEN '0d' WHEN 2 THEN '10D' WHEN 3 THEN 'week' ELSE NULL END")
    return table(spark, sf_dir, "documents").select("doc_id", T.horizon_steps(raw).alias("steps"))


def error_tone(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    kind = F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'mape' ELSE 'rmse' END")
    value = F.expr("CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 700) / 100D END")
    return orders.select("o_orderkey", T.error_tone(kind, value, F.expr("CAST(o_orderkey % 4 AS DOUBLE) * 100")).alias("tone"))


def ingest_rejects(spark, sf_dir):
    raw = raw_registry(spark, sf_dir)
    holes = raw.withColumns({"text": F.expr("CASE WHEN doc_id % 10 = 0 THEN ' \t' ELSE text END"), "event_date": F.expr("CASE WHEN doc_id % 15 = 0 OR doc_id % 7 = 3 THEN '' ELSE spread_date END")})
    return R.ingest(holes)[1]


def ingestion_summary(spark, sf_dir):
    return R.ingestion_summary(registry(spark, sf_dir))


def label_counts(spark, sf_dir):
    return R.label_counts(registry(spark, sf_dir))


def label_exceptions(spark, sf_dir):
    return R.label_exceptions(registry(spark, sf_dir))


def exact_dedup(spark, sf_dir):
    return R.exact_dedup(registry(spark, sf_dir), ORDER, ["record_id", "event_date", "text_hash"])


def exact_dedup_dropped(spark, sf_dir):
    return R.exact_dropped(registry(spark, sf_dir), ORDER)


def source_record_dupes(spark, sf_dir):
    raw = raw_registry(spark, sf_dir)
    rows = raw.select(T.record_id(F.col("source"), F.col("doc_id"), F.col("spread_date")).alias("record_id"), "source", F.expr("CAST(doc_id div 40 AS STRING)").alias("source_record_id"), "doc_id")
    return R.source_record_dupes(rows, ["doc_id"])


def leakage_status(spark, sf_dir):
    return R.leakage_status(registry(spark, sf_dir), ["doc_id"])


def distribution_report(spark, sf_dir):
    return R.distribution(registry(spark, sf_dir))


def near_dedup(spark, sf_dir):
    """By the registry's own dates; whole texts."""
    return R.near_dedup(registry(spark, sf_dir))


def union_sources(spark, sf_dir):
    statements = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_name"), F.lit("documents.json").alias("source_file"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("pages.json").alias("source_file"))
    return statements.unionByName(pages, allowMissingColumns=True)


def documents_listing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat_ws(" ", F.lit("Document"), "doc_id").alias("title"), F.expr(_SPREAD).alias("date"), F.lit("statement").alias("document_type"), F.lit(0).alias("file_ord"), F.col("doc_id").alias("pos"))
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("title"), F.lit("2024-01-10").alias("date"), F.lit("minutes").alias("document_type"), F.lit(1).alias("file_ord"), F.col("page_id").alias("pos"))
    return docs.unionByName(pages).orderBy(F.desc("date"), "file_ord", "pos").select("title", "date", "document_type")


def unique_links(spark, sf_dir):
    """Addresses without query or fragment, each with the first page that has it."""
    links = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("link"))
    return links.groupBy("link").agg(F.min("page_id").alias("page_id"))


_NORM = r"trim(regexp_replace(coalesce({0}, ''), '[\x{{09}}-\x{{0d}}\x{{1c}}-\x{{20}}\x{{85}}\pZ]+', ' ', 'g'))"
_CLEAN = "replace(lower(" + _NORM + "), '-', '_')"


def _when_label(column: str) -> str:
    exact = "".join(f" WHEN {column} IN ({', '.join(repr(v) for v in values)}) THEN '{name}'" for name, values in T.EXACT_LABELS.items())
    parts = "".join(" WHEN " + " OR ".join(f"contains({column}, '{p}')" for p in values) + f" THEN '{name}'" for name, values in T.PART_LABELS.items())
    return f"CASE WHEN {column} = '' THEN NULL{exact}{parts} END"


_DUCK_SPREAD = "strftime(DATE '2024-01-01' + CAST(doc_id % 20 AS INT), '%Y-%m-%d')"
_RAW = f"raw AS (SELECT doc_id, source, text, {_RAW_LABEL} AS label, CASE lang WHEN 'en' THEN '2024-01-02' WHEN 'fr' THEN '2024-01-03' WHEN 'de' THEN '2024-01-01' WHEN 'es' THEN '2024-1-5' ELSE '' END AS event_date, {_DUCK_SPREAD} AS spread_date FROM documents LEFT JOIN labels USING (doc_id))"
_REG = f"{_RAW}, reg AS (SELECT doc_id, source, event_date, label, substr(sha256(source || ':' || doc_id || ':' || event_date), 1, 16) AS record_id, sha256({_NORM.format('text')}) AS text_hash, {_when_label(_CLEAN.format('label'))} AS mapped_label FROM raw WHERE {_NORM.format('text')} <> '' AND event_date <> '')"


def _duck_event_date(raw: str, year: str) -> str:
    d = f"regexp_replace({raw}, '[^0-9]', '', 'g')"
    return f"CASE WHEN {raw} = '' THEN CASE WHEN regexp_full_match({year}, '[0-9]{{4}}') THEN {year} || '-01-01' ELSE '' END WHEN length({d}) = 8 THEN substr({d}, 1, 4) || '-' || substr({d}, 5, 2) || '-' || substr({d}, 7, 2) WHEN length({d}) = 4 THEN {d} || '-01-01' ELSE {raw} END"


QUERIES = {f.__name__: f for f in (
    normalize_text, text_hash, record_id, coerce_event_date, doc_type_map, label_map, prediction_label_map, invalid_dates, meeting_type, horizon_steps, error_tone, ingest_rejects,
    ingestion_summary, label_counts, label_exceptions, exact_dedup, exact_dedup_dropped, source_record_dupes, leakage_status, distribution_report, near_dedup, union_sources, documents_listing, unique_links,
)}

_VALID = "regexp_full_match(event_date, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') AND try_strptime(event_date, '%Y-%m-%d') IS NOT NULL"
ORACLES = {
    "normalize_text": f"SELECT doc_id, {_NORM.format('text')} AS text FROM documents",
    "text_hash": f"SELECT doc_id, sha256({_NORM.format('text')}) AS text_hash FROM documents",
    "record_id": f"WITH {_RAW} SELECT doc_id, substr(sha256(source || ':' || doc_id || ':' || spread_date), 1, 16) AS record_id FROM raw",
    "coerce_event_date": f"WITH d AS (SELECT doc_id, {_DATES} AS r, {_YEARS} AS y FROM documents) SELECT doc_id, {_duck_event_date('r', 'y')} AS event_date FROM d",
    "doc_type_map": f"WITH d AS (SELECT doc_id, lower({_NORM.format('(' + _TYPES + ')')}) AS t FROM documents) SELECT doc_id, CASE WHEN t IN ('0', 'minutes') THEN 'minutes' WHEN t IN ('1', 'statement') THEN 'statement' WHEN t = '' THEN 'unknown' ELSE t END AS document_type FROM d",
    "label_map": f"WITH d AS (SELECT doc_id, {_CLEAN.format('(' + _LABELS + ')')} AS l FROM documents) SELECT doc_id, {_when_label('l')} AS mapped_label FROM d",
    "prediction_label_map": f"""WITH d AS (SELECT doc_id, replace(lower({_NORM.format('(' + _LABELS + ')')}), '-', '_') AS l, upper({_LABELS}) AS u FROM documents)
      SELECT doc_id, CASE WHEN contains(l, 'hawk') OR contains(l, 'positive') OR l IN ('label_2', '2') THEN 'hawkish' WHEN contains(l, 'dov') OR contains(l, 'negative') OR l IN ('label_0', '0') THEN 'dovish' ELSE 'neutral' END AS label,
      CASE WHEN contains(u, 'POSITIVE') OR contains(u, 'LABEL_1') THEN 'Hawkish' WHEN contains(u, 'NEGATIVE') OR contains(u, 'LABEL_0') THEN 'Dovish' WHEN u = '' THEN 'Unknown' ELSE u END AS signal FROM d""",
    "invalid_dates": f"WITH d AS (SELECT doc_id, {_CHECKED} AS event_date FROM documents) SELECT * FROM d WHERE NOT ({_VALID})",
    "meeting_type": "WITH d AS (SELECT doc_id, lower(CASE doc_id % 3 WHEN 0 THEN 'Unscheduled call' WHEN 1 THEN 'SCHEDULED' ELSE 'Statement' END || ' ' || coalesce(text, '')) AS b FROM documents) SELECT doc_id, CASE WHEN contains(b, 'unscheduled') THEN 'Unscheduled' WHEN contains(b, 'scheduled') THEN 'Scheduled' ELSE 'Regular' END AS meeting_type FROM d",
    "horizon_steps": "SELECT doc_id, CAST(CASE doc_id % 5 WHEN 0 THEN 5 WHEN 1 THEN 1 WHEN 2 THEN 10 ELSE 3 END AS INT) AS steps FROM documents",
    "error_tone": """WITH d AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS m, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 700) / 100::DOUBLE END AS v, CAST(o_orderkey % 4 AS DOUBLE) * 100 AS b FROM orders),
      e AS (SELECT *, CASE WHEN b > 0 THEN v / b * 100 ELSE v END AS s FROM d)
      SELECT o_orderkey, CASE WHEN v IS NULL THEN 'neutral' WHEN m THEN CASE WHEN v <= 2 THEN 'low' WHEN v <= 5 THEN 'medium' ELSE 'high' END WHEN s <= 1 THEN 'low' WHEN s <= 2.5 THEN 'medium' ELSE 'high' END AS tone FROM e""",
    "ingest_rejects": f"""WITH {_RAW}, h AS (SELECT *, CASE WHEN doc_id % 10 = 0 THEN '' ELSE {_NORM.format('text')} END AS t, CASE WHEN doc_id % 15 = 0 OR doc_id % 7 = 3 THEN '' ELSE spread_date END AS e FROM raw)
      SELECT substr(sha256(source || ':' || doc_id || ':' || e), 1, 16) AS record_id, source, CAST(doc_id AS VARCHAR) AS source_record_id, CASE WHEN t = '' THEN 'blank_text' ELSE 'blank_event_date' END AS reason FROM h WHERE t = '' OR e = ''""",
    "ingestion_summary": f"WITH {_REG} SELECT source, count(*) AS records, count(*) FILTER (WHERE label <> '') AS labelled FROM reg GROUP BY source",
    "label_counts": f"WITH {_REG} SELECT CASE WHEN label = '' THEN 'unlabeled' ELSE coalesce(mapped_label, 'unmapped') END AS outcome, count(*) AS records FROM reg GROUP BY 1",
    "label_exceptions": f"WITH {_REG} SELECT record_id, source, label FROM reg WHERE mapped_label IS NULL AND label <> ''",
    "exact_dedup": f"WITH {_REG} SELECT record_id, event_date, text_hash FROM reg QUALIFY row_number() OVER (PARTITION BY event_date, text_hash ORDER BY source, doc_id) = 1",
    "exact_dedup_dropped": f"WITH {_REG} SELECT record_id, first_value(record_id) OVER w AS kept_record_id, event_date FROM reg WINDOW w AS (PARTITION BY event_date, text_hash ORDER BY source, doc_id) QUALIFY row_number() OVER w > 1",
    "source_record_dupes": f"WITH {_RAW}, r AS (SELECT *, substr(sha256(source || ':' || doc_id || ':' || spread_date), 1, 16) AS record_id, source || '::' || (doc_id // 40) AS key FROM raw) SELECT record_id, first_value(record_id) OVER w AS first_record_id, key FROM r WINDOW w AS (PARTITION BY key ORDER BY doc_id) QUALIFY row_number() OVER w > 1",
    "leakage_status": f"WITH {_REG}, c AS (SELECT count(*) FILTER (WHERE NOT ({_VALID})) AS a, count(*) - count(DISTINCT source || '::' || doc_id) AS b FROM reg) SELECT a AS invalid_event_dates, b AS source_record_duplicates, CASE WHEN a > 0 OR b > 0 THEN 'fail' ELSE 'pass' END AS status FROM c",
    "distribution_report": f"WITH {_REG}, r AS (SELECT source, coalesce(mapped_label, 'unlabeled') AS label FROM reg) SELECT source, label, count(*) AS records FROM r GROUP BY GROUPING SETS ((source, label), (source), (label))",
    "union_sources": "SELECT doc_id, source AS source_name, 'documents.json' AS source_file FROM documents UNION ALL SELECT page_id, NULL, 'pages.json' FROM pages",
    "documents_listing": f"SELECT 'Document ' || doc_id AS title, {_DUCK_SPREAD} AS date, 'statement' AS document_type FROM documents UNION ALL SELECT url, '2024-01-10', 'minutes' FROM pages",
    "unique_links": "SELECT regexp_replace(url, '[?#].*$', '') AS link, min(page_id) AS page_id FROM pages GROUP BY 1",
}
