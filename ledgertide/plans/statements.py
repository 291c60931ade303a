"""Queries given as SQL text, by table functions, by chosen semi and anti joins, over a sorted registry, and whole evaluation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgertide import sql
from ledgertide.catalog import table
from ledgertide.operators import packaging as P
from ledgertide.operators import selection as C
from ledgertide.plans import corpus, markets
from ledgertide.sources import runs
from ledgertide.working import shared_dir

_REQUESTS = "SELECT doc_id, element_at(array('click', 'error', 'purchase', 'signup', 'view'), CAST(doc_id % 5 AS INT) + 1) AS symbol, date_add(DATE'2023-12-25', CAST(doc_id % 50 AS INT)) AS requested_date FROM documents"


def sql_asof(spark, sf_dir):
    """The as-of rule as a correlated subquery."""
    return sql.query(spark, sf_dir, f"""SELECT doc_id, symbol, CAST(requested_date AS STRING) AS requested_date, CAST(price.date_used AS STRING) AS date_used, price.close FROM
      (SELECT q.*, (SELECT max(struct(c.date_used, c.close)) FROM closes_by_day c WHERE c.symbol = q.symbol AND c.day = q.requested_date) AS price FROM ({_REQUESTS}) q) WHERE price IS NOT NULL""")  # fmt: skip


def sql_label_changes(spark, sf_dir):
    """Labels and keys of the registry by SQL functions."""
    return sql.query(spark, sf_dir, """SELECT source, mapped_label, records, keys_agree, round(scaled, 6) AS scaled FROM (SELECT source, mapped_label, count(*) AS records,
      count_if(record_key(source, source_record_id, event_date) = record_id) AS keys_agree, on_scale(pct_change(count_if(label = ''), count(*)), 10) AS scaled FROM registry GROUP BY source, mapped_label)""")  # fmt: skip


def lateral_chunks(spark, sf_dir):
    return sql.query(spark, sf_dir, "SELECT d.doc_id, c.chunk, c.n_tokens, md5(c.tokens) AS digest FROM documents d, LATERAL token_chunks(d.text, 480, 400) c")


def lateral_returns(spark, sf_dir):
    found = sql.query(spark, sf_dir, "SELECT symbol, CAST(date AS STRING) AS date, close, round(ret, 8) AS ret, round(volatility, 8) AS volatility_5d FROM series_returns(TABLE(closes))")
    return found


def label_whitelist(spark, sf_dir):
    """Documents whose source has labelled good documents only."""
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    fine = labels.groupBy("source").agg(F.count_if(F.expr("quality = 0 AND toxic = 1")).alias("bad")).where("bad = 0").select("source")
    return C.having(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", fine)


def unlabelled_documents(spark, sf_dir):
    return C.lacking(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", table(spark, sf_dir, "labels").select("doc_id"))


def sorted_registry_range(spark, sf_dir):
    """Records of some days, from the files of a registry sorted by date that hold them."""
    path = f"{shared_dir(spark, 'sorted-registry')}/registry"
    rows = corpus.registry(spark, sf_dir).withColumn("event_date", F.expr(corpus._SPREAD)).select("record_id", "source", "source_record_id", "event_date", "text_hash")
    runs.write_sorted(rows, path, parts=16)
    return runs.read_range(spark, path, "event_date", "2024-01-03", "2024-01-05").select("record_id", "source", "event_date", "text_hash")


def by_sentence_length():
    """A classifier by how long a text's sentences are; it stands for trained ones, which need weights that no table has."""

    def classify(texts: list[str]) -> list[str]:
        share = [100 * t.count(".") / max(1, len(t)) for t in texts]
        return ["hawkish" if s < 1 else "dovish" if s > 2 else "neutral" for s in share]

    return classify


def evaluation_runs(spark, sf_dir):
    """Metrics of whole evaluation runs on the package's walk-forward folds, as their files hold them; all but the times."""
    rows = markets._package(spark, sf_dir, "text").withColumnRenamed("mapped_label", "label")
    summary = runs.evaluate(rows, P.walk_forward(spark, rows), {"sentence_length": by_sentence_length}, [11, 29, 47], shared_dir(spark, "evaluation"))
    if summary["failures"]:
        raise RuntimeError(summary["failures"][0]["error"])
    out = [(r["model_key"], r["seed"], r["evaluated_rows"], *[round(r["classification"][k], 8) for k in ("accuracy", "macro_f1")], round(r["error_proxy"]["rmse"], 8)) for r in summary["results"]]
    return spark.createDataFrame(out, "model_key string, seed int, evaluated_rows long, accuracy double, macro_f1 double, rmse double")  # a row for each model and seed


QUERIES = {f.__name__: f for f in (sql_asof, sql_label_changes, lateral_chunks, lateral_returns, label_whitelist, unlabelled_documents, sorted_registry_range, evaluation_runs)}

ORACLES = {
    "sql_asof": f"WITH {markets._EV}, {markets._REQ} SELECT doc_id, q.symbol, CAST(requested_date AS VARCHAR) AS requested_date, CAST(date AS VARCHAR) AS date_used, close FROM q ASOF JOIN s ON q.symbol = s.symbol AND s.date <= q.requested_date WHERE date_diff('day', date, requested_date) <= 7",
    "sql_label_changes": f"WITH {corpus._REG}, c AS (SELECT source, mapped_label, count(*) AS records, count(*) FILTER (WHERE label = '') AS u FROM reg GROUP BY 1, 2) SELECT source, mapped_label, records, records AS keys_agree, round(greatest(-1, least(1, (records::DOUBLE / nullif(u, 0) - 1) / 10)), 6) AS scaled FROM c",
    "lateral_chunks": """WITH d AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, k AS chunk, t[k * 400 + 1:k * 400 + 480] AS part FROM d, range(0, 100000) r(k) WHERE k = 0 OR k * 400 + 80 < len(t))
      SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(len(part) AS INTEGER) AS n_tokens, md5(array_to_string(part, ' ')) AS digest FROM c""",
    "lateral_returns": f"WITH {markets._EV} SELECT symbol, CAST(date AS VARCHAR) AS date, close, round(ret, 8) AS ret, round(volatility_5d, 8) AS volatility_5d FROM s",
    "label_whitelist": "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM labels JOIN documents USING (doc_id) GROUP BY source HAVING count(*) FILTER (WHERE quality = 0 AND toxic = 1) = 0)",
    "unlabelled_documents": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "sorted_registry_range": f"WITH {corpus._REG} SELECT record_id, source, {corpus._DUCK_SPREAD} AS event_date, text_hash FROM reg WHERE {corpus._DUCK_SPREAD} BETWEEN '2024-01-03' AND '2024-01-05'",
}
