"""Queries that need Python in their tasks, and the inventory of source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgertide.catalog import table
from ledgertide.operators import evaluation as E
from ledgertide.operators import features as X
from ledgertide.operators import forecast as O
from ledgertide.operators import sentiment as S
from ledgertide.plans import analysis, markets
from ledgertide.sources import readers, scans
from ledgertide.working import stored


def page_articles(spark, sf_dir):
    return readers.articles(readers.parse_pages(table(spark, sf_dir, "pages")), F.lit("statement"))


def page_links(spark, sf_dir):
    return readers.links(readers.parse_pages(table(spark, sf_dir, "pages")), "example")


def sentiment_scores(spark, sf_dir):
    """The best label of each document by a classifier that workers load: the model of the training rows."""
    model, priors, _ = analysis._word_model(spark, sf_dir)
    means = E.chunk_mean(S.score_chunks(analysis._chunks(spark, sf_dir), S.word_scorer(model, priors)))
    return E.top_label(means.withColumn("score", F.round("score", 6)), S.label_order())


def _scaled(spark, sf_dir):
    return X.scaled(markets._vectors(spark, sf_dir))


def forecast(spark, sf_dir):
    scaled = _scaled(spark, sf_dir)
    return O.forecast(scaled, stored(O.train(scaled), "models"), 3).drop("adapted_epochs")


def forecast_adapted(spark, sf_dir):
    scaled = _scaled(spark, sf_dir)
    return O.forecast(scaled, stored(O.train(scaled, O.Config(epochs=2)), "models"), 3, adapt=True)


def forecast_assembled(spark, sf_dir):
    vector = markets._vectors(spark, sf_dir)
    return O.assembled(vector, forecast_bands(spark, sf_dir), X.axis_scale(vector, "market_volatility", ["symbol"]))


def forecast_bands(spark, sf_dir):
    return X.bands(forecast(spark, sf_dir), X.spreads(markets._vectors(spark, sf_dir)))


def sweep_trials(spark, sf_dir):
    grid = E.sweep_grid(spark, hidden=[8, 16], learning_rate=[0.01, 0.005]).selectExpr("hidden", "learning_rate", "CAST(hidden * 10 + learning_rate * 1000 AS INT) AS trial")
    return O.sweep(_scaled(spark, sf_dir), grid)


_FILES = """concat('{"records": [', array_join(transform(sequence(1, CAST(doc_id % 9 AS INT) + 1), i -> concat('{"date": "2024-01-0', CAST(i AS STRING), CASE WHEN doc_id % 11 = 0 THEN '"}' ELSE '", "close": 10, "volatility_5d": 0.1}' END)), ','), ']}')"""


def source_inventory(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id")).alias("path"), F.when(F.col("doc_id") % 13 == 0, "{}").otherwise(F.expr(_FILES)).alias("value"))
    return scans.source_inventory(docs, scans.record_groups(docs))


QUERIES = {f.__name__: f for f in (page_articles, page_links, sentiment_scores, forecast, forecast_adapted, forecast_assembled, forecast_bands, sweep_trials, source_inventory)}
_LINKS = """l AS (SELECT url, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a FROM pages)"""
ORACLES = {
    "sentiment_scores": analysis.ORACLES["sentiment_top_label"],
    "page_links": f"""WITH {_LINKS} SELECT url, regexp_extract(url, '^https?://[^/]+') || replace(regexp_extract(a, 'href="([^"]*)"', 1), '&amp;', '&') AS href, trim(replace(regexp_extract(a, '>([^<]*)<', 1), '&amp;', '&')) AS text FROM l""",
    "source_inventory": """SELECT 'f' || doc_id AS path, 'unknown' AS format, CASE WHEN doc_id % 13 = 0 OR doc_id % 11 = 0 THEN 0 ELSE doc_id % 9 + 1 END AS vectors, CASE WHEN doc_id % 13 = 0 THEN 'no groups of market records' WHEN doc_id % 11 = 0 THEN 'a record lacks its close or volatility' WHEN doc_id % 9 + 1 > 5 THEN 'usable sequences' ELSE 'no sequence of 6 rows' END AS message, CASE WHEN doc_id % 13 = 0 OR doc_id % 11 = 0 THEN 0 ELSE 1 END AS record_groups, CASE WHEN doc_id % 13 = 0 OR doc_id % 11 = 0 THEN 0 ELSE doc_id % 9 + 1 END AS records,
      CASE WHEN doc_id % 13 = 0 OR doc_id % 11 = 0 THEN 0 WHEN doc_id % 9 + 1 > 5 THEN 1 ELSE 0 END AS usable_sequences, CASE WHEN doc_id % 13 = 0 THEN 'ignored' WHEN doc_id % 11 = 0 THEN 'error' WHEN doc_id % 9 + 1 > 5 THEN 'usable' ELSE 'insufficient' END AS status FROM documents""",
}
