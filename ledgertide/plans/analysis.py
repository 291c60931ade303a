"""Queries on evaluation and on the dashboard's series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgertide.catalog import table
from ledgertide.functions import text as T
from ledgertide.operators import alignment as A
from ledgertide.operators import evaluation as E
from ledgertide.operators import market as M
from ledgertide.operators import packaging as P
from ledgertide.operators import sentiment as S
from ledgertide.plans import corpus, markets
from ledgertide.sources import packages as K
from ledgertide.working import stored


def _word_model(spark, sf_dir):
    """(model, priors) of the package's training rows, and its rows with doc_id, split, source and label."""
    split = stored(P.time_split(markets._package(spark, sf_dir, "doc_id", "source", "text")), "word-model-rows")
    return *S.fit_words(split.where("split_tag = 'train'").select(F.split("text", " ").alias("tokens"), F.col("mapped_label").alias("label"))), split


def _chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return E.token_chunks(docs.select("doc_id", F.split(T.normalize(F.col("text")), " ").alias("tokens")))


def _predictions(spark, sf_dir):
    """Labels of the validation and test rows beside those that the model of the training rows gives their texts."""
    model, priors, split = _word_model(spark, sf_dir)
    own = split.where("split_tag <> 'train'")
    chunks = E.token_chunks(own.select("doc_id", F.split("text", " ").alias("tokens")))
    pred = E.top_label(_rounded(E.chunk_mean(S.score_words(chunks, model, priors))), S.label_order())
    return own.join(pred.select("doc_id", F.col("label").alias("pred")), "doc_id").select("source", F.col("mapped_label").alias("label"), "pred")


def _rounded(df, places=8):
    return df.withColumns({c: F.round(c, places) for c, kind in df.dtypes if kind == "double"})


def classification_metrics(spark, sf_dir):
    return _rounded(E.classification(_predictions(spark, sf_dir), ["source"]))


def ordinal_error(spark, sf_dir):
    return _rounded(E.ordinal_error(_predictions(spark, sf_dir), ["source"]))


def latency_percentile(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "value")
    return E.lower_percentiles(rows, "value", {"p50": 0.5, "p95": 0.95}, ["event_type"])


def combined_rmse(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("close"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000).alias("pred_close"), F.col("l_discount").alias("vol"), F.col("l_tax").alias("pred_vol"))
    return _rounded(E.combined_rmse(rows, ["l_returnflag"]), 5)


def sentiment_chunk_mean(spark, sf_dir):
    """Mean scores over each document's chunks by the model of the training rows."""
    model, priors, _ = _word_model(spark, sf_dir)
    return _rounded(E.chunk_mean(S.score_words(_chunks(spark, sf_dir), model, priors)), 6)


def sentiment_top_label(spark, sf_dir):
    return E.top_label(sentiment_chunk_mean(spark, sf_dir), S.label_order())


def token_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("tokens"))
    return E.token_chunks(docs).select("doc_id", "chunk", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest"))


def sample_rows(spark, sf_dir):
    return E.sample_rows(table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"], seed=11, cap=300)


def run_specs(spark, sf_dir):
    plan = E.sweep_grid(spark, model=["finbert", "baseline", "longform"], seed=[11, 29, 47, 71, 97])
    return plan.select("model", "seed", F.format_string("run_%s_v1.0.0_s%d", "model", "seed").alias("run_id"))


def sweep_grid(spark, sf_dir):
    return E.sweep_grid(spark, hidden=[32, 64], layers=[1, 2], dropout=[0.1], learning_rate=[0.001, 0.0005], batch=[16])


_TRIAL = "o_orderkey AS trial, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey * 37 % 101) / 100{d} END AS combined_rmse, (o_orderkey * 53 % 97) / 100{d} AS loss"


def _trials(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*[x.strip() for x in _TRIAL.format(d="D").split(", ")])


def sweep_best(spark, sf_dir):
    return E.best_trial(_trials(spark, sf_dir))


def trial_flatten(spark, sf_dir):
    nested = _trials(spark, sf_dir).select("trial", F.struct(F.struct("combined_rmse", "loss").alias("metrics"), F.struct((F.col("trial") % 4).alias("layers")).alias("config")).alias("summary"))
    return nested.select("trial", "summary.metrics.*", "summary.config.layers")


def acceptance_gate(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS run_id", "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'd1' END AS dataset_version", "'m1' AS model_version", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 0.5D END AS macro_f1", "CAST(o_orderkey % 3 AS INT) AS artifacts", "CASE WHEN o_orderkey % 11 = 0 THEN 'fail' ELSE 'pass' END AS leakage")
    return E.acceptance(runs)


def seed_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderpriority AS model", "(o_orderkey % 97) / 100D AS macro_f1", "(o_orderkey % 31) / 100D AS worst_f1", "CAST(o_orderkey % 300 AS DOUBLE) AS p95")
    return _rounded(E.seed_summary(rows), 6)


def _points(spark, sf_dir):
    """Three series of each event type: history, forecasts stamped day+n, realized days."""
    closes = M.daily_closes(table(spark, sf_dir, "events")).selectExpr("symbol", "CAST(date AS STRING) AS day", "close", "day(date) AS d")
    history = closes.where("d <= 20").selectExpr("symbol", "d AS pos", "day AS ts", "close AS value")
    forecast = closes.where("d BETWEEN 18 AND 27").selectExpr("symbol", "d AS pos", "CASE WHEN d % 3 = 0 THEN concat(day, '+1') ELSE day END AS ts", "close * 1.02D AS value", "close * 0.97D AS lower", "close * 1.01D AS upper")
    realized = closes.where("d > 22").selectExpr("symbol", "d AS pos", "day AS ts", "close AS value")
    return history, forecast, realized


def series_align(spark, sf_dir):
    return _rounded(A.aligned(*_points(spark, sf_dir), ["symbol"]))


def _pairs(spark, sf_dir):
    _, forecast, realized = _points(spark, sf_dir)
    return A.pairs(forecast, realized, ["symbol"])


def forecast_pairs(spark, sf_dir):
    return _rounded(_pairs(spark, sf_dir))


def forecast_error(spark, sf_dir):
    return _rounded(E.forecast_error(_pairs(spark, sf_dir), ["symbol"]), 6)


def error_badges(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    base = pairs.groupBy("symbol").agg(E.steady_mean(F.col("realized")).alias("baseline"))
    return _rounded(A.error_badges(E.forecast_error(pairs, ["symbol"]).join(base, "symbol"), "baseline"), 6)


def evaluation_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "CASE doc_id % 5 WHEN 0 THEN ' Hawkish' WHEN 1 THEN 'DOVISH' WHEN 2 THEN 'neutral' WHEN 3 THEN 'other' ELSE NULL END AS mapped_label", "CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE '2024-01-02' END AS event_date")
    return K.evaluation_rows(rows).select(F.md5("text").alias("digest"), "label", "event_date")


def _ends(spark, sf_dir):
    history, forecast, _ = _points(spark, sf_dir)
    last = history.groupBy("symbol").agg(F.max_by("value", "pos").alias("current"))
    ahead = forecast.groupBy("symbol").agg(F.max_by(F.struct(F.col("value").alias("predicted"), "lower", "upper"), "pos").alias("f")).select("symbol", "f.*")
    return last.join(ahead, "symbol")


def forecast_delta(spark, sf_dir):
    return _rounded(_ends(spark, sf_dir).select("symbol", A.percent_change(F.col("predicted"), F.col("current")).alias("pct"), (F.col("predicted") - F.col("current")).alias("diff")), 6)


def spot_delta(spark, sf_dir):
    return _rounded(A.spot_delta(_ends(spark, sf_dir).select("symbol", "predicted", "current")), 6)


def spot_band_check(spark, sf_dir):
    return _rounded(A.band_check(_ends(spark, sf_dir), "current", 0.015).select("symbol", "within", "distance", "distance_pct", "tone"), 6)


def realized_band_check(spark, sf_dir):
    _, forecast, realized = _points(spark, sf_dir)
    bands = A.last_by_day(forecast, ["symbol"], ["lower", "upper"])
    own = realized.selectExpr("symbol", "ts AS day", "value AS realized")
    checked = A.band_check(A.latest(own.join(bands, ["symbol", "day"]), ["symbol"]), "realized", 0.02)
    return _rounded(checked.select("symbol", "day", "within", "distance", "distance_pct", "tone"), 6)


QUERIES = {f.__name__: f for f in (
    classification_metrics, ordinal_error, latency_percentile, combined_rmse, sentiment_chunk_mean, sentiment_top_label, token_chunks, sample_rows, run_specs, sweep_grid, sweep_best, trial_flatten, acceptance_gate, seed_summary,
    series_align, forecast_pairs, forecast_error, error_badges, evaluation_rows, forecast_delta, spot_delta, spot_band_check, realized_band_check,
)}

_MODEL = f"""{markets._SPLIT}, z AS MATERIALIZED (SELECT doc_id, reg.source, mapped_label AS label, place, {corpus._NORM.format('text')} AS text FROM t JOIN reg USING (record_id) JOIN documents USING (doc_id)),
  l AS (SELECT unnest(['hawkish', 'dovish', 'neutral']) AS label, unnest([1, 2, 3]) AS nth), u AS (SELECT label, lower(unnest(string_split(text, ' '))) AS word FROM z WHERE place = 1), n AS MATERIALIZED (SELECT word, label, count(*) AS n FROM u WHERE word <> '' GROUP BY 1, 2),
  top AS MATERIALIZED (SELECT word FROM n GROUP BY word ORDER BY sum(n) DESC, word LIMIT 20000), kn AS (SELECT n.* FROM n JOIN top USING (word)), tot AS (SELECT l.label, coalesce(sum(n), 0) AS n FROM l LEFT JOIN kn USING (label) GROUP BY 1),
  prior AS MATERIALIZED (SELECT l.label, nth, ln((count(z.doc_id) + 1) / (SELECT count(*) + 3 FROM z WHERE place = 1)) AS lp FROM l LEFT JOIN z ON z.label = l.label AND place = 1 GROUP BY 1, 2),
  model AS MATERIALIZED (SELECT top.word, tot.label, ln((coalesce(kn.n, 0) + 1) / (tot.n + (SELECT count(*) FROM top))) AS lp FROM top CROSS JOIN tot LEFT JOIN kn ON kn.word = top.word AND kn.label = tot.label)"""
_CHUNKED = """w AS (SELECT doc_id, string_split(text, ' ') AS w FROM y), ch AS MATERIALIZED (SELECT doc_id, k AS chunk, w[k * 400 + 1:k * 400 + 480] AS part FROM w, range(0, 100000) r(k) WHERE k = 0 OR k * 400 + 80 < len(w)),
  sw AS (SELECT doc_id, chunk, label, sum(lp) AS lp FROM (SELECT doc_id, chunk, lower(unnest(part)) AS word FROM ch) JOIN model USING (word) GROUP BY 1, 2, 3),
  s AS (SELECT ch.doc_id, ch.chunk, prior.label, nth, coalesce(sw.lp, 0) + prior.lp AS lp FROM ch CROSS JOIN prior LEFT JOIN sw ON sw.doc_id = ch.doc_id AND sw.chunk = ch.chunk AND sw.label = prior.label),
  e AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY doc_id, chunk)) AS e FROM s), q AS (SELECT *, e / sum(e) OVER (PARTITION BY doc_id, chunk) AS score FROM e)"""
_CHUNKS = f"{_MODEL}, y AS (SELECT doc_id, {corpus._NORM.format('text')} AS text FROM documents WHERE text IS NOT NULL), {_CHUNKED}, m AS (SELECT doc_id, label, nth, round(avg(score), 6) AS score FROM q GROUP BY ALL)"
_P = f"{_MODEL}, y AS (SELECT doc_id, text FROM z WHERE place > 1), {_CHUNKED}, m AS (SELECT doc_id, label, nth, round(avg(score), 8) AS score FROM q GROUP BY ALL), g AS (SELECT doc_id, label AS pred FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, nth) = 1), judged AS (SELECT z.source, z.label, g.pred FROM z JOIN g USING (doc_id))"
_EVENTS = """c AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS date, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2), x AS (SELECT symbol, CAST(date AS VARCHAR) AS day, close, day(date) AS d FROM c),
  h AS (SELECT symbol, d, day, close AS value FROM x WHERE d <= 20), f AS (SELECT symbol, d, day, close * 1.02::DOUBLE AS value, close * 0.97::DOUBLE AS lower, close * 1.01::DOUBLE AS upper FROM x WHERE d BETWEEN 18 AND 27), r AS (SELECT symbol, d, day, close AS value FROM x WHERE d > 22)"""
_PAIRS = f"{_EVENTS}, q AS (SELECT r.symbol, r.day, f.value AS forecast, r.value AS realized FROM r JOIN f ON r.symbol = f.symbol AND r.day = f.day)"
_ENDS = f"{_EVENTS}, e AS (SELECT a.symbol, current, predicted, lower, upper FROM (SELECT symbol, arg_max(value, d) AS current FROM h GROUP BY 1) a JOIN (SELECT symbol, arg_max(value, d) AS predicted, arg_max(lower, d) AS lower, arg_max(upper, d) AS upper FROM f GROUP BY 1) b USING (symbol))"


def _check(value: str, caution: str) -> str:
    return f"CASE WHEN {value} BETWEEN lower AND upper THEN 0.0 WHEN {value} < lower THEN lower - {value} ELSE {value} - upper END AS distance, {value} BETWEEN lower AND upper AS within, {caution} AS caution, greatest(abs({value}), 1e-6) AS reference"


_JUDGED = "within, round(distance, 6) AS distance, round(distance / reference * 100, 6) AS distance_pct, CASE WHEN within THEN 'good' WHEN distance / reference <= caution THEN 'caution' ELSE 'danger' END AS tone"
ORACLES = {
    "classification_metrics": f"""WITH {_P}, kc AS (SELECT source, c, count(*) FILTER (WHERE label = c AND pred = c) AS hit, count(*) FILTER (WHERE label = c) AS sup, count(*) FILTER (WHERE pred = c) AS got FROM judged, (VALUES ('hawkish'), ('dovish'), ('neutral')) t(c) GROUP BY 1, 2),
      mf AS (SELECT *, CASE WHEN got > 0 THEN hit / got ELSE 0 END AS p, CASE WHEN sup > 0 THEN hit / sup ELSE 0 END AS r FROM kc), nf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM mf),
      o AS (SELECT source, sum(p) / 3 AS mp, sum(r) / 3 AS mr, sum(f) / 3 AS mf, CASE WHEN sum(sup) > 0 THEN sum(f * sup) / sum(sup) ELSE 0 END AS wf, min(f) AS xf FROM nf GROUP BY 1), a AS (SELECT source, count(*) AS records, avg(CAST(label = pred AS INT)) AS acc FROM judged GROUP BY 1)
      SELECT source, records, round(acc, 8) AS accuracy, round(mp, 8) AS macro_precision, round(mr, 8) AS macro_recall, round(mf, 8) AS macro_f1, round(wf, 8) AS weighted_f1, round(xf, 8) AS worst_f1 FROM o JOIN a USING (source)""",
    "ordinal_error": f"WITH {_P}, o AS (SELECT source, CASE label WHEN 'dovish' THEN -1 WHEN 'neutral' THEN 0 ELSE 1 END AS t, CASE pred WHEN 'dovish' THEN -1 WHEN 'neutral' THEN 0 ELSE 1 END AS q FROM judged) SELECT source, round(sqrt(avg((q - t) * (q - t))), 8) AS rmse, round(avg(abs(q - t) / greatest(abs(t), 1)) * 100, 8) AS mape FROM o GROUP BY 1",
    "latency_percentile": "WITH k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, percentile, value FROM k, (VALUES ('p50', 0.5::DOUBLE), ('p95', 0.95::DOUBLE)) t(percentile, s) WHERE k = CAST(floor((n - 1) * s) AS BIGINT)",
    "combined_rmse": "WITH d AS (SELECT l_returnflag, pow(l_extendedprice / 1000 - l_extendedprice * (1 - l_discount) / 1000, 2) AS c, pow(l_discount - l_tax, 2) AS v FROM lineitem) SELECT l_returnflag, round(sqrt(sum(c) / count(*)), 5) AS close_rmse, round(sqrt(sum(v) / count(*)), 5) AS vol_rmse, round(sqrt((sum(c) + sum(v)) / (2 * count(*))), 5) AS combined_rmse FROM d GROUP BY 1",
    "sentiment_chunk_mean": f"WITH {_CHUNKS} SELECT doc_id, label, score FROM m",
    "sentiment_top_label": f"WITH {_CHUNKS} SELECT doc_id, label, score FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, nth) = 1",
    "token_chunks": "WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, w, k, 400 * k AS a FROM t, range(0, 100000) r(k) WHERE 400 * k <= len(w) AND (k = 0 OR 400 * k + 80 < len(w))) SELECT doc_id, CAST(k AS INT) AS chunk, CAST(len(w[a + 1:a + 480]) AS INT) AS n_tokens, md5(array_to_string(w[a + 1:a + 480], ' ')) AS digest FROM s",
    "run_specs": "SELECT model, CAST(seed AS INT) AS seed, 'run_' || model || '_v1.0.0_s' || seed AS run_id FROM (VALUES ('finbert'), ('baseline'), ('longform')) m(model), (VALUES (11), (29), (47), (71), (97)) s(seed)",
    "sweep_grid": "SELECT * FROM (VALUES (32), (64)) a(hidden), (VALUES (1), (2)) b(layers), (VALUES (0.1::DOUBLE)) c(dropout), (VALUES (0.001::DOUBLE), (0.0005::DOUBLE)) d(learning_rate), (VALUES (16)) e(batch)",
    "sweep_best": f"SELECT {_TRIAL.format(d='::DOUBLE')} FROM orders WHERE o_orderkey % 13 <> 0 ORDER BY combined_rmse, loss, trial LIMIT 1",
    "trial_flatten": f"SELECT {_TRIAL.format(d='::DOUBLE')}, o_orderkey % 4 AS layers FROM orders",
    "acceptance_gate": "SELECT o_orderkey AS run_id, o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 3 > 0 AND o_orderkey % 11 <> 0 AS accepted FROM orders",
    "seed_summary": "WITH r AS (SELECT o_orderpriority AS model, (o_orderkey % 97) / 100::DOUBLE AS a, (o_orderkey % 31) / 100::DOUBLE AS b, o_orderkey % 300 AS c FROM orders), g AS (SELECT model, avg(a) AS mean_f1, coalesce(stddev_samp(a), 0) AS std_f1, avg(b) AS worst_f1, avg(c) AS p95 FROM r GROUP BY 1) SELECT model, round(mean_f1, 6) AS mean_f1, round(std_f1, 6) AS std_f1, round(worst_f1, 6) AS worst_f1, round(p95, 6) AS p95, CAST(row_number() OVER (ORDER BY mean_f1 DESC, worst_f1 DESC, p95, model) AS INT) AS place FROM g",
    "series_align": f"WITH {_EVENTS}, k AS (SELECT symbol, day FROM h UNION SELECT symbol, day FROM f UNION SELECT symbol, day FROM r) SELECT k.symbol, k.day, round(h.value, 8) AS history, round(f.value, 8) AS forecast, round(lower, 8) AS lower, round(upper, 8) AS upper, round(r.value, 8) AS realized, CASE WHEN upper IS NULL THEN 0.0 ELSE round(greatest(upper - lower, 0.0), 8) END AS band FROM k LEFT JOIN h USING (symbol, day) LEFT JOIN f USING (symbol, day) LEFT JOIN r USING (symbol, day)",
    "forecast_pairs": f"WITH {_PAIRS} SELECT symbol, day, round(forecast, 8) AS forecast, round(realized, 8) AS realized FROM q",
    "forecast_error": f"WITH {_PAIRS} SELECT symbol, round(sqrt(avg((realized - forecast) * (realized - forecast))), 6) AS rmse, round(avg(CASE WHEN abs(realized) > 1e-12 THEN abs((realized - forecast) / realized) END) * 100, 6) AS mape FROM q GROUP BY 1",
    "error_badges": f"""WITH {_PAIRS}, e AS (SELECT symbol, sqrt(avg((realized - forecast) * (realized - forecast))) AS rmse, avg(CASE WHEN abs(realized) > 1e-12 THEN abs((realized - forecast) / realized) END) * 100 AS mape, avg(realized) AS baseline FROM q GROUP BY 1), y AS (SELECT *, CASE WHEN baseline > 0 THEN rmse / baseline * 100 END AS pct FROM e)
      SELECT symbol, round(rmse, 6) AS rmse, round(mape, 6) AS mape, round(baseline, 6) AS baseline, CASE WHEN mape <= 2 THEN 'low' WHEN mape <= 5 THEN 'medium' ELSE 'high' END AS mape_tone, CASE WHEN coalesce(pct, rmse) <= 1 THEN 'low' WHEN coalesce(pct, rmse) <= 2.5 THEN 'medium' ELSE 'high' END AS rmse_tone, round(pct, 6) AS rmse_pct FROM y""",
    "evaluation_rows": "SELECT md5(trim(text)) AS digest, CASE doc_id % 5 WHEN 0 THEN 'hawkish' WHEN 1 THEN 'dovish' ELSE 'neutral' END AS label, '2024-01-02' AS event_date FROM documents WHERE doc_id % 5 < 3 AND doc_id % 7 <> 0 AND trim(coalesce(text, '')) <> ''",
    "forecast_delta": f"WITH {_ENDS} SELECT symbol, round(coalesce((predicted - current) / nullif(current, 0) * 100, 0.0), 6) AS pct, round(predicted - current, 6) AS diff FROM e",
    "spot_delta": f"WITH {_ENDS} SELECT symbol, round(predicted, 6) AS predicted, round(current, 6) AS current, round(predicted - current, 6) AS delta, round(coalesce((predicted - current) / nullif(current, 0) * 100, 0.0), 6) AS pct, CASE WHEN predicted > current THEN 'up' WHEN predicted < current THEN 'down' ELSE 'flat' END AS tone FROM e",
    "spot_band_check": f"WITH {_ENDS}, k AS (SELECT symbol, {_check('current', '0.015::DOUBLE')} FROM e) SELECT symbol, {_JUDGED} FROM k",
    "realized_band_check": f"WITH {_EVENTS}, o AS (SELECT r.symbol, r.day, r.value AS realized, lower, upper FROM r JOIN f ON r.symbol = f.symbol AND r.day = f.day QUALIFY row_number() OVER (PARTITION BY r.symbol ORDER BY r.day DESC) = 1), k AS (SELECT symbol, day, {_check('realized', '0.02::DOUBLE')} FROM o) SELECT symbol, day, {_JUDGED} FROM k",
}
