"""Queries over price series that stand on events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgertide.catalog import table
from ledgertide.operators import features as X
from ledgertide.operators import leakage as L
from ledgertide.operators import market as M
from ledgertide.operators import packaging as P
from ledgertide.plans import corpus
from ledgertide.sources import packages as K


def _series(spark, sf_dir):
    return M.with_volatility(M.daily_closes(table(spark, sf_dir, "events")))


def _long(spark, sf_dir):
    return M.with_volatility(M.order_closes(table(spark, sf_dir, "orders")))


def _requests(spark, sf_dir):
    """Each document asks for a day and a symbol."""
    docs = table(spark, sf_dir, "documents")
    symbol = F.expr("element_at(array('click', 'error', 'purchase', 'signup', 'view'), CAST(doc_id % 5 AS INT) + 1)")
    return docs.select("doc_id", symbol.alias("symbol"), F.expr("date_add(DATE'2023-12-25', CAST(doc_id % 50 AS INT))").alias("requested_date"))


def _rounded(df, *columns, places=8):
    return df.withColumns({c: F.round(c, places) for c in columns})


def simple_return(spark, sf_dir):
    rows = M.with_returns(M.order_closes(table(spark, sf_dir, "orders"))).where("ret IS NOT NULL")
    return _rounded(rows.select("symbol", "date", "ret"), "ret")


def rolling_vol(spark, sf_dir):
    return _rounded(_long(spark, sf_dir).select("symbol", "date", "volatility_5d"), "volatility_5d")


def asof_snapshot(spark, sf_dir):
    found = M.asof(_requests(spark, sf_dir), _series(spark, sf_dir).select("symbol", "date", "close", "volatility_5d"))
    return _rounded(found.select("doc_id", "symbol", "requested_date", "date_used", "close", "volatility_5d"), "volatility_5d")


def market_history(spark, sf_dir):
    found = M.history(_requests(spark, sf_dir), _series(spark, sf_dir), 10)
    return _rounded(found, "volatility_5d")


def realized_forward(spark, sf_dir):
    return _rounded(M.forward(_requests(spark, sf_dir), _series(spark, sf_dir), 3), "volatility_5d")


def forward_dates(spark, sf_dir):
    return M.forward(_requests(spark, sf_dir), _series(spark, sf_dir), 5).select("doc_id", "step", "date")


def doc_symbol_align(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("date_add(DATE'2023-12-25', CAST(doc_id % 50 AS INT))").alias("requested_date"))
    series = _series(spark, sf_dir).select("symbol", "date", "close")
    found = M.asof(M.pair_with_symbols(docs, series.select("symbol").distinct()), series)
    return found.select("doc_id", "symbol", "requested_date", "date_used", "close")


def last_wins_dedup(spark, sf_dir):
    return M.last_wins(asof_snapshot(spark, sf_dir).select("symbol", "date_used", "doc_id", "close"), ["symbol", "date_used"], ["doc_id"])


def top_k_history(spark, sf_dir):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    return _long(spark, sf_dir).withColumn("nth", nth).where("nth <= 30").select("symbol", "nth", "date", "close")


def _vectors(spark, sf_dir):
    sentiment = F.when(F.col("symbol").startswith("1"), 0.6).otherwise(0.25)
    return X.vectors(_long(spark, sf_dir).withColumn("sentiment_score", sentiment))


def feature_vectors(spark, sf_dir):
    return _rounded(_vectors(spark, sf_dir), "market_volatility", "close_change_pct", "volatility_change")


def feature_clamp(spark, sf_dir):
    return _rounded(X.scaled(_vectors(spark, sf_dir)).select("symbol", "date", "market_close", "close_change_pct"), "market_close", "close_change_pct")


def training_windows(spark, sf_dir):
    closes = F.transform("inputs", lambda r: r["market_close"])
    rows = X.windows(_vectors(spark, sf_dir)).select("symbol", "date", F.array_join(F.transform(closes, lambda c: F.round(c * 100).cast("long").cast("string")), ",").alias("closes"), "target_close")
    return rows


def window_inventory(spark, sf_dir):
    return X.window_inventory(_vectors(spark, sf_dir))


def last5_padded(spark, sf_dir):
    return X.last_padded(_vectors(spark, sf_dir)).select("symbol", F.array_join(F.transform("closes", lambda c: F.round(c * 100).cast("long").cast("string")), ",").alias("closes"))


def train_val_split(spark, sf_dir):
    return X.train_val(_long(spark, sf_dir).select("symbol", "date"), ["symbol"], ["date"])


def _forecasts(spark, sf_dir):
    """Three steps of plain carry-forward, as any model gives them."""
    last = _long(spark, sf_dir).groupBy("symbol").agg(F.max_by(F.struct("close", "volatility_5d"), "date").alias("l"))
    steps = last.select("symbol", "l.close", F.col("l.volatility_5d").alias("volatility"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("step"))
    return steps.withColumn("close", F.col("close") * (1 + 0.01 * F.col("step")))


def confidence_bands(spark, sf_dir):
    out = X.bands(_forecasts(spark, sf_dir), X.spreads(_vectors(spark, sf_dir)))
    return _rounded(out, "close", "volatility", "close_lower", "close_upper", "vol_lower", "vol_upper", places=4)


def vol_scale(spark, sf_dir):
    return _rounded(X.axis_scale(_long(spark, sf_dir), "volatility_5d", ["symbol"]), "suggested_ymin", "suggested_ymax", places=6)


def _package(spark, sf_dir, *more):
    rows = corpus.registry(spark, sf_dir).withColumn("event_date", F.expr(corpus._SPREAD))
    return P.supervised(rows).select("record_id", "event_date", "mapped_label", *more)


def supervised_rows(spark, sf_dir):
    return _package(spark, sf_dir)


def time_split(spark, sf_dir):
    return P.time_split(_package(spark, sf_dir))


def walk_forward_folds(spark, sf_dir):
    return P.walk_forward(spark, _package(spark, sf_dir))


def fallback_folds(spark, sf_dir):
    return P.fallback(spark, _package(spark, sf_dir))


def fold_manifest(spark, sf_dir):
    rows = _package(spark, sf_dir)
    return P.manifest(rows, P.walk_forward(spark, rows))


def fold_class_distribution(spark, sf_dir):
    rows = _package(spark, sf_dir)
    return P.class_distribution(rows, P.walk_forward(spark, rows))


def package_counts(spark, sf_dir):
    return K.package_counts(P.time_split(_package(spark, sf_dir, "source")))


def cross_split_duplicates(spark, sf_dir):
    """Whole texts of the package's validation and test rows against those of earlier splits."""
    return L.cross_split(P.time_split(_package(spark, sf_dir, "text")))


def boundary_ties(spark, sf_dir):
    return P.boundary_ties(P.time_split(_package(spark, sf_dir)))


def preparation_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr("CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE CAST(date_add(DATE'2023-12-25', CAST(doc_id % 50 AS INT)) AS STRING) END").alias("date"))
    series = _series(spark, sf_dir).select("symbol", "date", "close")
    symbols = series.select("symbol").distinct()
    valid = docs.where("trim(date) <> '' AND trim(coalesce(text, '')) <> ''").select("doc_id", F.col("date").cast("date").alias("requested_date"))
    found = M.asof(M.pair_with_symbols(valid, symbols), series)
    return K.preparation_summary(docs, symbols, found.select(F.col("doc_id").alias("document"), "symbol", F.col("date_used").alias("date")))


def price_window(spark, sf_dir):
    return M.price_window(_long(spark, sf_dir).drop("ret"), "5-LOW", "1995-01-01", "1996-01-01").select("symbol", "date", "close")


def fold_test_rows(spark, sf_dir):
    rows = _package(spark, sf_dir)
    return P.test_rows(rows, P.walk_forward(spark, rows)).select("record_id", "event_date", "fold_id")


def _dates_as_text(query):
    """The query with its dates as ISO strings, as the registry's tables keep them."""

    def run(spark, sf_dir):
        df = query(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})

    return run


QUERIES = {f.__name__: _dates_as_text(f) for f in (
    simple_return, rolling_vol, asof_snapshot, market_history, realized_forward, forward_dates, doc_symbol_align, last_wins_dedup, top_k_history, feature_vectors, feature_clamp, training_windows,
    window_inventory, last5_padded, train_val_split, confidence_bands, vol_scale, supervised_rows, time_split, walk_forward_folds, fallback_folds, fold_manifest, fold_class_distribution, fold_test_rows,
    package_counts, cross_split_duplicates, boundary_ties, preparation_summary, price_window,
)}

_VOL = "CASE WHEN count(ret) OVER f = 5 THEN stddev_samp(ret) OVER f ELSE 0.0 END AS volatility_5d FROM r WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
_EV = f"c AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS date, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2), r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM c), s AS (SELECT *, {_VOL})"
_OR = f"c AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS close FROM orders GROUP BY 1, 2), r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM c), s AS (SELECT *, {_VOL})"
_REQ = "q AS (SELECT doc_id, ['click', 'error', 'purchase', 'signup', 'view'][doc_id % 5 + 1] AS symbol, DATE '2023-12-25' + CAST(doc_id % 50 AS INT) AS requested_date FROM documents)"
_ASOF = f"{_EV}, {_REQ}, a AS (SELECT doc_id, q.symbol, requested_date, date AS date_used, close, round(volatility_5d, 8) AS volatility_5d FROM q ASOF JOIN s ON q.symbol = s.symbol AND s.date <= q.requested_date WHERE date_diff('day', date, requested_date) <= 7)"
_VEC = f"{_OR}, v AS (SELECT symbol, date, CASE WHEN symbol LIKE '1%' THEN 0.6::DOUBLE ELSE 0.25::DOUBLE END AS sentiment_score, close AS market_close, volatility_5d AS market_volatility, CASE WHEN abs(lag(close) OVER w) > 1e-12 THEN (close - lag(close) OVER w) / lag(close) OVER w ELSE 0.0 END AS close_change_pct, coalesce(volatility_5d - lag(volatility_5d) OVER w, 0.0) AS volatility_change FROM s WINDOW w AS (PARTITION BY symbol ORDER BY date))"
_PKG = f"{corpus._REG}, p AS (SELECT record_id, {corpus._DUCK_SPREAD} AS event_date, mapped_label FROM reg WHERE mapped_label IS NOT NULL)"
_SPLIT = f"""{_PKG}, k AS (SELECT *, row_number() OVER (ORDER BY event_date, record_id) - 1 AS pos, count(*) OVER () AS n FROM p), c AS (SELECT *, greatest(1, CAST(floor(n * 0.7::DOUBLE) AS BIGINT)) AS ct FROM k),
  t AS (SELECT record_id, event_date, CASE WHEN pos < ct THEN 1 WHEN pos < least(greatest(ct + 1, CAST(floor(n * 0.85::DOUBLE) AS BIGINT)), n) THEN 2 ELSE 3 END AS place FROM c)"""
_FOLDS = f"""{_PKG}, d AS (SELECT event_date, row_number() OVER (ORDER BY event_date) - 1 AS k FROM (SELECT DISTINCT event_date FROM p)),
  n AS (SELECT count(*) AS n, greatest(3, CAST(floor(count(*) * 0.6::DOUBLE) AS BIGINT)) AS m FROM d), g AS (SELECT n, m, greatest(1, (n - m) // 5) AS w FROM n),
  b AS (SELECT i, m + (i - 1) * w - 1 AS te, w, n FROM g, range(1, 5) t(i) WHERE n >= 8 AND m + (i + 1) * w - 1 < n),
  f AS (SELECT 'wf_fold_' || i AS fold_id, (SELECT min(event_date) FROM d) AS train_start, a.event_date AS train_end, v1.event_date AS val_start, v2.event_date AS val_end, t1.event_date AS test_start, t2.event_date AS test_end
    FROM b JOIN d a ON a.k = te JOIN d v1 ON v1.k = te + 1 JOIN d v2 ON v2.k = te + w JOIN d t1 ON t1.k = te + w + 1 JOIN d t2 ON t2.k = te + 2 * w)"""
ORACLES = {
    "simple_return": f"WITH {_OR} SELECT symbol, date, round(ret, 8) AS ret FROM s WHERE ret IS NOT NULL",
    "rolling_vol": f"WITH {_OR} SELECT symbol, date, round(volatility_5d, 8) AS volatility_5d FROM s",
    "asof_snapshot": f"WITH {_ASOF} SELECT * FROM a",
    "market_history": f"WITH {_EV}, {_REQ} SELECT doc_id, q.symbol, requested_date, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY date DESC) AS INT) AS nth, date, close, round(volatility_5d, 8) AS volatility_5d FROM q JOIN s ON q.symbol = s.symbol AND date <= requested_date AND date >= requested_date - 61 QUALIFY nth <= 10",
    "realized_forward": f"WITH {_EV}, {_REQ} SELECT doc_id, q.symbol, requested_date, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY date) AS INT) AS step, date, close, round(volatility_5d, 8) AS volatility_5d FROM q JOIN s ON q.symbol = s.symbol AND date > requested_date AND date < requested_date + 16 QUALIFY step <= 3",
    "forward_dates": f"WITH {_EV}, {_REQ} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY date) AS INT) AS step, date FROM q JOIN s ON q.symbol = s.symbol AND date > requested_date AND date < requested_date + 20 QUALIFY step <= 5",
    "doc_symbol_align": f"WITH {_EV}, q AS (SELECT doc_id, symbol, DATE '2023-12-25' + CAST(doc_id % 50 AS INT) AS requested_date FROM documents, (SELECT DISTINCT symbol FROM s)) SELECT doc_id, q.symbol, requested_date, date AS date_used, close FROM q ASOF JOIN s ON q.symbol = s.symbol AND s.date <= q.requested_date WHERE date_diff('day', date, requested_date) <= 7",
    "last_wins_dedup": f"WITH {_ASOF} SELECT symbol, date_used, doc_id, close FROM a QUALIFY row_number() OVER (PARTITION BY symbol, date_used ORDER BY doc_id DESC) = 1",
    "top_k_history": f"WITH {_OR} SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS INT) AS nth, date, close FROM s QUALIFY nth <= 30",
    "feature_vectors": f"WITH {_VEC} SELECT symbol, date, sentiment_score, market_close, round(market_volatility, 8) AS market_volatility, round(close_change_pct, 8) AS close_change_pct, round(volatility_change, 8) AS volatility_change FROM v",
    "feature_clamp": f"WITH {_VEC} SELECT symbol, date, round(market_close / 10000, 8) AS market_close, round(greatest(least(close_change_pct, 1.0), -1.0), 8) AS close_change_pct FROM v",
    "training_windows": f"WITH {_OR} SELECT symbol, date, string_agg(CAST(CAST(round(close * 100) AS BIGINT) AS VARCHAR), ',') OVER w AS closes, close AS target_close FROM s WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) QUALIFY count(*) OVER w = 5",
    "window_inventory": f"WITH {_OR} SELECT symbol, count(*) AS records, greatest(count(*) - 5, 0) AS windows, count(*) > 5 AS usable FROM s GROUP BY symbol",
    "last5_padded": f"WITH {_OR}, l AS (SELECT symbol, date, CAST(round(close * 100) AS BIGINT) AS c, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM s QUALIFY back <= 5), g AS (SELECT symbol, count(*) AS n, arg_min(c, date) AS first, string_agg(CAST(c AS VARCHAR), ',' ORDER BY date) AS rest FROM l GROUP BY symbol) SELECT symbol, repeat(first || ',', 5 - n) || rest AS closes FROM g",
    "train_val_split": f"WITH {_OR}, n AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM s) SELECT symbol, date, CASE WHEN n < 2 THEN 'both' WHEN k > n - greatest(1, CAST(floor(n * 0.2::DOUBLE) AS BIGINT)) THEN 'validation' ELSE 'train' END AS part FROM n",
    "confidence_bands": f"""WITH {_OR}, l AS (SELECT symbol, arg_max(close, date) AS c0, arg_max(volatility_5d, date) AS volatility FROM s GROUP BY symbol), m AS (SELECT *, volatility_5d - lag(volatility_5d) OVER (PARTITION BY symbol ORDER BY date) AS moved FROM s),
      g AS (SELECT symbol, greatest(coalesce(stddev_samp(ret), 0), 0.0025::DOUBLE) AS cs, coalesce(stddev_samp(moved), 0) AS vs FROM m GROUP BY symbol),
      x AS (SELECT symbol, CAST(k AS INT) AS step, c0 * (1 + 0.01::DOUBLE * k) AS close, volatility, cs, greatest(vs, volatility * 0.08::DOUBLE, 0.00015::DOUBLE) AS vs, 1.2816::DOUBLE * sqrt(k) AS z FROM l JOIN g USING (symbol), range(1, 4) t(k))
      SELECT symbol, step, round(close, 4) AS close, round(volatility, 4) AS volatility, round(greatest(0.0, close - greatest(close, 1.0) * cs * z), 4) AS close_lower, round(close + greatest(close, 1.0) * cs * z, 4) AS close_upper, round(greatest(0.0, volatility - vs * z), 4) AS vol_lower, round(volatility + vs * z, 4) AS vol_upper FROM x""",
    "vol_scale": f"WITH {_OR}, m AS (SELECT symbol, min(volatility_5d) AS a, max(volatility_5d) AS b FROM s GROUP BY symbol) SELECT symbol, round(greatest(0.0, a - greatest(b - a, 1e-6) * 0.15::DOUBLE), 6) AS suggested_ymin, round(b + greatest(b - a, 1e-6) * 0.15::DOUBLE, 6) AS suggested_ymax FROM m",
    "supervised_rows": f"WITH {_PKG} SELECT * FROM p",
    "time_split": f"WITH {_PKG}, k AS (SELECT *, row_number() OVER (ORDER BY event_date, record_id) - 1 AS pos, count(*) OVER () AS n FROM p), c AS (SELECT *, greatest(1, CAST(floor(n * 0.7::DOUBLE) AS BIGINT)) AS ct FROM k) SELECT record_id, event_date, mapped_label, CASE WHEN pos < ct THEN 'train' WHEN pos < least(greatest(ct + 1, CAST(floor(n * 0.85::DOUBLE) AS BIGINT)), n) THEN 'val' ELSE 'test' END AS split_tag FROM c",
    "package_counts": f"""WITH {_PKG}, k AS (SELECT *, row_number() OVER (ORDER BY event_date, record_id) - 1 AS pos, count(*) OVER () AS n FROM p), c AS (SELECT *, greatest(1, CAST(floor(n * 0.7::DOUBLE) AS BIGINT)) AS ct FROM k),
      t AS (SELECT record_id, mapped_label, CASE WHEN pos < ct THEN 'train' WHEN pos < least(greatest(ct + 1, CAST(floor(n * 0.85::DOUBLE) AS BIGINT)), n) THEN 'val' ELSE 'test' END AS split_tag FROM c), s AS (SELECT t.*, reg.source FROM t JOIN reg USING (record_id))
      SELECT 'split' AS kind, split_tag AS name, count(*) AS records FROM s GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'label', mapped_label, count(*) FROM s GROUP BY 2""",
    "cross_split_duplicates": f"""WITH {_SPLIT}, w AS MATERIALIZED (SELECT record_id, place, list_filter(string_split({corpus._NORM.format('text')}, ' '), lambda x: x <> '') AS w FROM t JOIN reg USING (record_id) JOIN documents USING (doc_id)),
      g AS MATERIALIZED (SELECT DISTINCT record_id, place, array_to_string(w[i:i + 4], ' ') AS gram FROM w, range(1, 100000) r(i) WHERE i <= greatest(1, len(w) - 4) AND len(w) > 0), n AS (SELECT record_id, count(*) AS n FROM g GROUP BY 1),
      b AS (SELECT l.record_id, l.place, e.record_id AS earlier, count(*) AS shared FROM g l JOIN g e ON l.gram = e.gram AND e.place < l.place GROUP BY 1, 2, 3),
      s AS (SELECT b.*, shared / (x.n + y.n - shared) AS similarity FROM b JOIN n x USING (record_id) JOIN n y ON y.record_id = b.earlier WHERE 100 * shared >= 80 * (x.n + y.n - shared))
      SELECT record_id, ['train', 'val', 'test'][place] AS split_tag, min(earlier) AS leaked_from, round(arg_min(similarity, earlier), 6) AS similarity FROM s GROUP BY 1, 2""",
    "boundary_ties": f"WITH {_SPLIT} SELECT event_date, count(*) FILTER (WHERE place = 1) AS train_rows, count(*) FILTER (WHERE place = 2) AS val_rows, count(*) FILTER (WHERE place = 3) AS test_rows FROM t GROUP BY event_date HAVING count(DISTINCT place) > 1",
    "preparation_summary": f"""WITH {_EV}, d AS (SELECT doc_id, doc_id % 17 = 0 OR trim(coalesce(text, '')) = '' AS skipped, DATE '2023-12-25' + CAST(doc_id % 50 AS INT) AS requested_date FROM documents),
      q AS (SELECT doc_id, symbol, requested_date FROM d, (SELECT DISTINCT symbol FROM s) WHERE NOT skipped), a AS (SELECT q.symbol, date FROM q ASOF JOIN s ON q.symbol = s.symbol AND s.date <= q.requested_date WHERE date_diff('day', date, requested_date) <= 7)
      SELECT count(*) AS total_documents, count(*) FILTER (WHERE NOT skipped) AS valid_documents, (SELECT count(DISTINCT (symbol, date)) FROM a) AS prepared_records, count(*) FILTER (WHERE skipped) AS skipped_documents, count(*) FILTER (WHERE NOT skipped) * (SELECT count(DISTINCT symbol) FROM s) - (SELECT count(*) FROM a) AS skipped_symbol_pairs FROM d""",
    "price_window": f"WITH {_OR} SELECT symbol, date, close FROM s WHERE symbol = '5-LOW' AND date >= DATE '1995-01-01' AND date < DATE '1996-01-01'",
    "walk_forward_folds": f"WITH {_FOLDS} SELECT * FROM f",
    "fallback_folds": f"""WITH {_PKG}, d AS (SELECT event_date, row_number() OVER (ORDER BY event_date) - 1 AS k FROM (SELECT DISTINCT event_date FROM p)), n AS (SELECT count(*) AS n, greatest(1, count(*) // 5) AS w FROM d),
      a AS (SELECT i, n, w, least(n - 3 * w, i * w + w) AS te FROM n, range(1, 4) t(i) WHERE n >= 12), b AS (SELECT *, least(te + w, n - w - 1) AS ve FROM a), c AS (SELECT *, least(ve + w, n - 1) AS xe FROM b WHERE ve + 1 < n)
      SELECT 'wf_fold_' || i AS fold_id, (SELECT min(event_date) FROM d) AS train_start, a.event_date AS train_end, v1.event_date AS val_start, v2.event_date AS val_end, t1.event_date AS test_start, t2.event_date AS test_end
      FROM c JOIN d a ON a.k = te JOIN d v1 ON v1.k = te + 1 JOIN d v2 ON v2.k = ve JOIN d t1 ON t1.k = ve + 1 JOIN d t2 ON t2.k = xe""",
    "fold_manifest": f"WITH {_FOLDS} SELECT f.*, (SELECT count(*) FROM p WHERE event_date BETWEEN train_start AND train_end) AS train_rows, (SELECT count(*) FROM p WHERE event_date BETWEEN val_start AND val_end) AS val_rows, (SELECT count(*) FROM p WHERE event_date BETWEEN test_start AND test_end) AS test_rows FROM f",
    "fold_class_distribution": f"WITH {_FOLDS} SELECT fold_id, mapped_label, count(*) AS records FROM p JOIN f ON event_date BETWEEN test_start AND test_end GROUP BY 1, 2",
    "fold_test_rows": f"WITH {_FOLDS} SELECT record_id, event_date, fold_id FROM p JOIN f ON event_date BETWEEN test_start AND test_end",
}

_DATES = {
    ("date",): ("simple_return", "rolling_vol", "forward_dates", "top_k_history", "feature_vectors", "feature_clamp", "training_windows", "train_val_split", "price_window"),
    ("date_used",): ("last_wins_dedup",),
    ("date_used", "requested_date"): ("asof_snapshot", "doc_symbol_align"),
    ("date", "requested_date"): ("market_history", "realized_forward"),
}
for _columns, _names in _DATES.items():
    for _name in _names:
        ORACLES[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _columns)}) FROM ({ORACLES[_name]})"
