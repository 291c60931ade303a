"""Queries on mergeable summaries, calendar frames, ranks, and differences of registry versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgertide.catalog import table
from ledgertide.operators import frames as R
from ledgertide.operators import market as M
from ledgertide.operators import registry_ops as G
from ledgertide.operators import sketches as S
from ledgertide.operators import versions as V
from ledgertide.plans import corpus
from ledgertide.working import stored

QUANTILES = {"p50": 0.5, "p95": 0.95}


def sketch_rollup(spark, sf_dir):
    """Estimates for each month and type from sketches kept by day."""
    days = stored(S.daily(table(spark, sf_dir, "events")), "daily-sketches")
    months = S.merged(days, F.date_format("day", "yyyy-MM").alias("month"), F.col("event_type"))
    return S.estimates(months, list(QUANTILES.values())).select("month", "event_type", "n", "distinct_users", "quantiles", F.get("frequent_users", F.lit(0))["count"].alias("most_of_a_user"))


def sketch_error_bounds(spark, sf_dir):
    """Exact counts beside whether the estimates from merged days keep their error bounds."""
    events = table(spark, sf_dir, "events")
    days = stored(S.daily(events), "daily-sketches")
    found = stored(S.estimates(S.merged(days, "event_type"), list(QUANTILES.values())), "sketch-estimates")
    rows = events.where("ts IS NOT NULL").join(F.broadcast(found.select("event_type", F.col("distinct_users").alias("estimate"), "quantiles")), "event_type")  # a row a type
    below = [F.count_if(F.col("value") < F.col("quantiles")[k]).alias(f"below_{n}") for k, n in enumerate(QUANTILES)]
    upto = [F.count_if(F.col("value") <= F.col("quantiles")[k]).alias(f"upto_{n}") for k, n in enumerate(QUANTILES)]
    exact = rows.groupBy("event_type", "estimate").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.count("value").alias("m"), *below, *upto)
    near = F.abs(F.col("estimate") - F.col("users")) <= 1 + 4 * S.HLL_ERROR * F.col("users")
    inside = [((F.col(f"below_{n}") <= (q + 2 * S.KLL_ERROR) * F.col("m")) & (F.col(f"upto_{n}") >= (q - 2 * S.KLL_ERROR) * F.col("m"))).alias(f"{n}_within") for n, q in QUANTILES.items()]
    return exact.select("event_type", "n", "users", near.alias("users_within"), *inside)


def moment_agreement(spark, sf_dir):
    """Discounted against listed prices by return flag."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("x"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"))
    out = S.agreement(S.merged_moments(S.partial_moments(rows, "l_returnflag", "x", "y"), "l_returnflag"), "l_returnflag")
    return out.select("l_returnflag", "n", F.round("rmse", 4).alias("rmse"), F.round("correlation", 8).alias("correlation"), F.round("stddev_x", 4).alias("stddev_x"))


def _returns(spark, sf_dir):
    return M.with_returns(M.order_closes(table(spark, sf_dir, "orders")))


def calendar_volatility(spark, sf_dir):
    """Of the returns of the last 30 days of the calendar."""
    found = R.calendar_volatility(_returns(spark, sf_dir), 30)
    return found.select("symbol", F.col("date").cast("string").alias("date"), "n", F.round("volatility", 8).alias("volatility"))


def return_ranks(spark, sf_dir):
    found = R.ranks(_returns(spark, sf_dir).withColumn("ret", F.round("ret", 3)), "ret", "symbol", "date")
    return found.select("symbol", F.col("date").cast("string").alias("date"), "position", "rank", F.col("dense_rank").cast("long").alias("dense_rank"), "tile")


def _versions(spark, sf_dir):
    """Two versions of the registry: labelled records with repeats, and all records without, whose balance-sheet labels were taken back."""
    rows = corpus.registry(spark, sf_dir)
    columns = ["record_id", "source", "event_date", "mapped_label"]
    kept = G.exact_dedup(rows, corpus.ORDER, columns)
    again = F.when(F.col("mapped_label") == "neutral", None).otherwise(F.col("mapped_label"))
    return rows.where("mapped_label IS NOT NULL").select(columns), kept.withColumn("mapped_label", again).select(columns)


def registry_changes(spark, sf_dir):
    old, new = (stored(v, "registry-version") for v in _versions(spark, sf_dir))
    return V.record_changes(old, new, "record_id", "source")


def registry_except_all(spark, sf_dir):
    return V.multiset_difference(*_versions(spark, sf_dir), ["source", "event_date", "mapped_label"])


def registry_intersect_all(spark, sf_dir):
    return V.multiset_common(*_versions(spark, sf_dir), ["source", "event_date", "mapped_label"])


QUERIES = {f.__name__: f for f in (sketch_rollup, sketch_error_bounds, moment_agreement, calendar_volatility, return_ranks, registry_changes, registry_except_all, registry_intersect_all)}

_RETURNS = "c AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS close FROM orders GROUP BY 1, 2), r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM c)"
_VERSIONS = f"""{corpus._REG}, old AS (SELECT record_id, source, event_date, mapped_label FROM reg WHERE mapped_label IS NOT NULL),
  new AS (SELECT record_id, source, event_date, nullif(mapped_label, 'neutral') AS mapped_label FROM (SELECT * FROM reg QUALIFY row_number() OVER (PARTITION BY event_date, text_hash ORDER BY source, doc_id) = 1))"""
_COLUMNS = "source, event_date, mapped_label"
ORACLES = {
    "sketch_error_bounds": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, TRUE AS users_within, TRUE AS p50_within, TRUE AS p95_within FROM events WHERE ts IS NOT NULL GROUP BY 1",
    "moment_agreement": "WITH p AS (SELECT l_returnflag, l_extendedprice AS x, l_extendedprice * (1 - l_discount) AS y FROM lineitem) SELECT l_returnflag, count(*) AS n, round(sqrt(avg((x - y) * (x - y))), 4) AS rmse, round(corr(x, y), 8) AS correlation, round(stddev_samp(x), 4) AS stddev_x FROM p GROUP BY 1",
    "calendar_volatility": f"WITH {_RETURNS} SELECT symbol, CAST(date AS VARCHAR) AS date, count(ret) OVER w AS n, round(stddev_samp(ret) OVER w, 8) AS volatility FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)",
    "return_ranks": f"""WITH {_RETURNS}, x AS (SELECT symbol, date, round(ret, 3) AS ret FROM r WHERE ret IS NOT NULL)
      SELECT symbol, CAST(date AS VARCHAR) AS date, row_number() OVER (PARTITION BY symbol ORDER BY ret, date) AS position, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, ntile(10) OVER (PARTITION BY symbol ORDER BY ret, date) AS tile FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ret)""",
    "registry_changes": f"""WITH {_VERSIONS} SELECT coalesce(old.record_id, new.record_id) AS record_id, CASE WHEN old.record_id IS NULL THEN 'added' WHEN new.record_id IS NULL THEN 'gone' ELSE 'changed' END AS change
      FROM old FULL OUTER JOIN new ON old.record_id = new.record_id WHERE old.record_id IS NULL OR new.record_id IS NULL OR old.mapped_label IS DISTINCT FROM new.mapped_label""",
    "registry_except_all": f"""WITH {_VERSIONS}, gone AS (SELECT {_COLUMNS} FROM old EXCEPT ALL SELECT {_COLUMNS} FROM new), added AS (SELECT {_COLUMNS} FROM new EXCEPT ALL SELECT {_COLUMNS} FROM old)
      SELECT {_COLUMNS}, 'gone' AS change, count(*) AS times FROM gone GROUP BY {_COLUMNS} UNION ALL SELECT {_COLUMNS}, 'added', count(*) FROM added GROUP BY {_COLUMNS}""",
    "registry_intersect_all": f"WITH {_VERSIONS} SELECT {_COLUMNS}, count(*) AS times FROM (SELECT {_COLUMNS} FROM old INTERSECT ALL SELECT {_COLUMNS} FROM new) GROUP BY {_COLUMNS}",
}
