"""Price series: returns, rolling volatility, and as-of joins of requests to trading days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE_DAYS, VOL_WINDOW = 7, 5
MOST_SYMBOLS = 10_000


def daily_closes(events: DataFrame) -> DataFrame:
    """(symbol, date, close): the last value of each day."""
    return events.groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("date")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))


def order_closes(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("close"))


def price_window(series: DataFrame, symbol: str, start: str, end: str) -> DataFrame:
    """Rows of a symbol with a close from start to the day before end, which the scan filters; none is an error."""
    rows = series.where((F.col("symbol") == symbol) & (F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(end).cast("date")) & F.col("close").isNotNull())
    if rows.isEmpty():
        raise ValueError(f"no prices of {symbol} from {start} to {end}")
    return rows


def _by_day() -> Window:
    return Window.partitionBy("symbol").orderBy("date")


def with_returns(series: DataFrame) -> DataFrame:
    return series.withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(_by_day())) - 1)


def with_volatility(series: DataFrame, window: int = VOL_WINDOW) -> DataFrame:
    """Sample deviation of the last `window` returns, 0 until there are so many."""
    if window < 2:
        raise ValueError("the window needs two returns at least")
    last = _by_day().rowsBetween(1 - window, 0)
    vol = F.when(F.count("ret").over(last) == window, F.stddev_samp("ret").over(last)).otherwise(0.0)
    return with_returns(series).withColumn("volatility_5d", vol)


def _at_least_one(name: str, value: int) -> None:
    if value < 1:
        raise ValueError(f"{name} must be 1 at least, not {value}")


def _days(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(first, last))


def asof(requests: DataFrame, series: DataFrame, tolerance: int = TOLERANCE_DAYS) -> DataFrame:
    """requests (symbol, requested_date, ...) with the latest row of series on or before the date, `tolerance` days back at most, one at least.

    Each series row is laid out over the days for which it is the latest, `tolerance` + 1 at most, so the join is an equality
    of symbol and day: no request is sorted into a window, and a hot symbol's side can be split.
    """
    _at_least_one("tolerance", tolerance)
    until = F.least(F.date_add("date", tolerance), F.coalesce(F.date_sub(F.lead("date").over(_by_day()), 1), F.date_add("date", tolerance)))
    covered = series.withColumn("until", until).select("*", _days(F.col("date"), F.col("until")).alias("requested_date")).drop("until").withColumnRenamed("date", "date_used")
    return requests.join(covered, ["symbol", "requested_date"])


def history(requests: DataFrame, series: DataFrame, n: int) -> DataFrame:
    """The last n rows on or before each request's date, inside its calendar window, with their rank from the latest."""
    _at_least_one("n", n)
    days = max(int(2.2 * n) + 20, 45) + 16
    rows = F.collect_list(F.struct("date", "close", "volatility_5d")).over(_by_day().rowsBetween(1 - n, 0))
    back = asof(requests, series.withColumn("rows", rows), tolerance=days).select(*requests.columns, F.posexplode(F.reverse("rows")).alias("back", "row"))
    return back.where(F.col("row.date") >= F.date_sub("requested_date", days)).select(*requests.columns, (F.col("back") + 1).alias("nth"), "row.date", "row.close", "row.volatility_5d")


def forward(requests: DataFrame, series: DataFrame, steps: int) -> DataFrame:
    """The first `steps` rows after each request's date, within max(4 * steps, 16) days, and their step."""
    _at_least_one("steps", steps)
    days = max(4 * steps, 16)
    rows = F.collect_list(F.struct("date", "close", "volatility_5d")).over(_by_day().rowsBetween(0, steps - 1))
    since = F.greatest(F.date_sub("date", days), F.coalesce(F.lag("date").over(_by_day()), F.date_sub("date", days)))
    covered = series.withColumns({"rows": rows, "since": since}).select("symbol", "rows", _days(F.col("since"), F.date_sub("date", 1)).alias("requested_date"))
    ahead = requests.join(covered, ["symbol", "requested_date"]).select(*requests.columns, F.posexplode("rows").alias("step", "row"))
    return ahead.where(F.col("row.date") < F.date_add("requested_date", days)).select(*requests.columns, (F.col("step") + 1).alias("step"), "row.date", "row.close", "row.volatility_5d")


def pair_with_symbols(docs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each document with each symbol; symbols is a list of MOST_SYMBOLS at most."""
    if symbols.limit(MOST_SYMBOLS + 1).count() > MOST_SYMBOLS:
        raise ValueError(f"more than {MOST_SYMBOLS} symbols")
    return docs.crossJoin(F.broadcast(symbols))


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row in the order of each key; aggregated before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")
