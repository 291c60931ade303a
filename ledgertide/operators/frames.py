"""Calendar frames over long price series, and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgertide.working import stored

#: Days of a stretch: a series is cut in stretches that start with a copy of the days that the first frames reach back to.
STRETCH_DAYS = 366


def calendar_volatility(returns: DataFrame, days: int, stretch: int = STRETCH_DAYS) -> DataFrame:
    """returns (symbol, date, ret) with n and volatility: count and sample deviation of the returns of the last `days` calendar days, the row's own
    day included; null for fewer than two.

    A RANGE frame by interval over the dates. A series is dealt out in stretches of days, each with the days before it that its frames reach, so a hot
    symbol is sorted by many tasks; rows of the overlap only lend their returns. Rows without a date are left out.
    """
    if days < 1 or stretch < 1:
        raise ValueError("a frame and a stretch need a day at least")
    day = F.unix_date(F.col("date"))
    first, last = F.floor(day / stretch), F.floor((day + (days - 1)) / stretch)
    laid = returns.where("date IS NOT NULL").withColumn("stretch", F.explode(F.sequence(first, last)))
    reach = Window.partitionBy("symbol", "stretch").orderBy(day).rangeBetween(1 - days, 0)
    out = laid.withColumns({"n": F.count("ret").over(reach), "volatility": F.stddev_samp("ret").over(reach)})
    return out.where(F.floor(day / stretch) == F.col("stretch")).drop("stretch")


def ranks(rows: DataFrame, value: str, key: str, tie: str, tiles: int = 10) -> DataFrame:
    """rows with position, rank, dense_rank and tile (of `tiles`) of value among the rows of key with one, smallest first; ties by `tie` in position and tile.

    Distinct values are counted first and only they are ordered in a key, with their counts; a row then gets its rank by a join, and its
    position among equals by an order of these alone. So a hot key sends its distinct values to a task, not its rows.
    """
    if tiles < 1:
        raise ValueError("there must be one tile at least")
    counts = stored(rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("equal")), "rank-counts")
    order = Window.partitionBy(key).orderBy(value)
    whole = F.sum("equal").over(Window.partitionBy(key))
    placed = counts.select(F.col(key).alias("k"), F.col(value).alias("v"), "equal", (F.sum("equal").over(order) - F.col("equal") + 1).alias("rank"), F.row_number().over(order).alias("dense_rank"), whole.alias("total"))
    same = F.col(key).eqNullSafe(F.col("k")) & (F.col(value) == F.col("v"))
    joined = rows.join(placed, same).drop("k", "v")
    nth = F.row_number().over(Window.partitionBy(key, value).orderBy(tie))
    position = F.col("rank") + F.when(F.col("equal") > 1, nth).otherwise(1) - 1
    small_size, larger = F.floor(F.col("total") / tiles), F.col("total") % tiles
    edge = larger * (small_size + 1)
    tile = F.when(F.col("position") <= edge, F.floor((F.col("position") - 1) / (small_size + 1)) + 1).otherwise(larger + F.floor((F.col("position") - 1 - edge) / F.greatest(small_size, F.lit(1))) + 1)
    return joined.withColumn("position", position).withColumn("tile", tile).drop("equal", "total")
