"""Semi and anti joins by the size of the side that selects: pushed into the scan, broadcast, or shuffled behind a Bloom filter."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.working import MOST_BROADCAST, stored

#: Values that a filter of the scan lists at most.
MOST_LISTED = 500
_BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "10g", "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "10000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": "268435456", "spark.sql.optimizer.runtime.bloomFilter.numBits": "134217728", "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "40000000",
}


@contextmanager
def bloom_filters(spark: SparkSession) -> Iterator[None]:
    """Plans made inside may filter the larger side of a join by a Bloom filter of the smaller one's keys, below the shuffle."""
    before = {k: spark.conf.get(k, None) for k in _BLOOM}
    for k, v in _BLOOM.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def strategy(n: int, most_listed: int = MOST_LISTED, most_broadcast: int = MOST_BROADCAST) -> str:
    return "listed" if n <= most_listed else "broadcast" if n <= most_broadcast else "shuffled"


def _chosen(keys: DataFrame, most_listed: int, most_broadcast: int) -> tuple[DataFrame, str]:
    """The distinct keys that aren't null, stored, and how to select by them; they are counted, so no side is broadcast on a guess."""
    kept = stored(keys.where(F.col(keys.columns[0]).isNotNull()).distinct(), "selected-keys")
    return kept, strategy(kept.limit(most_broadcast + 1).count(), most_listed, most_broadcast)


def _listed(key: Column, kept: DataFrame) -> Column:
    return key.isin([r[0] for r in kept.collect()])  # MOST_LISTED at most


def having(rows: DataFrame, key: str, keys: DataFrame, most_listed: int = MOST_LISTED, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """rows whose key is among the values of keys, a table of one column; each once, however often keys has it. Null is among none.

    Few values become a filter that reaches the scan and skips row groups; more are broadcast; beyond that both sides are shuffled, where bloom_filters()
    lets Spark drop most rows before the shuffle. In both cases the least and the largest value reach the scan.
    """
    kept, how = _chosen(keys, most_listed, most_broadcast)
    if how == "listed":
        return rows.where(_listed(F.col(key), kept))
    ends = kept.agg(F.min(kept.columns[0]), F.max(kept.columns[0])).first()
    if ends[0] is None:
        return rows.limit(0)
    other = kept.select(F.col(kept.columns[0]).alias("selected_key")).where(F.col("selected_key").between(*ends))
    rows = rows.where(F.col(key).between(*ends))
    return rows.join(F.broadcast(other) if how == "broadcast" else other.hint("merge"), F.col(key) == F.col("selected_key"), "left_semi")


def lacking(rows: DataFrame, key: str, keys: DataFrame, most_listed: int = MOST_LISTED, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """rows whose key is not among the values of keys, those with a null key included."""
    kept, how = _chosen(keys, most_listed, most_broadcast)
    if how == "listed":
        return rows.where(F.col(key).isNull() | ~_listed(F.col(key), kept))
    other = kept.select(F.col(kept.columns[0]).alias("selected_key"))
    return rows.join(F.broadcast(other) if how == "broadcast" else other.hint("merge"), F.col(key) == F.col("selected_key"), "left_anti")
