"""Differences of two versions of a registry: as multisets of rows, by record, and by manifests that skip equal partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.working import stored


def _content(columns: list[str]):
    """A row's content as 128 bits; nulls differ from empty strings."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def manifest(version: DataFrame, part: str) -> DataFrame:
    """(part, records, digest) of each partition: how many rows it has and a hash of them as a multiset, in whatever order they stand.

    The digest is the sum of the rows' hashes in two halves of 64 bits, each kept within 96, so tasks merge it before the shuffle.
    """
    halves = [F.sum(F.conv(F.substring(_content(sorted(version.columns)), k, 16), 16, 10).cast("decimal(20,0)")).alias(n) for k, n in ((1, "high"), (17, "low"))]
    sums = version.groupBy(F.col(part).alias("part")).agg(F.count(F.lit(1)).alias("records"), *halves)
    return sums.select("part", "records", F.concat_ws("-", F.col("high").cast("string"), F.col("low").cast("string")).alias("digest"))


def changed_parts(old: DataFrame, new: DataFrame) -> DataFrame:
    """(part, status) of two manifests: added, gone or changed; equal ones are left out."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col("a.part").eqNullSafe(F.col("b.part")), "full_outer")
    status = F.when(F.col("a.records").isNull(), "added").when(F.col("b.records").isNull(), "gone").when((F.col("a.records") != F.col("b.records")) | (F.col("a.digest") != F.col("b.digest")), "changed")
    return both.select(F.coalesce("a.part", "b.part").alias("part"), status.alias("status")).where("status IS NOT NULL")


def only_changed(version: DataFrame, parts: DataFrame, part: str) -> DataFrame:
    """The rows of a version in the parts listed."""
    listed = parts.select(F.col("part").alias("listed"))
    return version.join(F.broadcast(listed) if parts.limit(100_001).count() <= 100_000 else listed, F.col(part).eqNullSafe(F.col("listed")), "left_semi")


def multiset_difference(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, change, times): rows that new has more often than old (`added`) or less often (`gone`), and how many times: EXCEPT ALL both ways in
    one shuffle. Rows are equal if all columns are, nulls being equal; counts merge before the shuffle, so a hot row costs one row a task."""
    signed = old.select(*columns, F.lit(-1).alias("sign")).unionByName(new.select(*columns, F.lit(1).alias("sign")))
    sums = signed.groupBy(*columns).agg(F.sum("sign").alias("n")).where("n <> 0")
    return sums.select(*columns, F.when(F.col("n") > 0, "added").otherwise("gone").alias("change"), F.abs("n").alias("times"))


def multiset_common(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, times): rows that both have, as often as both have them: INTERSECT ALL."""
    signed = old.select(*columns, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(new.select(*columns, F.lit(0).alias("a"), F.lit(1).alias("b")))
    sums = signed.groupBy(*columns).agg(F.least(F.sum("a"), F.sum("b")).alias("times"))
    return sums.where("times > 0")


def record_changes(old: DataFrame, new: DataFrame, key: str, part: str) -> DataFrame:
    """(key, change) of the records of two versions with the same columns: added, gone or changed; equal ones are left out.

    Manifests are compared first, and only partitions that differ are read again. A key's rows are compared as a multiset, so repeated rows and their
    order do no harm; a key that has moved to another partition is changed. A null key is a key of its own.
    """
    parts = stored(changed_parts(manifest(old, part), manifest(new, part)), "changed-parts")
    columns = sorted(old.columns)
    side = lambda v, k: only_changed(v, parts, part).select(F.col(key).alias("key"), F.conv(F.substring(_content(columns), 1, 15), 16, 10).cast("decimal(38,0)").alias("h"), F.lit(k).alias("k"))
    signed = side(old, -1).unionByName(side(new, 1))
    kept = signed.groupBy("key").agg(F.count_if(F.col("k") < 0).alias("before"), F.count_if(F.col("k") > 0).alias("after"), F.sum(F.col("h") * F.col("k")).alias("moved"))
    change = F.when(F.col("before") == 0, "added").when(F.col("after") == 0, "gone").when((F.col("before") != F.col("after")) | (F.col("moved") != 0), "changed")
    return kept.select(F.col("key").alias(key), change.alias("change")).where("change IS NOT NULL")
