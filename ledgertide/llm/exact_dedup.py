"""Exact duplicates by 128-bit content hash, with the bytes compared inside each hash group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.llm.common import SPACE, documents, text_or_empty


def normalised(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one for each input row.

    Rows are grouped by (MD5, normalised text): the hash spreads the groups and the text, as part of the grouping key,
    is compared byte by byte, so texts whose hashes collide stay apart. Copies merge before the shuffle, so a text that
    holds a third of all rows sends one row a task. Members then find their group by two digests of their text, MD5 and
    SHA-256 together, so that their texts need not travel again.

    Null and empty text count as one. Null ids sort last. Of rows that repeat both id and text one is kept. Texts may be of any
    length; an empty table gives an empty one, and columns other than the two named have no effect.
    """
    body = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("body"))
    hashed = body.select("doc_id", "body", F.md5("body").alias("content_hash"))
    groups = (
        hashed.groupBy("content_hash", "body")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("content_hash", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    members = (
        hashed.select("doc_id", "content_hash", F.sha2("body", 256).alias("text_sha256"))
        .groupBy("doc_id", "content_hash", "text_sha256")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    return (
        members.join(groups, ["content_hash", "text_sha256"])
        .select("*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth"))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256")
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text equals that of a row with a smaller id; columns as in docs.

    Nulls and repeated rows as in duplicate_groups.
    """
    if not docs.columns:
        return docs
    struct = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(normalised(F.col(text_col)).alias("body"), F.struct(F.col(id_col).isNull(), F.col(id_col)).alias("rank"), struct.alias("row"))
    return keyed.groupBy(F.md5("body").alias("content_hash"), "body").agg(F.min_by("row", "rank").alias("row")).select("row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one of its group that stays."""
    return duplicate_groups(documents(spark, sf_dir))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM d WINDOW same AS (PARTITION BY body)
"""
