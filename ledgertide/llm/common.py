"""What the operators share: text normalisation, working tables, tokenization."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.working import shared_dir, stored

__all__ = ["SPACE", "SPACE_CHARS", "documents", "let", "part_pairs", "shared_dir", "stored", "text_key", "text_or_empty", "whole_keys", "words_of"]

#: ASCII white space, as in the operators' word definition.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body's lambdas refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart."""
    return F.unhex(F.md5(text))


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of all rows of some keys each; batches are sorted by their first column, the key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def part_pairs(parts: Column, value: Column) -> Column:
    """array<struct<i, j>>: the pairs of parts in which a value is seen, its own part with each other one; (0, 0) if there is one
    part. So every two values of a group meet, and no task holds more than two parts."""
    part = F.pmod(F.xxhash64(value), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(F.least(k, part).alias("i"), F.greatest(k, part).alias("j")))
    return F.when(parts > 1, F.filter(pairs, lambda x: x["i"] != x["j"])).otherwise(pairs)
