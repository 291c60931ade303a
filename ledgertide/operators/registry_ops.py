"""From raw records to a labelled, deduplicated registry, with its reports."""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.functions import text as T
from ledgertide.functions.ratios import Against
from ledgertide.operators.near_pairs import near_pairs, usable
from ledgertide.working import stored

REGISTRY = ["record_id", "source", "source_record_id", "document_type", "event_date", "title", "text", "label", "label_origin", "license_scope", "citation_ref", "ingested_at_utc", "text_hash"]
LABEL_MAP_VERSION, LABEL_TAXONOMY = "label_map_v1.0", "hawkish|dovish|neutral"
NEAR_THRESHOLD = 0.97


def _reason() -> Column:
    return F.when(F.col("text") == "", "blank_text").when(F.col("event_date") == "", "blank_event_date")


def normalized_records(raw: DataFrame) -> DataFrame:
    """raw: source, source_record_id, document_type, event_date, title, text, label, license_scope, citation_ref."""
    label = F.coalesce("label", F.lit(""))
    return raw.select(
        T.record_id(F.col("source"), F.col("source_record_id"), F.col("event_date")).alias("record_id"), "source", F.col("source_record_id").cast("string").alias("source_record_id"),
        "document_type", F.coalesce("event_date", F.lit("")).alias("event_date"), T.normalize(F.col("title")).alias("title"), T.normalize(F.col("text")).alias("text"),
        label.alias("label"), T.label_origin(label).alias("label_origin"), "license_scope", "citation_ref", F.current_timestamp().cast("string").alias("ingested_at_utc"), T.text_hash(F.col("text")).alias("text_hash"),
    )


def ingest(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry, rejects): rejected rows keep the reason."""
    rows = normalized_records(raw).withColumn("reason", _reason())
    return rows.where("reason IS NULL").select(REGISTRY), rows.where("reason IS NOT NULL").select("record_id", "source", "source_record_id", "reason")


def ingestion_summary(registry: DataFrame) -> DataFrame:
    return registry.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("label") != "").alias("labelled"))


def with_labels(registry: DataFrame) -> DataFrame:
    return registry.withColumns({"mapped_label": T.map_label(F.col("label")), "label_map_version": F.lit(LABEL_MAP_VERSION), "label_taxonomy": F.lit(LABEL_TAXONOMY)})


def label_counts(labelled: DataFrame) -> DataFrame:
    outcome = F.when(F.col("label") == "", "unlabeled").otherwise(F.coalesce("mapped_label", F.lit("unmapped")))
    return labelled.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("records"))


def label_exceptions(labelled: DataFrame) -> DataFrame:
    return labelled.where("mapped_label IS NULL AND label <> ''").select("record_id", "source", "label")


def _rank(order: list[str]) -> Column:
    return F.struct(*order, "record_id")


def _repeats(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows after the first of their key in the order, with first_record_id.

    The first is found by an aggregate that merges before the shuffle, and joined back, so one hot key is a skewed join
    side, which Spark splits. Rows that are equal in the order and in record_id are told apart by counting.
    """
    firsts = rows.groupBy(*keys).agg(F.min_by("record_id", _rank(order)).alias("first_record_id"), F.min(_rank(order)).alias("first_rank"), F.count(F.lit(1)).alias("in_group")).where("in_group > 1")
    known = rows.join(firsts, keys).withColumn("is_first", _rank(order) == F.col("first_rank")).drop("first_rank", "in_group")
    again = known.where("is_first").groupBy(*rows.columns, "first_record_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    again = again.select("*", F.explode(F.sequence(F.lit(2), F.col("times").cast("int"))).alias("nth")).drop("times", "nth")
    return known.where("NOT is_first").drop("is_first").unionByName(again)


def exact_dedup(registry: DataFrame, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """The first row in the order of each event date and text hash, or `columns` of it; merged before the shuffle. What is asked for travels in
    the aggregate, so ask for whole texts only where they are needed."""
    row = F.min_by(F.struct(*(columns or registry.columns)), _rank(order))
    return registry.groupBy(F.col("event_date").alias("k1"), F.col("text_hash").alias("k2")).agg(row.alias("row")).select("row.*")


def exact_dropped(registry: DataFrame, order: list[str]) -> DataFrame:
    rows = registry.select(*dict.fromkeys(["record_id", "event_date", "text_hash", *order]))
    return _repeats(rows, ["event_date", "text_hash"], order).select("record_id", F.col("first_record_id").alias("kept_record_id"), "event_date")


def source_record_dupes(registry: DataFrame, order: list[str]) -> DataFrame:
    rows = registry.select(*dict.fromkeys(["record_id", "source", "source_record_id", *order]))
    return _repeats(rows, ["source", "source_record_id"], order).select("record_id", "first_record_id", F.concat_ws("::", "source", "source_record_id").alias("key"))


#: Texts of a block at most, and bytes of their counts; two blocks are compared in one task.
BLOCK_TEXTS, BLOCK_BYTES = 8192, 16_000_000
#: Counts of letters of a text, and the length of the runs of letters that are counted besides.
LETTERS, RUN = 64, 5
#: Length of the longer runs that are counted before a ratio is taken, counts of these, and letters of texts that have so much of a language's usual
#: runs in common that only these tell them apart.
LONG_RUN, LONG_COUNTS, LONG_TEXT = 12, 1 << 17, 4096
#: Rounds in which only new survivors are compared; after them every pair that is left is.
ROUNDS = 3
#: Parts into which texts, pairs of blocks and pairs of texts are dealt: their work is in letters, not in the bytes by which Spark would merge parts.
PARTS = 96
#: Sides of the squares into which pairs are dealt, at least where each has so many letters of texts, and letters of the texts of a square at most, about.
LEAST_SIDES, SIDE_LETTERS, SQUARE_LETTERS = 10, 200_000, 40_000_000


def _counts(text: str, run: int, counts: int) -> np.ndarray:
    """Counts of the runs of `run` letters of a text, by a hash of them."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    h = np.zeros(max(0, len(c) - run + 1), dtype=np.uint64)
    for k in range(run):
        h = (h ^ c[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.bincount((h % np.uint64(counts)).astype(np.int64), minlength=counts).astype(np.int32)


def _most_apart(run: int, unmatched: np.ndarray | float) -> np.ndarray | float:
    """How far apart the counts of runs of two texts may be, all differences together, that have so many unmatched letters U: the matched ones lie in
    U + 1 blocks at most, each of which costs run - 1 of the runs on both sides."""
    return (2 * run - 1) * unmatched + 1e-6


def _candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """(later, earlier, letters), the texts of one date whose matching ratio may reach the threshold, and the lesser length.

    The ratio is at most 2 * shorter / (shorter + longer), so texts are laid in bands of lengths of which only equal and
    neighbouring ones can match. Bands are dealt out in blocks, and pairs of blocks are compared in tasks of their own,
    so a date, however large, is spread. Not the texts but counts of their letters and runs of letters are dealt out, about a byte of them for each
    letter or two: those of matching texts differ by _most_apart() at most, those of others by more, however long they are, as there are more counts for
    longer texts.
    """
    apart = math.log((2 - threshold) / threshold) * 1.000001  # as far apart as the logarithms of two matching lengths may be
    cells = lambda low: 1 << max(6, min(20, math.floor(low * apart / math.log(2))))
    width, band, block, none = F.lit(apart), F.col("band"), F.col("block"), F.lit(0)
    banded = classes.withColumn("band", F.floor(F.log(F.length("text").cast("double")) / width))
    texts = F.greatest(F.lit(1), F.least(F.lit(BLOCK_TEXTS), F.floor(F.lit(BLOCK_BYTES) / F.exp(F.least(band, F.lit(math.ceil(14 / apart))) * width))))
    sizes = banded.groupBy("event_date", "band").agg(F.ceil(F.count(F.lit(1)) / texts).cast("int").alias("blocks"))
    above = sizes.select("event_date", (band - 1).alias("band"), F.col("blocks").alias("above"))
    below = sizes.select("event_date", (band + 1).alias("band"), F.col("blocks").alias("below"))
    placed = banded.join(sizes.join(above, ["event_date", "band"], "left").join(below, ["event_date", "band"], "left"), ["event_date", "band"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            signs = []
            for text, low, less in zip(batch["text"], batch["band"], batch["below"], strict=True):
                letters = _counts(text, 1, LETTERS).tobytes()
                own = {n: letters + np.minimum(_counts(text, RUN, n), 255).astype(np.uint8).tobytes() for n in {cells(low), cells(low - 1) if less > 0 else cells(low)}}
                signs.append((len(text), own[cells(low)], own[cells(low - 1)] if less > 0 else None))
            yield batch.drop(columns="text").assign(**dict(zip(("letters", "own", "lower"), map(list, zip(*signs, strict=True)), strict=True)))

    held = placed.select("event_date", "cls", "rank.*", "band", "block", "blocks", F.coalesce("above", none).alias("above"), F.coalesce("below", none).alias("below"), "text").repartition(PARTS, "cls")
    counted = held.mapInPandas(count, "event_date string, cls string, source string, record_id string, band long, block int, blocks int, above int, below int, letters int, own binary, lower binary")
    pair = lambda low, i, side, j: F.struct(low.alias("low"), i.alias("i"), F.lit(side).alias("side"), j.alias("j"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own = F.transform(upto(F.col("blocks")), lambda j: pair(band, F.least(block, j), 0, F.greatest(block, j)))
    up = F.transform(upto(F.col("above")), lambda j: pair(band, block, 1, j))
    down = F.transform(upto(F.col("below")), lambda i: pair(band - 1, i, 1, block))
    dealt = counted.select("event_date", "cls", "source", "record_id", "band", "block", "letters", "own", "lower", F.explode(F.concat(own, up, down)).alias("pair"))
    flat = dealt.select("event_date", "pair.*", "cls", "source", "record_id", "band", "block", "letters", F.when(F.col("pair.low") == band, F.col("own")).otherwise(F.col("lower")).alias("sign"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        out, group = [], group.sort_values("letters", kind="stable")
        low, i, side, j = (int(group[c].iloc[0]) for c in ("low", "i", "side", "j"))
        names, sizes = list(zip(group["source"], group["record_id"], group["cls"], strict=True)), group["letters"].to_numpy(dtype=np.int64)
        signs = np.stack([np.frombuffer(x, dtype=np.uint8) for x in group["sign"]])
        letters, runs = np.ascontiguousarray(signs[:, : 4 * LETTERS]).view(np.int32), signs[:, 4 * LETTERS :]
        crossed = side == 1 or i != j
        is_left = ((group["band"] == low) & (group["block"] == i)).to_numpy() if crossed else np.ones(len(sizes), dtype=bool)
        left, right = np.flatnonzero(is_left), np.flatnonzero(~is_left if crossed else is_left)
        others, step = sizes[right], max(1, 4_000_000 // runs.shape[1])
        for k in left.tolist():
            begin = np.searchsorted(others, math.floor(sizes[k] * threshold / (2 - threshold) - 1e-6)) if crossed else np.searchsorted(right, k, side="right")
            met = right[begin : np.searchsorted(others, math.ceil(sizes[k] * (2 - threshold) / threshold + 1e-6), side="right")]
            unmatched = (1 - threshold) * (sizes[met] + sizes[k])
            near = np.abs(letters[met] - letters[k]).sum(axis=1) <= _most_apart(1, unmatched)
            met, unmatched = met[near], unmatched[near]
            for s in range(0, len(met), step):
                some = runs[met[s : s + step]]
                off = (np.maximum(some, runs[k]) - np.minimum(some, runs[k])).sum(axis=1, dtype=np.int64)
                for m in met[s : s + step][off <= _most_apart(RUN, unmatched[s : s + step])].tolist():
                    earlier, later = sorted((names[k], names[m]))
                    out.append((later[2], earlier[2], min(sizes[k], sizes[m])))
        return pd.DataFrame(out, columns=["later", "earlier", "letters"])

    pair_of_blocks = ["event_date", "low", "i", "side", "j"]
    return flat.repartition(PARTS, *pair_of_blocks).groupBy(*pair_of_blocks).applyInPandas(compare, "later string, earlier string, letters int")


def _with_texts(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    text = lambda side: classes.select(F.col("cls").alias(side), F.col("text").alias(f"{side}_text"))
    told = pairs.select("later", "earlier").join(text("later"), "later").join(text("earlier"), "earlier").select("later", "earlier", "later_text", "earlier_text")
    return told.repartition(PARTS, "later", "earlier")


def _may_match(a: str, b: str, threshold: float) -> bool:
    off = int(np.abs(_counts(a, LONG_RUN, LONG_COUNTS) - _counts(b, LONG_RUN, LONG_COUNTS)).sum())
    return off <= _most_apart(LONG_RUN, (1 - threshold) * (len(a) + len(b)))


def _likely(candidates: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(later, earlier) of the candidates but the long ones whose longer runs differ too much: these would be waited for in vain, one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[[_may_match(a, b, threshold) for a, b in zip(batch["later_text"], batch["earlier_text"], strict=True)], ["later", "earlier"]]

    known = _with_texts(candidates.where(F.col("letters") >= LONG_TEXT), classes).mapInPandas(run, "later string, earlier string")
    return candidates.where(F.col("letters") < LONG_TEXT).select("later", "earlier").unionByName(known)


def _matching(pairs: DataFrame, classes: DataFrame, threshold: float, sides: int) -> DataFrame:
    """(later, earlier, similarity) of those pairs (later, earlier) whose matching ratio reaches the threshold.

    Texts are dealt out to squares of later by earlier ones, `sides` on each side, so a text goes to 2 * sides tasks at most, however many pairs it has.
    """
    square = F.pmod(F.xxhash64("later"), F.lit(sides)) * sides + F.pmod(F.xxhash64("earlier"), F.lit(sides))
    placed = pairs.select(square.cast("int").alias("square"), "later", "earlier")
    named = placed.select("square", F.explode(F.array("later", "earlier")).alias("cls")).distinct()
    texts = named.join(classes.select("cls", "text"), "cls").select("square", F.col("cls").alias("later"), F.lit(None).cast("string").alias("earlier"), "text")
    dealt = placed.withColumn("text", F.lit(None).cast("string")).unionByName(texts).repartitionById(sides * sides, "square")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text, met = {}, {}
        for batch in batches:
            for _, later, earlier, known in batch.itertuples(index=False, name=None):
                if known is None:
                    met.setdefault(earlier, []).append(later)
                else:
                    text[later] = known
        for earlier, laters in met.items():
            b, out = Against(text[earlier], threshold), []
            for later in laters:
                if b.reached_by(a := text[later]) and (ratio := SequenceMatcher(None, a, text[earlier]).ratio()) >= threshold:
                    out.append((later, earlier, ratio))
            if out:
                yield pd.DataFrame(out, columns=["later", "earlier", "similarity"])

    return dealt.mapInPandas(run, "later string, earlier string, similarity double")


def _sides(candidates: DataFrame, classes: DataFrame) -> int:
    """Sides of the squares into which pairs are dealt, by the letters of their texts."""
    named = candidates.select(F.explode(F.array("later", "earlier")).alias("cls")).distinct()
    letters = named.join(classes.select("cls", "letters"), "cls").agg(F.sum("letters")).first()[0] or 0
    return max(1, min(LEAST_SIDES, math.ceil(letters / SIDE_LETTERS)), math.ceil(2 * letters / SQUARE_LETTERS))


def near_dedup(registry: DataFrame, threshold: float = NEAR_THRESHOLD) -> DataFrame:
    """(record_id, event_date, blocked_by, similarity) for each row; blocked_by is null for survivors.

    Within an event date, in the order of source and record id, a row is blocked by the first survivor whose matching
    ratio with it reaches the threshold. Equal texts of a date go together, as one of them decides for all. Rounds of joins
    settle who survives: a text without an earlier candidate does, and what is left is compared with the new survivors alone, so a group of near
    copies costs each of them about one ratio, not one for each other. After ROUNDS of them few candidates match, so all that are left are compared, and
    there are as many rounds more as the longest chain of their matches. At last those that were blocked before an earlier survivor was known are compared with it.
    """
    rank = F.struct("source", "record_id")
    rows = registry.select("record_id", "event_date", "source", F.md5(F.concat_ws("\n", "event_date", "text")).alias("cls"), "text")
    classes = stored(rows.groupBy("event_date", "cls", "text").agg(F.min(rank).alias("rank")).withColumns({"no": F.monotonically_increasing_id(), "letters": F.length("text")}), "near-classes")
    heads = classes.select("cls", "rank")
    found = near_pairs(classes, threshold) if usable(threshold) else _likely(stored(_candidates(classes, threshold), "near-blocks"), classes, threshold)
    candidates = stored(found, "near-candidates")
    sides = _sides(candidates, classes)
    as_ = lambda df, side: df.select(F.col("cls").alias(side))
    open_, turn = candidates, 0
    new = stored(candidates.select(F.col("earlier").alias("cls")).distinct().join(as_(candidates.withColumnRenamed("later", "cls"), "cls").distinct(), "cls", "left_anti"), "near-new")
    matches, alive, gone, known = [], [], [], None
    while not open_.isEmpty():
        if turn == ROUNDS:
            known = stored(_matching(open_, classes, threshold, sides), "near-known")
            free = open_.select(F.col("later").alias("cls")).distinct().join(as_(known.withColumnRenamed("later", "cls"), "cls").distinct(), "cls", "left_anti")
            open_, new = known.select("later", "earlier"), stored(new.unionByName(free), "near-new")
        alive.append(new.withColumn("since", F.lit(turn)))
        met = open_.join(as_(new, "earlier"), "earlier")
        matches.append(stored(_matching(met, classes, threshold, sides) if known is None else known.join(met, ["later", "earlier"], "left_semi").select("later", "earlier", "similarity"), "near-matches"))
        blocked = stored(matches[-1].select(F.col("later").alias("cls")).distinct(), "near-blocked")
        gone.append(blocked.withColumn("until", F.lit(turn)))
        left = open_.join(as_(blocked, "later"), "later", "left_anti")
        rest = stored(left.join(as_(new, "earlier"), "earlier", "left_anti").join(as_(blocked, "earlier"), "earlier", "left_anti"), "near-open")
        new = stored(left.select(F.col("later").alias("cls")).distinct().join(as_(rest.withColumnRenamed("later", "cls"), "cls"), "cls", "left_anti"), "near-new")
        open_, turn = rest, turn + 1
    first = None
    if matches:
        all_of = lambda parts: reduce(DataFrame.unionByName, parts)
        ranked = lambda df: df.join(heads.select(F.col("cls").alias("earlier"), "rank"), "earlier")
        best = lambda df: df.groupBy(F.col("later").alias("cls")).agg(F.min_by(F.struct(F.col("rank.record_id").alias("by"), "similarity"), "rank").alias("first"), F.min("rank").alias("first_rank"))
        found = ranked(all_of(matches))
        missed = candidates.join(all_of(gone).withColumnRenamed("cls", "later"), "later").join(all_of(alive).withColumnRenamed("cls", "earlier"), "earlier").where("since > until")
        missed = ranked(missed).join(best(found).select(F.col("cls").alias("later"), "first_rank"), "later").where("rank < first_rank")
        first = best(found.unionByName(ranked(stored(_matching(missed, classes, threshold, sides), "near-missed")))).drop("first_rank")
    judged = heads.join(first, "cls", "left") if first is not None else heads.withColumn("first", F.lit(None).cast("struct<by: string, similarity: double>"))
    all_ = rows.drop("text").join(judged, "cls")
    is_head = (F.col("record_id") == F.col("rank.record_id")) & (F.col("source") == F.col("rank.source"))
    blocked_by = F.coalesce("first.by", F.when(~is_head, F.col("rank.record_id")))
    similarity = F.coalesce(F.round("first.similarity", 5), F.when(~is_head, F.lit(1.0)))
    return all_.select("record_id", "event_date", blocked_by.alias("blocked_by"), similarity.alias("similarity"))


def invalid_dates(registry: DataFrame) -> DataFrame:
    return registry.where(~T.is_valid_date(F.col("event_date"))).select("record_id", "event_date")


def leakage_status(registry: DataFrame, order: list[str]) -> DataFrame:
    bad = invalid_dates(registry).agg(F.count(F.lit(1)).alias("invalid_event_dates"))
    twice = source_record_dupes(registry, order).agg(F.count(F.lit(1)).alias("source_record_duplicates"))
    failed = (F.col("invalid_event_dates") > 0) | (F.col("source_record_duplicates") > 0)
    return bad.crossJoin(twice).withColumn("status", F.when(failed, "fail").otherwise("pass"))  # one row each


def distribution(labelled: DataFrame) -> DataFrame:
    """Counts by source, by label and by both, in one pass."""
    rows = labelled.select("source", F.coalesce("mapped_label", F.lit("unlabeled")).alias("label"))
    return rows.groupingSets([[F.col("source"), F.col("label")], [F.col("source")], [F.col("label")]], "source", "label").agg(F.count(F.lit(1)).alias("records"))
