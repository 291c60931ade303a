"""Near-duplicates across the splits of a package: an exact set-similarity join by prefixes, lengths and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgertide.operators.components import components
from ledgertide.working import stored

#: Splits in the order of time.
SPLITS = ("train", "val", "test")
#: Words in a shingle, and of PER shingles of two texts' union those that both have at least.
SIZE, SHARE, PER = 5, 80, 100
#: Texts of a part: in a large group every part of later texts meets every part of earlier ones in a task of its own.
PART_TEXTS = 2_000


_FACTORS = np.array([0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingles(text: str, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words of a text; of the whole sequence where there are fewer words, none without words."""
    words = [w for w in text.split(" ") if w]
    if not words:
        return np.empty(0, dtype=np.int64)
    one = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    run = min(size, len(words))
    out = np.full(len(words) - run + 1, run, dtype=np.uint64)
    for k in range(run):
        out = (out ^ one[k : k + len(out)]) * _FACTORS[k % len(_FACTORS)]
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def _shingled(rows: DataFrame) -> DataFrame:
    """(record_id, split_tag, place, grams) of rows with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = pa.array([shingles(t.as_py()) for t in batch.column("text")], type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), batch.column("split_tag"), batch.column("place"), grams], names=["record_id", "split_tag", "place", "grams"])

    known = rows.select("record_id", "split_tag", _place(F.col("split_tag")).cast("int").alias("place"), "text").where("place > 0 AND text IS NOT NULL")
    return known.mapInArrow(run, f"record_id {rows.schema['record_id'].dataType.simpleString()}, split_tag string, place int, grams array<long>").where("size(grams) > 0")


def _place(tag: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SPLITS]), tag)


def _prefixes(classes: DataFrame) -> DataFrame:
    """(cls, gram): of each set's prefix, the n-grams that other sets have as well.

    In an order common to all sets, rare n-grams first, two similar sets share one of their first n - ceil(SHARE n) + 1. Those of one set only
    come first and lead nowhere.
    """
    grams = classes.select("cls", "n", F.explode("grams").alias("gram"))
    times = grams.groupBy("gram").agg(F.count(F.lit(1)).cast("int").alias("times")).where("times > 1")
    shared = grams.join(times, "gram").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("times", "gram"))).alias("shared"))
    size = F.col("n") - F.ceil(F.col("n") * SHARE / PER).cast("int") + 1
    first = F.slice("shared", F.lit(1), F.greatest(size - (F.col("n") - F.size("shared")), F.lit(0)))
    return shared.select("cls", F.explode(F.transform(first, lambda g: g["gram"])).alias("gram"))


def first_similar(later: list[np.ndarray], earlier: list[np.ndarray], share: int = SHARE, per: int = PER) -> Iterator[tuple[int, int, float]]:
    """(number of a later set, number of the first earlier set that is similar, similarity).

    Earlier sets are indexed by their prefixes; of those that share a prefix n-gram with a later set and are not too short or long, the first
    ones are compared until one is similar. So a group of copies costs each later set one comparison.
    """
    sets = [*earlier, *later]
    kinds, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(kinds), dtype=np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(kinds))
    sets = [np.sort(s) for s in np.split(rank[inverse], np.cumsum([len(s) for s in sets])[:-1])]
    prefix = [s[: len(s) - -(-share * len(s) // per) + 1] for s in sets]
    n = len(earlier)
    flat = np.concatenate([*prefix[:n], np.empty(0, dtype=np.int64)])
    owner = np.repeat(np.arange(n), [len(p) for p in prefix[:n]])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    sizes = np.array([len(s) for s in sets])
    for k in range(n, len(sets)):
        begin, end = np.searchsorted(flat, prefix[k]), np.searchsorted(flat, prefix[k], side="right")
        met = np.unique(np.concatenate([owner[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)]))
        met = met[(per * sizes[met] >= share * sizes[k]) & (per * sizes[k] >= share * sizes[met])]
        for other in met.tolist():
            both = len(np.intersect1d(sets[k], sets[other], assume_unique=True))
            if (per + share) * both >= share * int(sizes[k] + sizes[other]):
                yield k - n, other, both / int(sizes[k] + sizes[other] - both)
                break


def _compared(dealt: DataFrame) -> DataFrame:
    """(later, earlier, similarity) of classes, from rows (task, component, i, j, is_later, first_id, cls, grams): for each later class of a
    task the earlier one of the smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            is_later = t["is_later"].to_numpy()
            sets = [x.values.to_numpy() for x in t["grams"]]
            ids, cls = t["first_id"].to_pylist(), t["cls"].to_pylist()
            earlier = sorted(np.flatnonzero(~is_later).tolist(), key=lambda k: (ids[k], cls[k]))
            later = np.flatnonzero(is_later).tolist()
            found = list(first_similar([sets[k] for k in later], [sets[k] for k in earlier])) if earlier and later else []
            rows = [(cls[later[a]], cls[earlier[b]], s) for a, b, s in found]
            return pa.RecordBatch.from_pylist([dict(zip(("later", "earlier", "similarity"), r, strict=True)) for r in rows], schema=pa.schema([("later", pa.int64()), ("earlier", pa.int64()), ("similarity", pa.float64())]))

        key = None
        for batch in batches:
            names = np.column_stack([batch.column(c).to_numpy() for c in ("task", "component", "i", "j")])
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(names)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e > s:
                    if held and tuple(names[s]) != key:
                        yield told()
                        held = []
                    key = tuple(names[s])
                    held.append(batch.slice(s, e - s))
        if held:
            yield told()

    order = ["task", "component", "i", "j"]
    return dealt.repartition("task").sortWithinPartitions(*order).mapInArrow(run, "later long, earlier long, similarity double")


def cross_split(rows: DataFrame) -> DataFrame:
    """(record_id, split_tag, leaked_from, similarity) of each row of rows (record_id, split_tag, text) whose text is similar to one of an
    earlier split: by distinct runs of five words, 0.8 or more. leaked_from is the smallest record_id of all such rows.

    Rows of equal shingle sets are one class. Sets are compared only within what rare shingles in their prefixes connect, and there only
    later with earlier ones, so the work does not grow with the square of a split. Large groups are dealt out in parts. A shingle is known by 64
    bits of its hash. Texts without words are similar to nothing; null texts count as such. Rows of a null or unknown split take no part. Repeated rows
    repeat their results; an empty table gives an empty one.
    """
    known = stored(_shingled(rows), "split-shingles")
    firsts = [F.min(F.when(F.col("place") == k, F.col("record_id"))).alias(f"first_{k}") for k in (1, 2, 3)]
    classes = stored(known.groupBy("grams").agg(*firsts).withColumns({"cls": F.monotonically_increasing_id(), "n": F.size("grams")}), "split-classes")
    prefixes = stored(_prefixes(classes), "split-prefixes")
    hubs = prefixes.groupBy("gram").agg(F.min("cls").alias("b"), F.count(F.lit(1)).alias("times")).where("times > 1")
    groups = stored(components(prefixes.join(hubs, "gram").select(F.col("cls").alias("a"), "b")).select(F.col("node").alias("cls"), "component"), "split-groups")
    members = groups.join(classes, "cls")
    found = None
    for place in (2, 3):  # a class may be earlier for one split and later for another
        first = F.least(*[f"first_{k}" for k in range(1, place)]) if place > 2 else F.col("first_1")
        sides = F.filter(F.array(F.when(F.col(f"first_{place}").isNotNull(), F.struct(F.lit(True).alias("is_later"), F.lit("").alias("first_id"))), F.when(first.isNotNull(), F.struct(F.lit(False).alias("is_later"), first.alias("first_id")))), lambda x: x.isNotNull())
        rows_ = members.select("component", "cls", "grams", F.explode(sides).alias("side")).select("component", "cls", "grams", "side.*")
        size = rows_.groupBy("component").agg(F.ceil(F.count_if("is_later") / PART_TEXTS).cast("int").alias("m"), F.ceil(F.count_if(~F.col("is_later")) / PART_TEXTS).cast("int").alias("l")).where("m > 0 AND l > 0")
        own = lambda parts: F.pmod(F.xxhash64("cls"), parts).cast("int")
        upto = lambda parts: F.sequence(F.lit(0), parts - 1)
        pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
        tasks = F.when(F.col("is_later"), F.transform(upto(F.col("l")), lambda j: pair(own(F.col("m")), j))).otherwise(F.transform(upto(F.col("m")), lambda i: pair(i, own(F.col("l")))))
        dealt = rows_.join(size, "component").select("component", "is_later", "first_id", "cls", "grams", F.explode(tasks).alias("pair")).select("component", "is_later", "first_id", "cls", "grams", "pair.*")
        got = _compared(dealt.select(F.xxhash64("component", "i", "j").alias("task"), "*")).join(classes.select(F.col("cls").alias("earlier"), first.alias("first_id")), "earlier")
        best = got.groupBy("later").agg(F.min_by(F.struct(F.col("first_id").alias("leaked_from"), "similarity"), F.struct("first_id", "earlier")).alias("best"))
        same = classes.where(f"first_{place} IS NOT NULL").select(F.col("cls").alias("later"), F.when(first.isNotNull(), F.struct(first.alias("leaked_from"), F.lit(1.0).alias("similarity"))).alias("own"))  # equal sets
        both = same.join(best, "later", "left").select("later", F.when(F.col("own").isNull() | (F.col("best.leaked_from") < F.col("own.leaked_from")), F.col("best")).otherwise(F.col("own")).alias("best"), F.lit(place).alias("place"))
        found = both.where("best IS NOT NULL") if found is None else found.unionByName(both.where("best IS NOT NULL"))
    leaks = classes.select(F.col("cls").alias("later"), "grams").join(stored(found, "split-leaks"), "later")
    return known.join(leaks, ["grams", "place"]).select("record_id", "split_tag", "best.leaked_from", F.round("best.similarity", 6).alias("similarity"))
