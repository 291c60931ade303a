"""Near-duplicates by SimHash fingerprints, searched in BK-tree shards."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.llm.common import documents, part_pairs, stored, text_key, text_or_empty, whole_keys
from ledgertide.operators.components import components
from ledgertide.llm.ngram_join import gram_set, links_within
from ledgertide.working import small

SEED = 42
BITS = 64


def shingles(text: str, size: int) -> list[bytes]:
    """Runs of `size` words, A-Z lower-cased, joined by a space; the whole sequence where there are fewer words."""
    words = text.encode().lower().split()  # both are ASCII only on bytes
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[: len(words) - size]).tolist()]
    return [joined[a:b] for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def shingle_hashes(text: str, size: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(g, SEED) for g in shingles(text, size)], dtype="<u8")


def fingerprint(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of shingles' hashes, as a signed number; 0 for a text without words."""
    if not len(hashes):
        return 0
    return int(_majorities(hashes[:, None])[0])


def _majorities(hashes: np.ndarray) -> np.ndarray:
    """For each column of hashes a number with the bits that over half of its hashes have, signed."""
    counts = np.zeros(BITS * hashes.shape[1], dtype=np.int64)
    for at in range(0, len(hashes), 255):  # so many fit a byte
        rows = np.ascontiguousarray(hashes[at : at + 255]).view(np.uint8)
        counts += np.add.reduce(np.unpackbits(rows, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")


class BKTree:
    """Fingerprints by Hamming distance to their parent; take() removes what it finds."""

    def __init__(self, prints: Iterable[int]):
        self.prints: list[int] = []
        self.children: list[dict[int, int]] = []
        self.alive: list[bool] = []
        self.left: list[int] = []  # alive in the subtree
        self.parent: list[int] = []
        for x in prints:
            self.add(x)

    def add(self, x: int) -> int:
        k, at, up = len(self.prints), 0, -1
        while self.prints and at >= 0:
            self.left[at] += 1
            up, d = at, (self.prints[at] ^ x).bit_count()
            at = self.children[at].get(d, -1)
            if at < 0:
                self.children[up][d] = k
        self.prints.append(x)
        self.children.append({})
        self.alive.append(True)
        self.left.append(1)
        self.parent.append(up)
        return k

    def remove(self, k: int) -> None:
        self.alive[k] = False
        while k >= 0:
            self.left[k] -= 1
            k = self.parent[k]

    def take(self, x: int, radius: int) -> list[int]:
        """Removes and returns the numbers of the fingerprints within the radius of x."""
        found, todo = [], [0] if self.prints else []
        while todo:
            at = todo.pop()
            if not self.left[at]:
                continue
            d = (self.prints[at] ^ x).bit_count()
            if d <= radius and self.alive[at]:
                found.append(at)
            todo += [c for e, c in self.children[at].items() if d - radius <= e <= d + radius]
        for k in found:
            self.remove(k)
        return found

    def edges(self, radius: int) -> Iterator[tuple[int, int]]:
        """(found, finder): a forest of links within the radius that connects what any links connect. Each fingerprint is
        searched for once, among those not reached before, so a dense group costs little more than its size."""
        for k in range(len(self.prints)):
            if self.alive[k]:
                self.remove(k)
                group = [k]
                for finder in group:
                    found = self.take(self.prints[finder], radius)
                    yield from ((f, finder) for f in found)
                    group += found


class BKForest:
    """BK-trees of many shards at once, in arrays: shards are runs of `shard`, which is sorted, and a shard's first
    fingerprint is its root. Trees grow, and are searched, level by level for all fingerprints together."""

    def __init__(self, shard: np.ndarray, prints: np.ndarray):
        self.prints = prints.view("<u8")
        n = len(prints)
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if n else np.empty(0, np.int64)
        self.root = np.repeat(first, np.diff(np.append(first, n)))
        slots, children = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        todo = np.flatnonzero(self.root != np.arange(n))
        at = self.root[todo]
        while len(todo):  # fingerprints that meet at a node in equal distance go on below the first of them
            slot = at * (BITS + 1) + np.bitwise_count(self.prints[todo] ^ self.prints[at])
            slot, head, to = np.unique(slot, return_index=True, return_inverse=True)
            child = todo[head]
            slots.append(slot)
            children.append(child)
            at, inner = child[to], np.ones(len(todo), dtype=bool)
            inner[head] = False
            todo, at = todo[inner], at[inner]
        self.slots, self.children = np.concatenate(slots), np.concatenate(children)
        order = np.argsort(self.slots)
        self.slots, self.children = self.slots[order], self.children[order]

    def pairs(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(later, earlier) of every two fingerprints of a shard within the radius; only edges within it are followed."""
        later = np.flatnonzero(self.root != np.arange(len(self.prints)))
        node, found = self.root[later], [(np.empty(0, np.int64), np.empty(0, np.int64))]
        while len(later):
            d = np.bitwise_count(self.prints[later] ^ self.prints[node]).astype(np.int64)
            hit = d <= radius
            found.append((later[hit], node[hit]))
            base = node * (BITS + 1)
            begin = np.searchsorted(self.slots, base + np.maximum(d - radius, 0))
            size = np.searchsorted(self.slots, base + np.minimum(d + radius, BITS), side="right") - begin
            child = np.arange(int(size.sum())) + np.repeat(begin - np.cumsum(size) + size, size)
            later, node = np.repeat(later, size), self.children[child]
            earlier = node < later  # a subtree holds only what comes after its root
            later, node = later[earlier], node[earlier]
        a, b = zip(*found, strict=True)
        return np.concatenate(a), np.concatenate(b)


def spanning(a: list[int], b: list[int]) -> Iterator[int]:
    """Numbers of the pairs that join what the pairs before have not joined."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            yield k


#: Shards of more fingerprints than this get a tree of their own, whose dense groups cost little more than their size.
OWN_TREE = 512


def agreement(n: int, radius: int) -> int:
    """How many blocks of bits a shard's fingerprints share: enough for shards of about 64 random ones among n."""
    return next((k for k in (2, 3, 4) if BITS * k / (radius + k) >= math.log2(max(2, n)) - 6), 5)


def block_keys(fp: Column, radius: int, agree: int = 2) -> Column:
    """Keys of the shards of a fingerprint: one for each `agree` of radius + agree blocks of bits.

    Fingerprints within the radius agree on at least that many blocks, so they share a shard.
    """
    n = radius + agree
    cuts = [BITS * i // n for i in range(n + 1)]
    block = lambda i: F.call_function("shiftrightunsigned", fp, F.lit(cuts[i])).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1))

    def key(k: int, chosen: tuple[int, ...]) -> Column:
        out = F.lit(k).cast("long")
        for i in chosen:
            out = F.shiftleft(out, cuts[i + 1] - cuts[i]).bitwiseOR(block(i))
        return out

    return F.array(*[key(k, c) for k, c in enumerate(combinations(range(n), agree))])


#: Shards of more fingerprints than this are dealt out in parts.
LARGE_SHARD = 250_000


def _in_parts(dealt: DataFrame) -> DataFrame:
    """(key, fp, name) with the large shards dealt out: every two parts of one are a shard of their own."""
    sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE_SHARD)
    sizes = stored(sizes.select("key", F.ceil(F.col("n") / LARGE_SHARD).cast("int").alias("parts")), "large-shards")
    own = dealt.join(small(sizes), "key", "left")
    pairs = F.when(F.col("parts").isNotNull(), part_pairs(F.col("parts"), F.col("fp")))
    split = own.select("key", "fp", "name", F.explode_outer(pairs).alias("pair"))
    return split.select(F.when(F.col("pair").isNull(), F.col("key")).otherwise(F.xxhash64("key", "pair")).alias("key"), "fp", "name")


def _searched(spread: DataFrame, radius: int) -> DataFrame:
    """(a, b): edges between names of fingerprints within the radius, in the shards of each partition of (key, fp, name)."""

    def search(keys: np.ndarray, fps: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.flatnonzero(np.diff(keys)) + 1
        begin = np.concatenate([[0], cut])
        sizes = np.diff(np.append(begin, len(keys)))
        a, b = [], []
        for s, n in zip(begin[sizes > OWN_TREE].tolist(), sizes[sizes > OWN_TREE].tolist(), strict=True):
            for x, y in BKTree([x & _MASK for x in fps[s : s + n].tolist()]).edges(radius):
                a.append(s + x)
                b.append(s + y)
        few = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= OWN_TREE), sizes))
        x, y = BKForest(keys[few], fps[few]).pairs(radius)
        joins = list(spanning(x.tolist(), y.tolist()))
        return names[np.concatenate([few[x[joins]], np.array(a, dtype=np.int64)])], names[np.concatenate([few[y[joins]], np.array(b, dtype=np.int64)])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in search(*(t[c].to_numpy() for c in ("key", "fp", "name")))], names=["a", "b"])

    return spread.sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def links(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b): edges between names that connect what distances of at most `radius` connect. prints has distinct (kind, fp), each
    with a name; fingerprints of one kind are searched together.

    Each shard has a BK-tree and gives one edge for each fingerprint that it links, not a pair for each link. Dense shards,
    which more blocks would not divide, are dealt out in parts, so a task's memory has a bound.
    """
    sizes = [r["count"] for r in prints.groupBy("kind").count().collect()]  # a row for each kind
    n = max(sizes, default=0)
    key = F.explode(block_keys(F.col("fp"), radius, agreement(n, radius))).alias("key")
    dealt = prints.select("kind", key, "fp", "name").select(F.xxhash64("kind", "key").alias("key"), "fp", "name")
    if n > LARGE_SHARD:  # else no shard can be large
        dealt = _in_parts(dealt)

    own = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")) * len(sizes)  # as many for each kind, so that sorts stay small
    return _searched(dealt.repartition(own, "key") if len(sizes) > 1 else dealt.repartition("key"), radius)


_MASK = (1 << BITS) - 1


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(t.as_py(), size)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=pa.int64())], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row; component_id is the smallest id that links reach.

    Documents of equal fingerprints form a class, and only classes are searched. Null texts count as empty; texts
    without words have fingerprint zero and are linked like any other. Null ids count last: a component has a null
    component_id only if none of its rows has an id. Repeated rows get repeated results. Texts may be of any length;
    an empty table gives an empty one, and columns other than the two named have no effect.
    """
    prints = stored(fingerprints(docs, id_col, text_col, size), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    linked = components(links(classes.select(F.lit(0).alias("kind"), "fp", F.col("fp").alias("name")), radius))
    labelled = classes.join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    members = labelled.join(smallest, "component").select("fp", "component_id")
    return prints.join(members, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For similar(): words in a shingle, and of PER shingles of two texts' union those that both have at least.
SIMILAR_SIZE, SIMILAR_SHARE, SIMILAR_PER = 5, 80, 100
#: Shard keys of a text, each from so many least hashes, and bits that fingerprints in a shard may differ in. A pair at the similarity has
#: a key in common with a probability of 1 - (1 - 0.8 ** BAND_ROWS) ** BANDS = 0.992, and differs in 10 bits on average.
BANDS, BAND_ROWS, SIMILAR_RADIUS = 16, 6, 18
#: Odd multipliers, each of which puts the hashes in another order, and how many shingles are put in order at a time.
_ORDERS = (np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_BLOCK = 4096


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The BANDS shard keys of a text's shingle hashes: as many for every text, whatever the table's size. All 0 without shingles."""
    if not len(hashes):
        return np.zeros(BANDS, dtype=np.int64)
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.min([(h[k : k + _BLOCK, None] * _ORDERS).min(axis=0) for k in range(0, len(h), _BLOCK)], axis=0)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        key = (key ^ column.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _banded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, key, text_key, fp, bands) of each row: the size of its shingle set, 128-bit hashes of set and text, the fingerprint, shard keys."""
    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("text_key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (gram_set(t.as_py(), SIMILAR_SIZE) for t in batch.column("text"))
            out = [(len(g), hashlib.blake2b(g.tobytes(), digest_size=16).digest(), fingerprint(g), band_keys(g)) for g in sets]
            n, keys, prints, bands = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, type=pa.int32()), pa.array(keys, type=pa.binary()), batch.column("text_key"), pa.array(prints, type=pa.int64()), pa.array(list(bands), type=pa.list_(pa.int64()))],
                names=["doc_id", "n", "key", "text_key", "fp", "bands"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n int, key binary, text_key binary, fp long, bands array<long>")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, component) of each row: rows of a component are near-duplicates, by five-word shingles and a similarity of 0.8 or more.

    Rows of equal shingle sets are one class; those without words are one. A class lies in BANDS shards, keyed by its least hashes, and a BK-tree for
    each shard links fingerprints within SIMILAR_RADIUS bits. What these links connect is then joined exactly, by whole shingle sets in
    prefix trees, so which links a shard's forest held does not matter, and no pair below the similarity is taken.
    """
    rows = stored(_banded(docs, id_col, text_col), "near-sets")
    classes = stored(
        rows.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
        .withColumn("cls", F.monotonically_increasing_id()), "near-classes",
    )
    dealt = classes.where("n > 0").select(F.explode("bands").alias("key"), "fp", F.col("cls").alias("name"))
    groups = components(_searched(_in_parts(dealt).repartition("key"), SIMILAR_RADIUS)).select(F.col("node").alias("cls"), "component")
    joined = components(links_within(stored(groups, "near-candidates"), classes, docs, id_col, text_col, SIMILAR_SIZE, SIMILAR_SHARE, SIMILAR_PER))
    named = classes.select("key", "cls").join(joined.select(F.col("node").alias("cls"), "component"), "cls", "left").select("key", F.coalesce("component", "cls").alias("component"))
    return rows.select("doc_id", "text_key", "key").join(named, "key").select("doc_id", "text_key", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one text of each group of similar() rows: that of the smallest id, null ids last; columns as in docs.

    Rows of equal texts stay or go together. Null texts count as empty; texts without words are one group. Texts may be of any length;
    an empty table gives an empty one, and other columns, whatever their names, have no effect.
    """
    found = stored(similar(docs, id_col, text_col), "near-groups")
    firsts = found.groupBy("component").agg(F.min_by("text_key", F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first"))
    gone = stored(found.join(firsts, "component").where("text_key <> first").select(F.col("text_key").alias("gone")).distinct(), "near-gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key(text_or_empty(F.col(text_col))).alias("text_key"))
    return rows.join(small(gone), F.col("text_key") == F.col("gone"), "left_anti").select("row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document: fingerprints of four-word shingles, linked at four or fewer differing bits."""
    return near_duplicates(documents(spark, sf_dir))
