"""Documents linked by the Jaccard similarity of their n-gram sets: an exact join in prefix trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.llm.common import documents, part_pairs, shared_dir, stored, text_key, text_or_empty, whole_keys
from ledgertide.operators.components import components
from ledgertide.working import discard, small, stored_at

SIZE = 4
#: Sets link when PER * intersection >= SHARE * union.
SHARE, PER = 85, 100
#: Of sets of more than SMALL n-grams one n-gram in RATE, by its hash, is counted over all documents; these come first in the order of
#: n-grams. That is more than SHARE leaves to a prefix, so a prefix seldom needs others. Of smaller sets all are counted, in an order
#: of their own; sets that can link across SMALL are in both.
RATE, SMALL = 4, 200
_SMALL_MARK = np.uint64(0x5851F42D4C957F2D)
#: N-grams in a part: what n-grams connect is joined in trees of two parts at most.
PART_GRAMS = 1_000_000
#: Numbers of a label that a search reads before it looks at the bounds again.
STEP = 32
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def gram_set(text: str, size: int = SIZE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of `size` words, A-Z lower-cased; of the whole sequence where there are fewer words."""
    words = text.encode().lower().split()  # both are ASCII only on bytes
    if not words:
        return np.empty(0, dtype=np.uint64)
    c = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    run = min(size, len(words))
    h = np.full(len(words) - run + 1, run, dtype=np.uint64)
    for j in range(run):
        h = (h ^ c[j : len(h) + j]) * _MIX[j % len(_MIX)]
        h ^= h >> np.uint64(32)
    return np.unique(h)


def least_overlap(n: int) -> int:
    """N-grams that a set of n shares with any set that it links with."""
    return -(-SHARE * n // PER)


def prefix_size(n: int) -> int:
    """Of two sets that link, the first so many n-grams, in any order common to all sets, have one in common."""
    return n - least_overlap(n) + 1


def alone(n: int) -> bool:
    """A set of n links with no other set: not even with one of one n-gram more."""
    return PER * n < SHARE * (n + 1)


class PrefixTree:
    """Ordered sets in a trie whose unary paths are single nodes. search() walks all paths together, level by level, with the
    overlap that sets share up to a node counted once, and leaves subtrees whose remaining lengths can't reach the similarity."""

    def __init__(self, sets: list[np.ndarray], share: int = SHARE, per: int = PER):
        """sets are distinct, each of distinct numbers; numbers that more sets hold come first, so that sets share paths."""
        self.share, self.both = share, share + per
        _, flat, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(times), dtype=np.int64)
        rank[np.argsort(-times, kind="stable")] = np.arange(len(times))
        cuts = np.cumsum([len(s) for s in sets])[:-1]
        self.sets = [np.sort(s) for s in np.split(rank[flat], cuts)]
        order = sorted(range(len(sets)), key=lambda k: self.sets[k].astype(">u4").tobytes())
        begin, parent, depth, owner = [0], [-1], [0], [-1]  # of a node: where its label begins, depth at its end, the set it ends, if any
        label_of = [-1]  # a set whose numbers from begin to depth are the label
        path, before = [0], np.empty(0, dtype=np.int64)
        for k in order:
            mine = self.sets[k]
            n = min(len(before), len(mine))
            differ = before[:n] != mine[:n]
            common = int(differ.argmax()) if differ.any() else n
            low = -1
            while depth[path[-1]] > common:
                low = path.pop()
            if depth[path[-1]] < common:  # the node below is cut in two
                begin.append(begin[low])
                parent.append(path[-1])
                depth.append(common)
                owner.append(-1)
                label_of.append(label_of[low])
                begin[low], parent[low] = common, len(begin) - 1
                path.append(len(begin) - 1)
            begin.append(common)
            parent.append(path[-1])
            depth.append(len(mine))
            owner.append(k)
            label_of.append(k)
            path.append(len(begin) - 1)
            before = mine
        self.parent, self.depth, self.owner = np.array(parent), np.array(depth), np.array(owner)
        self.label_size = self.depth - np.array(begin)
        self.label_begin = np.cumsum(self.label_size) - self.label_size
        self.labels = np.concatenate([np.empty(0, dtype=np.int64), *[self.sets[s][b:d] for s, b, d in zip(label_of[1:], begin[1:], depth[1:], strict=True)]])
        self.children = np.argsort(self.parent, kind="stable")
        self.child_begin = np.searchsorted(self.parent[self.children], np.arange(len(parent)))
        self.child_end = np.searchsorted(self.parent[self.children], np.arange(len(parent)), side="right")
        self.node_of = {int(k): at for at, k in enumerate(owner) if k >= 0}
        self.left = np.zeros(len(parent), dtype=np.int64)  # sets in the subtree that are still there
        self.shortest, self.longest = np.full(len(parent), np.iinfo(np.int64).max), np.zeros(len(parent), dtype=np.int64)
        for k, at in self.node_of.items():
            n = len(self.sets[k])
            while at >= 0:
                self.left[at] += 1
                self.shortest[at], self.longest[at] = min(self.shortest[at], n), max(self.longest[at], n)
                at = parent[at]
        self.there = np.ones(len(sets), dtype=bool)
        self.mark = np.zeros(len(times), dtype=bool)

    def remove(self, k: int) -> None:
        self.there[k] = False
        at = self.node_of[k]
        while at >= 0:
            self.left[at] -= 1
            at = self.parent[at]

    def search(self, k: int) -> list[int]:
        """The sets still there that set k links with."""
        mine = self.sets[k]
        n = len(mine)
        self.mark[mine] = True
        found: list[int] = []
        share, both, per = self.share, self.both, self.both - self.share
        nodes, read, shared = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)  # of the label of a node, and up to there
        while len(nodes):
            done = read == self.label_size[nodes]
            ends = nodes[done]
            hit = (both * shared[done] >= share * (n + self.depth[ends])) & (self.owner[ends] >= 0)
            found += [o for o in self.owner[ends[hit]].tolist() if self.there[o]]
            size = self.child_end[ends] - self.child_begin[ends]
            child = self.children[np.arange(int(size.sum())) + np.repeat(self.child_begin[ends] - np.cumsum(size) + size, size)]
            upto = np.repeat(shared[done], size)
            fits = (self.left[child] > 0) & (per * self.longest[child] >= share * n) & (share * self.shortest[child] <= per * n)
            nodes = np.concatenate([nodes[~done], child[fits]])
            read = np.concatenate([read[~done], np.zeros(int(fits.sum()), dtype=np.int64)])
            shared = np.concatenate([shared[~done], upto[fits]])
            if not len(nodes):
                break
            size = np.minimum(STEP, self.label_size[nodes] - read)
            end = np.cumsum(size)
            label = self.labels[np.arange(int(end[-1])) + np.repeat(self.label_begin[nodes] + read - end + size, size)]
            shared = shared + np.add.reduceat(self.mark[label], end - size, dtype=np.int64)
            read = read + size
            depth = self.depth[nodes] - self.label_size[nodes] + read
            rest = n - np.searchsorted(mine, label[end - 1], side="right")  # of set k beyond what was read
            go = (both * (shared + rest) >= share * (n + self.shortest[nodes])) & (both * (shared + self.longest[nodes] - depth) >= share * (n + self.longest[nodes]))
            nodes, read, shared = nodes[go], read[go], shared[go]
        self.mark[mine] = False
        return found

    def edges(self) -> Iterator[tuple[int, int]]:
        """(found, finder): a forest of links that connects what any links connect; each set is searched for once, among
        those not reached before."""
        for k in range(len(self.sets)):
            if self.there[k]:
                self.remove(k)
                group = [k]
                for finder in group:
                    found = self.search(finder) if self.left[0] else []
                    for f in found:
                        self.remove(f)
                    yield from ((f, finder) for f in found)
                    group += found


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, key, text_key, small, large, other) of each row: the size of its set, 128-bit hashes of set and text, its n-grams that
    are counted over all documents, as a small set and as a large one, and the least others, where its prefix needs some."""
    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), text_key(text).alias("text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, small_, large, other = [], [], [], [], []
            for t in batch.column("text"):
                grams = gram_set(t.as_py())
                n.append(len(grams))
                keys.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                links, few = not alone(n[-1]), SHARE * n[-1] <= PER * SMALL
                small_.append((grams if links and few else grams[:0]).view("<i8") ^ _SMALL_MARK.view("<i8"))
                grams = grams if links and PER * n[-1] > SHARE * SMALL else grams[:0]
                is_counted = grams % np.uint64(RATE) == 0
                some = grams[is_counted]
                large.append(some.view("<i8"))
                other.append(grams[~is_counted][: max(0, prefix_size(n[-1]) - len(some))].view("<i8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, type=pa.int32()), pa.array(keys, type=pa.binary()), batch.column("text_key"), *[pa.array(x, type=pa.list_(pa.int64())) for x in (small_, large, other)]],
                names=["doc_id", "n", "key", "text_key", "small", "large", "other"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n int, key binary, text_key binary, small array<long>, large array<long>, other array<long>")


def _prefixes(classes: DataFrame) -> DataFrame:
    """(cls, gram): the n-grams of each set's prefix that another set may have in its own.

    The order is that of their number of sets, then of their hashes; those that are not counted come last. N-grams of a single set
    come first of all and lead nowhere, so a set with enough of them is done with here.
    """
    kinds = classes.select("cls", "n", F.posexplode(F.array("small", "large")).alias("kind", "counted"))
    grams = kinds.select("cls", "n", "kind", F.size("counted").alias("all"), F.explode("counted").alias("gram"))
    times = stored(grams.groupBy("gram").agg(F.count(F.lit(1)).cast("int").alias("times")).where("times > 1"), "gram-times")
    size = F.col("n") - F.ceil(F.col("n") * SHARE / PER).cast("int") + 1
    shared = grams.join(times, "gram").groupBy("cls", "n", "kind", "all").agg(F.sort_array(F.collect_list(F.struct("times", "gram"))).alias("shared"))
    first = F.slice("shared", F.lit(1), F.greatest(size - (F.col("all") - F.size("shared")), F.lit(0)))
    return shared.select("cls", F.explode(F.transform(first, lambda g: g["gram"])).alias("gram")).unionByName(classes.select("cls", F.explode("other").alias("gram")))


def links_within(groups: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int = SIZE, share: int = SHARE, per: int = PER) -> DataFrame:
    """(a, b): links between classes (cls, n, rep) that connect what all links within each group (cls, component) connect.

    One text of each class, that of the row rep, is fetched. A group of more than PART_GRAMS n-grams is dealt out in parts, and every two parts have a tree
    of their own, so no task holds more than two parts and together they see every pair.
    """
    members = groups.join(classes.select("cls", "n", "rep"), "cls")
    sizes = members.groupBy("component").agg(F.ceil(F.sum("n") / PART_GRAMS).cast("int").alias("parts"))
    dealt = members.join(sizes, "component").select("cls", "component", "rep", F.explode(part_pairs(F.col("parts"), F.col("cls"))).alias("pair"))
    wanted = stored(dealt.select(F.xxhash64("component", "pair").alias("tree"), "component", "pair.i", "pair.j", "cls", F.col("rep.doc_id").alias("id"), F.col("rep.text_key").alias("text_key")), "gram-groups")
    text = text_or_empty(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("key"), text.alias("text")).alias("d")
    rows = texts.join(small(wanted).alias("w"), (F.col("d.key") == F.col("w.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("w.id")))
    rows = rows.select("tree", "component", "i", "j", "cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches):
            cls, same = t["cls"].to_numpy(), np.column_stack([t[n].to_numpy() for n in ("tree", "component", "i", "j")])
            cuts = [0, *(np.flatnonzero((same[1:] != same[:-1]).any(axis=1)) + 1).tolist(), len(cls)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                names, at = np.unique(cls[s:e], return_index=True)  # a row may be there twice
                tree = PrefixTree([gram_set(t["text"][s + int(k)].as_py(), size) for k in at], share, per)
                a, b = zip(*found, strict=True) if (found := list(tree.edges())) else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(names[list(x)] if x else [], type=pa.int64()) for x in (a, b)], names=["a", "b"])

    order = ["tree", "component", "i", "j"]
    return rows.repartition("tree").sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def linked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: the size of its set of SIZE-word shingles and the smallest id that links reach.

    Rows of equal sets are one class. Any two sets that link have an n-gram of their prefixes in common, so what shared prefix n-grams
    connect holds all links; there, and only there, sets are joined in prefix trees. An n-gram is known by 64 bits of its hash, a set by 128.
    Null texts count as empty; rows without words link with nothing, and their component is their own id. Null ids count last: a
    component has a null component_id only if none of its rows has an id. Repeated rows get repeated results. Texts may be of any
    length; an empty table gives an empty one, and columns other than the two named have no effect.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "gram-sets")
    sets = stored_at(_sets(docs, id_col, text_col), path)
    classes = stored(
        sets.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("rep"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("small", "large", "other")])
        .withColumn("cls", F.monotonically_increasing_id()), "gram-classes",
    )
    members = stored(sets.select("doc_id", "n", "key"), "gram-members")
    discard(spark, path)
    prefixes = stored(_prefixes(classes), "gram-prefixes")
    hubs = prefixes.groupBy("gram").agg(F.min("cls").alias("b"), F.count(F.lit(1)).alias("times")).where("times > 1")
    groups = components(prefixes.join(hubs, "gram").select(F.col("cls").alias("a"), "b")).select(F.col("node").alias("cls"), "component")
    links = components(links_within(stored(groups, "gram-candidates"), classes, docs, id_col, text_col)).select(F.col("node").alias("cls"), F.col("component").alias("group"))
    named = classes.select("cls", "key", "least_id").join(links, "cls", "left").select("key", "least_id", F.coalesce("group", "cls").alias("group"))
    smallest = named.groupBy("group").agg(F.min("least_id").alias("component_id"))
    of_key = named.join(smallest, "group").select("key", "component_id")
    out = members.join(of_key, "key", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document by links of four-word shingle sets of similarity 0.85 or more. Odd rows as in linked_documents()."""
    return linked_documents(documents(spark, sf_dir))
