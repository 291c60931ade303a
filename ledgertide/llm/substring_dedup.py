"""Repeated passages of words, found by super-k-mers that travel to their minimiser's bucket."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ledgertide.llm.common import documents, stored, text_or_empty

#: Words in a window, and words in the runs among which its minimiser is chosen.
WINDOW, RUN = 20, 6
#: Buckets of more super-k-mers than this are dealt out by longer runs around the minimiser, in about so large parts.
LARGE_BUCKET = 5000
#: Words that a task numbers together, super-k-mers that it merges, and windows of a bucket that it remembers, at most.
MOST_WORDS, MOST_HELD, MOST_SEEN = 400_000, 200_000, 500_000
#: Words left of the minimiser, and right of its start, that every window of the left or right half holds.
_LEFT, _RIGHT = 7, 14
_NO_ID = -(1 << 63)
_FACTORS = [np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1) | 1) & (1 << 64) - 1) for j in range(WINDOW)]


def minimisers(texts: list[list[bytes]], window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, windows, offset, minimiser) of the super-k-mers of some texts, given by their words.

    A super-k-mer is a longest stretch of windows of one text that share their minimiser, at the same place; offset is that
    place less start. A minimiser is the run of `run` words of least hash (40 bits of it) in the window, the first of them on a
    tie, so equal windows have equal ones at equal distances, and two windows of one super-k-mer are never equal. The texts
    have fewer than 2^24 words in all.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    n = int(sizes.sum())
    if n < window:
        return (np.empty(0, np.int64),) * 5
    c = np.fromiter(map(crc32, chain.from_iterable(texts)), dtype=np.uint64, count=n)
    h = np.zeros(n - run + 1, dtype=np.uint64)
    for j in range(run):
        h += (c[j : n - run + 1 + j] + np.uint64(1)) * _FACTORS[j]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    hashes, low = h, np.uint64(24)  # the low bits are the place, so that the first of equal hashes is the least
    h = h >> low << low | np.arange(len(h), dtype=np.uint64)
    span, width = window - run + 1, 1
    while 2 * width <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    if width < span:
        h = np.minimum(h[: len(h) - (span - width)], h[span - width :])
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(texts)), sizes)[: len(h)]
    at = np.flatnonzero(np.arange(len(h)) + window <= ends[of])  # windows that end in the text where they start
    if not len(at):
        return (np.empty(0, np.int64),) * 5
    h, of = h[at], of[at]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]))
    windows = np.diff(np.append(first, len(h)))
    place = (h[first] & np.uint64((1 << 24) - 1)).astype(np.int64)
    begin = (ends - sizes)[of[first]]
    return of[first], at[first] - begin, windows, place - at[first], hashes[place].view(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(doc, tie, text): null ids come first; tie, the text's hash, tells rows of equal id apart. Also whether there are none."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer, as documents are ordered by it")
    doc, text = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), text_or_empty(F.col(text_col))
    unique = docs.groupBy(doc.alias("doc")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return docs.select(doc.alias("doc"), (F.lit(0).cast("long") if unique else F.xxhash64(text)).alias("tie"), text.alias("text")), unique


def super_kmers(keyed: DataFrame) -> DataFrame:
    """(doc, tie, minimisers, places) of documents with a window, in a row or several; a place is start, windows and offset in one number."""

    def rows(ids: np.ndarray, ties: np.ndarray, held: list[tuple[int, int, list[bytes]]]) -> pa.RecordBatch:
        own, begin, texts = zip(*held, strict=True)
        of, start, windows, offset, least = minimisers(list(texts))
        cuts = pa.array(np.searchsorted(of, np.arange(len(held) + 1)), type=pa.int32())
        places = start + np.array(begin)[of] << 16 | windows << 8 | offset
        lists = [pa.ListArray.from_arrays(cuts, pa.array(c)) for c in (least, places)]
        return pa.RecordBatch.from_arrays([pa.array(ids[list(own)]), pa.array(ties[list(own)]), *lists], names=["doc", "tie", "minimisers", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held: list[tuple[int, int, list[bytes]]] = []
            size = 0
            for k, text in enumerate(batch.column(2)):
                words = text.as_py().encode().split()
                for start in range(0, len(words) - WINDOW + 1, MOST_WORDS):  # a very long text in pieces
                    held.append((k, start, words[start : start + MOST_WORDS + WINDOW - 1]))
                    size += len(held[-1][2])
                    if size >= MOST_WORDS:
                        yield rows(ids, ties, held)
                        held, size = [], 0
            if held:
                yield rows(ids, ties, held)

    return keyed.mapInArrow(run, "doc long, tie long, minimisers array<long>, places array<long>")


def _starts(words: list[bytes]) -> np.ndarray:
    """Where each word begins in the words joined by a space, and where a word after the last would."""
    return np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)])


def _pieces(start: int, windows: int, offset: int, parts: int, joined: bytes, at: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(part, start, words) of a super-k-mer: as it is, or for a large bucket its two halves.

    The windows that hold at least _LEFT words before the minimiser all hold those and it; the others hold _RIGHT words
    from its start on. Equal windows fall into the same half with the same such run, whose hash tells the part.
    """
    text = lambda a, b: joined[at[a] : at[b] - 1]
    if parts == 1:
        yield 0, start, text(start, start + windows + WINDOW - 1)
        return
    place, beyond = start + offset, start + windows
    middle = min(max(start, place - _LEFT + 1), beyond)
    if start < middle:
        yield 1 + crc32(text(place - _LEFT, place + RUN)) % parts, start, text(start, middle + WINDOW - 1)
    if middle < beyond:
        yield 1 + crc32(text(place, place + _RIGHT), 1) % parts, middle, text(middle, beyond + WINDOW - 1)


_PACKED = ["bucket", "part", "doc", "tie", "first", "beyond", "words"]
_TYPES = [*[pa.int64()] * 6, pa.binary()]


def _packed(joined: DataFrame) -> DataFrame:
    """(bucket, part, doc, tie, first, beyond, words) of (doc, tie, text, kmers): super-k-mers as packed strings, and the hash of
    their minimiser's words as their bucket.

    A task merges equal strings: the earliest travels, and for the others a row without words states that they are
    late, in ranges as long as they get. So a passage that a third of all documents share costs a bucket one string a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, int, int, int, int]] = {}
        out: list[tuple] = []

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal out
            for k in range(0, len(out), 20_000):
                columns = zip(*out[k : k + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, _TYPES, strict=True)], names=_PACKED)
            out = []

        def travel() -> Iterator[pa.RecordBatch]:
            for words, (doc, tie, first, bucket, part) in held.items():
                out.append((bucket, part, doc, tie, first, None, words))
                if len(out) == 20_000:
                    yield from rows()
            held.clear()
            yield from rows()

        for batch in batches:
            lists = batch.column(3)
            cuts, flat = lists.offsets.to_pylist(), lists.values
            place, parts = (flat.field(k).to_numpy() for k in range(2))
            for k, (doc, tie, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)):
                words = text.as_py().encode().split()
                joined, at = b" ".join(words), _starts(words)
                own = slice(cuts[k], cuts[k + 1])
                order = np.argsort(place[own])
                late, until = -1, -1  # a range that goes on
                for p, n in zip(place[own][order].tolist(), parts[own][order].tolist(), strict=True):
                    least = (p >> 16) + (p & 0xFF)
                    b = xxhash.xxh64_intdigest(joined[at[least] : at[least + RUN] - 1]) - (1 << 63)
                    for part, first, string in _pieces(p >> 16, p >> 8 & 0xFF, p & 0xFF, n, joined, at):
                        mine = (doc, tie, first, b, part)
                        other = held.setdefault(string, mine)
                        if other is mine:
                            continue
                        beyond = first + string.count(b" ") + 1
                        if other > mine:
                            held[string] = mine
                            out.append((other[0], -1, *other[:3], other[2] + beyond - first, None))
                        elif first <= until:
                            until = beyond
                        else:
                            if late >= 0:
                                out.append((doc, -1, doc, tie, late, until, None))
                            late, until = first, beyond
                if late >= 0:
                    out.append((doc, -1, doc, tie, late, until, None))
                if len(held) > MOST_HELD:
                    yield from travel()
            yield from rows()
        yield from travel()

    return joined.mapInArrow(run, "bucket long, part long, doc long, tie long, first long, beyond long, words binary")


def _windows(words: bytes) -> list[bytes]:
    ends = np.cumsum([len(w) + 1 for w in words.split(b" ")])
    starts = [0, *ends[: len(ends) - WINDOW].tolist()]
    return [words[a:b] for a, b in zip(starts, (ends[WINDOW - 1 :] - 1).tolist(), strict=True)]


_FOUND = ["kind", "doc", "tie", "first", "beyond"]


def _late_in_buckets(packed: DataFrame) -> DataFrame:
    """(kind, doc, tie, first, beyond): words covered by windows that start earlier as well, bucket by bucket.

    Sorted by document and place, the first window of each kind comes first, and so does the first super-k-mer, whose
    repeats need not be taken apart; nor need a bucket of one kind only. A task remembers at most MOST_SEEN
    windows of a bucket; the others pass with their words as `kind`, to be compared across tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, whole, seen, alone = None, set(), set(), None
        for batch in batches:
            out: list[tuple] = []
            for b, part, doc, tie, first, beyond, words in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if words is None:
                    out.append((None, doc, tie, first, beyond))
                    continue
                if (b, part) != bucket:
                    bucket, whole, seen, alone = (b, part), set(), set(), words
                    whole.add(words)
                    continue
                if words in whole:
                    out.append((None, doc, tie, first, first + words.count(b" ") + 1))
                    continue
                if alone is not None:
                    seen.update(_windows(alone))
                    alone = None
                full = len(seen) > MOST_SEEN
                if not full:
                    whole.add(words)
                begun, windows = -1, _windows(words)
                for k, window in enumerate(windows):
                    if window in seen:
                        begun = k if begun < 0 else begun
                        continue
                    if begun >= 0:
                        out.append((None, doc, tie, first + begun, first + k + WINDOW - 1))
                        begun = -1
                    if full:
                        out.append((window, doc, tie, first + k, first + k + WINDOW))
                    else:
                        seen.add(window)
                if begun >= 0:
                    out.append((None, doc, tie, first + begun, first + len(windows) + WINDOW - 1))
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, [pa.binary(), *[pa.int64()] * 4], strict=True)], names=_FOUND)

    dealt = packed.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "doc", "tie", "first")
    return dealt.mapInArrow(run, "kind binary, doc long, tie long, first long, beyond long")


def repeated_ranges(keyed: DataFrame) -> DataFrame:
    """(doc, tie, first, beyond) of words covered by windows that also start earlier; ranges may overlap. Rows are distinct documents.

    Only super-k-mers whose minimiser occurs again can hold such windows. Minimisers are counted first, without words;
    the words of the others, found by their documents, then travel packed to their bucket.
    """
    kmers = super_kmers(keyed)  # made twice, since stored they would take about half as much disk as the documents
    counted = kmers.select(F.explode("minimisers").alias("minimiser")).groupBy("minimiser").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = stored(counted, "minimisers")  # so that a hot minimiser is a skewed side of a join of two shuffles
    single = kmers.select("doc", "tie", F.explode(F.arrays_zip(F.col("minimisers").alias("minimiser"), F.col("places").alias("place"))).alias("x")).select("doc", "tie", "x.*")
    shared = single.join(counted, "minimiser").select("doc", "tie", F.struct("place", F.ceil(F.col("n") / LARGE_BUCKET).cast("int").alias("parts")).alias("kmer"))
    joined = keyed.join(shared.groupBy("doc", "tie").agg(F.collect_list("kmer").alias("kmers")), ["doc", "tie"])
    found = stored(_late_in_buckets(_packed(joined.select("doc", "tie", "text", "kmers"))), "repeats")
    ranges, open_ = found.where("kind IS NULL").drop("kind"), found.where("kind IS NOT NULL")
    if open_.isEmpty():
        return ranges
    earliest = open_.groupBy("kind").agg(F.min(F.struct("doc", "tie", "first")).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    late = open_.join(earliest, "kind").where(F.struct("doc", "tie", "first") != F.col("earliest"))
    return ranges.unionByName(late.select(*ranges.columns))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text), one row for each document; kept_text if with_text.

    Ids are integers of any size. Null texts count as empty. Documents of fewer than WINDOW words lose nothing; texts may
    be of any length. Null ids come before all others. Rows of equal id are documents of their own in the order of their
    texts' hashes; rows that repeat id and text stand at the same place, so neither repeats the other. An empty table gives
    an empty one, and columns other than the two named have no effect, whatever their names.
    """
    keyed, unique = _keyed(docs, id_col, text_col)
    by_doc = repeated_ranges(keyed if unique else keyed.dropDuplicates(["doc", "tie"])).groupBy("doc", "tie").agg(F.collect_list(F.struct("first", "beyond")).alias("ranges"))
    joined = keyed.join(by_doc, ["doc", "tie"], "left")
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, ranges in zip(*[batch.column(k) for k in range(3)], strict=True):
                words = text.as_py().encode().split()
                n = removed = len(words)
                if ranges.is_valid:
                    at, kept = 0, []
                    for first, beyond in sorted(zip(*(ranges.values.field(k).to_pylist() for k in range(2)), strict=True)):
                        kept += words[at:first]
                        at = max(at, beyond)
                    words = kept + words[at:]
                removed -= len(words)
                body = b" ".join(words)
                out.append((doc.as_py(), n, removed, hashlib.sha256(body).hexdigest(), *[body.decode()] * with_text))
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, [*[pa.int64()] * 3, *[pa.string()] * 2], strict=False)], names=names)

    done = joined.select("doc", "text", "ranges").mapInArrow(run, "doc long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    return done.select(F.nullif(F.col("doc"), F.lit(_NO_ID)).cast(kind).alias("doc_id"), *names[1:])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that earlier windows of WINDOW words repeat, counted, and the digest of the rest."""
    return drop_repeats(documents(spark, sf_dir), with_text=False)
