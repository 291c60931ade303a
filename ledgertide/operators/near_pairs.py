"""Pairs of texts that may be nearly the same, by runs of letters that one of the two would have lost otherwise."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters of runs of letters, by a hash of them; they tell usual runs from rare ones, and are what the driver holds.
COUNTERS = 1 << 22
#: Counters that are added up in one group.
SEGMENT = 1 << 16
#: Runs that are sorted in one task, about, parts at least where each has so many letters, and runs that a task holds before it hands them on.
PART_RUNS, LEAST_PARTS, PART_LETTERS, HELD_RUNS = 6_000_000, 96, 500_000, 4_000_000
#: Pairs that a task holds before equal ones are added up.
HELD_PAIRS = 6_000_000
#: The shortest run that is worth looking for; lower thresholds, which would need shorter ones, are left to other ways.
LEAST_RUN = 5
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _edits(threshold: float) -> float:
    """Unmatched letters of two texts, both together, for each letter of one of them, at most: M matched letters are 2 M / (a + b) >= threshold, and M is at
    most the lesser length, so a + b is at most 2 a / threshold."""
    return 2 * (1 - threshold) / threshold


def run_lengths(threshold: float) -> tuple[int, int, int]:
    """(run, short, long from): runs of texts of `long from` letters or more, and of shorter ones. A text of n letters has n // run runs that do not
    overlap, and these are more than there are unmatched letters."""
    each = _edits(threshold)
    run, short = math.floor(0.82 / each), math.floor(0.5 / each)
    enough = math.ceil(2 / (1 / run - each))
    return run, short, 1 + max((n for n in range(enough) if n // run <= math.floor(n * each + 1e-6)), default=0)


def usable(threshold: float) -> bool:
    return threshold < 1 and math.floor(0.5 / _edits(threshold)) >= LEAST_RUN


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def runs_of(letters: np.ndarray, run: int) -> np.ndarray:
    """A hash of the run of letters that begins at each place, put together from runs of 1, 2, 4, ... letters."""
    n, out, have, width = len(letters), None, 0, 1
    if n < run:
        return np.zeros(0, dtype=np.uint64)
    part = (letters + np.uint64(1)) * _ODD
    part ^= part >> np.uint64(29)
    while width <= run:
        if run & width:
            if out is None:
                out = part
            else:
                size = n - have - width + 1
                out = out[:size] * _MIX + part[have : have + size]
                out ^= out >> np.uint64(31)
            have += width
        if 2 * width <= run:
            part = (part[: len(part) - width] * _MIX + part[width:]) * _ODD
            part ^= part >> np.uint64(32)
        width *= 2
    out = out * _ODD
    return out ^ (out >> np.uint64(29))


def _counter(runs: np.ndarray) -> np.ndarray:
    return (runs & np.uint64(COUNTERS - 1)).astype(np.int64)


def apart(places: np.ndarray, run: int) -> int:
    """How many of the runs at these places, in order, do not overlap, at most."""
    after, k, n = np.searchsorted(places, places + run).tolist(), 0, 0
    while k < len(after):
        k, n = after[k], n + 1
    return n


def chosen(runs: np.ndarray, usual: np.ndarray, letters: int, run: int, threshold: float) -> tuple[np.ndarray, int]:
    """(runs, need): the rarest runs of a text by an order that all texts share, and how many of them it shares with any text that it matches.

    An unmatched letter of either text breaks one at most of runs that do not overlap. So runs are taken in the order until there are U + need
    of those, U being the most unmatched letters. Of two matching texts, let A be the one whose last run stands earlier in the order: need of A's are in the other
    text too, and as they stand before its last run, they were taken there. Repeats of a run in a text are told apart by counting.
    """
    most = math.floor(letters * _edits(threshold) + 1e-6)
    order = (usual[_counter(runs)].astype(np.uint64) << np.uint64(60)) | (runs >> np.uint64(4))
    goal = most + 1 + max(0, letters // run - most - 1) // 3
    share = 1 / max(1.0, letters / goal - run + 1)
    while True:
        k = min(len(order) - 1, int(share * len(order)))
        places = np.flatnonzero(order <= np.partition(order, k)[k])
        found = apart(places, run)
        if found >= goal or k == len(order) - 1:
            break
        share *= max(1.06, 1 + 0.4 * (goal - found) / goal)
    taken = np.sort(runs[places])
    first = np.flatnonzero(np.concatenate(([True], taken[1:] != taken[:-1])))
    nth = np.arange(len(taken)) - np.repeat(first, np.diff(np.append(first, len(taken))))
    return taken + nth.astype(np.uint64) * _MIX, min(found, goal) - most


def _usual(classes: DataFrame, run: int, letters: int) -> np.ndarray:
    """How usual the runs of each counter are, in 16 steps: only the order of runs rests on it, so counters may be shared by chance."""
    mean = letters / COUNTERS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, held, size = np.zeros(COUNTERS, dtype=np.int64), [], 0
        for batch in batches:
            for text in batch["text"]:
                held.append(_counter(runs_of(_letters(text), run)))
                size += len(held[-1])
                if size > 2_000_000:
                    counts += np.bincount(np.concatenate(held), minlength=COUNTERS)
                    held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=COUNTERS)
        if counts.any():
            yield pd.DataFrame({"segment": range(0, COUNTERS, SEGMENT), "counts": [counts[k : k + SEGMENT].astype(np.int32).tobytes() for k in range(0, COUNTERS, SEGMENT)]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in group["counts"])
        over = (total - mean - 6 * math.sqrt(mean)) / 8
        steps = np.clip(np.ceil(np.log2(np.maximum(over, 1))), 0, 15).astype(np.uint8)
        return pd.DataFrame({"segment": group["segment"].iloc[:1], "steps": [steps.tobytes()]})

    usual = np.zeros(COUNTERS, dtype=np.uint8)
    for row in classes.select("text").mapInPandas(count, "segment int, counts binary").groupBy("segment").applyInPandas(add, "segment int, steps binary").toLocalIterator():
        usual[row["segment"] : row["segment"] + SEGMENT] = np.frombuffer(row["steps"], dtype=np.uint8)
    return usual


def _dealt(classes: DataFrame, run: int, usual: np.ndarray, parts: int, threshold: float) -> DataFrame:
    """The chosen runs of texts, packed: for each part, the runs of many texts, one text after another."""
    sent = classes.sparkSession.sparkContext.broadcast(usual)

    def hand_on(held: list[tuple[int, int, int, np.ndarray]]) -> pd.DataFrame:
        keys, of = np.concatenate([h[3] for h in held]), np.repeat(np.arange(len(held), dtype=np.int32), [len(h[3]) for h in held])
        part = ((keys >> np.uint64(32)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        keys, of, part = keys[order].astype(np.uint32), of[order], part[order]
        nos, letters, needs = (np.array([h[k] for h in held], dtype=t) for k, t in ((0, np.int64), (1, np.int32), (2, np.int32)))
        rows, ends = [], np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part))
        for begin, end in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
            mine = of[begin:end]
            first = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
            text, times = mine[first], np.diff(np.append(first, len(mine))).astype(np.int32)
            rows.append((int(part[begin]), keys[begin:end].tobytes(), nos[text].tobytes(), letters[text].tobytes(), needs[text].tobytes(), times.tobytes()))
        return pd.DataFrame(rows, columns=["part", "runs", "nos", "letters", "needs", "times"])

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for no, text in zip(batch["no"], batch["text"], strict=True):
                if math.floor(len(text) * _edits(threshold) + 1e-6) < 1:
                    continue  # only an equal text matches
                taken, need = chosen(runs_of(_letters(text), run), sent.value, len(text), run, threshold)
                held.append((no, len(text), need, taken))
                size += len(taken)
                if size > HELD_RUNS:
                    yield hand_on(held)
                    held, size = [], 0
        if held:
            yield hand_on(held)

    return classes.select("no", "text").mapInPandas(take, "part int, runs binary, nos binary, letters binary, needs binary, times binary")


class _Pairs:
    """Counts of pairs of texts, added up now and then and handed on before they are too many."""

    def __init__(self, nos: np.ndarray, letters: np.ndarray, needs: np.ndarray, threshold: float, parts: int) -> None:
        self.parts = parts
        self.nos, self.letters, self.needs, self.most = nos, letters.astype(np.int64), needs, (2 - threshold) / threshold
        self.known, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.held, self.size = [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[pd.DataFrame]:
        lesser, larger = np.minimum(self.letters[a], self.letters[b]), np.maximum(self.letters[a], self.letters[b])
        near = (larger <= lesser * self.most + 1e-6) & (a != b)
        a, b = a[near].astype(np.int64), b[near].astype(np.int64)
        self.held.append(np.minimum(a, b) * len(self.nos) + np.maximum(a, b))
        self.size += len(a)
        if self.size > HELD_PAIRS:
            self.settle()
            if len(self.known) > HELD_PAIRS:
                yield from self.hand_on()

    def settle(self) -> None:
        new, counts = np.unique(np.concatenate([*self.held, np.zeros(0, dtype=np.int64)]), return_counts=True)
        keys, where = np.unique(np.concatenate((self.known, new)), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate((self.counts, counts)), minlength=len(keys)).astype(np.int64)
        self.known, self.counts, self.held, self.size = keys, total, [], 0

    def hand_on(self) -> Iterator[pd.DataFrame]:
        """Packed, by a hash of the pair."""
        self.settle()
        if len(self.known):
            a, b = np.divmod(self.known, len(self.nos))
            need, bucket = np.minimum(self.needs[a], self.needs[b]), (self.nos[a].astype(np.uint64) * _ODD + self.nos[b].astype(np.uint64)) * _MIX
            bucket = ((bucket >> np.uint64(32)) % np.uint64(self.parts)).astype(np.uint16 if self.parts <= 1 << 16 else np.int64)
            order = np.argsort(bucket, kind="stable")
            columns, bucket = (self.nos[a[order]], self.nos[b[order]], need[order], self.counts[order]), bucket[order]
            ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
            rows = [(int(bucket[x]), *(c[x:y].tobytes() for c in columns)) for x, y in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=["bucket", "a", "b", "need", "shared"])
        self.known, self.counts = self.known[:0], self.counts[:0]


def _enough(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b) of the pairs that share as many runs as they need, of packed counts."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for bucket, *row in batch.itertuples(index=False, name=None):
            held.setdefault(bucket, []).append(row)
    for bucket in list(held):
        a, b, need, shared = (np.frombuffer(b"".join(x), dtype=t) for x, t in zip(zip(*held.pop(bucket), strict=True), (np.int64, np.int64, np.int32, np.int64), strict=True))
        known_a, at_a = np.unique(a, return_inverse=True)
        known_b, at_b = np.unique(b, return_inverse=True)
        pairs, first, at = np.unique(at_a * len(known_b) + at_b, return_index=True, return_inverse=True)
        kept = pairs[np.bincount(at, weights=shared, minlength=len(pairs)) >= need[first]]
        if len(kept):
            x, y = np.divmod(kept, len(known_b))
            yield pd.DataFrame({"a": known_a[x], "b": known_b[y]})


def _met(rows: list[pd.DataFrame], threshold: float, parts: int) -> Iterator[pd.DataFrame]:
    """(bucket, a, b, need, shared): counts of the runs of a part that two texts share."""
    joined = lambda c, t: np.frombuffer(b"".join(x for r in rows for x in r[c]), dtype=t)
    nos, at, inverse = np.unique(joined("nos", np.int64), return_index=True, return_inverse=True)
    runs, texts = joined("runs", np.uint32), np.repeat(inverse.astype(np.int32), joined("times", np.int32))
    order = np.argsort(runs, kind="stable")
    runs, texts = runs[order], texts[order]
    first = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1])))
    many = np.diff(np.append(first, len(runs)))
    pairs = _Pairs(nos, joined("letters", np.int32)[at], joined("needs", np.int32)[at], threshold, parts)
    for size in np.unique(many[many > 1]).tolist():
        begins = first[many == size]
        if size <= 1000:
            i, j = np.triu_indices(size, 1)
            step = max(1, 2_000_000 // len(i))
            for s in range(0, len(begins), step):
                some = texts[begins[s : s + step, None] + np.arange(size)]
                yield from pairs.add(some[:, i].ravel(), some[:, j].ravel())
            continue
        for begin in begins.tolist():
            some = texts[begin : begin + size]
            some = some[np.argsort(pairs.letters[some], kind="stable")]
            ends = np.searchsorted(pairs.letters[some], pairs.letters[some] * pairs.most + 1e-6, side="right")
            for k, end in enumerate(ends.tolist()):
                yield from pairs.add(np.broadcast_to(some[k], end - k - 1), some[k + 1 : end])
    yield from pairs.hand_on()


def near_pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """(later, earlier), the texts of one date whose matching ratio may reach the threshold, of classes (no, event_date, cls, rank, letters, text).

    Each text hands on its rarest runs of letters, as many as a text that matches must share some of (see `chosen`), and texts that share enough of
    them are candidates. Work grows with the letters and with the texts that share rare runs, not with the pairs of texts.
    """
    run, short, long_from = run_lengths(threshold)

    def shared(run: int, some: DataFrame) -> DataFrame:
        letters = some.agg(F.sum("letters")).first()[0] or 0
        parts = max(1, min(LEAST_PARTS, math.ceil(letters / PART_LETTERS)), math.ceil(letters * 0.4 / PART_RUNS))

        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            of: dict[int, list[pd.DataFrame]] = {}
            for batch in batches:
                for part, rows in batch.groupby("part"):
                    of.setdefault(part, []).append(rows)
            for part in list(of):
                yield from _met(of.pop(part), threshold, parts)

        met = _dealt(some, run, _usual(some, run, letters), parts, threshold).repartitionById(parts, "part").mapInPandas(meet, "bucket int, a binary, b binary, need binary, shared binary")
        return met.repartitionById(parts, "bucket").mapInPandas(_enough, "a long, b long")

    # pairs whose lesser text is short meet by short runs, others by long ones
    size, some = F.col("letters"), classes.select("no", "letters", "text")
    both = shared(short, some.where(size < math.ceil(long_from * (2 - threshold) / threshold) + 1)).unionByName(shared(run, some.where(size >= long_from))).distinct()
    head = lambda side: classes.select(F.col("no").alias(side), F.struct("event_date", F.col("rank.source").alias("source"), F.col("rank.record_id").alias("record_id"), "cls").alias(f"head_{side}"))
    known = both.join(head("a"), "a").join(head("b"), "b").where("head_a.event_date = head_b.event_date")
    return known.select(F.greatest("head_a", "head_b")["cls"].alias("later"), F.least("head_a", "head_b")["cls"].alias("earlier"))
