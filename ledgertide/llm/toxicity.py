"""Toxicity by a learned lexicon: Levenshtein automata over its trie, and scores of the words around each hit."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.llm.common import documents, let, stored, text_or_empty, words_of

#: Documents from which the lexicon and the weights are learned, at most: those of the smallest hashes of their ids.
MOST_FIT = 12_000
#: Stems in the lexicon at most (the model's size), and their lengths.
MOST_TERMS, STEM_LENGTHS = 2_000, range(4, 9)
#: How many times as common among toxic documents as among others a term must be.
ENRICHED = 4
#: A term of at least so many letters may be misspelled by one edit.
FUZZY_LENGTH = 5
#: Words over which hits add up, and words that a quotation may have.
CONTEXT, QUOTATION = 10, 200
FEATURES = 6
#: Quotation marks, each with those that close it (fixed values).
_MARKS = {'"': '"', "'": "'", "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "‘": "’"}
_OPENS = re.compile(rf"[(\[*_]*([{''.join(_MARKS)}])")
_CLOSES = re.compile(rf"([{''.join(sorted(set(''.join(_MARKS.values()))))}])[)\].,;:!?*_]*$")
_EDGES = re.compile(r"^\W+|\W+$")
#: Digits and signs written for letters (fixed values).
_LEET = str.maketrans("013457@$", "oieastas")
_MOST_SEEN = 400_000


def plain(word: str) -> str:
    """Lower case, without punctuation at either end, and with look-alike digits read as letters."""
    word = _EDGES.sub("", word.lower())
    return word.translate(_LEET) if not word.isalpha() else word


class Trie:
    """The lexicon; match() finds the term that a word begins with, spelled exactly or within one edit."""

    def __init__(self, terms: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.term: list[int] = [0]  # length of the term that ends here
        self.heads, self.seconds = set(), set()
        for t in terms:
            at = 0
            for ch in t:
                if ch not in self.next[at]:
                    self.next[at][ch] = len(self.next)
                    self.next.append({})
                    self.term.append(0)
                at = self.next[at][ch]
            self.term[at] = len(t)
            self.heads.add(t[:2])
            self.seconds.add(t[2:4])

    def exact(self, word: str) -> bool:
        at = 0
        for ch in word:
            if self.term[at]:
                return True
            at = self.next[at].get(ch, -1)
            if at < 0:
                return False
        return bool(self.term[at])

    def fuzzy(self, word: str) -> bool:
        """Intersects the trie with the automaton of edits: its states are pairs (letters of the word read, edits).

        One edit leaves the first two letters of a term, or the next two, in place; words with neither are not tried.
        """
        if len(word) < FUZZY_LENGTH - 1:
            return False
        if word[:2] not in self.heads and not self.seconds & {word[2:4], word[3:5], word[1:3]}:
            return False
        todo = [(0, frozenset({(0, 0), (1, 1)}))]
        while todo:
            at, states = todo.pop()
            for ch, nxt in self.next[at].items():
                reached = set()
                for i, e in states:
                    if i < len(word) and word[i] == ch:
                        reached.add((i + 1, e))
                    if e == 0:
                        reached.add((i, 1))  # the word lacks the letter
                        reached.add((i + 1, 1))  # another letter stands for it
                for i, e in list(reached):
                    if e == 0:
                        reached.add((i + 1, 1))  # the word has a letter more
                reached = {(i, e) for i, e in reached if i <= len(word)}
                if not reached:
                    continue
                if self.term[nxt] >= FUZZY_LENGTH:
                    return True
                todo.append((nxt, frozenset(reached)))
        return False


def quotations(words: list[str]) -> list[tuple[int, int]]:
    """(first, last) words of the quotations: from a word that begins with a mark to the next one that ends with its counterpart,
    QUOTATION words at most. A mark that is not closed so quotes nothing."""
    found, begun, closing = [], -1, ""
    for k, w in enumerate(words):
        if w.isalnum():
            continue
        if (begun < 0 or k - begun >= QUOTATION) and (m := _OPENS.match(w)):
            begun, closing = k, _MARKS[m[1]]
            if m.end() == len(w):  # the mark stands alone
                continue
        if begun >= 0 and (m := _CLOSES.search(w)) and m[1] in closing:
            found.append((begun, k))
            begun = -1
    return found


class Scorer:
    """Features of texts; remembers which words hit, up to _MOST_SEEN of either kind."""

    def __init__(self, terms: Iterable[str]):
        self.trie = Trie(terms)
        self.hits: dict[str, int] = {}
        self.missed: set[str] = set()

    def _look_up(self, words: set[str]) -> None:
        for w in words:
            p = plain(w)
            if self.trie.exact(p):
                self.hits[w] = 1
            elif self.trie.fuzzy(p):
                self.hits[w] = 2
            else:
                self.missed.add(w)

    def features(self, text: str) -> list[float]:
        words = text.split()
        kinds = set(words)
        if len(self.missed) > _MOST_SEEN or len(self.hits) > _MOST_SEEN:
            self.missed.clear()
            self.hits.clear()
        self._look_up((kinds - self.missed).difference(self.hits))
        if not (kinds := kinds.intersection(self.hits)):
            return [1.0] + [0.0] * (FEATURES - 1)
        at = [k for k, w in enumerate(words) if w in kinds]
        exact = fuzzy = quoted = 0
        loud, inside = [], set()
        for first, last in quotations(words):
            inside.update(range(first, last + 1))
        for k in at:
            if k in inside:
                quoted += 1
                continue
            loud.append(k)
            if self.hits[words[k]] == 1:
                exact += 1
            else:
                fuzzy += 1
        window, most = 0, 0
        for j, k in enumerate(loud):
            while loud[window] < k - CONTEXT:
                window += 1
            most = max(most, j - window + 1)
        return [1.0, float(exact > 0) + math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(most), math.log1p(100 * (exact + fuzzy) / len(words))]


def stems(text: str) -> set[str]:
    found = set()
    for w in set(text.split()):
        p = plain(w)
        if p.isalpha():
            found.update(p[:n] for n in STEM_LENGTHS if len(p) >= n)
    return found


def _near_copy_key(text: Column, seed: int) -> Column:
    """The least hash of runs of five words: copies, and mostly near copies, share it."""
    runs = lambda w: F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 5, F.lit(0))), lambda i: F.xxhash64(F.lit(seed), *[F.get(w, i + k) for k in range(5)])))
    return let(words_of(text), runs)


def _without_copies(texts: DataFrame) -> DataFrame:
    """One of each group of near copies, so that the words of a much copied document don't pass for common ones."""
    keyed = texts.select("text", "y", *[_near_copy_key(F.col("text"), k).alias(f"copy_{k}") for k in range(4)])
    for k in range(4):
        keyed = keyed.dropDuplicates([f"copy_{k}"])
    return keyed.select("text", "y")


def choose_terms(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> list[str]:
    """Stems that toxic documents hold far more often; of one family the longest stem that covers it all."""
    rate = n_toxic / max(1, n_toxic + n_clean)
    if not 0 < rate < 1:
        return []
    least = math.log(max(2, len(counts))) + 2
    toxic = {s: t for s, t, _ in counts}

    def weight(t: int, c: int) -> float:
        return t * math.log(t / (t + c) / rate) + (c * math.log(c / (t + c) / (1 - rate)) if c else 0.0)

    good = sorted(((weight(t, c), s) for s, t, c in counts if t * n_clean > ENRICHED * c * n_toxic and t > 0), reverse=True)
    chosen: list[str] = []
    longer: dict[str, list[str]] = {}
    for s in toxic:
        longer.setdefault(s[:-1], []).append(s)
    for w, s in good:
        if w < least or len(chosen) == MOST_TERMS:
            break
        if any(s.startswith(c) or c.startswith(s) for c in chosen):
            continue
        while best := max(longer.get(s, []), key=toxic.get, default=None):
            if toxic[best] < 0.98 * toxic[s]:
                break
            s = best
        chosen.append(s)
    return sorted(chosen)


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], list[float]]:
    """(terms, weights) from labelled documents; of more than MOST_FIT, those of the smallest hashes of their ids.

    What reaches the driver is bounded by that sample: stems that pass a threshold, and the features of its documents.
    Without labelled documents of both kinds there are no terms, and every score is the same: near 0 or 1 where all have one label, and 0.5 where there
    is none. Null ids and labels are left out; of repeated labels of an id the highest counts.
    """
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_FIT)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    fitted = stored(_without_copies(texts.join(F.broadcast(sample), "doc_id")), "toxicity-fit")
    sizes = {r["y"]: r["count"] for r in fitted.groupBy("y").count().collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1), strict=True):
                found[y.as_py()].update(stems(text.as_py()))
        for y, c in found.items():
            if c:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array(list(c.values()) if y else [0] * len(c), type=pa.int64()), pa.array([0] * len(c) if y else list(c.values()), type=pa.int64())], names=["stem", "t", "c"])

    counted = fitted.mapInArrow(count, "stem string, t long, c long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(f"t >= 3 AND t * {sizes.get(0, 0)} > {ENRICHED} * c * {sizes.get(1, 0)}")
    kept = [(r["stem"], r["t"], r["c"]) for r in counted.orderBy("stem").collect()]
    terms = choose_terms(kept, sizes.get(1, 0), sizes.get(0, 0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([scorer.features(t.as_py()) for t in batch.column(0)], type=pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    rows = fitted.mapInArrow(measure, "x array<double>, y int").collect()
    x = np.array([r["x"] for r in rows]).reshape(-1, FEATURES)
    return terms, fit_weights(x, np.array([r["y"] for r in rows], dtype=float)).tolist()


def score(docs: DataFrame, model: tuple[list[str], list[float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, hits) for each row, hits telling whether any term was found.

    Null and empty texts get the score of a text without hits. Texts may be of any length; repeated rows get repeated
    results; an empty table gives an empty one, and columns other than the two named have no effect.
    """
    terms, weights = model
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, w = Scorer(terms), np.array(weights)
        for batch in batches:
            x = np.array([scorer.features(t.as_py()) for t in batch.column(1)]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))), pa.array(x[:, 1:4].any(axis=1))], names=["doc_id", "score", "hits"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, hits boolean")


def held_out(fold: int, folds: int, doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each document; those with crc32(doc_id) mod 5 = 0 are held out from learning."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(0, 5))
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out(0, 5).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
