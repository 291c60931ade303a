"""Languages of spans: script ranges narrow the candidates, and Viterbi over words pays for each switch."""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgertide.llm.common import documents, stored
from ledgertide.llm.toxicity import held_out

#: Distinct texts of a language from which the model is learned, about; languages of more are thinned by the hash of the text.
FIT_PER_LANGUAGE = 3_000
#: Languages that a model can hold; more are refused.
MOST_LANGUAGES = 250
#: Counts of n-grams of letters that the model keeps at most, as many of each language, the largest; words stand between spaces.
MOST_COUNTS, GRAM_LENGTHS = 600_000, (2, 3)
SMOOTHING = 0.5
#: What a switch of language costs, in nats, and what one word can say at most for one language against another.
SWITCH, MOST_PER_WORD = 8.0, 6.0
#: A language is a candidate for a script that holds at least this share of its training words.
SCRIPT_SHARE = 0.001
UNKNOWN = "und"
#: Start of each Unicode range and its script (fixed values); ranges end where the next begins.
_SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)
_STARTS = [s for s, _ in _SCRIPTS]
#: Words times languages whose scores a worker remembers, and words that it labels together.
_MOST_CELLS, _CHUNK_WORDS = 12_000_000, 300_000
#: Texts of more letters are labelled in stretches of STRETCH_WORDS words, of which one is held at a time.
LONG_TEXT, STRETCH_WORDS = 2_000_000, 100_000
#: The score of a language that the script of a word rules out.
_BARRED = np.float32(-1e6)


#: Word characters but for digits and underscores: letters, and a few numerals such as fractions.
_WORD = re.compile(r"[^\W\d_]+")


def script(word: str) -> str:
    k = bisect.bisect_right(_STARTS, ord(word[0])) - 1
    return _SCRIPTS[k][1] if k >= 0 else "other"


def _of_letters(found: list[str]) -> list[str]:
    """The runs of letters in runs of word characters."""
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in ((run,) if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def words(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return _of_letters(_WORD.findall(text.lower())) if text else []


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in GRAM_LENGTHS for i in range(len(w) - n + 1) if n > 1 or w[i] != " "]


class Model:
    """Log-probabilities of n-grams by language, and the languages of each script. Only the counts that were learned are stored: what an
    n-gram has in a language beyond one that the language lacks, and for each length what such a one has."""

    def __init__(self, counts: list[tuple[str, str, int]], scripts: list[tuple[str, str, int]]):
        self.langs = sorted({lang for lang, _, _ in scripts})
        at = {lang: k for k, lang in enumerate(self.langs)}
        totals = np.zeros((max(GRAM_LENGTHS) + 1, len(self.langs)))
        for lang, g, n in counts:
            totals[len(g), at[lang]] += n
        self.grams = {g: k for k, g in enumerate(sorted({g for _, g, _ in counts}))}
        kinds = Counter(map(len, self.grams))
        self.lacking = np.array([np.log(SMOOTHING / (t + SMOOTHING * max(1, kinds[n]))) for n, t in enumerate(totals)], dtype=np.float32)
        order = sorted((self.grams[g], at[lang], n) for lang, g, n in counts)
        number = np.fromiter((k for k, _, _ in order), dtype=np.int64, count=len(order))
        self.begin = np.searchsorted(number, np.arange(len(self.grams) + 1))
        self.lang = np.fromiter((k for _, k, _ in order), dtype=np.uint8, count=len(order))
        self.more = np.fromiter((math.log((n + SMOOTHING) / SMOOTHING) for _, _, n in order), dtype=np.float32, count=len(order))
        self.length = np.fromiter(map(len, sorted(self.grams)), dtype=np.uint8, count=len(self.grams))
        own: dict[str, Counter] = {}
        for lang, s, n in scripts:
            own.setdefault(lang, Counter())[s] += n
        names = {s for c in own.values() for s in c}
        self.allowed = {s: np.array([own[lang][s] >= SCRIPT_SHARE * sum(own[lang].values()) for lang in self.langs]) for s in names}

    def sums(self, new: list[str]) -> np.ndarray:
        """The sums over the n-grams of each word that any language has, by language."""
        out = np.zeros((len(new), len(self.langs)), dtype=np.float32)
        get = self.grams.get
        parts = [[k for g in grams(w) if (k := get(g)) is not None] for w in new]
        word = np.repeat(np.arange(len(new)), [len(p) for p in parts])
        gram = np.fromiter(chain.from_iterable(parts), dtype=np.int64, count=len(word))
        for n in GRAM_LENGTHS:
            out += np.bincount(word[self.length[gram] == n], minlength=len(new))[:, None].astype(np.float32) * self.lacking[n]
        size = self.begin[gram + 1] - self.begin[gram]
        entry = np.arange(int(size.sum())) + np.repeat(self.begin[gram] - np.cumsum(size) + size, size)
        cell = np.repeat(word, size) * len(self.langs) + self.lang[entry]
        return out + np.bincount(cell, weights=self.more[entry], minlength=out.size).reshape(out.shape).astype(np.float32)


class Labeller:
    """Scores words, which it remembers, and labels the spans of texts."""

    def __init__(self, model: Model):
        self.m = model
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, len(model.langs)), dtype=np.float32)
        self.most_known = max(10_000, _MOST_CELLS // max(1, len(model.langs)))

    def _score(self, new: list[str]) -> np.ndarray:
        """Log-odds of words by language: sums over their n-grams, within what one word may say for one candidate against
        another. Languages that the word's script rules out are no candidates."""
        s = self.m.sums(new) / len(GRAM_LENGTHS)
        kinds, barred = [script(w) for w in new], np.zeros(s.shape, dtype=bool)
        for name in set(kinds):
            allowed = self.m.allowed.get(name)
            if allowed is not None and allowed.any():
                barred[np.ix_(np.array([k == name for k in kinds]), ~allowed)] = True
        s[barred] = _BARRED
        s = np.maximum(s - s.max(axis=1)[:, None], -MOST_PER_WORD)
        s[barred] = _BARRED
        return s

    def _numbers(self, texts: list[list[str]]) -> np.ndarray:
        new = set().union(*texts).difference(self.known)
        if len(self.known) + len(new) > self.most_known:
            self.known.clear()
            new = set().union(*texts)
        if len(self.known) + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros((len(self.known) + 2 * len(new), self.scores.shape[1]), np.float32)])
        if new:
            at, new = len(self.known), sorted(new)
            for k in range(0, len(new), 20_000):
                part = new[k : k + 20_000]
                self.scores[at + k : at + k + len(part)] = self._score(part)
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), dtype=np.int64)

    def label(self, texts: list[list[str]]) -> list[tuple[str, float, str]]:
        """(language, score, spans) of each text, given by its words. All texts advance together, longest first."""
        if not self.m.langs:
            return [(UNKNOWN, 0.0, "")] * len(texts)
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(-sizes, kind="stable")
        seen = self._numbers([texts[k] for k in order])
        n = sizes[order]
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        active = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), side="left")  # texts with more than t words
        best = np.zeros((len(texts), len(self.m.langs)), dtype=np.float32)
        back = np.empty((len(seen), len(self.m.langs)), dtype=np.uint8)
        for t, a in enumerate(active.tolist()):
            at = begin[:a] + t
            best[:a], back[at] = self._step(best[:a], self.scores[seen[at]])
        path = np.empty(len(seen), dtype=np.uint8)
        state = best.argmax(axis=1)
        for t in range(len(active) - 1, -1, -1):
            a = int(active[t])
            at = begin[:a] + t
            path[at] = state[:a]
            state[:a] = back[at, state[:a]]
        out: list[tuple[str, float, str]] = [(UNKNOWN, 0.0, "")] * len(texts)
        for k, b, size in zip(order.tolist(), begin.tolist(), n.tolist(), strict=True):
            if size:
                out[k] = self._told(path[b : b + size])
        return out

    @staticmethod
    def _step(v: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best sums after one word more, and the language before it, of each row and language."""
        top = v.argmax(axis=1)
        other = v[np.arange(len(v)), top][:, None] - SWITCH
        stay = v >= other
        return np.where(stay, v, other) + scores, np.where(stay, np.arange(v.shape[1], dtype=np.uint8), top[:, None].astype(np.uint8))

    def _told(self, own: np.ndarray) -> tuple[str, float, str]:
        votes = np.bincount(own, minlength=len(self.m.langs))
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
        spans = ",".join(f"{x}-{y}:{self.m.langs[own[x]]}" for x, y in zip(cuts, cuts[1:], strict=False))
        top = int(votes.argmax())
        return self.m.langs[top], float(votes[top] / len(own)), spans

    def label_long(self, text: str) -> tuple[str, float, str]:
        """label() of one text by stretches: sums are kept where each begins, and what led there is found again on the way back, so
        scores and words of one stretch are held at a time."""
        if not self.m.langs:
            return UNKNOWN, 0.0, ""
        low = text.lower()
        stretches, best, begin, n = [], np.zeros((1, len(self.m.langs)), dtype=np.float32), 0, 0
        for k, found in enumerate(_WORD.finditer(low), 1):
            if k % STRETCH_WORDS == 0:
                stretches.append((begin, found.end()))
                begin = found.end()
        stretches.append((begin, len(low)))
        starts = []
        for s, e in stretches:
            starts.append(best)
            for row in self.scores[self._numbers([_of_letters(_WORD.findall(low, s, e))])]:
                best, _ = self._step(best, row)
        state, paths = int(best.argmax()), []
        for (s, e), v in zip(reversed(stretches), reversed(starts), strict=True):
            seen = self._numbers([_of_letters(_WORD.findall(low, s, e))])
            back = np.empty((len(seen), len(self.m.langs)), dtype=np.uint8)
            for t, row in enumerate(self.scores[seen]):
                v, back[t] = self._step(v, row)
            path = np.empty(len(seen), dtype=np.uint8)
            for t in range(len(seen) - 1, -1, -1):
                path[t] = state
                state = int(back[t, state])
            paths.append(path)
            n += len(path)
        return self._told(np.concatenate(paths[::-1])) if n else (UNKNOWN, 0.0, "")


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from labelled texts. Each language gives about FIT_PER_LANGUAGE of its distinct texts, those of the smallest
    hashes, so copies count once; of its counts of n-grams the largest are kept, as many for each language, MOST_COUNTS together, so
    one of few texts is not crowded out. Only they reach the driver."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.select("lang", F.xxhash64("text").alias("hash")).distinct().groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Model([], [])
    parts = 1 << 20
    share = F.element_at(F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(max(1, round(parts * min(1.0, FIT_PER_LANGUAGE / r["count"])))))]), F.col("lang"))
    picked = rows.where(F.pmod(F.xxhash64("text"), F.lit(parts)) < share).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                found.setdefault(lang.as_py(), Counter()).update(words(text.as_py()))
        for lang, own in found.items():
            out: Counter = Counter()
            for w, n in own.items():
                for g in grams(w):
                    out[g] += n
                out[f"script:{script(w)}"] += n
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), type=pa.string()), pa.array(list(out)), pa.array(list(out.values()), type=pa.int64())], names=["lang", "gram", "n"])

    counted = stored(picked.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-counts")
    is_script = F.col("gram").startswith("script:")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.where(~is_script).withColumn("nth", nth).where(F.col("nth") <= MOST_COUNTS // len(sizes))
    return Model([(r["lang"], r["gram"], r["n"]) for r in top.collect()], [(r["lang"], r["gram"].removeprefix("script:"), r["n"]) for r in counted.where(is_script).collect()])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans) for each row.

    spans lists stretches of words, numbered from 0 with ends exclusive, and their languages; lang_pred is the language
    of most words, the first by name on a tie, and score its share of them. Null texts and texts without a letter get
    "und" and 0, and so does every text where there was nothing to learn from. Texts may be of any length; repeated rows get
    repeated results; an empty table gives an empty one, and columns other than the two named have no effect.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_COUNTS and MOST_LANGUAGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            out: list[tuple[str, float, str]] = []
            held, size = [], 0
            for text in batch.column(1):
                if (t := text.as_py()) is not None and len(t) > LONG_TEXT:
                    out += [*(labeller.label(held) if held else []), labeller.label_long(t)]
                    held, size = [], 0
                    continue
                held.append(words(t))
                size += len(held[-1])
                if size >= _CHUNK_WORDS:
                    out += labeller.label(held)
                    held, size = [], 0
            if held:
                out += labeller.label(held)
            a, b, c = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(a), type=pa.string()), pa.array(list(b), type=pa.float64()), pa.array(list(c), type=pa.string())], names=["doc_id", "lang_pred", "score", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, spans string")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document's whole text; those with crc32(doc_id) mod 4 = 2 are held out from learning."""
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out(2, 4)))
    return identify(docs, model).select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score", "spans")
