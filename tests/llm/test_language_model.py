"""The language model and its labels against plain Python, over the whole table and on long texts."""

import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgertide.llm import language_id as L
from ledgertide.llm import registry


def plain_words(text):
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()


def plain_model(rows):
    """lang -> its counts of n-grams, and script -> the languages that may have words of it."""
    counts, scripts = defaultdict(Counter), defaultdict(Counter)
    for text, lang in {(t, g) for t, g in rows if t is not None and g is not None}:
        for w in plain_words(text):
            scripts[lang][L.script(w)] += 1
            counts[lang].update(L.grams(w))
    allowed = {s: {g for g, c in scripts.items() if c[s] >= L.SCRIPT_SHARE * sum(c.values())} for s in {s for c in scripts.values() for s in c}}
    return {g: counts[g] for g in scripts}, allowed


def plain_scores(counts, allowed, word, kinds):
    langs = sorted(counts)
    known = [g for g in L.grams(word) if any(g in c for c in counts.values())]
    total = {(lang, n): sum(v for g, v in counts[lang].items() if len(g) == n) for lang in langs for n in L.GRAM_LENGTHS}
    may = {g for g in langs if g in allowed.get(L.script(word), set())} or set(langs)
    s = {g: sum(math.log((counts[g][x] + L.SMOOTHING) / (total[g, len(x)] + L.SMOOTHING * kinds[len(x)])) for x in known) / len(L.GRAM_LENGTHS) for g in langs}
    top = max(s[g] for g in may)
    return np.array([max(s[g] - top, -L.MOST_PER_WORD) if g in may else float(L._BARRED) for g in langs])


def value(scores, path):
    return sum(scores[t][k] for t, k in enumerate(path)) - L.SWITCH * sum(a != b for a, b in zip(path, path[1:], strict=False))


def best_value(scores):
    best = scores[0].copy()
    for s in scores[1:]:
        best = np.maximum(best, best.max() - L.SWITCH) + s
    return best.max()


def test_op4_against_a_plain_model(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in table}
    counts, allowed = plain_model([(r.text, r.lang) for r in table if not held[r.doc_id]])
    assert max(len([r for r in table if r.lang == g]) for g in counts) <= L.FIT_PER_LANGUAGE and sum(map(len, counts.values())) <= L.MOST_COUNTS
    langs, kinds = sorted(counts), Counter(len(g) for g in set().union(*counts.values()))
    totals = {}
    got = {r.doc_id: r for r in registry.queries()["op4_language_id"](spark, sf).collect()}
    assert len(got) == len(table)
    for r in table:
        w, mine = plain_words(r.text), got[r.doc_id]
        if not w:
            assert (mine.lang_pred, mine.score) == ("und", 0.0)
            continue
        for x in set(w) - totals.keys():
            totals[x] = None
        scores = []
        for x in w:
            if totals[x] is None:
                totals[x] = plain_scores(counts, allowed, x, kinds)
            scores.append(totals[x])
        path = []
        for span in mine.spans.split(","):
            where, lang = span.split(":")
            begin, end = map(int, where.split("-"))
            assert begin == len(path)
            path += [langs.index(lang)] * (end - begin)
        assert len(path) == len(w)
        assert value(scores, path) == pytest.approx(best_value(scores), abs=1e-2 + 1e-5 * len(w))  # single precision against double
        votes = Counter(path)
        assert mine.lang_pred == langs[min(votes, key=lambda k: (-votes[k], k))] and mine.score == pytest.approx(max(votes.values()) / len(w))


def small_model(spark, more=()):
    rows = [(k, "the cat sits with the dog there" if k % 2 else "le chat est avec un chien ici", "en" if k % 2 else "fr") for k in range(60)]
    return L.fit(spark.createDataFrame([*rows, *more], "doc_id long, text string, lang string"))


@pytest.mark.parametrize("stretch", [1, 2, 7, 100_000])
def test_long_texts_are_labelled_like_others(spark, monkeypatch, stretch):
    monkeypatch.setattr(L, "STRETCH_WORDS", stretch)
    lab = L.Labeller(small_model(spark))
    rng = np.random.default_rng(2)
    parts = ["the cat sits with the dog", "le chat est avec un chien", "½ x²y 12 --", "Ünïcode", "dog chien"]
    texts = [" ".join(parts[k] for k in rng.integers(0, 5, n)) for n in (1, 3, 60)] + ["", "12 ½"]
    assert [lab.label_long(t) for t in texts] == lab.label([L.words(t) for t in texts])


def test_a_very_long_text_among_others(spark, monkeypatch):
    monkeypatch.setattr(L, "LONG_TEXT", 1000)
    monkeypatch.setattr(L, "STRETCH_WORDS", 5000)
    long = "the cat sits with the dog there " * 4000 + "le chat est avec un chien ici " * 4000
    rows = [(1, "le chat"), (2, long), (3, None), (4, "the dog"), (5, long)]
    got = L.identify(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), small_model(spark)).collect()
    assert [(r.doc_id, r.lang_pred) for r in got] == [(1, "fr"), (2, "en"), (3, "und"), (4, "en"), (5, "en")]
    assert got[1].spans == "0-28000:en,28000-56000:fr" == got[4].spans


def test_a_rare_language_keeps_its_counts(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_COUNTS", 60)
    model = small_model(spark, [(k, "zorg blix quav", "qq") for k in (900,)])
    assert model.langs == ["en", "fr", "qq"]
    assert L.Labeller(model).label([L.words("zorg quav blix zorg")])[0][0] == "qq"
    assert all(len(model.lang[model.lang == k]) <= 20 for k in range(3))


def test_words_are_runs_of_letters():
    odd = [c for c in map(chr, range(0x2FFFF)) if unicodedata.category(c)[0] in "LNM"]
    for at in range(0, len(odd), 997):
        text = "ab".join(odd[at : at + 997])
        runs = "".join(c if c.isalpha() else " " for c in text.lower() if c.isalpha() or not c.isspace()).split()
        assert L.words(text) == runs
