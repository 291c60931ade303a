"""Candidates of near duplicates by shared rare runs, and the threshold of a matching ratio, against plain Python."""

import random
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pytest

from ledgertide.functions.ratios import reaches
from ledgertide.operators import near_pairs as N
from ledgertide.operators import registry_ops as R

ALPHABETS = ["ab", "abcdefghij ", "abcdefghijklmnopqrstuvwxyz .,", "".join(map(chr, range(33, 160))), "één twee漢字😀 abcdefgh"]


def edited(rng, text, times, letters):
    out = list(text)
    for _ in range(times):
        k = rng.randrange(len(out) + 1)
        if rng.random() < 0.5:
            out[k:k] = rng.choices(letters + "#", k=rng.choice([1, 3]))
        else:
            del out[k : k + rng.choice([1, 3])]
    return "".join(out)


def test_reaches_is_the_matcher():
    rng, reached = random.Random(3), 0
    for k in range(600):
        letters = ALPHABETS[k % len(ALPHABETS)]
        weights = [1 / (1 + i) ** rng.choice([0, 1, 2]) for i in range(len(letters))]
        a = "".join(rng.choices(letters, weights, k=rng.choice([0, 1, 50, 199, 200, 201, 400, 900])))
        b = edited(rng, a, rng.choice([0, 1, 2, 5, 20]), letters)
        a, b = rng.sample([a, b], 2)
        ratio = SequenceMatcher(None, a, b).ratio()
        for threshold in (0.97, 0.9, 0.5, ratio, min(1.0, ratio + 1e-9)):
            assert reaches(a, b, threshold) == (ratio >= threshold)
        reached += 0.5 < ratio < 1
    assert reached > 100


@pytest.mark.parametrize("threshold", [0.95, 0.97, 0.99])
@pytest.mark.parametrize("steps", [1, 16])
def test_texts_that_match_share_the_runs_they_need(threshold, steps):
    rng, run_of, matched, least = random.Random(5), N.run_lengths(threshold), 0, 0
    usual = np.random.default_rng(2).integers(0, steps, N.COUNTERS).astype(np.uint8)
    for k in range(300):
        letters = ALPHABETS[k % len(ALPHABETS)]
        size = rng.choice([20, 33, 34, 50, 51, 52, 70, 130, 400, 1500])
        a = "".join(rng.choices(letters, k=size)) if k % 3 else ("".join(rng.choices(letters, k=30)) * size)[:size]
        b = list(a)
        for place in rng.sample(range(size), int(size * (1 - threshold) / threshold)):  # one letter here and there, so that most runs are broken
            b[place] = ""
        b = "".join(b)
        if a == b or 2 * len(b) / (len(a) + len(b)) < threshold:
            continue
        run = run_of[1] if len(b) < run_of[2] else run_of[0]
        (x, need_x), (y, need_y) = (N.chosen(N.runs_of(N._letters(t), run), usual, len(t), run, threshold) for t in (a, b))
        assert len(np.unique(x)) == len(x) and min(need_x, need_y) >= 1
        shared = len(np.intersect1d(x, y))
        assert shared >= min(need_x, need_y)
        matched, least = matched + 1, max(least, min(need_x, need_y))
    assert matched > 60 and least > 1


def test_near_pairs_are_those_that_may_match(spark, monkeypatch):
    monkeypatch.setattr(N, "HELD_RUNS", 2000)
    monkeypatch.setattr(N, "HELD_PAIRS", 50)
    monkeypatch.setattr(N, "PART_RUNS", 4000)
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.choice([2, 4, 7]))) for _ in range(900)]
    line = " ".join(rng.choices(words, k=30))
    texts = [" ".join(rng.choices(words, k=k)) for k in [3, 5, 8, 9, 10, 11, 30, 100, 100, 100, 100, 1500, 1500] * 4]
    texts = list(dict.fromkeys(texts + [line + " " + t for t in texts[:30]] + [edited(rng, t, max(1, len(t) // 120), "abc") for t in texts for _ in range(2)] + ["漢字" * 200, "漢字" * 201, "", "a"]))
    rows = [(k, "2024-01-01" if k % 9 else "2024-01-02", str(k), ("s", f"r{k:04}"), len(t), t) for k, t in enumerate(texts)]
    classes = spark.createDataFrame(rows, "no long, event_date string, cls string, rank struct<source: string, record_id: string>, letters int, text string").repartition(3)
    got = {(int(r["later"]), int(r["earlier"])) for r in N.near_pairs(classes, 0.97).collect()}
    pairs = {(y, x) for x, y in combinations(range(len(texts)), 2) if rows[x][1] == rows[y][1]}
    want = {(y, x) for y, x in pairs if (m := SequenceMatcher(None, texts[y], texts[x])).real_quick_ratio() >= 0.97 and m.ratio() >= 0.97}
    assert want <= got <= pairs and len(want) > 20
    assert len(got) < 3 * len(texts) < len(pairs) / 10  # texts with a line in common don't meet


def test_near_dedup_compares_no_unlike_texts_and_takes_ratios_of_matches_alone(spark, tmp_path, monkeypatch):
    taken = tmp_path / "taken"

    class Counted(SequenceMatcher):
        def ratio(self):
            with taken.open("a") as f:
                f.write("x")
            return super().ratio()

    monkeypatch.setattr(R, "SequenceMatcher", Counted)
    monkeypatch.setattr(R, "_candidates", None)  # which compares all pairs of texts of one length
    rng = random.Random(9)
    base = "".join(rng.choices("abcdefgh ", k=1000))
    texts = [base + "q", base + "qq%", "q" + base + "q", "".join(rng.choices("abcdefgh ", k=1001))]  # the third's first q is matched with the first's last one
    rows = [(f"r{k}", "2024-01-01", "s", t) for k, t in enumerate(texts)]
    got = {r["record_id"]: r["blocked_by"] for r in R.near_dedup(spark.createDataFrame(rows, "record_id string, event_date string, source string, text string")).collect()}
    assert SequenceMatcher(None, texts[2], texts[0]).ratio() < 0.1
    assert got == {"r0": None, "r1": "r0", "r2": None, "r3": None} and taken.read_text() == "x"


def test_thresholds_that_need_short_runs_compare_all(spark):
    assert N.usable(0.97) and N.usable(0.96) and not N.usable(0.9) and not N.usable(1.0)
    rows = [(f"r{k}", "2024-01-01", "s", t) for k, t in enumerate(["abcdefghij" * 5, "abcdefghij" * 5 + "xxxxx", "klmnopqrst" * 5])]
    frame = spark.createDataFrame(rows, "record_id string, event_date string, source string, text string")
    assert {r["record_id"]: r["blocked_by"] for r in R.near_dedup(frame, 0.9).collect()} == {"r0": None, "r1": "r0", "r2": None}
