"""Near-duplicates across splits against all pairs."""

import random

import pytest

from ledgertide.operators import leakage as L


def shingle_set(text):
    w = [x for x in (text or "").split(" ") if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain(rows):
    out = []
    for rid, tag, text in rows:
        mine = shingle_set(text)
        if tag not in ("val", "test") or not mine:
            continue
        earlier = L.SPLITS[: L.SPLITS.index(tag)]
        near = [(other, len(mine & s) / len(mine | s)) for other, t, x in rows if t in earlier and (s := shingle_set(x)) and 100 * len(mine & s) >= 80 * len(mine | s)]
        if near:
            best = min(near)
            sims = {s for o, s in near if o == best[0]}
            out.append((rid, tag, best[0], round(max(sims) if len(sims) == 1 else best[1], 6)))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(300)}"
    passage = [word() for _ in range(50)]
    out = [("a0", "train", None), ("a1", "test", ""), ("a2", "val", "one two"), ("a3", "train", "one two"), ("a4", None, "one two"), ("a5", "other", "one two"), ("a6", "test", "one two"), ("a6", "test", "one two")]
    out += [("b0", "train", "la " * 4000), ("b1", "test", "la " * 90)]
    for g in range(14):
        base = [word() for _ in range(rng.choice([6, 30, 120]))]
        for k in range(rng.choice([2, 9])):
            text = [f"x{rng.randrange(99)}" if rng.random() < rng.choice([0, 0.01, 0.04]) else w for w in base] + (passage if g % 3 == 0 else [])
            out.append((f"r{rng.randrange(10**6):06d}", rng.choice(L.SPLITS), " ".join(text)))
    chain = [f"c{k}" for k in range(80)]
    out += [(f"z{k}", L.SPLITS[k % 3], " ".join(chain[3 * k : 3 * k + 60])) for k in range(6)]
    return out


@pytest.mark.parametrize("part", [L.PART_TEXTS, 1, 3])
def test_leaks_against_all_pairs(spark, rows, monkeypatch, part):
    monkeypatch.setattr(L, "PART_TEXTS", part)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "record_id string, split_tag string, text string, gram string, cls int").repartition(3)
    assert sorted(tuple(r) for r in L.cross_split(frame).collect()) == plain(rows)
    assert L.cross_split(frame.limit(0)).count() == 0


def test_a_group_of_copies_is_compared_once_a_text():
    """Later sets stop at their first similar earlier set, so a dense group costs its size and not its square."""
    import numpy as np

    base = np.arange(200)
    earlier, later = [np.append(base, 1000 + k) for k in range(300)], [np.append(base, 5000 + k) for k in range(300)]
    calls = []
    whole = np.intersect1d
    try:
        np.intersect1d = lambda *a, **k: calls.append(1) or whole(*a, **k)
        found = list(L.first_similar(later, earlier))
    finally:
        np.intersect1d = whole
    assert [(a, b) for a, b, _ in found] == [(k, 0) for k in range(300)] and len(calls) == 300


def test_components(spark):
    from ledgertide.operators.components import components

    edges = [(k, k + 1) for k in range(0, 50)] + [(100 + k, 100) for k in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(51)} | {k: 100 for k in range(100, 130)}


