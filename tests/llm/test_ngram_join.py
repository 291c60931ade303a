"""Links of n-gram sets against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from ledgertide.llm import ngram_join as N
from ledgertide.llm import registry


def plain_set(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + N.SIZE]) for i in range(max(1, len(w) - N.SIZE + 1))) if w else frozenset()


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 85 * len(a | b)


def plain(rows):
    """Sorted (doc_id, n_shingles, component_id) by comparing all sets that share an n-gram."""
    sets = [plain_set(t) for _, t in rows]
    kinds = {s: k for k, s in enumerate(dict.fromkeys(sets))}
    top = list(range(len(kinds)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    of_gram = {}
    for s, k in kinds.items():
        for g in s:
            of_gram.setdefault(g, []).append((s, k))
    for group in of_gram.values():
        for (a, i), (b, j) in combinations(group, 2):
            if find(i) != find(j) and linked(a, b):
                top[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for (doc_id, _), s in zip(rows, sets, strict=True):
        if s and doc_id is not None:
            c = find(kinds[s])
            least[c] = min(doc_id, least.get(c, doc_id))
    return sorted(((doc_id, len(s), least.get(find(kinds[s])) if s else doc_id) for (doc_id, _), s in zip(rows, sets, strict=True)), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def edited(rng, words, rate):
    return [rng.choice("abcdefghij") + str(rng.randrange(50)) if rng.random() < rate else w for w in words]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(60)]
    out = [(0, None), (1, ""), (2, " \t"), (3, "one two"), (4, "ONE  two"), (5, "one two three four"), (None, "one two"), (6, "É ß x"), (6, "é ß x"), (None, None)]
    out += [(7, "la " * 5000), (8, "La la " * 40)]
    for group in range(12):
        base = [word() for _ in range(rng.choice([6, 9, 10, 40, 150, 400]))]
        for k in range(rng.choice([1, 2, 8])):
            text = edited(rng, base, rng.choice([0.0, 0.01, 0.03, 0.05]))
            out.append((20 + 10 * group + k, " ".join(text + (passage if group % 3 == 0 else []))))
    chain = [f"c{k}" for k in range(60)]  # each links with its neighbours only
    out += [(300 + k, " ".join(chain[k : k + 56])) for k in range(5)]
    out += [(400 + k, " ".join(f"n{j}" for j in range(k))) for k in range(4, 16)]
    return out + out[30:34]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], "doc_id long, text string, gram string, cls int, key string").repartition(3)


@pytest.mark.parametrize("part", [N.PART_GRAMS, 150])
@pytest.mark.parametrize(("rate", "small"), [(N.RATE, N.SMALL), (N.RATE, 38), (1, 0), (10**9, 0)])
def test_components_of_odd_rows(frame, rows, monkeypatch, part, rate, small):
    for name, value in (("PART_GRAMS", part), ("RATE", rate), ("SMALL", small), ("STEP", 7)):
        monkeypatch.setattr(N, name, value)
    assert found(N.linked_documents(frame)) == plain(rows)


def test_op12_against_all_pairs(spark, sf):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(registry.queries()["op12_ngram_join"](spark, sf)) == plain(table)


def test_no_documents(frame):
    assert N.linked_documents(frame.limit(0)).count() == 0


@pytest.mark.parametrize("step", [1, 5, 32])
def test_tree_finds_what_pairs_link(monkeypatch, step):
    monkeypatch.setattr(N, "STEP", step)
    rng = random.Random(2)
    for trial in range(30):
        base = rng.sample(range(500), rng.choice([7, 20, 80]))
        sets = {tuple(sorted(set(base) ^ set(rng.sample(range(500), rng.randrange(4))))) for _ in range(25)} | {(1, 2, 3), (1, 2)}
        sets = [np.array(s, dtype=np.uint64) for s in sets]
        tree = N.PrefixTree(sets)
        as_sets = [frozenset(s.tolist()) for s in sets]
        gone = set(rng.sample(range(len(sets)), trial % 5))
        for k in gone:
            tree.remove(k)
        for k in range(len(sets)):
            assert sorted(tree.search(k)) == [j for j in range(len(sets)) if j not in gone and linked(as_sets[k], as_sets[j])]


@pytest.mark.parametrize("n", range(1, 60))
def test_bounds_on_sizes(n):
    for m in range(1, 80):
        most = [i for i in range(min(n, m) + 1) if 100 * i >= 85 * (n + m - i)]
        assert all(i >= N.least_overlap(n) for i in most)
        assert not (most and N.alone(n) and m > n)
