"""The pipeline's near-duplicate stage against all pairs, and how its rows and its recall behave."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgertide.llm import ngram_join, simhash


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike(a, b):
    return a == b or 100 * len(a & b) >= 80 * len(a | b)


def plain_groups(rows):
    sets = [shingle_set(t) for _, t in rows]
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if of[i] != of[j] and alike(sets[i], sets[j]):
                of = [of[j] if x == of[i] else x for x in of]
    return of


def edited(rng, words, changes):
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"n{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [(1, None), (2, ""), (3, " \n"), (None, "one two three"), (4, "ONE two  three"), (4, "ONE two  three"), (None, None), (6, "la " * 9000), (7, "Straße x y z ü w")]
    for k in range(14):
        base = [f"b{rng.randrange(3000)}" for _ in range(rng.choice([30, 120, 400]))]
        out.append((100 + 20 * k, " ".join(base)))
        for j in range(rng.choice([0, 1, 6])):  # close enough to be found surely, or far apart
            out.append((101 + 20 * k + j, " ".join(edited(rng, base, rng.choice([0, len(base) // 80, len(base) // 2])))))
    return out


@pytest.mark.parametrize("parts", [ngram_join.PART_GRAMS, 100])
def test_one_text_of_each_group_stays(spark, rows, monkeypatch, parts):
    monkeypatch.setattr(ngram_join, "PART_GRAMS", parts)
    frame = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "doc_id long, text string, key string, fp int, `m.x` double").repartition(3)
    groups, least = plain_groups(rows), {}
    for (doc_id, text), g in zip(rows, groups, strict=True):
        rank = (doc_id is None, doc_id or 0)
        least[g] = min(least.get(g, (rank, text or "")), (rank, text or ""))
    stay = {t for _, t in least.values()}
    kept = simhash.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    by = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=by) == sorted(((i, t) for i, t in rows if (t or "") in stay), key=by)
    assert simhash.drop_near_duplicates(frame.limit(0)).count() == 0


def test_pairs_near_the_similarity_are_found(spark):
    rng, rows, pairs = random.Random(1), [], []
    for k in range(400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        other = edited(rng, base, rng.randrange(5, 9))
        a, b = shingle_set(" ".join(base)), shingle_set(" ".join(other))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        pairs.append(len(a & b) / len(a | b))
    got = {r.doc_id: r.component for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [got[2 * k] == got[2 * k + 1] for k in range(400)]
    assert not any(f for f, s in zip(found, pairs, strict=True) if s < 0.8)
    for low, high, want in ((0.8, 0.82, 0.95), (0.82, 0.9, 0.97)):
        inside = [f for f, s in zip(found, pairs, strict=True) if low <= s < high]
        assert len(inside) >= 30 and sum(inside) >= want * len(inside), (low, len(inside), sum(inside))


@pytest.mark.parametrize("n", [0, 1, 3, 4096, 4097, 30_000])
def test_every_text_has_as_many_keys(n):
    h = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    keys = simhash.band_keys(h)
    assert keys.shape == (simhash.BANDS,) and keys.dtype == np.int64
    assert (keys == simhash.band_keys(h[::-1])).all()  # the order of shingles tells nothing


def test_keys_agree_as_often_as_sets_do():
    rng, hits = np.random.default_rng(3), []
    for _ in range(60):
        pool = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
        a, b = pool[:200], pool[50:250]  # 150 of 250
        hits.append((simhash.band_keys(a) == simhash.band_keys(b)).mean())
    assert abs(np.mean(hits) - 0.6**simhash.BAND_ROWS) < 0.02


def test_a_hub_of_unlike_texts_hides_no_pair(spark, monkeypatch):
    """All texts in one shard and within the radius: the pair that is alike is joined, whatever the forest's edges."""
    monkeypatch.setattr(simhash, "SIMILAR_RADIUS", 64)
    banded = simhash._banded
    monkeypatch.setattr(simhash, "_banded", lambda *a: banded(*a).withColumns({"bands": F.array(F.lit(7).cast("long"))}))
    rng = random.Random(2)
    texts = [[f"{k}w{rng.randrange(10**6)}" for _ in range(80)] for k in range(6)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(10 + k, " ".join(edited(rng, texts[k], 1))) for k in (2, 4)]
    got = {r.doc_id: r.component for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[10 + 2] == got[2] and got[10 + 4] == got[4] and len(set(got.values())) == 6
