"""What each stage of the pipeline keeps, against plain Python on its own input."""

import re
from collections import defaultdict

import corpus_pipeline
import pytest

from ledgertide.llm import registry
from ledgertide.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf):
    """name -> (rows before, rows after) of each stage, by id."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, sf), "tested-stage")
        out[name] = (docs, after)
        docs = after
    return out


def by_id(df):
    rows = {r.doc_id: r for r in df.collect()}
    assert len(rows) == df.count()
    return rows


def test_stages_keep_whole_rows(steps):
    assert list(steps) == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    for name, (before, after) in steps.items():
        if name != "packing":
            assert after.columns == COLUMNS
            old, new = by_id(before), by_id(after)
            assert new and all(old[k] == r for k, r in new.items()), name


def test_quality_keeps_what_the_query_keeps(spark, sf, steps):
    kept = {r.doc_id for r in registry.queries()["op10_quality_rules"](spark, sf).where("kept").collect()}
    assert set(by_id(steps["quality"][1])) == kept and len(kept) < steps["quality"][0].count()


def test_exact_keeps_the_least_id_of_equal_texts(steps):
    before, after = steps["exact_dedup"]
    least = {}
    for k, r in by_id(before).items():
        key = re.sub("[\x20\x09-\x0d]+", " ", r.text or "")
        least[key] = min(k, least.get(key, k))
    assert set(by_id(after)) == set(least.values())


def test_near_keeps_one_of_each_group_and_all_others(steps):
    before, after = steps["near_dedup"]
    rows, kept = by_id(before), by_id(after)
    sets, of_gram = {}, defaultdict(list)
    for k, r in rows.items():
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        for g in sets[k]:
            of_gram[g].append(k)
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for k in rows:
        others = {j for g in sets[k] for j in of_gram[g] if j != k}
        links = [j for j in others if near(k, j) >= 0.8]
        if k not in kept:  # dropped documents have a link
            assert links
        else:  # of a pair that is surely found, one goes
            assert not any(j in kept and near(k, j) >= 0.9 for j in links)


def test_mixing_keeps_prefixes_of_its_order(steps):
    before, after = steps["mixing"]
    rows, kept = by_id(before), by_id(after)
    size = lambda r: len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))
    total, chosen = sum(map(size, rows.values())), sum(map(size, kept.values()))
    assert 0 < chosen <= corpus_pipeline.MIX_SHARE * total + 1 and set(kept) < set(rows)


def test_packing_holds_every_document_once(steps):
    before, after = steps["packing"]
    pieces = defaultdict(list)
    for r in after.collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(by_id(before))
    for own in pieces.values():
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))] and sum(r.length for r in own) == own[0].doc_tokens
