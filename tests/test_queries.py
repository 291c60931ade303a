"""Each query against its SQL in another engine; queries without SQL against plain Python."""

import random
from difflib import SequenceMatcher

import pytest
from conftest import rows_of

from ledgertide.plans import corpus, registry

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_every_query_is_named_once():
    assert set(ORACLES) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_near_dedup_against_plain_loop(spark, sf):
    rows = corpus.registry(spark, sf).select("record_id", "source", "text", "event_date").toPandas()
    want = {}
    for _, group in rows.groupby("event_date"):
        kept = []
        for r in group.sort_values(["source", "record_id"]).itertuples():
            by = next((k.record_id for k in kept if (m := SequenceMatcher(None, r.text, k.text)).real_quick_ratio() >= 0.97 and m.quick_ratio() >= 0.97 and m.ratio() >= 0.97), None)
            want[r.record_id] = by
            if by is None:
                kept.append(r)
    got = {r["record_id"]: r["blocked_by"] for r in corpus.near_dedup(spark, sf).collect()}
    assert got == want


def test_sample_rows_against_stdlib(spark, sf):
    from ledgertide.operators.evaluation import sample_rows

    frame = spark.range(0, 500, 1, 7).withColumnRenamed("id", "k")
    picked = random.Random(29).sample(range(500), 40)
    assert sorted(r["k"] for r in sample_rows(frame, ["k"], 29, 40).collect()) == sorted(picked)
    assert sample_rows(frame, ["k"], 29, 0).count() == 500
