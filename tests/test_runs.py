"""Table functions, the SQL interface, chosen semi joins, sorted registries, evaluation runs and the preparation call."""

import csv
import json
import random
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgertide import sql
from ledgertide.functions import tables
from ledgertide.operators import evaluation as E
from ledgertide.operators import packaging as P
from ledgertide.operators import selection as C
from ledgertide.sources import runs
from ledgertide.sources.packages import read_text


@pytest.fixture(scope="module")
def known(spark, sf):
    sql.register(spark, sf)
    return spark


def plan(df):
    return df._jdf.queryExecution().toString()


def test_chunks_of_odd_texts(known):
    rows = [(1, None), (2, ""), (3, "a"), (4, " ".join(map(str, range(481)))), (5, " ".join(map(str, range(480)))), (6, " ".join(map(str, range(881))))]
    known.createDataFrame(rows, "id int, text string").createOrReplaceTempView("odd_texts")
    got = known.sql("SELECT id, c.* FROM odd_texts, LATERAL token_chunks(text, 480, 400) c").collect()
    frame = known.table("odd_texts").where("text IS NOT NULL").select(F.col("id").alias("doc_id"), F.split("text", " ").alias("tokens"))
    want = {(r.doc_id, r.chunk, len(r.tokens), " ".join(r.tokens)) for r in E.token_chunks(frame).collect()}
    assert {tuple(r) for r in got} == want
    for bad in ("0, 1", "4, 5", "NULL, 1"):
        with pytest.raises(Exception, match="positive|tokens out"):
            known.sql(f"SELECT * FROM token_chunks('a b', {bad})").collect()


def test_groups_by_lateral(known):
    rows = [(1, '{"groups": [{"records": [{"date": "d1"}, {"date": "d2"}]}, {"records": []}]}'), (2, "no json"), (3, None), (4, '[{"x": 1}]')]
    known.createDataFrame(rows, "id int, payload string").createOrReplaceTempView("payloads")
    got = known.sql("SELECT id, g.grp, g.idx, g.record FROM payloads LEFT JOIN LATERAL record_groups(payload) g ON TRUE").collect()
    from ledgertide.sources.scans import groups_of

    want = []
    for i, p in rows:
        try:
            groups = groups_of(json.loads(p)) if p else []
        except ValueError:
            groups = []
        found = [(i, g, k, json.dumps(r, sort_keys=True)) for g, own in enumerate(groups) for k, r in enumerate(own)]
        want += found or [(i, None, None, None)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_series_by_partition(known):
    rows = [("a", date(2024, 1, d), c) for d, c in zip((5, 1, 2, 4, 3, 6, 7), (1.0, 2.0, 0.0, None, 3.0, 4.0, 5.0), strict=True)] + [(None, date(2024, 1, 1), 1.0)]
    known.createDataFrame(rows, "symbol string, date date, close double").createOrReplaceTempView("odd_series")
    got = {(r.symbol, r.date.day): r.ret for r in known.sql("SELECT * FROM series_returns(TABLE(odd_series))").collect()}
    assert got == {("a", 1): None, ("a", 2): -1.0, ("a", 3): None, ("a", 4): None, ("a", 5): None, ("a", 6): 3.0, ("a", 7): 0.25, (None, 1): None}
    with pytest.raises(Exception, match="symbol, date and close"):
        known.sql("SELECT * FROM series_returns(TABLE(SELECT 1 AS x))").collect()
    assert set(tables.FUNCTIONS) == {"token_chunks", "record_groups", "series_returns"}


def test_the_correlated_asof_is_a_hash_join(known):
    from ledgertide.plans import statements

    found = statements.sql_asof(known, __import__("conftest").SF)
    text = plan(found)
    assert "LeftOuter" in text.split("== Optimized Logical Plan ==")[1] and "NestedLoop" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize(("listed", "cast"), [(500, 1000), (0, 1000), (0, 0)])
def test_semi_and_anti_joins_of_every_kind(spark, tmp_path, listed, cast):
    path = str(tmp_path / "rows")
    spark.range(0, 1000).select(F.when(F.col("id") % 50 != 0, F.col("id") % 97).alias("k"), F.col("id").alias("v")).write.parquet(path)
    rows, keys = spark.read.parquet(path), spark.createDataFrame([(3,), (5,), (5,), (None,), (5000,)], "x long")
    how = C.strategy(3, listed, cast)
    if how == "shuffled":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # so small a table would not be shuffled
    with C.bloom_filters(spark):
        inside, outside = C.having(rows, "k", keys, listed, cast), C.lacking(rows, "k", keys, listed, cast)
        text = plan(inside)
        assert {r.v for r in inside.collect()} == {r.v for r in rows.collect() if r.k in (3, 5)}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.v for r in outside.collect()} == {r.v for r in rows.collect() if r.k not in (3, 5)}
    assert {"listed": "PushedFilters: [In(k" in text or "PushedFilters: [IsNotNull(k), In(k" in text or "In(k, [3,5,5000])" in text, "broadcast": "BroadcastHashJoin" in text, "shuffled": "might_contain" in text or "mightcontain" in text.lower().replace("_", "")}[how], text
    assert how == "listed" or "GreaterThanOrEqual(k,3)" in text
    assert C.having(rows, "k", keys.limit(0), listed, cast).count() == 0 and C.lacking(rows, "k", keys.limit(0), listed, cast).count() == 1000


def test_a_range_reads_its_files_only(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"2024-01-{rng.randrange(1, 29):02d}" if k % 40 else None, rng.choice("ab"), str(k), "x") for k in range(2000)]
    path = f"file://{tmp_path}/registry"
    frame = spark.createDataFrame(rows, "event_date string, source string, source_record_id string, text string").repartition(5)
    manifest = runs.write_sorted(frame, path, parts=8).collect()
    assert sum(r.records for r in manifest) == 2000 and len(manifest) == 8
    got = runs.read_range(spark, path, "event_date", "2024-01-05", "2024-01-08")
    want = [r for r in rows if r[0] and "2024-01-05" <= r[0] <= "2024-01-08"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert 0 < len(got.inputFiles()) <= 3
    assert runs.read_range(spark, path, "event_date", "2031", "2032").count() == 0
    order = lambda r: (r[0] or "", r[1], r[2])
    parts = [[tuple(r) for r in spark.read.parquet(m.file).collect()] for m in sorted(manifest, key=lambda m: m.file)]
    assert [order(r) for p in parts for r in p] == sorted(map(order, rows))


def test_summary_scrape_and_sweep_files(spark, tmp_path):
    rows = [("s1", "1", "2024", "x", "hawkish"), ("s1", "2", "2024", "y", ""), ("s2", "3", "2024", "z", "dovish")]
    registry = spark.createDataFrame(rows, "source string, source_record_id string, event_date string, text string, label string")
    payload = runs.write_summary(registry, f"file://{tmp_path}/s.json")
    assert payload == json.loads(read_text(spark, f"file://{tmp_path}/s.json")) == {"record_count": 3, "labeled_count": 2, "source_counts": {"s1": 2, "s2": 1}}
    docs = spark.createDataFrame([("t \"q\", x\ny", None), ("u", "v")], "title string, url string")
    runs.write_scrape(docs, f"file://{tmp_path}", "found")
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"file://{tmp_path}/found.csv")
    assert back.columns == ["title", "url"] and sorted(map(repr, back.collect())) == sorted(map(repr, docs.collect()))
    assert spark.read.schema(docs.schema).json(f"file://{tmp_path}/found.json").count() == 2
    trials = spark.createDataFrame([(1, ((0.3, 0.1), (2,))), (2, ((0.1, 0.5), (4,))), (3, ((None, None), (1,)))], "trial int, summary struct<metrics struct<combined_rmse double, loss double>, config struct<layers int>>")
    runs.write_sweep(trials, f"file://{tmp_path}/sweep")
    lines = [r for f in sorted((tmp_path / "sweep.csv").glob("part-*.csv")) for r in csv.DictReader(f.open())]
    assert [r["trial"] for r in lines] == ["2", "1", "3"] and list(lines[0]) == ["trial", "combined_rmse", "loss", "layers"]


LABELS = ("hawkish", "dovish", "neutral")


@pytest.fixture(scope="module")
def package(spark):
    rng = random.Random(3)
    rows = [(f"r{k:04d}", f"2024-01-{rng.randrange(1, 21):02d}", "w" * rng.randrange(1, 9), rng.choice(LABELS)) for k in range(400)]
    return rows, spark.createDataFrame(rows, "record_id string, event_date string, text string, label string").repartition(4)


def test_evaluation_against_plain_loops(spark, package, tmp_path):
    rows, frame = package
    folds, names = P.walk_forward(spark, frame), LABELS

    def coin():  # inside, so that workers get it by value
        return lambda texts: [names[len(t) % 3] for t in texts]

    def broken():
        raise OSError("no such checkpoint")

    summary = runs.evaluate(frame, folds, {"coin": coin, "gone": broken}, [11, 29], f"file://{tmp_path}", cap=25)
    assert summary["results"], summary["failures"]
    assert {(f["model_key"], f["seed"]) for f in summary["failures"]} == {("gone", 11), ("gone", 29)} and "no such checkpoint" in " ".join(f["error"] for f in summary["failures"])
    kept = json.loads(read_text(spark, f"file://{tmp_path}/summary.json"))
    assert kept == summary and [r["run_id"] for r in kept["results"]] == ["run_coin_s11", "run_coin_s29"]
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    for r in kept["results"]:
        truth, pred = [], []
        for f in sorted(folds.collect(), key=lambda f: f.fold_id):
            test = [x for x in ordered if f.test_start <= x[1] <= f.test_end]
            own = random.Random(r["seed"]).sample(test, 25) if len(test) > 25 else test
            told = next(x for x in r["folds"] if x["fold_id"] == f.fold_id)
            assert (told["test_rows_total"], told["test_rows_evaluated"]) == (len(test), len(own))
            truth += [x[3] for x in own]
            pred += coin()([x[2] for x in own])
        assert r["evaluated_rows"] == len(truth)
        assert r["classification"]["accuracy"] == pytest.approx(sum(a == b for a, b in zip(truth, pred, strict=True)) / len(truth))
        f1 = []
        for c in LABELS:
            hit, sup, out = sum(a == b == c for a, b in zip(truth, pred, strict=True)), truth.count(c), pred.count(c)
            f1.append(2 * hit / (sup + out) if sup + out else 0.0)
        assert r["classification"]["macro_f1"] == pytest.approx(sum(f1) / 3)
        assert json.loads(read_text(spark, f"file://{tmp_path}/{r['run_id']}/metrics.json"))["latency"]["p95_ms"] >= 0
    with pytest.raises(ValueError, match="no fold"):
        runs.evaluate(frame, folds.limit(0), {"coin": coin}, [1], f"file://{tmp_path}/none")


def test_preparation_in_one_call(spark, tmp_path):
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(120)) for _ in range(40)]
    rows = [(f"s{k % 3}", str(k), "statement", f"2024-01-{1 + k % 12:02d}", "", base[k], ("Hawkish", "dovish", "neutral", "")[k % 4], "l", "") for k in range(40)]
    rows += [("s9", "90", "statement", rows[5][3], "", base[5], "Hawkish", "l", ""), ("s9", "91", "statement", rows[6][3], "", base[6] + " end", "Hawkish", "l", ""), ("s9", "92", "statement", "", "", "text", "", "l", ""), ("s9", "93", "statement", "2024-01-01", "", " ", "", "l", "")]
    raw = spark.createDataFrame(rows, "source string, source_record_id string, document_type string, event_date string, title string, text string, label string, license_scope string, citation_ref string")
    out = runs.prepare(raw, f"file://{tmp_path}", "v1", "f1", "wf")
    assert spark.read.parquet(out["registry"]).count() == 42 and spark.read.parquet(out["passed"]).count() == 40
    report = lambda n: json.loads(read_text(spark, f"{out['reports']}/{n}.json"))
    assert report("exact_duplicates")["dropped_rows"] == 1 and report("near_duplicates")["blocked_rows"] == 1 and report("leakage")["status"] == "pass" and report("label_exceptions")["rejected_rows"] == 2
    assert json.loads(read_text(spark, f"file://{tmp_path}/ingestion_summary.json"))["record_count"] == 42
    split = Counter(r.split_tag for r in spark.read.parquet(f"{out['package']}/splits").collect())
    assert sum(split.values()) == 30 and set(split) == {"train", "val", "test"}
    with pytest.raises(ValueError, match="labelled rows"):
        runs.prepare(raw.limit(0), f"file://{tmp_path}/none", "v1", "f1", "wf")
