"""Rules and edge cases on small fixtures."""

import datetime as dt
import json
import math
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgertide.functions import text as T
from ledgertide.operators import alignment as A
from ledgertide.operators import evaluation as E
from ledgertide.operators import features as X
from ledgertide.operators import forecast as O
from ledgertide.operators import market as M
from ledgertide.operators import packaging as P
from ledgertide.operators import registry_ops as R
from ledgertide.operators import sentiment as S
from ledgertide.sources import packages, readers, scans


def values(spark, column, inputs):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], "k int, v string")
    return [r["x"] for r in frame.select("k", column(F.col("v")).alias("x")).orderBy("k").collect()]


def test_label_map(spark):
    inputs = ["Hawkish", "label-2", "hawkish dovish", "increase", "balance sheet", " ", None, "unknown", "LABEL_1"]
    assert values(spark, T.map_label, inputs) == ["hawkish", "hawkish", "hawkish", "dovish", "neutral", None, None, None, "neutral"]
    assert values(spark, T.signal_label, ["LABEL_1", "label_0", "", None]) == ["Hawkish", "Dovish", "Unknown", "Unknown"]
    assert values(spark, T.map_prediction, ["LABEL_1", "x", None, "2"]) == ["neutral", "neutral", "neutral", "hawkish"]


def test_dates(spark):
    assert values(spark, T.event_date, ["20240131", "2024", "01/31/2024", "2024-01-31T10:00:00", ""]) == ["2024-01-31", "2024-01-01", "0131-20-24", "2024-01-31T10:00:00", ""]
    assert values(spark, T.is_valid_date, ["2024-1-5", "2024-02-30", "24-01-01", None]) == [True, False, False, False]
    assert values(spark, T.long_date, ["on march 5,  2024 we", "May 32, 2024", ""]) == ["2024-03-05", None, None]
    assert values(spark, T.date_from_url, ["/a/fomcminutes20240131.htm", "/a"]) == ["2024-01-31", ""]


def test_white_space(spark):
    assert values(spark, T.normalize, [" a  b\x1c", None, "\t\n"]) == ["a b", "", ""]


def test_asof_takes_friday_for_sunday_and_keeps_tolerance(spark):
    series = spark.createDataFrame([("s", dt.date(2026, 3, 12), 101.0), ("s", dt.date(2026, 3, 13), 102.0)], "symbol string, date date, close double")
    asked = spark.createDataFrame([("s", dt.date(2026, 3, 15)), ("s", dt.date(2026, 3, 20)), ("s", dt.date(2026, 3, 21)), ("s", dt.date(2026, 3, 11))], "symbol string, requested_date date")
    got = {r["requested_date"].day: r["date_used"].day for r in M.asof(asked, series).collect()}
    assert got == {15: 13, 20: 13}


def test_volatility_is_zero_until_the_window_is_full(spark):
    series = spark.createDataFrame([("s", dt.date(2024, 1, k), float(c)) for k, c in enumerate([10.0, 11, 0, 12, 13, 12, 14, 13, 15], 1)], "symbol string, date date, close double")
    rows = M.with_volatility(series).orderBy("date").collect()
    assert [r["volatility_5d"] for r in rows][:5] == [0.0] * 5
    with pytest.raises(ValueError):
        M.with_volatility(series, 1)


def test_features(spark):
    series = spark.createDataFrame([("s", dt.date(2024, 1, 1), 5000.0, 0.01, 0.6), ("s", dt.date(2024, 1, 2), 5100.0, 0.0115, 0.6)], "symbol string, date date, close double, volatility_5d double, sentiment_score double")
    rows = X.vectors(series).orderBy("date").collect()
    assert [round(r["close_change_pct"], 9) for r in rows] == [0.0, 0.02]
    assert [round(r["volatility_change"], 9) for r in rows] == [0.0, 0.0015]
    assert X.last_padded(X.vectors(series)).first()["closes"] == [5000.0, 5000.0, 5000.0, 5000.0, 5100.0]


def test_splits_and_folds(spark):
    for n in (1, 2, 10, 90):
        rows = spark.createDataFrame([(f"r{k:03}", f"2024-01-{k // 7 + 1:02}") for k in range(n)], "record_id string, event_date string")
        tags = [r["split_tag"] for r in P.time_split(rows).orderBy("event_date", "record_id").collect()]
        a = max(1, int(n * 0.7))
        b = min(max(a + 1, int(n * 0.85)), n)
        assert tags == ["train"] * a + ["val"] * (b - a) + ["test"] * (n - b)
    dates = lambda n: spark.createDataFrame([(f"2024-02-{k + 1:02}", None) for k in range(n)], "event_date string, mapped_label string")
    assert P.walk_forward(spark, dates(7)).count() == 0 and P.walk_forward(spark, dates(20)).count() > 0
    assert P.fallback(spark, dates(11)).count() == 0 and P.fallback(spark, dates(12)).count() == 3
    assert P.supervised(dates(3)).count() == 0 and P.supervised(dates(3), include_unlabeled=True).count() == 3


def test_metrics(spark):
    rows = spark.createDataFrame([("hawkish", "hawkish"), ("dovish", "neutral")], "label string, pred string").withColumn("g", F.lit(1))
    got = E.classification(rows, ["g"]).first()
    assert got["accuracy"] == 0.5 and round(got["macro_f1"], 6) == round(1 / 3, 6)
    assert E.classification(rows.where("false"), ["g"]).count() == 0
    sample = spark.createDataFrame([(1, float(v)) for v in (9, 8, 1, 2, 3, 4)], "g int, v double")
    assert E.lower_percentile(sample, "v", 0.95, ["g"]).first()["value"] == 8.0


def test_percentile_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(E, "BRACKET", 100)
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(0, 1, 3000), "b": np.concatenate([np.zeros(2500), rng.exponential(1, 500)]), "c": np.array([5.0]), "d": np.repeat([1.0, 2.0], 700)}
    rows = spark.createDataFrame([(k, float(x)) for k, own in values.items() for x in own] + [("a", None)], "k string, v double").repartition(5)
    for share in (0.0, 0.01, 0.5, 0.95, 0.99, 1.0):
        got = {r["k"]: r["value"] for r in E.lower_percentile(rows, "v", share, ["k"]).collect()}
        assert got == {k: float(np.sort(own)[int((len(own) - 1) * share)]) for k, own in values.items()}


def test_chunks(spark):
    for n, want in ((479, 1), (480, 1), (481, 2), (880, 2), (881, 3)):
        docs = spark.createDataFrame([(1, ["t"] * n)], "doc_id long, tokens array<string>")
        assert E.token_chunks(docs).count() == want


def test_best_trial_and_grid(spark):
    trials = spark.createDataFrame([(1, 0.22, 0.10), (2, 0.11, 0.12), (3, 0.14, 0.08), (4, None, 0.0)], "trial int, combined_rmse double, loss double")
    assert E.best_trial(trials).first()["trial"] == 2
    assert E.sweep_grid(spark, a=[1, 2], b=[1, 2], c=[1], d=[0.1, 0.2], e=[1]).count() == 8


def test_band_check_and_stamps(spark):
    rows = spark.createDataFrame([(1.0, 0.9, 1.1), (1.0, 1.01, 1.1), (1.0, 1.5, 2.0), (None, 1.0, 2.0)], "v double, lower double, upper double")
    assert [r["tone"] for r in A.band_check(rows, "v", 0.015).collect()] == ["good", "caution", "danger"]
    points = spark.createDataFrame([(1, 0, "d", 1.0), (1, 1, "d+1", 2.0)], "k int, pos int, ts string, value double")
    assert A.last_by_day(points, ["k"], ["value"]).first()["value"] == 2.0


def test_leakage(spark):
    rows = spark.createDataFrame([("a", "s", "1", "2024-01-01"), ("b", "s", "1", "2024-01-01")], "record_id string, source string, source_record_id string, event_date string")
    assert R.leakage_status(rows, ["record_id"]).first()["status"] == "fail"
    assert R.leakage_status(rows.limit(1), ["record_id"]).first()["status"] == "pass"


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rows": [{"x": 1}, {"x": 2}]}')
    (tmp_path / "b.json").write_text('[{"x": 3}]')
    (tmp_path / "c.jsonl").write_text('{"x": 4}\n\n{"x": 5}\n')
    (tmp_path / "d.csv").write_text("x,y\n6,a\n")
    got = [sorted(r["x"] for r in readers.read_any(spark, f"{tmp_path}/{n}", "x int").collect()) for n in ("a.json", "b.json", "c.jsonl", "d.csv", "e.jsonl", "f.txt")]
    assert got == [[1, 2], [3], [4, 5], [6], [], []]
    readers.write(spark.range(3), f"{tmp_path}/out", "parquet")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_nested_groups(spark):
    deep = '{"groups": [{"series": [{"sequences": [[{"c": 1}], {"items": []}]}]}, 5, {"data": [{"c": 2}]}]}'
    files = [("a", '{"sequences": [[{"c": 1}, {"c": 2}], {"rows": [{"c": 3}]}]}'), ("b", '[{"c": 1}]'), ("c", "{}"), ("d", deep), ("e", '[{"rows": [{"c": 1}]}, {"c": 2}]'), ("f", "{bad"), ("g", "[]")]
    got = scans.record_groups(spark.createDataFrame(files, "path string, value string")).collect()
    found = {}
    for r in got:
        if r["message"] is None:
            found.setdefault((r["path"], r["grp"]), []).extend([] if r["record"] is None else [json.loads(r["record"]).get("c")])
    assert found == {("a", 0): [1, 2], ("a", 1): [3], ("b", 0): [1], ("d", 0): [1], ("d", 1): [], ("d", 2): [2], ("e", 0): [1], ("g", 0): []}
    assert [r["path"] for r in got if r["message"]] == ["f"]


def test_inventory_of_a_folder(spark, tmp_path):
    record = lambda k, **more: {"date": f"2024-01-{k + 1:02}", "close": 10 + k, "volatility_5d": 0.1} | more
    (tmp_path / "in" / "deep").mkdir(parents=True)
    write = lambda name, text: (tmp_path / "in" / name).write_text(text)
    write("deep/use.json", json.dumps({"groups": [{"symbol": "A", "records": [record(k) for k in range(7)]}, {"records": [record(k) for k in range(2)]}]}))
    write("few.json", json.dumps([record(k) for k in range(5)]))
    write("lines.jsonl", "\n".join(json.dumps(record(k)) for k in range(6)) + "\n\n")
    write("table.csv", "date,close,volatility_5d\n" + "".join(f"2024-01-0{k + 1},1,0.1\n" for k in range(6)))
    write("lacking.json", json.dumps([record(k, close="") for k in range(7)]))
    write("broken.json", "{oops")
    write("none.json", '{"a": 1}')
    write("notes.txt", "hello")
    write(".hidden.json", json.dumps([record(k) for k in range(7)]))
    got = {r["path"].rsplit("/", 1)[1]: r for r in scans.inspect_folder(spark, f"{tmp_path}/in").collect()}
    assert {k: (r["status"], r["record_groups"], r["records"], r["vectors"], r["usable_sequences"]) for k, r in got.items()} == {
        "use.json": ("usable", 2, 9, 9, 1), "few.json": ("insufficient", 1, 5, 5, 0), "lines.jsonl": ("usable", 1, 6, 6, 1), "table.csv": ("usable", 1, 6, 6, 1),
        "lacking.json": ("error", 0, 0, 0, 0), "broken.json": ("error", 0, 0, 0, 0), "none.json": ("ignored", 0, 0, 0, 0), "notes.txt": ("ignored", 0, 0, 0, 0),
    }
    assert got["table.csv"]["format"] == "csv" and scans.inspect_folder(spark, f"{tmp_path}/nowhere").count() == 0


def test_scans_of_splits_and_folders(spark, tmp_path):
    put = lambda name, text: ((tmp_path / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / name).write_text(text))
    put("hub/train/b.jsonl", '{"sentence": " one ", "year": 2001, "label": 1}\n{"text": "two", "date": "20240131", "id": "x7"}\n')
    put("hub/train/a.json", '[{"text": "zero", "event_date": "2024", "type": "speech"}, 5]')
    put("hub/test/c.csv", "content,date,label_text,title\nthree,Jan 5,hawkish,T\n")
    hub = {r["text"]: r for r in scans.scan_splits(spark, f"{tmp_path}/hub", scans.Collection("hub", keys=scans.SPLIT_KEYS)).collect()}
    assert {k: (r["source_record_id"], r["event_date"], r["document_type"], r["label"]) for k, r in hub.items()} == {
        "zero": ("train:0", "2024-01-01", "speech", ""), "one": ("train:1", "2001-01-01", "statement", "1"), "two": ("x7", "2024-01-31", "statement", ""), "three": ("test:0", "Jan 5", "statement", "hawkish"),
    }
    put("folder/x/k.csv", "Date,Text,Type\n2024-02-01,alpha,0\n2024-02-02,\"be\nta\",1\n,,\n")
    put("folder/y/z/m.json", '{"data": [{"minutes": "gamma", "timestamp": "2020"}]}')
    put("folder/readme.md", "no records")
    kept = scans.Collection("folder", "terms", "cite")
    raw = scans.scan_folder(spark, f"{tmp_path}/folder", kept)
    assert {(r["text"], r["source_record_id"], r["document_type"], r["event_date"]) for r in raw.collect()} == {("alpha", "k.csv:0", "minutes", "2024-02-01"), ("be\nta", "k.csv:1", "statement", "2024-02-02"), ("", "k.csv:2", "unknown", ""), ("gamma", "m.json:0", "unknown", "2020-01-01")}
    registry, rejects = R.ingest(raw)
    assert registry.count() == 3 and [r["reason"] for r in rejects.collect()] == ["blank_text"] and registry.columns == R.REGISTRY
    put("two/a.json", '[{"date": "20240131", "text": "t1"}, {"date": "2023-01-01", "content": "t0"}]')
    got = scans.scan_scraped(spark, f"{tmp_path}/two", ["a.json", "missing.json"], scans.Collection("scraped", keys=scans.SCRAPED_KEYS)).collect()
    assert sorted((r["source_record_id"], r["event_date"], r["text"], r["document_type"]) for r in got) == [("a.json:0", "20240131", "t1", "unknown"), ("a.json:1", "2023-01-01", "t0", "unknown")]
    assert scans.scan_scraped(spark, f"{tmp_path}/two", ["missing.json"], kept).count() == 0
    docs = scans.raw_documents(spark, f"{tmp_path}/two", ["missing.json", "a.json"])
    assert [(r["date"], r["source_file"]) for r in docs.collect()] == [("2023-01-01", "a.json"), ("20240131", "a.json")]


def test_csv_files_of_equal_headers_are_one_scan(spark, tmp_path):
    put = lambda name, text: ((tmp_path / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / name).write_text(text))
    for k in range(5):
        put(f"a/n {k}+é.csv", f"\ndate,text\n2024-01-0{k + 1},plain {k}\n")  # names that a URI encodes, a line without a header before it
        put(f"b{k}/m.csv", f"text,date\nturned {k},2024-02-0{k + 1}\n")
    put("c/quoted.csv", '"da""te","text\nof it",text\nx,y,quoted\n')
    put("c/other.csv", '"da""te","text\nof all",text,date\nx,y,other,2024-03-01\n')
    put("c/empty.csv", "")
    found = scans.file_records(spark, str(tmp_path))
    got = {(r["text"], r.get("date")) for r in map(json.loads, (x["record"] for x in found.collect()))}
    assert got == {(f"plain {k}", f"2024-01-0{k + 1}") for k in range(5)} | {(f"turned {k}", f"2024-02-0{k + 1}") for k in range(5)} | {("quoted", None), ("other", "2024-03-01")}
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 4
    (tmp_path / "none").mkdir()
    assert scans.file_records(spark, str(tmp_path / "none")).count() == 0


def test_parameters_that_make_no_sense_are_refused(spark):
    asked = spark.createDataFrame([("a", dt.date(2024, 1, 2))], "symbol string, requested_date date")
    series = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0, 0.0)], "symbol string, date date, close double, volatility_5d double")
    for bad in (lambda: M.asof(asked, series, tolerance=0), lambda: M.history(asked, series, 0), lambda: M.forward(asked, series, 0)):
        with pytest.raises(ValueError):
            bad()
    assert M.asof(asked, series, tolerance=1).count() == 1 and M.history(asked, series, 1).count() == 1


def test_unzip_of_uneven_arrays(spark):
    frame = spark.createDataFrame([("a", [1, 2], ["x"]), ("b", None, ["y"]), ("c", [], [])], "k string, n array<int>, s array<string>")
    got = A.unzip(frame, ["k"], number="n", name="s").collect()
    assert sorted(map(tuple, got), key=str) == [("a", 0, 1, "x"), ("a", 1, 2, None)]


def test_numbers_go_on_over_the_stretches_of_a_file(spark, tmp_path):
    (tmp_path / "long.jsonl").write_text("".join(f'{{"k": {k}, "pad": "{"x" * 200}"}}\n' for k in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        rows = scans.numbered(scans.file_records(spark, str(tmp_path)), ["path"])
        got = rows.selectExpr("idx", "get_json_object(record, '$.k') AS k").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 3000 and all(r["idx"] == int(r["k"]) for r in got)


def test_packages(spark, tmp_path):
    rows = [(f"r{k:02}", f"2024-01-{k + 1:02}", ("hawkish", "dovish", None)[k % 3], f"s{k % 2}", f"text {k}") for k in range(24)]
    labelled = spark.createDataFrame(rows, "record_id string, event_date string, mapped_label string, source string, text string")
    (tmp_path / "reports").mkdir()
    packages.write_reports(spark, f"file:{tmp_path}/reports", {"dedup": ({"dropped": 7}, labelled.select("record_id"))}, most=2)
    assert json.loads((tmp_path / "reports" / "dedup.json").read_text()) == {"dropped": 7, "rows": [{"record_id": "r00"}, {"record_id": "r01"}]}
    folder = packages.write_package(labelled, f"file:{tmp_path}/out", "d1", "f1", "walk", f"file:{tmp_path}/reports")
    meta = json.loads(packages.read_text(spark, f"{folder}/dataset_metadata.json"))
    assert (meta["input_rows"], meta["supervised_rows"], meta["label_counts"], meta["split_counts"]) == (24, 16, {"dovish": 8, "hawkish": 8}, {"train": 11, "val": 2, "test": 3})
    assert meta["quality_reports"] == 1 and (tmp_path / "out" / meta["training_package_id"] / "quality_reports" / "dedup.json").exists()
    manifest = json.loads(packages.read_text(spark, f"{folder}/fold_manifest.json"))
    assert manifest["fold_count"] == len(manifest["folds"]) > 0 and sum(manifest["folds"][0]["class_distribution"].values()) == manifest["folds"][0]["test_rows"]
    rows, folds = packages.load_evaluation(spark, folder)
    assert rows.count() == 16 and [tuple(r) for r in folds.collect()] == [tuple(f[n] for n in folds.columns) for f in manifest["folds"]]
    rows, folds = packages.load_evaluation(spark, f"{folder}/missing")
    assert rows.count() == folds.count() == 0
    with pytest.raises(ValueError, match="10 labelled rows"):
        packages.write_package(labelled.limit(12), f"file:{tmp_path}/out", "d2", "f1", "walk")


def test_training_dataset(spark, tmp_path):
    prepared = spark.createDataFrame([(1, "A", "2024-01-03", 2.0), (2, "A", "2024-01-02", 1.0), (1, "B", "2024-01-03", 3.0)], "document long, symbol string, date string, close double")
    docs = spark.createDataFrame([(1, "2024-01-03", "x"), (2, "2024-01-02", "y"), (3, " ", "z"), (4, "2024-01-01", None)], "doc long, date string, text string")
    summary = packages.preparation_summary(docs, prepared.select("symbol").distinct(), prepared)
    packages.write_training_dataset(prepared, summary, f"file:{tmp_path}/set", ["a.json"])
    meta = json.loads((tmp_path / "set" / "metadata.json").read_text())
    assert meta == {"total_documents": 4, "valid_documents": 2, "prepared_records": 3, "skipped_documents": 2, "skipped_symbol_pairs": 1, "symbols": ["A", "B"], "source_files": ["a.json"]}
    groups = {r["symbol"]: [x["date"] for x in r["records"]] for r in spark.read.json(f"file:{tmp_path}/set/groups").collect()}
    assert groups == {"A": ["2024-01-02", "2024-01-03"], "B": ["2024-01-03"]}


def test_repeats_of_a_key(spark):
    rows = spark.createDataFrame([("a", "d", "h", 2), ("b", "d", "h", 1), ("b", "d", "h", 1), ("c", "d", "h", 3), ("e", "d", "other", 1), ("f", "x", "h", 1)], "record_id string, event_date string, text_hash string, pos int")
    assert sorted(r["record_id"] for r in R.exact_dedup(rows, ["pos"]).collect()) == ["b", "e", "f"]
    assert sorted((r["record_id"], r["kept_record_id"]) for r in R.exact_dropped(rows, ["pos"]).collect()) == [("a", "b"), ("b", "b"), ("c", "b")]


def test_near_dedup_settles_chains_in_order(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_TEXTS", 2)
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz ")) for _ in range(150))
    texts, t = [], base
    for k in range(9):  # each differs from the one before by two letters, so those far apart don't match
        texts.append(t)
        t = t[: 15 * k] + "#%" + t[15 * k + 2 :]
    texts += [texts[4], texts[0], base + base, "short", "short"]
    rows = [(f"r{k:02}", "2024-01-01" if k != 13 else "2024-01-02", "s", x) for k, x in enumerate(texts)]
    kept, want = [], {}
    for rid, day, _, x in rows:
        hit = next(((k, r) for k, d, y in kept if d == day and (r := SequenceMatcher(None, x, y).ratio()) >= R.NEAR_THRESHOLD), None)
        want[rid] = (hit[0], round(hit[1], 5)) if hit else (None, None)
        if not hit:
            kept.append((rid, day, x))
    got = R.near_dedup(spark.createDataFrame(rows, "record_id string, event_date string, source string, text string")).collect()
    assert {r["record_id"]: (r["blocked_by"], r["similarity"]) for r in got} == want and 3 < len(kept) < 9


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_near_dedup_takes_few_ratios_of_long_texts_and_copies(spark, tmp_path, monkeypatch, rounds):
    taken = tmp_path / "taken"

    class Counted(SequenceMatcher):
        def ratio(self):
            with taken.open("a") as f:
                f.write("x")
            return super().ratio()

    monkeypatch.setattr(R, "SequenceMatcher", Counted)
    monkeypatch.setattr(R, "ROUNDS", rounds)
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(60)]
    texts = [" ".join(rng.choice(words, 4000)) for _ in range(8)]  # long texts of a language have most runs of three letters in common
    copied = " ".join(rng.choice(words, 300))
    texts += [copied + "%" * k for k in range(6)]
    rows = [(f"r{k:02}", "2024-01-01", "s", x) for k, x in enumerate(texts)]
    got = {r["record_id"]: r["blocked_by"] for r in R.near_dedup(spark.createDataFrame(rows, "record_id string, event_date string, source string, text string")).collect()}
    assert got == {r[0]: "r08" if k > 8 else None for k, r in enumerate(rows)}
    assert len(taken.read_text()) <= (5 if rounds else 15)


def test_record_groups_hands_on_many_files_at_once(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    import pandas as pd

    from ledgertide.sources import scans

    made = tmp_path / "made"

    def counted(*args, **kwargs):
        with made.open("a") as f:
            f.write("x")
        return pd.DataFrame(*args, **kwargs)

    monkeypatch.setattr(scans, "pd", SimpleNamespace(DataFrame=counted))
    values = ['{"records": [{"a": 1}, {"a": 2}]}', "{}", "not JSON"]
    files = spark.createDataFrame([(f"f{k:03}", values[k % 3]) for k in range(300)], "path string, value string").coalesce(1)
    got = scans.record_groups(files).collect()
    assert sorted({(int(r["path"][1:]) % 3, r["grp"], r["pos"], r["record"], bool(r["message"])) for r in got}, key=repr) == [(0, 0, 0, '{"a": 1}', False), (0, 0, 1, '{"a": 2}', False), (2, None, None, None, True)]
    assert len(got) == 300 and len(made.read_text()) < 10


def test_chunk_mean_scores_each_chunk_once(spark, tmp_path):
    from ledgertide.operators import sentiment

    taken = tmp_path / "taken"

    def load():
        def score(texts):
            with taken.open("a") as f:
                f.write("x" * len(texts))
            return [[{"label": "hawkish", "score": 0.25}] for _ in texts]

        return score

    chunks = spark.createDataFrame([(k // 2, k % 2, ["a"]) for k in range(20)], "doc_id long, chunk int, tokens array<string>")
    got = E.chunk_mean(sentiment.score_chunks(chunks, load)).collect()
    assert sorted((r["doc_id"], r["score"]) for r in got) == [(k, 0.25) for k in range(10)]
    assert len(taken.read_text()) == 20


def test_forecast_error_does_not_depend_on_the_order_of_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x), float(x) * 1.02) for x in rng.integers(1, 20000, 40) / 100]
    orders = [(k, *rows[i]) for k in range(60) for i in rng.permutation(len(rows))]
    frame = spark.createDataFrame(orders, "k int, realized double, forecast double").coalesce(1)
    assert len({r["mape"] for r in E.forecast_error(frame, ["k"]).collect()}) == 1
    large = spark.createDataFrame([(1, 1e30, 0.0), (1, 3e30, 0.0), (2, None, 1.0)], "k int, realized double, forecast double")
    assert [(r["k"], r["m"]) for r in large.groupBy("k").agg(E.steady_mean(F.col("realized")).alias("m")).orderBy("k").collect()] == [(1, 2e30), (2, None)]


def test_strict_dates_and_price_windows(spark):
    days = spark.createDataFrame([("2024-02-29",), (None,)], "d string")
    assert [str(r["x"]) for r in days.select(T.iso_date(F.col("d")).alias("x")).collect()] == ["2024-02-29", "None"]
    for bad in ("15-03-2026", "2024-02-30", "2024-1-5"):
        with pytest.raises(Exception, match="not a date"):
            spark.createDataFrame([(bad,)], "d string").select(T.iso_date(F.col("d"))).collect()
    series = spark.createDataFrame([("A", dt.date(2024, 1, k), float(k) if k != 2 else None) for k in (1, 2, 3, 4)], "symbol string, date date, close double")
    assert [r["close"] for r in M.price_window(series, "A", "2024-01-01", "2024-01-04").orderBy("date").collect()] == [1.0, 3.0]
    with pytest.raises(ValueError, match="no prices"):
        M.price_window(series, "B", "2024-01-01", "2024-01-04")
    monkey = spark.createDataFrame([(f"s{k}",) for k in range(M.MOST_SYMBOLS + 1)], "symbol string")
    with pytest.raises(ValueError, match="symbols"):
        M.pair_with_symbols(days, monkey)


def test_last_rows_are_padded(spark):
    vector = spark.createDataFrame([("A", dt.date(2024, 1, k), 10.0 + k) for k in range(1, 4)] + [("B", dt.date(2024, 1, k), 20.0 + k) for k in range(1, 8)], "symbol string, date date, market_close double")
    assert {r["symbol"]: r["closes"] for r in X.last_padded(vector).collect()} == {"A": [11.0, 11.0, 11.0, 12.0, 13.0], "B": [23.0, 24.0, 25.0, 26.0, 27.0]}


def test_classifier_outputs(spark):
    raw = ['[[{"label": "a", "score": "0.5"}, 3, {"score": 1}]]', '[{"label": "b", "score": 2}, null]', '{"label": "a"}', "[]", "[[]]", None, '[{"label": 1, "score": "x"}]']
    got = [[tuple(x) for x in r.s] for r in spark.createDataFrame([(k, x) for k, x in enumerate(raw)], "k int, raw string").orderBy("k").select(S.label_scores(F.col("raw")).alias("s")).collect()]
    assert got == [[("a", 0.5), ("", 1.0)], [("b", 2.0)], [], [], [], [], [("1", 0.0)]]

    def missing():
        raise OSError("no checkpoint")

    load = S.first_that_loads(missing, lambda: lambda texts: [[[{"label": "hawkish", "score": float(len(t))}]] for t in texts])
    chunks = spark.createDataFrame([(1, 0, ["ab", "c"])], "doc_id long, chunk int, tokens array<string>")
    assert [tuple(r) for r in S.score_chunks(chunks, load).collect()] == [(1, 0, "hawkish", 4.0)]
    with pytest.raises(OSError):
        S.first_that_loads(missing)()


def test_word_frequencies_tell_labels(spark):
    rows = [(["Raise", "rates", ""], "hawkish"), (["raise", "x"], "hawkish"), (["cut", "rates"], "dovish"), (["hold"], "neutral"), (["noise"], "other"), (["noise"], None)]
    model, priors = S.fit_words(spark.createDataFrame(rows, "tokens array<string>, label string"))
    known = {r["word"]: r for r in model.collect()}
    assert set(known) == {"raise", "rates", "x", "cut", "hold"} and known["raise"]["hawkish"] == pytest.approx(math.log(3 / 9)) and priors["hawkish"] == pytest.approx(math.log(3 / 7))
    chunks = spark.createDataFrame([(1, 0, ["RAISE", "raise"]), (2, 0, ["cut"]), (3, 0, ["unknown"]), (4, 0, []), (5, 0, None)], "doc_id long, chunk int, tokens array<string>")
    native = {(r.doc_id, r.label): r.score for r in S.score_words(chunks, model, priors).collect()}
    loaded = {(r.doc_id, r.label): r.score for r in S.score_chunks(chunks.where("doc_id < 5"), S.word_scorer(model, priors)).collect()}
    assert all(native[k] == pytest.approx(v) for k, v in loaded.items()) and len(native) == 15
    best = {d: max(S.LABELS, key=lambda x: native[d, x]) for d in range(1, 6)}  # noqa: B023
    assert best == {1: "hawkish", 2: "dovish", 3: "hawkish", 4: "hawkish", 5: "hawkish"}
    none, even = S.fit_words(spark.createDataFrame([], "tokens array<string>, label string"))
    assert none.count() == 0 and {x: r for x, r in even.items()} == dict.fromkeys(S.LABELS, math.log(1 / 3))


def test_pages(spark):
    html = "<title>T</title><h3>March 5, 2024</h3><main><p>One &amp; <b>two</b></p></main><script>x</script><a href='/b'>B</a>"
    page = readers.parse_pages(spark.createDataFrame([("http://x/a", html), (None, None)], "url string, html string"))
    row = readers.articles(page, F.lit("statement")).where("url = 'http://x/a'").first()
    assert (row["date"], row["text"]) == ("2024-03-05", "One & two")
    assert [r["href"] for r in readers.links(page, "x", "b").collect()] == ["http://x/b"]


def test_elements_by_precedence(spark):
    grid = "<div class='x col-md-8 col-xs-12 col-sm-8'><ul><li>in <i>grid</i><li>second</ul><br></div>"
    pages = {
        "grid": f"<main><p>main</main>{grid}<article><p>article</article><p>loose",
        "article": "<article><p>one<p>two</article><main><p>main</p></main>",
        "plain": "<title>T</title><p>loose</p><style>p{}</style><div>rest</div>",
        "date": "<h3>January 1, 2020</h3><time>no date</time><time>on march 3, 2021</time><p class='big article__time'>Released May 4, 2022</p>",
    }
    got = {r["url"]: r for r in readers.parse_pages(spark.createDataFrame(list(pages.items()), "url string, html string")).collect()}
    assert [got[k]["body"] for k in ("grid", "article", "plain")] == ["in grid\nsecond", "one\ntwo", "T loose rest"]
    row = readers.articles(spark.createDataFrame([got["date"]], readers._PAGE), F.lit("minutes")).first()
    assert (row["date"], row["title"]) == ("2022-05-04", "FOMC minutes 2022-05-04")


def test_calendar_pages(spark):
    html = "<a href='/cal/hist2019.htm'>2019</a><a href='/cal/hist2020.htm'>2020</a><a href='/cal/hist2019.htm'>again</a><a href='/other'>x</a>"
    parsed = readers.parse_pages(spark.createDataFrame([("http://h/cal/", html), ("http://h/b", html)], "url string, html string"))
    assert [r["url"] for r in readers.calendar_pages(parsed, "http://h/cal/", "/hist[0-9]{4}[.]htm$").collect()] == ["http://h/cal/hist2020.htm", "http://h/cal/hist2019.htm", "http://h/cal/"]


def test_gradient_by_differences():
    rng = np.random.default_rng(2)
    x, y = rng.normal(0, 1, (7, 5, 5)), rng.normal(0, 1, (7, 2))
    model = O.Forecaster(O.Config(hidden=3, layers=2, head=4))
    g = model.gradient(x, y)
    assert g.keys() == model.w.keys()
    for name, p in model.w.items():
        for at in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(4)]:
            old, step = p[at], 1e-6
            p[at] = old + step
            up = model.loss(x, y)
            p[at] = old - step
            down = model.loss(x, y)
            p[at] = old
            assert abs((up - down) / (2 * step) - g[name][at]) < 1e-5, name


def test_models_are_kept_adapted_and_swept(spark, tmp_path):
    rows = [(s, f"2024-01-{k + 1:02}", 0.5, 0.5 + 0.01 * k * (1 if s == "A" else -1), 0.1, 0.0, 0.0) for s in "AB" for k in range(16)] + [("C", "2024-01-01", 0.5, 0.4, 0.1, 0.0, 0.0)]
    scaled = spark.createDataFrame(rows, "symbol string, date string, sentiment_score double, market_close double, market_volatility double, close_change_pct double, volatility_change double")
    O.save_models(O.train(scaled, O.Config(hidden=4, head=4, epochs=5)), f"{tmp_path}/models")
    models = O.load_models(scaled, f"{tmp_path}/models")
    meta = {r["symbol"]: r for r in models.collect()}
    assert meta["C"]["loss"] is None and meta["A"]["epochs"] == 5 and meta["A"]["close_scale"] == O.CLOSE_SCALE and json.loads(meta["A"]["config"])["hidden"] == 4
    plain, adapted = (sorted(map(tuple, O.forecast(scaled, models, 2, adapt=a).collect())) for a in (False, True))
    assert len(plain) == 6 and {r[4] for r in plain} == {None} and all(1 <= r[4] <= O.ADAPT_EPOCHS for r in adapted if r[0] != "C") and plain[4:] == adapted[4:] and plain[0] != adapted[0]
    a = O.Forecaster.from_bytes(meta["A"]["config"], meta["A"]["weights"])
    last = O._windows(scaled.where("symbol = 'A'").toPandas())[2]
    assert abs(a.one_step(last)[0] - plain[0][2]) < 1e-6
    trials = O.sweep(scaled, spark.createDataFrame([(1, 2, 0.01), (2, 4, 0.02)], "trial int, hidden int, learning_rate double"), O.Config(epochs=3))
    best = O.train_best(scaled, trials, O.Config(epochs=2)).first()
    assert json.loads(best["config"])["hidden"] in (2, 4)
    with pytest.raises(ValueError):
        O.train_best(scaled, trials.where("symbol = 'C'"))
    assert (O._windows(scaled.limit(0).toPandas())[2] == np.zeros((5, 5))).all()


def test_forecaster():
    rng = np.random.default_rng(1)
    x, y = rng.normal(0, 0.1, (40, 5, 5)), np.abs(rng.normal(0.5, 0.1, (40, 2)))
    model = O.Forecaster(O.Config())
    before = model.loss(x, y)
    got = model.fit(x, y)
    assert model.loss(x, y) < before and all(v >= 0 for v in got.values())
    assert model.roll(x[0], 3).shape == (3, 2) and (model.roll(x[0], 3)[:, 1] >= 0).all()
