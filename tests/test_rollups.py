"""Sketches, moments, calendar frames, ranks and version differences on odd rows."""

import math
import random
import statistics
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgertide.operators import frames as R
from ledgertide.operators import sketches as S
from ledgertide.operators import versions as V

EVENTS = "ts timestamp, event_type string, user_id long, value double, n int"


@pytest.fixture(scope="module")
def events(spark):
    rng, begin = random.Random(1), datetime(2024, 1, 1)
    rows = [(begin + timedelta(minutes=rng.randrange(10 * 1440)), "a" if rng.random() < 0.9 else None, int(rng.paretovariate(0.4)) % 20_000, rng.gauss(0, 50), 0) for _ in range(30_000)]
    rows += [(None, "a", 1, 1.0, 0), (begin, "b", None, None, 0), (begin, "b", None, float("nan"), 0)]
    return spark.createDataFrame(rows, EVENTS).repartition(5)


def test_merged_days_keep_their_error_bounds(events):
    days = S.daily(events)
    rows = {r.event_type: r for r in S.estimates(S.merged(days, "event_type"), [0.1, 0.5, 0.99]).collect()}
    for kind in ("a", None):
        own = [r for r in events.where("ts IS NOT NULL").collect() if r.event_type == kind]
        got, users, values = rows[kind], Counter(r.user_id for r in own), sorted(r.value for r in own)
        assert got.n == len(own) and abs(got.distinct_users - len(users)) <= 4 * S.HLL_ERROR * len(users)
        for q, v in zip((0.1, 0.5, 0.99), got.quantiles, strict=True):
            assert abs(sum(x <= v for x in values) / len(values) - q) <= 2 * S.KLL_ERROR + 1 / len(values)
        for user, n in users.most_common(3):
            found = dict((x["item"], x["count"]) for x in got.frequent_users)
            assert abs(found[user] - n) <= 2 * len(own) / S.TOP_ITEMS
    assert rows["b"].n == 2 and rows["b"].distinct_users == 0 and rows["b"].quantiles is None
    assert S.daily(events.limit(0)).count() == 0


def test_days_are_added_once_and_roll_up(spark, events, tmp_path):
    path = f"file://{tmp_path}/sketches"
    first = events.where("ts < '2024-01-05'")
    assert S.add_days(spark, first, path) == 4 and S.add_days(spark, first, path) == 0
    assert S.add_days(spark, events, path) == 6
    kept = spark.read.parquet(path)
    assert kept.groupBy("day", "event_type").count().where("count > 1").count() == 0
    one = {r.event_type: r for r in S.estimates(S.merged(kept, "event_type"), [0.5]).collect()}
    all_ = {r.event_type: r for r in S.estimates(S.merged(S.daily(events), "event_type"), [0.5]).collect()}
    near = lambda a, b: a.n == b.n and abs(a.distinct_users - b.distinct_users) <= 4 * S.HLL_ERROR * b.distinct_users
    assert one.keys() == all_.keys() and all(near(one[k], all_[k]) for k in all_)
    weeks = S.merged(S.merged(kept, F.weekofyear("day").alias("week"), F.col("event_type")), "event_type")
    assert all(near(r, all_[r.event_type]) for r in S.estimates(weeks, [0.5]).collect())


def test_moments_of_odd_rows(spark):
    rng = random.Random(2)
    rows = [("k", 1e9 + rng.random(), 1e9 + rng.random()) for _ in range(400)] + [(None, float(i), 2.0 * i) for i in range(9)] + [("one", 1.0, 2.0), ("flat", 1.0, 1.0), ("flat", 1.0, 5.0), ("k", None, 1.0), ("k", float("nan"), 1.0), ("none", None, None)]
    parts = S.partial_moments(spark.createDataFrame(rows, "key string, x double, y double").repartition(7), "key", "x", "y")
    got = {r.key: r for r in S.agreement(S.merged_moments(parts, "key"), "key").collect()}
    assert set(got) == {"k", None, "one", "flat"}
    xs, ys = zip(*[(x, y) for k, x, y in rows if k == "k" and x is not None and not math.isnan(x)], strict=True)
    assert got["k"].n == 400 and got["k"].correlation == pytest.approx(statistics.correlation(xs, ys), abs=1e-6) and got["k"].stddev_x == pytest.approx(statistics.stdev(xs), rel=1e-6)
    assert got["k"].rmse == pytest.approx(math.sqrt(sum((a - b) ** 2 for a, b in zip(xs, ys, strict=True)) / 400))
    assert got[None].correlation == pytest.approx(1.0) and got["one"].stddev_x is None and got["one"].correlation is None and got["flat"].correlation is None and got["flat"].rmse == pytest.approx(math.sqrt(8))
    stored_again = S.merged_moments(S.merged_moments(parts, "key").unionByName(parts.limit(0)), "key")
    assert stored_again.count() == 4 and S.merged_moments(parts.limit(0), "key").count() == 0


@pytest.mark.parametrize("stretch", [1, 5, 366])
def test_calendar_frames_in_stretches(spark, stretch):
    rng, begin = random.Random(3), date(1969, 12, 1)
    rows = [(s, begin + timedelta(days=rng.randrange(120)), rng.choice([None, rng.random(), rng.random()])) for s in ("a", None, "b") for _ in range(60)] + [("a", None, 1.0)]
    got = R.calendar_volatility(spark.createDataFrame(rows, "symbol string, date date, ret double"), 10, stretch).collect()
    want = []
    for s, d, r in rows:
        if d:
            own = [x for t, e, x in rows if t == s and e and 0 <= (d - e).days < 10 and x is not None]
            want.append((s, d, r, len(own), round(statistics.stdev(own), 9) if len(own) > 1 else None))
    assert sorted(((x.symbol, x.date, x.ret, x.n, None if x.volatility is None else round(x.volatility, 9)) for x in got), key=repr) == sorted(want, key=repr)
    with pytest.raises(ValueError, match="day"):
        R.calendar_volatility(spark.createDataFrame(rows[:1], "symbol string, date date, ret double"), 0)


@pytest.mark.parametrize("tiles", [1, 3, 10])
def test_ranks_of_ties(spark, tiles):
    rng = random.Random(4)
    rows = [(k, rng.choice([1.0, 2.0, 2.5, 7.0, None]), i) for k in ("a", None) for i in range(23)] + [("few", 1.0, 0), ("few", 1.0, 1)]
    frame = spark.createDataFrame(rows, "k string, x double, i int")
    got = sorted(((r.k, r.i, r.position, r.rank, r.dense_rank, r.tile) for r in R.ranks(frame.withColumnRenamed("k", "key"), "x", "key", "i", tiles).withColumnRenamed("key", "k").collect()), key=repr)
    frame.createOrReplaceTempView("ranked")
    w = "OVER (PARTITION BY k ORDER BY x"
    want = spark.sql(f"SELECT k, i, row_number() {w}, i), rank() {w}), dense_rank() {w}), ntile({tiles}) {w}, i) FROM ranked WHERE x IS NOT NULL").collect()
    assert got == sorted((tuple(r) for r in want), key=repr)


COLUMNS = "id string, part string, text string"
OLD = [("1", "p", "x"), ("2", "p", None), ("3", "q", "same"), ("3", "q", "same"), ("4", "q", "gone"), (None, "r", "n"), ("6", None, "y"), ("7", "s", "moved"), ("8", "t", "a"), ("8", "t", "b")]
NEW = [("1", "p", "x"), ("2", "p", ""), ("3", "q", "same"), ("5", "q", "added"), (None, "r", "n"), ("6", None, "y"), ("7", "u", "moved"), ("8", "t", "b"), ("8", "t", "a")]


def test_changes_of_versions(spark):
    old, new = spark.createDataFrame(OLD, COLUMNS), spark.createDataFrame(NEW, COLUMNS)
    got = {r.id: r.change for r in V.record_changes(old, new, "id", "part").collect()}
    assert got == {"2": "changed", "3": "changed", "4": "gone", "5": "added", "7": "changed"}
    parts = {r.part: r.status for r in V.changed_parts(V.manifest(old, "part"), V.manifest(new, "part")).collect()}
    assert parts == {"p": "changed", "q": "changed", "s": "gone", "u": "added"}  # t has its rows in another order, r and null are equal
    assert V.record_changes(old, old, "id", "part").count() == 0 and V.record_changes(old.limit(0), new.limit(0), "id", "part").count() == 0
    assert V.record_changes(old.limit(0), new, "id", "part").count() == len({r[0] for r in NEW})


def test_multisets_against_the_engines_own(spark):
    old, new = spark.createDataFrame(OLD * 2, COLUMNS), spark.createDataFrame(NEW + NEW[:3], COLUMNS)
    names = ["id", "part", "text"]
    flat = lambda df: sorted(map(repr, (r[:3] for r in df.collect() for _ in range(r["times"]))))
    plain = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    diff = V.multiset_difference(old, new, names)
    assert flat(diff.where("change = 'added'")) == plain(new.exceptAll(old)) and flat(diff.where("change = 'gone'")) == plain(old.exceptAll(new))
    assert flat(V.multiset_common(old, new, names)) == plain(old.intersectAll(new))
