"""Streams fed with files in turns against the same rows as a table."""

from datetime import datetime, timedelta

import pytest
from conftest import rows_of

from ledgertide.operators import market as M
from ledgertide.streaming import state as S
from ledgertide.streaming import windows as W

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, start string"
BEGIN = datetime(2024, 3, 1)


def event(k, minutes, user=1, kind="a", value=1.0):
    return (k, None if minutes is None else BEGIN + timedelta(minutes=minutes), user, kind, value, "x")


class Feed:
    """A folder that gets one file at a time, and what a stream over it has written so far."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def add(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def drained(self, stream):
        W.drained(stream(W.event_stream(self.spark, f"{self.folder}/in", SCHEMA, files=1)), f"{self.folder}/out", f"{self.folder}/progress")
        return rows_of(self.spark.read.parquet(f"{self.folder}/out").toPandas())


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, str(tmp_path))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("size", "slide"), [("10 minutes", None), ("10 minutes", "5 minutes")])
def test_windows_in_turns_with_late_rows_and_restarts(spark, feed, size, slide):
    first = [event(1, 1, value=5.0), event(2, 1, value=7.0), event(3, 8, kind=None, value=None), event(4, None), event(5, 30, kind="b"), event(6, 12)]
    second = [event(7, 2, value=99.0), event(8, 23), event(9, 60)]  # the first is late: the watermark stands at 20 minutes
    third = [event(10, 44, value=3.0), event(11, 59, value=-1.0), event(12, 200)]  # the first is late: it stands at 50
    stream = lambda s: W.windowed(s, size, slide, delay="10 minutes")
    for rows in (first, second, third):
        feed.add(rows)
        got = feed.drained(stream)
    late = {7, 10}
    kept = frame(spark, [r for r in first + second + third if r[0] not in late])
    want = W.windowed(kept, size, slide).where("end <= TIMESTAMP'2024-03-01 03:10:00'")
    assert got == rows_of(want.toPandas())
    assert got == feed.drained(stream)  # nothing new: nothing twice


def test_windows_of_odd_rows(spark):
    rows = [event(1, 5, value=None), event(2, 5, value=4.0), event(2, 5, value=4.0), event(3, 6, kind=None, value=float("nan")), event(4, None)]
    got = {r.event_type: r for r in W.windowed(frame(spark, rows), "1 hour").collect()}
    assert got["a"].n == 3 and got["a"].open is None and got["a"].close == 4.0 and got["a"].high == 4.0 and got["a"].total == 8.0
    assert got[None].n == 1
    assert W.windowed(frame(spark, []), "1 hour").count() == 0


def plain_sessions(rows, gap):
    out = {}
    for k, ts, user, _, value, _ in sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[0])):
        own = out.setdefault(user, [])
        if not own or (ts - own[-1][1]).total_seconds() > gap:
            own.append([ts, ts, 0, 0.0])
        own[-1][1:] = [ts, own[-1][2] + 1, own[-1][3] + (value or 0)]
    return sorted(((u, *s) for u, own in out.items() for s in own), key=repr)


ODD = [event(1, 0), event(2, 10), event(3, 20.0001), event(4, 20), event(5, 200, user=None), event(6, 205, user=None, value=2.0), event(7, None), event(8, 31, user=2), event(8, 31, user=2), event(9, 40.5, user=2)]


def test_sessions_of_odd_rows(spark):
    got = sorted((tuple(r) for r in W.sessions(frame(spark, ODD), 600).collect()), key=repr)
    assert got == plain_sessions(ODD, 600)
    assert W.sessions(frame(spark, []), 600).count() == 0
    with pytest.raises(ValueError, match="gap"):
        W.sessions(frame(spark, ODD), 0)


def test_sessions_in_turns_merge_over_files(spark, feed):
    first = [event(1, 0), event(2, 12, user=2), event(3, 20)]
    second = [event(4, 9, value=3.0), event(5, 25)]  # the first joins two sessions of the first file
    third = [event(6, 300), event(7, 301, user=2)]
    fourth = [event(8, 30, value=50.0), event(9, 500)]  # the first is late
    for rows in (first, second, third, fourth):
        feed.add(rows)
        got = feed.drained(lambda s: W.session_stream(s, "11 minutes", "30 minutes"))
    kept = [r for r in first + second + third + fourth if r[0] not in (8, 9)]
    assert got == rows_of(W.sessions(frame(spark, kept), 660).toPandas())


def test_volatility_in_turns_against_the_table(spark, feed):
    day = 24 * 60
    values = [3.0, 4.0, 5.0, 4.5, 0.0, 6.0, 7.0, 6.5, 8.0, 7.0, None, 5.0, 5.5]
    rows = [event(2 * k, day * k + 600, value=v) for k, v in enumerate(values)] + [event(2 * k + 1, day * k + 300, value=-1.0) for k in range(13)]
    rows += [event(100 + k, day * k + 10, kind=None, value=1.0 + k % 3) for k in range(9)]
    turns = [[r for r in rows if r[1] < BEGIN + timedelta(days=d) and r[1] >= BEGIN + timedelta(days=d - 4)] for d in (4, 8, 12, 16)]
    turns[2].append(event(900, day * 2 + 700, value=77.0))  # late: its day came out long ago
    with S.state_store(spark):
        for t in turns:
            feed.add(t)
            got = feed.drained(lambda s: S.volatility_stream(s, "1 hour"))
    last = max(r[1] for r in rows) - timedelta(hours=1)
    table = M.daily_closes(frame(spark, rows)).where(f"date < DATE'{last.date()}'")
    want = M.with_volatility(table).select("symbol", "date", "close", "ret", "volatility_5d").toPandas()
    names = ["ret", "volatility_5d"]
    rounded = lambda f: f.assign(**{n: f[n].astype(float).round(9) for n in names})
    assert rows_of(rounded(spark.read.parquet(f"{feed.folder}/out").toPandas())) == rows_of(rounded(want))
    assert len(got) == len(want)


def test_state_of_a_silent_symbol_is_given_up(spark, feed):
    day = 24 * 60
    with S.state_store(spark):
        for rows in ([event(k, day * k, value=1.0 + k) for k in range(5)], [event(50, day * 30, kind="b")], [event(60, day * 31, value=9.0)], [event(61, day * 33, kind="b")]):
            feed.add(rows)
            feed.drained(lambda s: S.volatility_stream(s, "1 hour", expires_days=10))
    found = {(r.symbol, r.date.day if r.date.month == 3 else -1): r.ret for r in spark.read.parquet(f"{feed.folder}/out").collect()}
    assert found["a", 2] == 1.0
    assert [r.ret for r in spark.read.parquet(f"{feed.folder}/out").where("symbol = 'a' AND close = 9").collect()] == [None]


def test_closes_are_the_last_of_a_day(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    got = S.closes(events).selectExpr("symbol", "CAST(day_end AS DATE) AS date", "close")
    assert rows_of(got.toPandas()) == rows_of(M.daily_closes(events).toPandas())
    with pytest.raises(ValueError, match="two returns"):
        S.Volatility(1)
