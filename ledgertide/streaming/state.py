"""Daily closes and their rolling volatility over a stream, by state for each symbol."""

from __future__ import annotations

import statistics
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgertide.operators.market import VOL_WINDOW
from ledgertide.streaming.windows import timed

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Days without a close after which a symbol's state is given up.
EXPIRES_DAYS = 400


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside use the state store that timers and several states for a key need, and that spills to disk."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def closes(events: DataFrame, delay: str | None = None) -> DataFrame:
    """(symbol, day_end, close): the last value of each symbol and day by (ts, event_id). As a stream, a day comes out once the
    watermark has passed it, and rows of it that come later are dropped. Merged before the shuffle, so a hot symbol sends a row
    for a day and task."""
    days = timed(events, delay).groupBy(F.window("ts", "1 day").alias("window"), F.col("event_type").alias("symbol")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))
    at = F.window_time("window") if events.isStreaming else F.col("window.end") - F.expr("INTERVAL 1 MICROSECOND")
    return days.select("symbol", at.alias("day_end"), "close")


class Volatility(StatefulProcessor):
    """Keeps the last closes of a symbol: enough for `window` returns. A timer forgets symbols that have none for EXPIRES_DAYS."""

    def __init__(self, window: int = VOL_WINDOW, expires_days: int = EXPIRES_DAYS):
        if window < 2:
            raise ValueError("the window needs two returns at least")
        self.window, self.expires = window, timedelta(days=expires_days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", "closes array<double>")
        self.forget = handle.getValueState("forget", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days = pd.concat(list(rows)).sort_values("day_end")  # a day is one row, however hot the symbol
        held = list(self.recent.get()[0]) if self.recent.exists() else []
        out = []
        for day, close in zip(days["day_end"], days["close"], strict=True):
            held = [*held, None if pd.isna(close) else float(close)][-self.window - 1 :]
            back = [b / a - 1 if a and b is not None else None for a, b in zip(held, held[1:], strict=False)]
            whole = len(back) == self.window and None not in back
            out.append((key[0], day.date(), held[-1], back[-1] if back else None, statistics.stdev(back) if whole else 0.0))
        self.recent.update((held,))
        if self.forget.exists():
            self.handle.deleteTimer(self.forget.get()[0])
        at = int((days["day_end"].max() + self.expires).timestamp() * 1000)
        self.handle.registerTimer(at)
        self.forget.update((at,))
        yield pd.DataFrame(out, columns=["symbol", "date", "close", "ret", "volatility_5d"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        self.forget.clear()
        return iter([])

    def close(self) -> None:
        pass


def volatility_stream(events: DataFrame, delay: str, window: int = VOL_WINDOW, expires_days: int = EXPIRES_DAYS) -> DataFrame:
    """(symbol, date, close, ret, volatility_5d) of each day of a stream that the watermark has passed.

    Two stateful steps: last-wins closes by day, then returns and the sample deviation of the last `window` of them, 0 until there
    are so many. A null or zero close gives no return, and no deviation until it has left the window. State is one row for
    an open day and window + 1 closes for a symbol. The symbol of null events is null and has a state of its own.
    """
    days = closes(events, delay)
    return days.groupBy("symbol").transformWithStateInPandas(Volatility(window, expires_days), "symbol string, date date, close double, ret double, volatility_5d double", "Append", "eventTime")
