"""Table functions for SQL: chunks of tokens, nested groups of records, and returns of price series."""

from __future__ import annotations

import json
import statistics
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import DataType, DateType, DoubleType, IntegerType, StringType, StructType

from ledgertide.operators.market import VOL_WINDOW
from ledgertide.sources.scans import groups_of


def _row(**columns: DataType) -> StructType:
    """The type of a function's rows; analyze() runs where no session can parse a schema."""
    out = StructType()
    for name, kind in columns.items():
        out.add(name, kind)
    return out


class TokenChunks:
    """token_chunks(text, size, stride): (chunk, n_tokens, tokens) of a text's tokens, windows of `size` every `stride`, the last one reaching the end. A null
    text has none, an empty one an empty chunk."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument, stride: AnalyzeArgument) -> AnalyzeResult:
        for name, x in (("size", size), ("stride", stride)):
            if not x.isConstantExpression or x.value is None or x.value < 1:
                raise ValueError(f"{name} must be a positive constant")
        if stride.value > size.value:
            raise ValueError("chunks would leave tokens out: stride is larger than size")
        return AnalyzeResult(_row(chunk=IntegerType(), n_tokens=IntegerType(), tokens=StringType()))

    def eval(self, text: str, size: int, stride: int) -> Iterator[tuple]:
        if text is None:
            return
        tokens, start, chunk = text.split(" "), 0, 0
        while start == 0 or start + (size - stride) < len(tokens):
            part = tokens[start : start + size]
            yield chunk, len(part), " ".join(part)
            start, chunk = start + stride, chunk + 1


class RecordGroups:
    """record_groups(json): (grp, idx, record) of every list of records nested anywhere in a JSON text, in the order of their beginnings. A text that is no
    JSON has none."""

    @staticmethod
    def analyze(payload: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(_row(grp=IntegerType(), idx=IntegerType(), record=StringType()))

    def eval(self, payload: str) -> Iterator[tuple]:
        try:
            parsed = json.loads(payload) if payload is not None else None
        except ValueError:
            return
        for g, records in enumerate(groups_of(parsed)):
            for i, r in enumerate(records):
                yield g, i, json.dumps(r, sort_keys=True)


class SeriesReturns:
    """series_returns(TABLE(symbol, date, close)): (symbol, date, close, ret, volatility) of each row, in partitions by symbol and in the order of dates, which the
    function asks for itself. Only the last returns are held. One symbol is one task; market.with_volatility has no such limit on its plan."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not {"symbol", "date", "close"} <= set(rows.dataType.names):
            raise ValueError("series_returns takes a table with symbol, date and close")
        return AnalyzeResult(_row(symbol=StringType(), date=DateType(), close=DoubleType(), ret=DoubleType(), volatility=DoubleType()), partitionBy=[PartitioningColumn("symbol")], orderBy=[OrderingColumn("date")])

    def __init__(self) -> None:
        self.before: float | None = None
        self.returns: list[float | None] = []

    def eval(self, row) -> Iterator[tuple]:
        close = row["close"]
        ret = close / self.before - 1 if self.before and close is not None else None
        self.returns = [*self.returns, ret][-VOL_WINDOW:]
        whole = len(self.returns) == VOL_WINDOW and None not in self.returns
        self.before = close
        yield row["symbol"], row["date"], close, ret, statistics.stdev(self.returns) if whole else 0.0


FUNCTIONS = {"token_chunks": TokenChunks, "record_groups": RecordGroups, "series_returns": SeriesReturns}


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL by their names."""
    for name, cls in FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls))
