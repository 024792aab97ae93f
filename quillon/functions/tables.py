"""Recurrences that SQL can call: table functions over rows that the caller partitions and orders.

    register(spark)
    SELECT * FROM wilder(TABLE(SELECT series_id, ts, close FROM bars) PARTITION BY (series_id) ORDER BY (ts), 'close', 14)

A row goes through as it comes, with one number of state for each partition, so a partition is never held. A long series
is one partition of one task; scans.linear_scans runs it on all cores.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql.types import DoubleType, NumericType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _checked(table: AnalyzeArgument, column: AnalyzeArgument, size: AnalyzeArgument, prefix: str) -> AnalyzeResult:
    """The rows' own columns and the average. Arguments are checked when a query is analysed."""
    if not table.isTable:
        raise ValueError("the first argument must be a table: TABLE(...) PARTITION BY ... ORDER BY ...")
    if not isinstance(column.dataType, StringType) or column.value is None:
        raise ValueError("the second argument must name a column")
    if not isinstance(size.value, int) or size.value < 1:
        raise ValueError("the third argument must be a whole number of 1 or more")
    fields = {f.name: f for f in table.dataType.fields}
    if column.value not in fields:
        raise ValueError(f"the table has no column {column.value}: it has {', '.join(fields)}")
    if not isinstance(fields[column.value].dataType, NumericType):
        raise ValueError(f"{column.value} is not a number")
    name = f"{prefix}_{size.value}"
    if name in fields:
        raise ValueError(f"the table has a column {name} already")
    return AnalyzeResult(StructType([*table.dataType.fields]).add(name, DoubleType()))


class _Recurrence:
    """A running average whose first value is the mean of the first `seed`; a NULL after a value makes all later ones NULL."""

    def __init__(self) -> None:
        self.n, self.y, self.gap = 0, 0.0, False

    def step(self, x: Any, alpha: float, seed: int) -> float | None:
        if x is None:
            self.gap = self.gap or self.n > 0
        if x is None or self.gap:
            return None
        self.n += 1
        if self.n <= seed:
            self.y += x
            if self.n < seed:
                return None
            self.y /= seed
        else:
            self.y += alpha * (x - self.y)
        return self.y


class Wilder(_Recurrence):
    """wilder(TABLE, column, period): the rows with rma_<period>."""

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument, period: AnalyzeArgument) -> AnalyzeResult:
        return _checked(table, column, period, "rma")

    def eval(self, row: Row, column: str, period: int) -> Iterator[tuple]:
        yield (*row, self.step(row[column], 1.0 / period, period))


class Exponential(_Recurrence):
    """exponential(TABLE, column, span): the rows with ema_<span>."""

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument, span: AnalyzeArgument) -> AnalyzeResult:
        return _checked(table, column, span, "ema")

    def eval(self, row: Row, column: str, span: int) -> Iterator[tuple]:
        yield (*row, self.step(row[column], 2.0 / (span + 1), 1))


def register(spark: SparkSession) -> None:
    """Makes wilder and exponential known to the session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("wilder", udtf(Wilder))
    spark.udtf.register("exponential", udtf(Exponential))
