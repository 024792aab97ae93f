"""Column expressions that the operators share. Missing values are NULL, never NaN."""

from __future__ import annotations

from collections.abc import Sequence
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SERIES, TIME = "series_id", "ts"
#: Columns that windows by time order by before the time, as long as blocks are built in this thread; they never change
#: the order.
ORDER: ContextVar[tuple[str, ...]] = ContextVar("order", default=())


def by_time(*more: str) -> WindowSpec:
    return Window.partitionBy(SERIES, *more).orderBy(*[c for c in ORDER.get() if c not in more], TIME)


def nz(x: Column) -> Column:
    """NULL for zero, so that a division by it is NULL."""
    return F.nullif(x, F.lit(0.0))


def no(x: Column) -> Column:
    """A flag that is false where it is unknown."""
    return F.coalesce(x, F.lit(False))


def diff(x: Column, n: int = 1) -> Column:
    return x - F.lag(x, n).over(by_time())


def pct_change(x: Column, n: int = 1) -> Column:
    """Relative change; NULL on a zero base."""
    return x / nz(F.lag(x, n).over(by_time())) - 1


def ln(x: Column) -> Column:
    return F.ln(nz(x))


def full_frame(x: Column, rows: int, fn) -> Column:
    """fn over the last rows rows, NULL unless all of them have a value."""
    frame = by_time().rowsBetween(-(rows - 1), 0)
    return F.when(F.count(x).over(frame) == rows, fn(x).over(frame))


def crossing(fast: Column, slow: Column) -> Column:
    """1 where fast rises over slow, -1 where it falls below, else 0."""
    above = F.when(fast.isNotNull() & slow.isNotNull(), (fast > slow).cast("int"))
    return F.coalesce(above - F.lag(above).over(by_time()), F.lit(0)).cast("tinyint")


def any_null(columns: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles cut to digits, with no negative zero, so that engines can be compared."""
    return df.select(*[(F.round(f"`{c}`", digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])
