"""Linear recurrences y[t] = q * y[t-1] + u[t] as block scans.

A series is cut into chunks of CHUNK rows. Inside a chunk the recurrence is a running sum of scaled inputs; what earlier
chunks carry into it is a fold of a few of their last values, as q**CHUNK is tiny. All recurrences of one call share the
passes. A recurrence forgets: after about 40 / alpha rows its start no longer shows in a double, so blocks of a series
with so many rows before them run independently of each other.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import SERIES, by_time
from quillon.operators.blocks import CHUNK, in_blocks

#: exp(-FORGET) is below what a double can tell from nothing.
FORGET = 40.0


class Scan(NamedTuple):
    """out = recurrence over column x with weight alpha (above 0, 1 at most), from the mean of its first `seed` values on."""

    out: str
    x: str
    alpha: float
    seed: int

    def memory(self) -> int:
        """Rows after which the start of the recurrence no longer shows."""
        return self.seed + (1 if self.alpha >= 1 else math.ceil(FORGET / -math.log1p(-self.alpha)))


def wilder(out: str, x: str, period: int) -> Scan:
    """Wilder's moving average: the seed is the mean of the first period values."""
    return Scan(out, x, 1.0 / period, period)


def exponential(out: str, x: str, span: int) -> Scan:
    """Exponential moving average without adjustment, defined from the first value on."""
    return Scan(out, x, 2.0 / (span + 1), 1)


def _fold(fade: float) -> Callable[[Column, Column], Column]:
    return lambda total, tail: total * fade + tail


def scan_blocks(df: DataFrame, scans: list[Scan]) -> DataFrame:
    """linear_scans inside the blocks that in_blocks makes."""
    if not scans:
        return df
    upto = by_time().rowsBetween(Window.unboundedPreceding, 0)
    step = {}
    for k, s in enumerate(scans):
        x = F.col(s.x)
        step[f"_n{k}"] = F.count(x).over(upto)
        step[f"_mean{k}"] = F.avg(x).over(upto)
    df = df.withColumns(step)
    fed = {}
    for k, s in enumerate(scans):
        x, n = F.col(s.x), F.col(f"_n{k}")
        fed[f"_u{k}"] = F.when((n == s.seed) & x.isNotNull(), F.col(f"_mean{k}")).when(n > s.seed, x * s.alpha).otherwise(0.0)
        fed[f"_gap{k}"] = F.max((x.isNull() & (n > 0)).cast("int")).over(upto)
    df = df.withColumns(fed)
    place = F.pmod("_r", F.lit(CHUNK))
    inside = by_time("_c").rowsBetween(Window.unboundedPreceding, 0)
    local, long = {}, []
    for k, s in enumerate(scans):
        u, q = F.col(f"_u{k}"), 1.0 - s.alpha
        if q <= 0:
            local[f"_y{k}"] = u
        elif -math.log(q) * CHUNK > 600:  # the scaled inputs would not fit into a double, but few rows are remembered
            recent = F.collect_list(u).over(by_time().rowsBetween(-math.ceil(FORGET / -math.log(q)), 0))
            local[f"_y{k}"] = F.aggregate(recent, F.lit(0.0), _fold(q))
        else:
            local[f"_y{k}"] = F.pow(F.lit(q), place) * F.sum(u * F.pow(F.lit(q), -place)).over(inside)
            long.append(k)
    df = df.withColumns(local)
    earlier = Window.partitionBy(SERIES).orderBy("_c")
    carried = {}
    for k in long:
        fade = (1.0 - scans[k].alpha) ** CHUNK
        terms = 1 + math.ceil(FORGET / -math.log(fade))
        tails = F.collect_list(F.when(place == CHUNK - 1, F.col(f"_y{k}"))).over(earlier.rangeBetween(-terms, -1))
        carried[f"_c{k}"] = F.aggregate(tails, F.lit(0.0), _fold(fade))
    df = df.withColumns(carried)
    done = {}
    for k, s in enumerate(scans):
        value = F.col(f"_y{k}")
        if k in long:
            value = value + F.pow(F.lit(1.0 - s.alpha), place + 1) * F.col(f"_c{k}")
        done[s.out] = F.when((F.col(f"_n{k}") >= s.seed) & (F.col(f"_gap{k}") == 0), value)
    df = df.withColumns(done)
    return df.drop(*[f"_{x}{k}" for x in ("n", "gap", "mean", "u", "y", "c") for k in range(len(scans))])


def linear_scans(df: DataFrame, scans: list[Scan]) -> DataFrame:
    """df with a column for each scan. Leading NULLs are skipped; a NULL after the first value makes all later rows NULL;
    series with fewer values than the seed needs are NULL throughout."""
    return in_blocks(df, lambda d: scan_blocks(d, scans), max(s.memory() for s in scans), [s.x for s in scans])
