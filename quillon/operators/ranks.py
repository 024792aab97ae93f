"""Trailing ranks: the place of a value among the last rows, in O(n log n) for any number of rows.

Inside a block, values are replaced by their order and kept in a wavelet matrix: for each bit of the order, how many
values up to each place have a zero there. Walking the bits down answers, for all rows at once, how many values of a
window are smaller and how many equal.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from quillon.functions import SERIES


class Rank(NamedTuple):
    """out = average rank of x among the non-null values of the last rows rows, as a share; NULL with under least values."""

    out: str
    x: str
    rows: int = 1000
    least: int = 250


def below_and_equal(order: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: how many of order[low:high] are smaller than the value there, and how many are equal."""
    values, own = order.copy(), order
    low, high, below = low.copy(), high.copy(), np.zeros(len(order), np.int64)
    for bit in range(int(order.max(initial=0)).bit_length() - 1, -1, -1):
        ones = (values >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~ones)])
        low0, high0 = zeros[low], zeros[high]
        up = (own >> bit & 1).astype(bool)
        below += np.where(up, high0 - low0, 0)
        low = np.where(up, zeros[-1] + low - low0, low0)
        high = np.where(up, zeros[-1] + high - high0, high0)
        values = np.concatenate([values[~ones], values[ones]])
    return below, high - low


def trailing_share(x: np.ndarray, rows: int, least: int) -> np.ndarray:
    """Average rank of each value among those of the last rows rows (NaN: none), as a share of them."""
    fine = ~np.isnan(x)
    upto = np.concatenate([[0], np.cumsum(fine)])
    at = np.flatnonzero(fine)
    low, high = upto[np.maximum(at + 1 - rows, 0)], upto[at + 1]
    below, equal = below_and_equal(np.unique(x[fine], return_inverse=True)[1], low, high)
    out = np.full(len(x), np.nan)
    n = high - low
    out[at] = np.where(n >= least, (below + 0.5 * equal + 0.5) / np.maximum(n, 1), np.nan)
    return out


def rank_blocks(df: DataFrame, ranks: list[Rank]) -> DataFrame:
    """df with the ranks, inside the blocks that in_blocks makes: one pass over Arrow tables, a block at a time."""
    if not ranks:
        return df
    schema = StructType([*df.schema.fields, *[StructField(r.out, DoubleType()) for r in ranks]])

    def add(block: pa.Table) -> pa.Table:
        order = np.argsort(block["_r"].to_numpy(), kind="stable")
        for r in ranks:
            x = block[r.x].cast(pa.float64()).to_numpy(zero_copy_only=False)[order] if block.num_rows else np.zeros(0)
            shares = np.empty(len(x))
            shares[order] = trailing_share(x, r.rows, r.least)
            block = block.append_column(r.out, pa.array(shares, from_pandas=True))
        return block

    return df.groupBy(SERIES).applyInArrow(add, schema)
