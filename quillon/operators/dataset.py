"""Windowed supervised data: targets, contiguous windows, purged splits, scalers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import SERIES, TIME, any_null, by_time, ln
from quillon.operators.blocks import in_blocks, numbered, plain
from quillon.operators.features import model_columns


def forward_return(df: DataFrame, horizon: int = 1) -> DataFrame:
    x = ln(F.col("close"))
    return in_blocks(df, lambda d: d.withColumn("fwd", F.lead(x, horizon).over(by_time()) - x), 0, ahead=horizon)


def target(df: DataFrame, horizon: int = 1) -> DataFrame:
    """y is 1 where the forward log return is positive, 0 on ties, NULL on the last rows."""
    df = forward_return(df, horizon)
    return df.withColumn("y", F.when(F.col("fwd").isNotNull(), (F.col("fwd") > 0).cast("float")))


def require_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing features: {', '.join(missing)}")
    if len(set(columns)) != len(columns):
        raise ValueError("a feature is named twice")
    return list(columns)


RETURN_COLUMNS = ["ret_1", "ret_20"]
REGIME_COLUMNS = ["regime_p_bull", "regime_p_bear", "regime_p_sideways", "regime_p_high_vol", "regime_confidence", "regime_changepoint", "regime_entropy"]


def final_features(df: DataFrame) -> list[str]:
    """The inputs of models in order: technical columns, returns, regime columns. KeyError when one is missing."""
    return require_columns(df, [*model_columns(df), *RETURN_COLUMNS, *REGIME_COLUMNS])


def _usable(df: DataFrame, columns: Sequence[str], lookback: int) -> DataFrame:
    """usable(df), inside blocks."""
    needed = [*require_columns(df, columns), "y", *(["regime"] if "regime" in df.columns else [])]
    fine = ~any_null(needed) & ~F.col("is_warmup")
    df = df.withColumn("usable", F.coalesce(fine, F.lit(False)))
    frame = by_time().rowsBetween(-(lookback - 1), 0)
    return df.withColumn("window_ok", F.sum(F.col("usable").cast("int")).over(frame) == lookback)


def usable(df: DataFrame, columns: Sequence[str], lookback: int = 32) -> DataFrame:
    """df with usable and window_ok: the last lookback rows are all usable (inputs, target and, where there is one, the
    regime not NULL, no warm-up)."""
    return in_blocks(df, lambda d: _usable(d, columns, lookback), lookback)


def windows(df: DataFrame, columns: Sequence[str], lookback: int = 32) -> DataFrame:
    """(series_id, ts, row_index, y, x) with x the lookback rows of features, oldest first, as floats."""
    row = F.array(*[F.col(c).cast("float") for c in columns])

    def build(d: DataFrame) -> DataFrame:
        frame = by_time().rowsBetween(-(lookback - 1), 0)
        return _usable(d, columns, lookback).withColumn("x", F.collect_list(row).over(frame))

    found = in_blocks(numbered(df), build, lookback)
    return found.where("window_ok").select(SERIES, TIME, F.col("_r").cast("long").alias("row_index"), "y", "x")


def require_windows(df: DataFrame, columns: Sequence[str], lookback: int = 32) -> DataFrame:
    """windows(df), or ValueError where no series has more than lookback usable rows."""
    counts = usable(df, columns, lookback).groupBy(SERIES).agg(F.count_if("usable").alias("n"))
    if counts.where(F.col("n") > lookback).isEmpty():
        raise ValueError(f"no series has more than {lookback} usable rows")
    return windows(df, columns, lookback)


def last_windows(df: DataFrame, rows: int = 9000) -> DataFrame:
    """The latest windows of all series, for a quick run."""
    return df.orderBy(F.col(TIME).desc(), SERIES).limit(rows)


def require_training(df: DataFrame, share: float = 0.15, gap: int = 33) -> DataFrame:
    """chronological_split(df), or ValueError where a series keeps no training row after the purge."""
    n = F.count("*")
    left = df.groupBy(SERIES).agg((n - F.floor(n * share) - gap).alias("left"))
    if not left.where(F.col("left") <= 0).isEmpty():
        raise ValueError(f"a series keeps no row to train on: {share:.0%} of it go to validation and {gap} rows to the gap")
    return chronological_split(df, share, gap)


def chronological_split(df: DataFrame, share: float = 0.15, gap: int = 33) -> DataFrame:
    """df with part: train, then gap purged rows, then the last share of each series as val; a short series may have no
    training rows."""
    df = numbered(plain(df))
    totals = df.groupBy(SERIES).agg(F.count("*").alias("_total"))
    n_train = F.col("_total") - F.floor(F.col("_total") * share)
    part = F.when(F.col("_r") >= n_train, "val").when(F.col("_r") >= n_train - gap, "purge").otherwise("train")
    return plain(df.join(totals, SERIES).withColumn("part", part)).drop("_total")


def scaler_statistics(df: DataFrame, columns: Sequence[str], lookback: int = 32) -> DataFrame:
    """Mean and population deviation of each feature over the rows of all windows: a row counts once for each window
    that holds it, which is a weight, so windows are not materialised. Deviations under 1e-8 count as 1."""

    def build(d: DataFrame) -> DataFrame:
        cover = F.sum(F.col("window_ok").cast("int")).over(by_time().rowsBetween(0, lookback - 1))
        return _usable(d, columns, lookback).withColumn("_w", cover)

    rows = in_blocks(df, build, lookback, ahead=lookback).where("_w > 0")
    long = rows.select("_w", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["_w"], list(columns), "column_name", "v")
    sums = long.groupBy("column_name").agg(F.sum("_w").alias("n"), (F.sum(F.col("_w") * F.col("v")) / F.sum("_w")).alias("mean"))
    spread = long.join(F.broadcast(sums), "column_name").groupBy("column_name", "n", "mean").agg((F.sum(F.col("_w") * F.pow(F.col("v") - F.col("mean"), 2)) / F.first("n")).alias("_var"))
    sd = F.sqrt("_var")
    return spread.select("column_name", "n", "mean", F.when(sd < 1e-8, 1.0).otherwise(sd).alias("std"))


def scaled(df: DataFrame, statistics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with columns standardised by statistics(column_name, mean, std), which become one row that goes to all tasks;
    columns that the statistics lack become NULL."""
    of = {c: [F.max(F.when(F.col("column_name") == c, F.col(x))).alias(f"_{x}_{k}") for x in ("mean", "std")] for k, c in enumerate(columns)}
    one = statistics.agg(*[x for pair in of.values() for x in pair])
    out = df.crossJoin(F.broadcast(one))
    out = out.withColumns({c: ((F.col(c).cast("double") - F.col(f"_mean_{k}")) / F.col(f"_std_{k}")).cast("float") for k, c in enumerate(columns)})
    return out.drop(*[f"_{x}_{k}" for k in range(len(columns)) for x in ("mean", "std")])


def require_fitted(statistics: DataFrame) -> DataFrame:
    """RuntimeError where a scaler has no statistics."""
    if statistics.isEmpty():
        raise RuntimeError("the scaler is not fitted")
    return statistics
