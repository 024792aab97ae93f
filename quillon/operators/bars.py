"""From ticks and raw rows to clean bars: aggregation, session columns, first-copy de-duplication, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import SERIES, TIME, by_time, pct_change
from quillon.operators.blocks import in_blocks

PRICES = ["open", "high", "low", "close"]
SESSION_START, SESSION_END, SESSION_BARS = "09:15", "15:15", 25


def bars(ticks: DataFrame, value: str = "value", time: str = "ts", series: str | None = None, width: str = "15 minutes", sequence: str | None = None) -> DataFrame:
    """Open, high, low, close and number of ticks of every interval that has ticks.

    Ticks of one time are in the order of sequence, a whole number, where there is one, else of their values, so that the
    order of rows never shows.
    """
    name = F.lit("ALL") if series is None else F.col(series)
    if sequence is None:
        at = F.struct(F.col(time), F.col(value))
    else:  # one number of time and sequence, as aggregates of numbers need no sort
        micros = F.unix_micros(F.col(time).cast("timestamp")).cast("decimal(18,0)")
        at = (micros * F.lit(str(2 * 10**19)).cast("decimal(20,0)") + F.col(sequence).cast("decimal(19,0)")).cast("decimal(38,0)")
    spans = ticks.select(name.alias(SERIES), at.alias("_t"), F.col(value).alias("_v"), F.window(time, width).start.alias(TIME))
    return spans.groupBy(SERIES, TIME).agg(
        F.min_by("_v", "_t").alias("open"),
        F.max("_v").alias("high"),
        F.min("_v").alias("low"),
        F.max_by("_v", "_t").alias("close"),
        F.count("*").alias("n_ticks"),
    )


def regular_session(df: DataFrame, start: str = SESSION_START, end: str = SESSION_END) -> DataFrame:
    return df.where(F.date_format(TIME, "HH:mm").between(start, end))


def first_copies(df: DataFrame, sequence: str = "ingest_seq") -> DataFrame:
    """Of rows with one timestamp, the first by sequence (file order); dropDuplicates would keep any."""
    rank = F.row_number().over(Window.partitionBy(SERIES, TIME).orderBy(sequence))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def session_columns(df: DataFrame) -> DataFrame:
    day = F.date_format(TIME, "yyyy-MM-dd")
    df = df.withColumn("session_date", day)
    place = F.row_number().over(by_time("session_date")) - 1
    df = in_blocks(df, lambda d: d.withColumn("_after", F.lead("session_date").over(by_time())), 0, ahead=1)
    return df.withColumns(
        {
            "bar_of_day": place.cast("smallint"),
            "is_session_open": place == 0,
            "is_session_close": F.coalesce(F.col("_after") != F.col("session_date"), F.lit(True)),
        }
    ).drop("_after")


def integrity(df: DataFrame) -> DataFrame:
    """One row for each series: counts of bad rows, null cells, sessions, the range and the largest move."""
    wrong = (F.col("high") < F.col("low")) | (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
    flat = df.withColumn("_move", F.abs(pct_change(F.col("close"))) * 1e4)
    main = flat.groupBy(SERIES).agg(
        F.count("*").alias("n_rows"),
        F.count_if(wrong).alias("ohlc_violations"),
        sum((F.count_if(F.col(c) <= 0) for c in PRICES), F.lit(0)).cast("long").alias("non_positive"),
        sum((F.count_if(F.col(c).isNull()) for c in PRICES), F.lit(0)).cast("long").alias("null_cells"),
        F.min(TIME).alias("first_ts"),
        F.max(TIME).alias("last_ts"),
        F.max("_move").alias("max_abs_return_bps"),
    )
    return main


def session_audit(df: DataFrame, bars_per_session: int = SESSION_BARS) -> DataFrame:
    sizes = df.groupBy(SERIES, F.date_format(TIME, "yyyy-MM-dd").alias("session_date")).agg(F.count("*").alias("n"))
    return sizes.groupBy(SERIES).agg(
        F.count("*").alias("n_sessions"),
        F.count_if(F.col("n") < bars_per_session).alias("short_sessions"),
        (F.lit(bars_per_session) * F.count("*") - F.sum("n")).cast("long").alias("missing_bars"),
    )


def short_sessions(df: DataFrame, top: int = 10, bars_per_session: int = SESSION_BARS) -> DataFrame:
    """The shortest sessions, a report of `top` rows."""
    sizes = df.groupBy(SERIES, F.date_format(TIME, "yyyy-MM-dd").alias("session_date")).agg(F.count("*").alias("n_bars"))
    return sizes.where(F.col("n_bars") < bars_per_session).orderBy("n_bars", "session_date", SERIES).limit(top)


def session_invariants(df: DataFrame) -> DataFrame:
    """One row for each series with session columns: sessions, open and close flags, longest session, largest first
    place; in clean bars the first three are equal and the last is 0."""
    firsts = df.groupBy(SERIES, "session_date").agg(F.count("*").alias("n"), F.min_by("bar_of_day", TIME).alias("first"), F.count_if("is_session_open").alias("opens"), F.count_if("is_session_close").alias("closes"))
    return firsts.groupBy(SERIES).agg(
        F.count("*").alias("n_sessions"), F.sum("opens").alias("n_opens"), F.sum("closes").alias("n_closes"), F.max("n").alias("longest"), F.max("first").alias("largest_first")
    )


def outside_sessions(df: DataFrame, start: str = SESSION_START, end: str = SESSION_END) -> DataFrame:
    """By series the rows outside the regular session and their dates, sorted, as one text."""
    out = df.where(~F.date_format(TIME, "HH:mm").between(start, end))
    dates = F.array_sort(F.collect_set(F.date_format(TIME, "yyyy-MM-dd")))
    return out.groupBy(SERIES).agg(F.count("*").alias("n_rows"), F.size(dates).alias("n_dates"), F.array_join(dates, ",").alias("dates"))


def null_census(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = columns or df.columns
    counts = df.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return counts.unpivot([], names, "column_name", "n_null").where("n_null > 0")


def overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """Timestamps that both splits have; none may."""
    return train.select(SERIES, TIME).intersect(test.select(SERIES, TIME))


def require_after(train: DataFrame, test: DataFrame) -> None:
    """Raises ValueError unless every series of train ends strictly before test begins."""
    ends = train.groupBy(SERIES).agg(F.max(TIME).alias("_end"))
    begins = test.groupBy(SERIES).agg(F.min(TIME).alias("_begin"))
    if not ends.join(begins, SERIES).where("_end >= _begin").isEmpty():
        raise ValueError("the seed must end strictly before the data begin")
