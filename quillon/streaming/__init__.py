"""The live twin: ticks to bars with a watermark, and moving averages that carry their state from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from quillon.functions import SERIES, TIME
from quillon.sources import scratch_folder
from quillon.streaming.indicators import bar_stream, live_indicators, state_in_rocksdb

#: Files that bars are written to before they are streamed.
BAR_FILES = 4


def tick_stream(spark: SparkSession, folder: str, table: str = "events", series: str = "event_type", files_per_batch: int = 8) -> DataFrame:
    """The table's file, or all files of its folder, as a stream of (series_id, ts, seq, value); seq orders ticks of one
    time."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    # a pattern may match a file as well as a folder; a plain path must be a folder
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{table}.[p]arquet")
    return raw.select(F.col(series).alias(SERIES), F.col("ts").alias(TIME), F.col("event_id").cast("long").alias("seq"), F.col("value").cast("double").alias("value"))


def live_bars(ticks: DataFrame, width: str = "15 minutes", late: str | None = "2 days") -> DataFrame:
    """Bars of a tick stream. With `late` an interval closes when the watermark has passed it, and later ticks are
    dropped; without it all intervals stay open and every tick counts, which suits a bounded run."""
    if late is not None:
        ticks = ticks.withColumn(TIME, F.col(TIME).cast("timestamp")).withWatermark(TIME, late)
    spans = ticks.groupBy(SERIES, F.window(TIME, width).alias("w"))
    order = F.struct(TIME, "seq")
    found = spans.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("n_ticks"))
    return found.select(SERIES, F.col("w.start").alias(TIME), "open", "high", "low", "close", "n_ticks")


def live_average(ticks: DataFrame, alpha: float, column: str = "value") -> DataFrame:
    """(series_id, n, average) after each batch: y += alpha * (x - y) over the rows of each series in the order in which
    they arrive, by time and seq within a batch. Two numbers a series are carried, no row is skipped; NULLs count as no
    row."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, value = state.get if state.exists else (0, 0.0)
        rows = pd.concat([p[[TIME, "seq", column]] for p in parts]).dropna(subset=[column]).sort_values([TIME, "seq"])
        for x in rows[column].tolist():
            value = x if not n else value + alpha * (x - value)
            n += 1
        if n:
            state.update((n, value))
            yield pd.DataFrame({SERIES: [key[0]], "n": [n], "average": [value]})

    return ticks.groupBy(SERIES).applyInPandasWithState(step, f"{SERIES} string, n long, average double", "n long, value double", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, keys: list[str], folder: str | None = None) -> DataFrame:
    """Runs a stream in update mode over all that is there now and returns the last row of each key, from a scratch folder.
    With a folder that an earlier run has used, it goes on from where that one ended."""
    spark = stream.sparkSession
    path = folder or scratch_folder(stream.sparkSession, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces what it wrote
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/state").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/out")
    values = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in values])


def stream_average(spark: SparkSession, d: str) -> DataFrame:
    """The moving average of all ticks by type, as a stream ends with it."""
    out = drained(live_average(tick_stream(spark, d), 2.0 / 13), [SERIES])
    return out.select(SERIES, "n", (F.round("average", 6) + 0.0).alias("last_average"))


def stream_bars(spark: SparkSession, d: str) -> DataFrame:
    """The bars of all ticks by type, as a stream ends with them."""
    out = drained(live_bars(tick_stream(spark, d), late=None), [SERIES, TIME])
    return out.select(SERIES, TIME, *[(F.round(c, 6) + 0.0).alias(c) for c in ("open", "high", "low", "close")], "n_ticks")


def _bar_files(spark: SparkSession, d: str) -> str:
    """The bars of all ticks by type as files, one for each stretch of time, oldest first."""
    from quillon.plans import _bars

    path = scratch_folder(spark, "bar-files")
    bars = _bars(spark, d).select(SERIES, TIME, "close").persist()
    first, last = bars.agg(F.min(TIME), F.max(TIME)).first()
    edges = [] if first is None else [first + (last - first) * k / BAR_FILES for k in range(1, BAR_FILES)]
    for k, (low, high) in enumerate(zip([None, *edges], [*edges, None], strict=True)):
        part = bars if low is None else bars.where(F.col(TIME) >= F.lit(low))
        part = part if high is None else part.where(F.col(TIME) < F.lit(high))
        part.coalesce(1).write.mode("overwrite" if k == 0 else "append").parquet(path)
    bars.unpersist()
    return path


def stream_indicators(spark: SparkSession, d: str) -> DataFrame:
    """RSI, an average and causal regimes of all bars, as a stream of files of bars gives them."""
    from quillon.plans import FIXED_MODEL

    with state_in_rocksdb(spark):
        out = drained(live_indicators(bar_stream(spark, _bar_files(spark, d)), FIXED_MODEL), [SERIES, TIME])
    names = [c for c in out.columns if c not in (SERIES, TIME, "stale")]
    return out.where("not stale").select(SERIES, F.col(TIME).cast("timestamp_ntz").alias(TIME), *[(F.round(c, 6) + 0.0).alias(c) for c in names])


QUERIES = {"stream_indicators": stream_indicators, "stream_average": stream_average, "stream_bars": stream_bars}
