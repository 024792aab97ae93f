"""Indicators and causal regimes of a live feed of bars: state that is carried from bar to bar by series.

A series' state is one typed row in the state store: the recurrences of the RSI and of exponential averages, the last
closes, and the filtered probabilities of a regime model. Bars are taken in order of time; one that is not later than the
last is dropped. By the watermark of the feed, a series that has fallen behind is reported once as stale, and later
forgotten, so that its next bar begins anew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillon.functions import SERIES, TIME
from quillon.operators.regimes import Hmm

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bars that the longer return of a regime model looks back on.
TREND = 20


@contextmanager
def state_in_rocksdb(spark: SparkSession):
    """Inside, queries that start keep their state in RocksDB, which typed state needs; the session is left as it was."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class _Series:
    """The state of one series, and what a bar does to it."""

    def __init__(self, periods: Sequence[int], spans: Sequence[int], model: Hmm, row: tuple | None):
        self.periods, self.spans, self.model = periods, spans, model
        if row is None:
            row = (None, 0, False, False, 0.0, [0.0] * len(periods), [0.0] * len(periods), [0.0] * len(spans), [], [])
        self.last, self.n, self.gap, self.stale, self.close = row[:5]
        self.gains, self.losses, self.averages, self.logs, self.p = (list(x) for x in row[5:])

    def row(self) -> tuple:
        return (self.last, self.n, self.gap, self.stale, self.close, self.gains, self.losses, self.averages, self.logs, self.p)

    def _mean(self, values: list[float], k: int, x: float) -> None:
        """Wilder's average of changes: their sum until there are enough of them, then the recurrence."""
        period, n = self.periods[k], self.n - 1
        if n < period:
            values[k] += x
        elif n == period:
            values[k] = (values[k] + x) / period
        else:
            values[k] += (x - values[k]) / period

    def take(self, close: float | None) -> tuple[list[float | None], list[float | None], list[float] | None]:
        """RSIs, averages and probabilities after a bar, None where they are not known."""
        missing = close is None or close != close
        if missing and not self.n:
            return [None] * len(self.periods), [None] * len(self.spans), self._scored(None)
        self.gap = self.gap or missing
        if self.gap:
            return [None] * len(self.periods), [None] * len(self.spans), self._scored(close)
        self.n += 1
        step = close - self.close if self.n > 1 else None
        self.close = close
        rsi: list[float | None] = []
        for k, period in enumerate(self.periods):
            if step is not None:
                self._mean(self.gains, k, max(step, 0.0))
                self._mean(self.losses, k, max(-step, 0.0))
            gain, loss = self.gains[k], self.losses[k]
            known = self.n - 1 >= period
            rsi.append(None if not known else 50.0 if gain == loss == 0 else 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss))
        for k, span in enumerate(self.spans):
            self.averages[k] = close if self.n == 1 else self.averages[k] + 2 / (span + 1) * (close - self.averages[k])
        return rsi, list(self.averages), self._scored(close)

    def _scored(self, close: float | None) -> list[float] | None:
        """Filtered probabilities by the returns over one and over TREND bars; a bar that lacks one is passed over."""
        x = math.log(close) if close is not None and close == close and close > 0 else math.nan
        self.logs = [*self.logs, x][-TREND - 1 :]
        if len(self.logs) <= TREND:
            return None
        z = np.array([[self.logs[-1] - self.logs[-2], self.logs[-1] - self.logs[0]]])
        if np.isnan(z).any():
            return None
        logb = self.model.log_density(self.model.scaled(z))
        step = self.model.steps(logb, not self.p)[0]
        p = (np.full(len(step), 1 / len(step)) if not self.p else np.array(self.p)) @ step
        self.p = (p / p.sum()).tolist()
        return self.p


STATE = "last long, n long, gap boolean, stale boolean, close double, gains array<double>, losses array<double>, averages array<double>, logs array<double>, p array<double>"


class Indicators(StatefulProcessor):
    def __init__(self, periods: Sequence[int], spans: Sequence[int], model: dict, stale_ms: int, forget_ms: int):
        self.periods, self.spans, self.params = tuple(periods), tuple(spans), model
        self.stale_ms, self.forget_ms = stale_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", STATE)
        self.model = Hmm(self.params)

    def _load(self) -> _Series:
        return _Series(self.periods, self.spans, self.model, tuple(self.state.get()) if self.state.exists() else None)

    def _wake(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def _frame(self, rows: list[list[Any]]) -> pd.DataFrame:
        names = [SERIES, TIME, *[f"rsi_{p}" for p in self.periods], *[f"ema_{s}" for s in self.spans], *[f"p{k}" for k in range(len(self.model.start))], "stale"]
        out = pd.DataFrame(rows, columns=names)
        return out.astype({c: "float64" for c in names[2:-1]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        s, out = self._load(), []
        bars = pd.concat(list(rows)).sort_values([TIME, "close"])
        for ts, close in zip(bars[TIME], bars["close"]):
            at = int(pd.Timestamp(ts).value // 1_000_000)
            if s.last is not None and at <= s.last:
                continue
            s.last, s.stale = at, False
            rsi, averages, p = s.take(close)
            out.append([key[0], ts, *rsi, *averages, *(p or [None] * len(self.model.start)), False])
        self.state.update(s.row())
        if s.last is not None:
            self._wake(s.last + self.stale_ms)
        yield self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s = self._load()
        if s.last is None or s.stale:
            self.state.clear()
            yield self._frame([])
            return
        s.stale = True
        self.state.update(s.row())
        self.handle.registerTimer(s.last + self.forget_ms)
        blank = [None] * (len(self.periods) + len(self.spans) + len(self.model.start))
        yield self._frame([[key[0], pd.Timestamp(s.last, unit="ms"), *blank, True]])


def live_indicators(
    bars: DataFrame, model: dict, periods: Sequence[int] = (7, 14, 21), spans: Sequence[int] = (12,), delay: str = "0 seconds", stale_after_s: int = 30 * 86400, forget_after_s: int = 90 * 86400
) -> DataFrame:
    """(series_id, ts, rsi_*, ema_*, p0, p1, ..., stale) of each bar of a stream of bars(series_id, ts, close), as it comes.

    `model` takes the returns over one and over TREND bars. Averages are NULL until they have enough bars, and after a
    bar without a close; such a bar is passed over by the regime model. Bars later than `delay` behind the latest of the
    feed, and those not after the last one of their series, are dropped. A series whose last bar lies more than
    stale_after_s behind the watermark gets one row with stale set; after forget_after_s its state goes.
    """
    states = len(model["startprob"])
    columns = [*[f"rsi_{p} double" for p in periods], *[f"ema_{s} double" for s in spans], *[f"p{k} double" for k in range(states)]]
    given = bars.select(SERIES, F.col(TIME).cast("timestamp").alias(TIME), F.col("close").cast("double")).withWatermark(TIME, delay)
    processor = Indicators(periods, spans, model, stale_after_s * 1000, forget_after_s * 1000)
    schema = f"{SERIES} string, {TIME} timestamp, {', '.join(columns)}, stale boolean"
    return given.groupBy(SERIES).transformWithStateInPandas(processor, schema, "Update", "EventTime")


def bar_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Files of bars as a stream, in the order in which they were written."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
