"""Streams over a file and over a folder of parts give what a batch gives."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import bars as B
from quillon.operators.regimes import Hmm
from quillon.plans import FIXED_MODEL
from quillon.streaming import drained, live_average, live_bars, tick_stream
from quillon.streaming.indicators import PROVIDER, bar_stream, live_indicators, state_in_rocksdb

T0 = dt.datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The same ticks in five files, some with equal times."""
    folder = str(tmp_path_factory.mktemp("ticks"))
    df = spark.read.parquet(f"{SF}/events.parquet")
    df.withColumn("ts", F.date_trunc("minute", "ts").cast("timestamp_ntz")).repartitionByRange(5, "ts", "event_id").sortWithinPartitions("ts", "event_id").write.parquet(f"{folder}/events.parquet")
    return folder


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.select("series_id", "ts", "open", "high", "low", "close", "n_ticks").collect())


def test_bars(spark, parts):
    for folder in (SF, parts):
        got = drained(live_bars(tick_stream(spark, folder, files_per_batch=2), late=None), ["series_id", "ts"])
        ticks = spark.read.parquet(f"{folder}/events.parquet").withColumn("at", F.struct("ts", "event_id"))
        want = ticks.groupBy(F.col("event_type").alias("series_id"), F.window("ts", "15 minutes").start.alias("ts")).agg(
            F.min_by("value", "at").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "at").alias("close"), F.count("*").alias("n_ticks")
        )
        assert rows(got) == rows(want)


def test_bars_with_a_watermark_are_a_part_of_all_bars(spark, parts):
    got = drained(live_bars(tick_stream(spark, parts)), ["series_id", "ts"]).count()
    assert 0 < got <= B.bars(spark.read.parquet(f"{parts}/events.parquet"), series="event_type").count()


def test_every_tick_counts_in_the_average(spark, parts):
    for folder in (SF, parts):
        got = {r["series_id"]: r for r in drained(live_average(tick_stream(spark, folder, files_per_batch=8), 0.2), ["series_id"]).collect()}
        want = {}
        for r in spark.read.parquet(f"{folder}/events.parquet").orderBy("ts", "event_id").collect():
            n, y = want.get(r["event_type"], (0, 0.0))
            want[r["event_type"]] = (n + 1, r["value"] if not n else y + 0.2 * (r["value"] - y))
        assert {k: (r["n"], round(r["average"], 9)) for k, r in got.items()} == {k: (n, round(y, 9)) for k, (n, y) in want.items()}


@pytest.fixture
def feed(spark, tmp_path):
    """Bars of three series: one with a gap and leading bars without a close, one that stops early. Written file by file."""
    rng = np.random.default_rng(41)
    rows = []
    for name, n in (("A", 120), ("B", 90), ("C", 40)):
        closes = (100 + rng.normal(0, 1, n).cumsum()).round(2).tolist()
        if name == "B":
            closes[:2] = [None, None]
            closes[70] = None
        rows += [(name, T0 + dt.timedelta(minutes=15 * k), c) for k, c in enumerate(closes)]
    folder = str(tmp_path / "bars")

    def write(low, high):
        some = [r for r in rows if low <= (r[1] - T0).total_seconds() / 900 < high]
        spark.createDataFrame(some, "series_id string, ts timestamp_ntz, close double").coalesce(1).write.mode("append").parquet(folder)

    return rows, folder, write


def expected(rows):
    """RSI over 14, an average over 12 and filtered states of each bar, by loops."""
    h, out = Hmm(FIXED_MODEL), {}
    for name in sorted({r[0] for r in rows}):
        part = sorted(r for r in rows if r[0] == name)
        closes, gain, loss, ema, n, gap, p = [], 0.0, 0.0, None, 0, False, None
        for _, ts, c in part:
            gap = gap or (c is None and n > 0)
            rsi = None
            if c is not None and not gap:
                n += 1
                ema = c if n == 1 else ema + 2 / 13 * (c - ema)
                if n > 1:
                    up, down = max(c - before, 0), max(before - c, 0)
                    gain, loss = (gain + up, loss + down) if n <= 15 else (gain + (up - gain) / 14, loss + (down - loss) / 14)
                    if n == 15:
                        gain, loss = gain / 14, loss / 14
                    if n >= 15:
                        rsi = 100 * gain / (gain + loss)
                before = c
            closes.append(c)
            seen = None
            if len(closes) > 20 and None not in (closes[-1], closes[-2], closes[-21]):
                x = np.array([[np.log(closes[-1] / closes[-2]), np.log(closes[-1] / closes[-21])]])
                b = np.exp(h.log_density(x)[0])
                p = (h.start if p is None else p @ h.trans) * b
                p = seen = p / p.sum()
            out[name, ts] = (rsi, None if gap or not n else ema, seen)
    return out


def live(spark, folder, **options):
    stream = live_indicators(bar_stream(spark, folder), FIXED_MODEL, (14,), (12,), **options)
    return stream.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def check(found, want):
    assert {(r["series_id"], r["ts"]) for r in found} == set(want)
    for r in found:
        for got, x in zip((r["rsi_14"], r["ema_12"], r["p0"], r["p3"]), (*want[r["series_id"], r["ts"]][:2], *((None, None) if want[r["series_id"], r["ts"]][2] is None else want[r["series_id"], r["ts"]][2][[0, 3]])), strict=True):
            assert (got is None) == (x is None) and (x is None or got == pytest.approx(x, abs=1e-8))


def test_state_outlives_a_restart(spark, feed, tmp_path):
    """A query that is started again on its checkpoint goes on from the state, and bars that come twice count once."""
    rows, folder, write = feed
    at = str(tmp_path / "query")
    before = spark.conf.get(PROVIDER, None)
    with state_in_rocksdb(spark):
        write(0, 33)
        one = drained(live(spark, folder), ["series_id", "ts", "stale"], at).count()
        write(25, 80)
        write(80, 130)
        found = drained(live(spark, folder), ["series_id", "ts", "stale"], at).where("not stale").collect()
    assert spark.conf.get(PROVIDER, None) == before
    assert one == 99
    check(found, expected(rows))


def test_a_series_that_falls_behind_is_stale_once_and_then_forgotten(spark, feed, tmp_path):
    rows, folder, write = feed
    for low in range(0, 120, 20):
        write(low, low + 20)
    # bars of C from long after its last one: its state is gone by then
    back = [("C", T0 + dt.timedelta(minutes=15 * k), 50.0 + k % 3) for k in (130, 131)]
    with state_in_rocksdb(spark):
        at = str(tmp_path / "query")
        found = drained(live(spark, folder, stale_after_s=900 * 20, forget_after_s=900 * 40), ["series_id", "ts", "stale"], at)
        stale = found.where("stale").collect()
        last = {"B": 89, "C": 39}
        assert "C" in {r["series_id"] for r in stale} and all(r["ts"] == T0 + dt.timedelta(minutes=15 * last[r["series_id"]]) and r["ema_12"] is None for r in stale)
        spark.createDataFrame(back, "series_id string, ts timestamp_ntz, close double").coalesce(1).write.mode("append").parquet(folder)
        again = drained(live(spark, folder, stale_after_s=900 * 20, forget_after_s=900 * 40), ["series_id", "ts", "stale"], at)
        new = again.where(F.col("ts") >= F.lit(back[0][1])).where("series_id = 'C'").orderBy("ts").collect()
    assert [r["ema_12"] for r in new] == pytest.approx([back[0][2], back[0][2] + 2 / 13 * (back[1][2] - back[0][2])])
