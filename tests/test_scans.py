"""Recurrences and indicator blocks against plain loops and known values."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import rounded
from quillon.operators import features as X
from quillon.operators import scans
from quillon.operators.blocks import numbered
from quillon.operators.scans import exponential, linear_scans, wilder

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "series_id string, ts timestamp_ntz, open double, high double, low double, close double"


def frame(spark, closes, series="A"):
    rows = [(series, T0 + dt.timedelta(minutes=15 * k), *[None if c is None else float(c)] * 1, None if c is None else c + 1.0, None if c is None else c - 1.0, None if c is None else float(c)) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, SCHEMA)


def column(df, name):
    return [r[name] for r in df.orderBy("series_id", "ts").select(name).collect()]


def loop(values, period):
    out, y, seen = [], None, []
    for x in values:
        if x is None and not seen:
            out.append(None)
            continue
        seen.append(x)
        if any(v is None for v in seen):
            out.append(None)
        elif len(seen) < period:
            out.append(None)
        else:
            y = sum(seen) / period if len(seen) == period else y + (x - y) / period
            out.append(y)
    return out


@pytest.mark.parametrize("n,lead", [(5, 0), (40, 3), (900, 1)])
def test_wilder_average_is_the_loop(spark, n, lead):
    values = [None] * lead + np.random.default_rng(n).normal(100, 5, n).tolist()
    got = column(linear_scans(frame(spark, values), [wilder("y", "close", 14)]), "y")
    for a, b in zip(got, loop(values, 14), strict=True):
        assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)


def test_a_gap_after_the_first_value_ends_the_average(spark):
    got = column(linear_scans(frame(spark, [1, 2, 3, None, 5, 6]), [wilder("y", "close", 2), exponential("e", "close", 3)]), "y")
    assert got[1:3] == [1.5, 2.25] and got[3:] == [None] * 3


def test_exponential_average_starts_at_the_first_value(spark):
    values = np.random.default_rng(1).normal(10, 1, 600).tolist()
    y, want = None, []
    for x in values:
        y = x if y is None else y + 2 / 13 * (x - y)
        want.append(y)
    assert np.allclose(column(linear_scans(frame(spark, values), [exponential("y", "close", 12)]), "y"), want, atol=1e-9)


@pytest.mark.parametrize("period", [1, 2, 14])
def test_averages_of_any_weight_in_blocks(spark, period, monkeypatch):
    """A short memory, and many blocks of one series: values after a gap stay NULL, whatever block they are in."""
    from quillon.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 4 * blocks.CHUNK)
    values = np.random.default_rng(period).normal(50, 9, 9000).tolist()
    for gap in (None, 700, 5000):
        given = [None if k == gap else v for k, v in enumerate(values)]
        df = blocks.in_blocks(frame(spark, given), lambda d: scans.scan_blocks(d, [wilder("y", "close", period), exponential("e", "close", period)]), 700, ["close"], 3000)
        got, also = column(df, "y"), column(df, "e")
        want = loop(given, period)
        assert len(got) == len(given)
        for a, b in zip(got, want, strict=True):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-8)
        assert all(v is not None and v == v for v in also[:gap]) and (gap is None or set(also[gap:]) == {None})


def test_features_in_blocks_are_those_of_the_whole_series(spark):
    closes = np.random.default_rng(8).normal(0, 1, 9000).cumsum().round(2) + 500
    df = X.single("adx", frame(spark, closes.tolist()))
    assert df.count() == 9000
    high, low = closes + 1, closes - 1
    tr = [2.0] + [max(h - b, abs(h - c), abs(b - c)) for h, b, c in zip(high[1:], low[1:], closes, strict=False)]
    up, down = np.diff(high), -np.diff(low)
    plus = [None, *np.where((up > down) & (up > 0), up, 0.0).tolist()]
    minus = [None, *np.where((down > up) & (down > 0), down, 0.0).tolist()]
    a, b, c = loop(plus, 14), loop(minus, 14), loop(tr, 14)
    di = [None if x is None or z is None else (100 * x / z, 100 * y / z) for x, y, z in zip(a, b, c, strict=True)]
    dx = [None if x is None else 0.0 if sum(x) == 0 else 100 * abs(x[0] - x[1]) / sum(x) for x in di]
    for got, want in zip(column(df, "adx_14"), loop(dx, 14), strict=True):
        assert (got is None) == (want is None) and (got is None or abs(got - want) < 1e-6)


def test_rsi_is_the_loop_of_gains_and_losses(spark):
    rng = np.random.default_rng(71)
    walks = {"up": rng.uniform(0.2, 1.9, 60), "down": -rng.uniform(0.1, 0.8, 60), "still": np.zeros(60), "mixed": rng.normal(0, 1, 300), "rare": np.where(rng.random(200) < 0.05, 1.5, 0.0)}
    for name, steps in walks.items():
        closes = (1000 + np.concatenate([[0], steps.cumsum()])).tolist()
        moves = [None, *[b - a for a, b in zip(closes, closes[1:], strict=False)]]
        gains, losses = (loop([None if m is None else max(sign * m, 0.0) for m in moves], 14) for sign in (1, -1))
        want = [None if g is None else 50.0 if g == v == 0 else 100 * g / (g + v) for g, v in zip(gains, losses, strict=True)]
        got = column(X.rsi(frame(spark, closes)), "rsi_14")
        for x, y in zip(got, want, strict=True):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-8), name


def test_crossing(spark):
    from quillon.functions import crossing

    rng = np.random.default_rng(19)
    pairs = [(None if rng.random() < 0.15 else int(rng.integers(0, 4)), None if rng.random() < 0.1 else int(rng.integers(0, 4))) for _ in range(90)]
    want, before = [], None
    for f, v in pairs:
        above = None if f is None or v is None else int(f > v)
        want.append(0 if above is None or before is None else above - before)
        before = above
    rows = [("A", T0 + dt.timedelta(minutes=k), f, v) for k, (f, v) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, fast int, slow int").withColumn("x", crossing(F.col("fast"), F.col("slow")))
    assert column(df, "x") == want and {-1, 0, 1} == set(want)


def test_later_bars_never_change_earlier_features(spark):
    closes = np.random.default_rng(2).normal(100, 2, 330).round(2).tolist()
    base = X.build_features(frame(spark, closes))
    closes[320:] = [c - 11 for c in closes[320:]]
    moved = X.build_features(frame(spark, closes))
    key = [c for c in base.columns if c != "ts"]
    early = T0 + dt.timedelta(minutes=15 * 319)
    one, two = (rounded(d.where(F.col("ts") <= F.lit(early))).orderBy("ts").select(key).collect() for d in (base, moved))
    assert one == two


def test_seed_must_end_before_the_data(spark):
    df = frame(spark, range(50, 80))
    with pytest.raises(ValueError):
        X.attach_features(df, df, blocks=("rsi",))


def test_model_columns_leave_prices_and_flags_out(spark):
    names = X.model_columns(X.build_features(frame(spark, range(100, 130))))
    assert len(names) == 34 and "rsi_14" in names and "dx" not in names and "close" not in names


def test_places_are_no_model_columns(spark):
    df = frame(spark, range(100, 130))
    placed = X.build_features(numbered(df, ["open", "high", "low", "close"]))
    assert "_r" in placed.columns and X.model_columns(placed) == X.model_columns(X.build_features(df))


def test_rows_with_the_same_values_tie(spark):
    rng = np.random.default_rng(5)
    closes = np.tile(rng.uniform(0.01, 90, 20).round(2), 16).tolist()  # any 20 in a row are the same values in another order
    got = X.bollinger(frame(spark, closes)).where("bb_std is not null")
    assert got.select("bb_mid", "bb_std", "bb_bandwidth").distinct().count() == 1
    shares = [s for s in column(got, "bb_bandwidth_pctile") if s is not None]
    assert len(shares) == 301 - 249 and shares == [(n + 1) / 2 / n for n in range(250, 302)]
    flat = X.bollinger(frame(spark, [0.1] * 25)).where("bb_mid is not null")
    assert {(r["bb_mid"], r["bb_std"], r["bb_pct_b"]) for r in flat.collect()} == {(0.1, 0.0, None)}
