"""Bars, sources, windows, evaluation and regimes on small fixtures."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import sources
from quillon.operators import bars as B
from quillon.operators import dataset as D
from quillon.operators import evaluate as E

T0 = dt.datetime(2024, 1, 1)


def test_raw_csv_and_first_copies(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("date,time,open,high,low,close,pivot\n02-01-2024,09:30:00+05:30,1,2,1,2,9\n02-01-2024,09:15:00+05:30,1,3,1,2,9\n02-01-2024,09:15:00+05:30,5,6,5,5,9\n")
    df = sources.read_raw_bars(spark, str(path))
    assert "src_pivot" in df.columns
    rows = B.first_copies(df).orderBy("ts").collect()
    assert [r["high"] for r in rows] == [3.0, 2.0]
    (tmp_path / "bad.csv").write_text("date,open\n1,2\n")
    with pytest.raises(ValueError, match="time"):
        sources.read_raw_bars(spark, str(tmp_path / "bad.csv"))


def test_splits_and_models_are_stored_and_read(spark, tmp_path):
    df = spark.range(3).withColumnRenamed("id", "x")
    sources.write_split(df, str(tmp_path / "t"), "train")
    sources.write_split(df.where("x = 0"), str(tmp_path / "t"), "test")
    assert sources.read_split(spark, str(tmp_path / "t"), "train").count() == 3
    assert sources.read_split(spark, str(tmp_path / "t"), "test").count() == 1
    with pytest.raises(FileNotFoundError):
        sources.read_split(spark, str(tmp_path / "none"), "train")
    sources.write_model(spark, {"a": [1.5, 2]}, str(tmp_path / "m"))
    assert sources.read_model(spark, str(tmp_path / "m")) == {"a": [1.5, 2]}


def predictions(spark, y, p):
    rows = [("A", T0 + dt.timedelta(minutes=k), float(a), float(b)) for k, (a, b) in enumerate(zip(y, p, strict=True))]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double, p double")


def counted(y, p, t):
    """tn, fp, fn, tp by a loop."""
    out = [0, 0, 0, 0]
    for a, b in zip(y, p, strict=True):
        out[2 * int(a) + int(b >= t)] += 1
    return tuple(out)


@pytest.mark.parametrize("seed,t", [(11, 0.5), (12, 0.31), (13, 0.69)])
def test_metrics_against_a_loop(spark, seed, t):
    rng = np.random.default_rng(seed)
    y, p = rng.integers(0, 2, 57), rng.random(57).round(2)
    r = E.classification_metrics(predictions(spark, y, p), t).first()
    tn, fp, fn, tp = counted(y, p, t)
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (tn, fp, fn, tp) and r["n"] == 57 and r["threshold"] == t
    assert r["precision"] == pytest.approx(tp / (tp + fp)) and r["recall"] == pytest.approx(tp / (tp + fn))
    assert r["mcc"] == pytest.approx(np.corrcoef(y, p >= t)[0, 1]) and r["brier"] == pytest.approx(((p - y) ** 2).mean())
    pairs = [(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]]
    assert r["auc"] == pytest.approx(np.mean(pairs))


def test_predictions_of_one_value(spark):
    r = E.classification_metrics(predictions(spark, [1, 0, 0, 1, 0, 0, 0], [0.2] * 7), 0.5).first()
    assert r["accuracy"] == pytest.approx(5 / 7) and r["mcc"] == 0 and r["precision"] == 0 and r["f1"] == 0 and r["auc"] == 0.5
    only = E.classification_metrics(predictions(spark, [1, 1], [0.7, 0.4]), 0.5).first()
    assert only["auc"] is None and only["recall"] == 0.5


def test_thresholds_lie_on_the_grid_and_go_by_model(spark):
    rng = np.random.default_rng(21)
    y = rng.integers(0, 2, 240)
    low = predictions(spark, y, np.where(y == 1, 0.42, 0.36)).withColumn("model", F.lit("low"))
    high = predictions(spark, y, np.where(y == 1, 0.66, 0.61)).withColumn("model", F.lit("high"))
    found = {r["model"]: r["threshold"] for r in E.pick_thresholds(low.unionByName(high)).collect()}
    assert 0.36 < found["low"] <= 0.42 and 0.61 < found["high"] <= 0.66
    assert E.pick_threshold(low) == found["low"]


def test_costs_and_turnover(spark):
    side = [1, -1, -1, 1, -1, 1, 1]
    fwd = [0.01, 0.02, -0.03, 0.0, -0.01, 0.005, -0.002]
    df = predictions(spark, [1] * 7, [0.5 + 0.3 * s for s in side])
    times = spark.createDataFrame([(T0 + dt.timedelta(minutes=k), f) for k, f in enumerate(fwd)], "ts timestamp_ntz, fwd double")
    df = df.join(times, "ts")
    gross = sum(a * b for a, b in zip(side, fwd, strict=True))
    flips = 0.5 + sum(a != b for a, b in zip(side, side[1:], strict=False))
    for r in E.cost_sensitivity(df, 0.5, [0.0, 4.0]).collect():
        assert r["flips"] == flips and r["gross_pct"] == pytest.approx(100 * gross)
        assert r["net_pct"] == pytest.approx(100 * (gross - flips * r["cost_bps"] / 1e4)) and r["break_even_bps"] == pytest.approx(gross / flips * 1e4)
    s = E.directional_strategy(df, 0.5, 4.0).first()
    assert s["position_flips"] == 5 and s["hit_rate"] == pytest.approx(np.mean([a * b > 0 for a, b in zip(side, fwd, strict=True)]))
    again = E.directional_strategy(df.withColumn("model", F.lit("m")), 0.5, 4.0, ("model",)).first()
    assert again["net_pct"] == pytest.approx(s["net_pct"])


def test_windows_are_contiguous(spark):
    closes = [100.0 + k % 7 for k in range(60)]
    rows = [("A", T0 + dt.timedelta(minutes=k), c, None if k == 40 else 1.0) for k, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, close double, f double")
    df = D.target(df).withColumn("is_warmup", F.lit(False))
    got = D.windows(df, ["f"], 8).orderBy("ts").collect()
    assert [r["row_index"] for r in got] == [k for k in range(59) if k >= 7 and not 40 <= k <= 47]
    with pytest.raises(KeyError):
        D.windows(df, ["absent"], 8)
    parts = {r["part"]: r["n"] for r in D.chronological_split(D.windows(df, ["f"], 8), 0.15, 9).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"train": len(got) - 6 - 9, "purge": 9, "val": 6}


def test_what_cannot_be_windowed_or_split_raises(spark):
    rows = [("A", T0 + dt.timedelta(minutes=k), 100.0 + k % 5) for k in range(40)]
    df = D.target(spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, close double")).withColumn("is_warmup", F.lit(False))
    assert D.require_windows(df, ["close"], 38).count() == 2
    with pytest.raises(ValueError, match="usable rows"):
        D.require_windows(df, ["close"], 39)
    with pytest.raises(ValueError, match="to train on"):
        D.require_training(D.windows(df, ["close"], 8), 0.15, 30)
    with pytest.raises(RuntimeError):
        D.require_fitted(D.scaler_statistics(df.limit(0), ["close"]))
    flat = D.scaled(df.withColumn("one", F.lit(1.0)), D.scaler_statistics(df.withColumn("one", F.lit(1.0)), ["one"], 8), ["one"])
    assert {r["one"] for r in flat.select("one").collect()} == {0.0}


def test_quality_report(spark):
    rows = [("A", T0 + dt.timedelta(minutes=15 * k), 5.0, 6.0, 4.0, 5.0, 1) for k in range(40)]
    df = B.session_columns(B.regular_session(spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, open double, high double, low double, close double, n_ticks long")))
    text = sources.quality_report(df, "bars", df.limit(0))
    assert "n_rows: 3" in text and "short session 2024-01-01: 3 bars" in text and "rows in both splits: 0" in text


def test_queries_match_their_sql(spark):
    """A few registered queries against DuckDB; the driver runs all of them."""
    import duckdb

    from quillon.queries import ORACLES, QUERIES

    con = duckdb.connect()
    folder = "/root/testdata/sf0.001"
    for t in ("events", "orders", "lineitem", "labels", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name in ("bars15", "session_columns", "rsi_block", "adx_block", "window_contiguity", "classification_metrics", "regime_runs", "hmm_viterbi_fixed", "metrics_by_model", "warm_start_all"):
        df = QUERIES[name](spark, folder)
        names = sorted(df.columns)
        rel = con.sql(ORACLES[name])
        order = [rel.columns.index(c) for c in names]
        key = lambda r: tuple(("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)) for v in r)
        assert sorted(key([r[c] for c in names]) for r in df.collect()) == sorted(key([r[k] for k in order]) for r in rel.fetchall()), name


def test_queries_match_their_sql_where_closes_are_zero(spark, tmp_path):
    """A close of 0 has no logarithm, so its bar has no return and no regime."""
    import duckdb

    from quillon.queries import ORACLES, QUERIES

    rng = np.random.default_rng(41)
    ticks = [(k, T0 + dt.timedelta(minutes=15 * (k // 2)), "ab"[k % 2], 0.0 if k % 34 in (7, 9, 20) else round(rng.uniform(1, 90), 2)) for k in range(300)]
    con = duckdb.connect()
    con.sql("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, event_type VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?)", ticks)
    con.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    for name in ("rolling_return", "regime_runs", "model_matrix"):
        df = QUERIES[name](spark, str(tmp_path))
        rel = con.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(rel.columns), name
        order = [rel.columns.index(c) for c in df.columns]
        key = lambda r: tuple(("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)) for v in r)
        assert sorted(key(r) for r in df.collect()) == sorted(key([r[k] for k in order]) for r in rel.fetchall()), name
