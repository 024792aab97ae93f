"""Windows, sums and ranks over blocks of one series against loops over the whole series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import by_time
from quillon.operators import bars as B
from quillon.operators import blocks
from quillon.operators import dataset as D
from quillon.operators import evaluate as E
from quillon.operators import features as X
from quillon.operators import regimes as R
from quillon.operators.blocks import in_blocks, numbered, plain, running
from quillon.operators.ranks import trailing_share

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def small(monkeypatch):
    """Blocks of a few rows, so that a short series has many."""
    monkeypatch.setattr(blocks, "CHUNK", 4)
    monkeypatch.setattr(blocks.in_blocks, "__defaults__", (8, (), 16, 0))
    monkeypatch.setattr(blocks.running, "__defaults__", (16,))


def series(spark, n, seed, names=("A", "B")):
    rng = np.random.default_rng(seed)
    rows = []
    for name in names:
        at = T0
        for _ in range(n):
            at += dt.timedelta(minutes=int(rng.choice([15, 30, 3000])))
            rows.append((name, at, float(rng.integers(90, 110)), str(rng.choice(["up", "down", "flat"])), bool(rng.random() < 0.9)))
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, close double, regime string, fine boolean").repartition(5), rows


def by_series(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_places_are_shared(spark):
    df, rows = series(spark, 60, 1)
    once = numbered(df, ["close"])
    assert numbered(once, ["close"]) is once and numbered(once) is once and plain(once).columns == df.columns
    want = {(n, r[1]): k for n, part in by_series(rows).items() for k, r in enumerate(part)}
    assert {(r["series_id"], r["ts"]): r["_r"] for r in once.collect()} == want


def test_looking_ahead_and_back(spark, small):
    df, rows = series(spark, 90, 2)
    out = in_blocks(df, lambda d: d.withColumns({"ahead": F.lead("close", 3).over(by_time()), "back": F.lag("close", 5).over(by_time())}), 5, ahead=3)
    got = {(r["series_id"], r["ts"]): (r["ahead"], r["back"]) for r in out.collect()}
    assert len(got) == 180 and out.count() == 180
    for name, part in by_series(rows).items():
        for k, r in enumerate(part):
            want = (part[k + 3][2] if k + 3 < len(part) else None, part[k - 5][2] if k >= 5 else None)
            assert got[name, r[1]] == want


def test_running_sums(spark, small):
    df, rows = series(spark, 70, 3)
    got = {(r["series_id"], r["ts"]): r["s"] for r in running(df, {"s": F.col("close").cast("long")}).collect()}
    for name, part in by_series(rows).items():
        for r, want in zip(part, np.cumsum([int(x[2]) for x in part]).tolist(), strict=True):
            assert got[name, r[1]] == want


def test_runs_and_transitions(spark, small):
    df, rows = series(spark, 80, 4)
    df = df.withColumn("regime", F.when(F.col("fine"), F.col("regime")))
    got = sorted((r["series_id"], r["run_id"], r["regime"], r["first_ts"], r["last_ts"], r["n_bars"]) for r in R.runs(df).collect())
    want, moves = [], {}
    for name, part in sorted(by_series(rows).items()):
        scored, k, before = [r for r in part if r[4]], 0, None
        for r in scored:
            if r[3] == before:
                last = want[-1]
                want[-1] = (*last[:4], r[1], last[5] + 1)
            else:
                k += 1
                want.append((name, k, r[3], r[1], r[1], 1))
            if before is not None:
                moves[before, r[3]] = moves.get((before, r[3]), 0) + 1
            before = r[3]
    assert got == want
    assert {(r["from_regime"], r["to_regime"]): r["n"] for r in R.transitions(df).collect()} == moves


def test_runs_end_at_gaps(spark, small):
    df, rows = series(spark, 80, 4)
    df = df.withColumn("regime", F.when(F.col("fine"), F.col("regime")))
    got = sorted((r["series_id"], r["run_id"], r["regime"], r["first_ts"], r["last_ts"], r["n_bars"]) for r in R.runs(df, gaps_end=True).collect())
    want = []
    for name, part in sorted(by_series(rows).items()):
        k, before = 0, None
        for r in part:
            now = r[3] if r[4] else None
            if now is not None and now == before:
                want[-1] = (*want[-1][:4], r[1], want[-1][5] + 1)
            elif now is not None:
                k += 1
                want.append((name, k, now, r[1], r[1], 1))
            before = now
    assert got == want and len(want) > R.runs(df).count()


def test_summed_returns_step_over_missing_closes(spark, small):
    df, rows = series(spark, 90, 6)
    df = df.withColumn("close", F.when(F.col("fine"), F.col("close")).when(F.col("regime") == "up", 0.0))
    got = {(r["series_id"], r["ts"]): r["sum_20"] for r in R.summed_return(df).collect()}
    gaps = 0
    for name, part in by_series(rows).items():
        x = [np.log(r[2]) if r[4] else None for r in part]
        for k, r in enumerate(part):
            known = k >= 20 and x[k] is not None and x[k - 20] is not None
            assert got[name, r[1]] == (pytest.approx(x[k] - x[k - 20], abs=1e-12) if known else None)
            gaps += known and None in x[k - 20 : k]
    assert gaps > 20 and len(got) == 180


def test_targets_windows_and_splits(spark, small):
    df, rows = series(spark, 100, 5)
    df = D.target(df.withColumn("is_warmup", ~F.col("fine")))
    got = {(r["series_id"], r["ts"]): r for r in D.windows(df, ["close"], 4).collect()}
    want = 0
    for name, part in by_series(rows).items():
        for k, r in enumerate(part):
            some = part[max(0, k - 3) : k + 1]
            if len(some) == 4 and all(x[4] for x in some) and k + 1 < len(part):
                want += 1
                found = got[name, r[1]]
                assert found["row_index"] == k and [v[0] for v in found["x"]] == [x[2] for x in some] and found["y"] == float(part[k + 1][2] > r[2])
    assert len(got) == want > 20
    split = D.chronological_split(df.select("series_id", "ts"), 0.2, 7).groupBy("series_id", "part").count().collect()
    assert {(r["series_id"], r["part"]): r["count"] for r in split} == {(n, p): c for n in "AB" for p, c in (("train", 73), ("purge", 7), ("val", 20))}
    stats = {r["column_name"]: r for r in D.scaler_statistics(df.withColumn("regime", F.lit("x")), ["close"], 4).collect()}
    values = [v[0] for r in got.values() for v in r["x"]]
    assert stats["close"]["n"] == len(values) and stats["close"]["mean"] == pytest.approx(np.mean(values)) and stats["close"]["std"] == pytest.approx(np.std(values))


def test_positions_of_several_models(spark, small):
    df, rows = series(spark, 60, 6)
    df = df.crossJoin(spark.createDataFrame([("one", 0.0), ("two", 0.45)], "model string, shift double")).withColumn("p", (F.col("close") - 90) / 20 + F.col("shift"))
    got = {(r["model"], r["series_id"], r["ts"]): r["turnover"] for r in E.positions(df, 0.6, ("model",)).collect()}
    assert len(got) == 240
    for model, shift in (("one", 0.0), ("two", 0.45)):
        for name, part in by_series(rows).items():
            before = 0.0
            for r in part:
                now = 1.0 if (r[2] - 90) / 20 + shift >= 0.6 else -1.0
                assert got[model, name, r[1]] == abs(now - before) / 2
                before = now


def test_session_ends_are_found_over_block_edges(spark, small):
    df, rows = series(spark, 90, 7)
    got = {(r["series_id"], r["ts"]): (r["bar_of_day"], r["is_session_close"]) for r in B.session_columns(df).collect()}
    for name, part in by_series(rows).items():
        place = 0
        for k, r in enumerate(part):
            place = place + 1 if k and part[k - 1][1].date() == r[1].date() else 0
            assert got[name, r[1]] == (place, k + 1 == len(part) or part[k + 1][1].date() != r[1].date())


def brute_share(x, rows, least):
    out = []
    for k, v in enumerate(x):
        seen = [u for u in x[max(0, k + 1 - rows) : k + 1] if u == u]
        out.append(np.nan if v != v or len(seen) < least else (sum(u < v for u in seen) + (sum(u == v for u in seen) + 1) / 2) / len(seen))
    return np.array(out)


@pytest.mark.parametrize("rows,least", [(1, 1), (2, 1), (7, 3), (100, 20), (5000, 10)])
def test_trailing_ranks_are_those_of_a_sorted_window(rows, least):
    rng = np.random.default_rng(rows)
    for x in (rng.integers(0, 9, 400).astype(float), rng.normal(size=300), np.zeros(50), np.full(20, np.nan), np.zeros(0)):
        x = np.where(rng.random(len(x)) < 0.1, np.nan, x)
        assert np.allclose(trailing_share(x, rows, least), brute_share(x, rows, least), equal_nan=True, atol=1e-12)


def test_ranks_over_more_rows_than_a_halo(spark):
    """A window of 4,000 rows needs more rows before a block than averages do."""
    rng = np.random.default_rng(9)
    closes = (200 + rng.normal(0, 1, 12000).cumsum()).round(2)
    rows = [("A", T0 + dt.timedelta(minutes=15 * k), *[float(c)] * 4) for k, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, open double, high double, low double, close double")
    found = X.bollinger(df, rank_rows=4000).orderBy("ts").select("bb_bandwidth", "bb_bandwidth_pctile").toPandas()
    x = found.bb_bandwidth.to_numpy(float)
    got = found.bb_bandwidth_pctile.to_numpy(float)
    at = np.concatenate([np.arange(0, 300), np.arange(8150, 8250), np.arange(11900, 12000)])
    for k in at:
        seen = x[max(0, k - 3999) : k + 1]
        seen = seen[~np.isnan(seen)]
        want = np.nan if np.isnan(x[k]) or len(seen) < 250 else ((seen < x[k]).sum() + ((seen == x[k]).sum() + 1) / 2) / len(seen)
        assert (np.isnan(want) and np.isnan(got[k])) or got[k] == pytest.approx(want, abs=1e-12)


def brute_auc(rows):
    up, down = [p for p, y in rows if y], [p for p, y in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in up for b in down) / (len(up) * len(down)) if up and down else None


def test_area_under_the_curve_by_ranges(spark):
    rng = np.random.default_rng(14)
    rows = [(str(rng.choice(["m", "n"])), float(rng.integers(0, 30)) if rng.random() < 0.6 else float(rng.normal(15, 9)), int(rng.random() < 0.3)) for _ in range(600)]
    rows += [("m", 7.0, 1)] * 200 + [("one", 0.5, 1)]
    df = spark.createDataFrame(rows, "model string, p double, y int").repartition(6)
    for parts in (None, 1, 3, 17):
        ranks = {(r["p"], r["n"]): r["rank"] for r in E.ranked(df, parts=parts).collect()}
        values = np.array([r[1] for r in rows])
        assert all(rank == pytest.approx((values < p).sum() + ((values == p).sum() + 1) / 2) for (p, _), rank in ranks.items())
    got = {r["model"]: r["auc"] for r in E.auc(df, ("model",)).collect()}
    for name in ("m", "n", "one"):
        want = brute_auc([(p, y) for m, p, y in rows if m == name])
        assert got[name] is None if want is None else got[name] == pytest.approx(want)
    assert E.auc(df.limit(0)).first()["auc"] is None


def test_no_task_ranks_all_rows(spark):
    """Windows over rows are dealt by range; only the totals of ranges are taken in order in one task."""
    df = spark.range(1000).select(F.col("id").cast("double").alias("p"), (F.col("id") % 2).alias("y"))
    plan = E.ranked(df)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and all("windowspecdefinition(_range" in w for w in windows)


def test_ticks_of_one_time_have_a_fixed_order(spark):
    rows = [(T0, float(v), k) for k, v in enumerate(np.random.default_rng(3).permutation(64))]
    want = None
    for parts in (1, 3, 8):
        df = spark.createDataFrame(rows, "ts timestamp_ntz, value double, event_id long").repartition(parts)
        one = B.bars(df).first()
        two = B.bars(df, sequence="event_id").first()
        assert (one["open"], one["close"]) == (0.0, 63.0) and (two["open"], two["close"]) == (rows[0][1], rows[-1][1])
        want = want or (one, two)
        assert (one, two) == want


def test_blocks_are_planned_in_threads(spark):
    from concurrent.futures import ThreadPoolExecutor

    df, _ = series(spark, 30, 8, ("A",))
    full = [("A", T0 + dt.timedelta(minutes=15 * k), 1.0, 2.0, 0.5, float(k % 7)) for k in range(60)]
    bars = spark.createDataFrame(full, "series_id string, ts timestamp_ntz, open double, high double, low double, close double")
    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(lambda k=k: X.macd(bars).count() if k % 2 else df.withColumn("x", F.lag("close").over(by_time())).count()) for k in range(12)]
        assert [j.result() for j in jobs] == [60 if k % 2 else 30 for k in range(12)]
