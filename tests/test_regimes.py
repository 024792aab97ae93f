"""The hidden Markov model in blocks against plain loops over one series."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import regimes as R

T0 = dt.datetime(2024, 1, 1)
CENTRES = np.array([[1, 2, 1, 1], [-1, -2, 1, 1], [0, 0, 1, 3], [0, 0.5, 4, 2]], float)


def frame(spark, x, series="A"):
    rows = pd.DataFrame(x, columns=R.INPUTS).assign(ts=[T0 + dt.timedelta(minutes=15 * k) for k in range(len(x))], series_id=series, is_warmup=False)
    return spark.createDataFrame(rows)


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(31)
    state = np.repeat(rng.integers(0, 4, 30), 17)
    x = CENTRES[state] + rng.normal(0, 0.3, (len(state), 4))
    old, R.BLOCK = R.BLOCK, 64
    df = frame(spark, x).unionByName(frame(spark, x[::-1].copy(), "B")).repartition(3)
    yield df, x, state, R.fit_regimes(df)
    R.BLOCK = old


def loops(model, x):
    """Filter, smoother, best path and log-likelihood row by row."""
    h = R.Hmm(model)
    logb = h.log_density(h.scaled(x))
    top = logb.max(axis=1)
    b = np.exp(logb - top[:, None])
    p, filtered, total = h.start, [], 0.0
    with np.errstate(divide="ignore"):
        moves, score = np.log(h.trans), np.log(h.start) + logb[0]
    came = []
    for t in range(len(x)):
        p = (p if t == 0 else p @ h.trans) * b[t]
        total += np.log(p.sum()) + top[t]
        p = p / p.sum()
        filtered.append(p)
        if t:
            step = score[:, None] + moves
            came.append(step.argmax(0))
            score = step.max(0) + logb[t]
    smoothed = [filtered[-1]]
    for f in filtered[-2::-1]:
        smoothed.append(f * (h.trans @ (smoothed[-1] / (f @ h.trans))))
    path = [int(score.argmax())]
    for c in came[::-1]:
        path.append(int(c[path[-1]]))
    return np.array(filtered), np.array(smoothed[::-1]), path[::-1], total


def test_blocks_give_what_loops_give(fitted):
    df, x, _, model = fitted
    found = R.decode(df, model, more=True).toPandas().sort_values(["series_id", "ts"])
    total = 0.0
    for name, rows in (("A", x), ("B", x[::-1])):
        mine = found[found.series_id == name]
        filtered, smoothed, path, part = loops(model, rows)
        total += part
        assert np.abs(np.stack(mine.posterior) - filtered).max() < 1e-9 and np.abs(np.stack(mine.smoothed) - smoothed).max() < 1e-9
        assert mine.state.tolist() == path
    assert total == pytest.approx(model["log_likelihood"], abs=1e-6)


def test_fit_recovers_states(fitted):
    df, x, state, model = fitted
    path = R.decode(df.where("series_id = 'A'"), model, more=True).orderBy("ts").toPandas().state.to_numpy()
    assert sum(np.bincount(path[state == s]).max() for s in np.unique(state)) / len(state) > 0.95
    assert np.allclose(np.array(model["transmat"]).sum(1), 1) and sorted(model["label_map"].values()) == sorted(R.NAMES)
    assert sum(r["n"] for r in model["state_stats"]) == 2 * len(x)


def test_states_are_named_by_volatility_and_trend():
    assert R.name_states([0.3, -2.0, 0.1, 5.0], [1.0, 2.0, 9.0, 1.5]) == {2: "high_vol", 3: "bull", 0: "sideways", 1: "bear"}
    assert R.name_states([0.1, 0.4], [1.0, 1.0]) == {1: "state_0", 0: "state_1"}


def test_later_rows_never_change_earlier_ones_and_unscored_rows_are_null(spark, fitted):
    df, x, _, model = fitted
    one = df.where("series_id = 'A'").withColumn("is_warmup", F.minute("ts") + F.hour("ts") * 60 + F.dayofmonth("ts") * 1440 < 1500)
    moved = one.withColumn("ret_1", F.when(F.col("ts") >= F.lit(T0 + dt.timedelta(days=4)), F.col("ret_1") * 3).otherwise(F.col("ret_1")))
    early = F.col("ts") < F.lit(T0 + dt.timedelta(days=4))
    a, b = (R.regime_columns(d, model).where(early).orderBy("ts").toPandas() for d in (one, moved))
    assert np.allclose(a.regime_confidence.dropna(), b.regime_confidence.dropna())
    assert a.regime.isna().sum() == a.is_warmup.sum() > 0 and a.regime_confidence.isna().sum() == a.is_warmup.sum()
    p = a[[c for c in a.columns if c.startswith("regime_p_")]].dropna()
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(a.regime_changepoint.dropna(), 1 - a.regime_confidence.dropna())


def test_warm_start(spark, fitted):
    df, x, _, model = fitted
    one = df.where("series_id = 'A'")
    at = F.lit(T0 + dt.timedelta(days=3))
    train, test = one.where(F.col("ts") < at), one.where(F.col("ts") >= at)
    warm = R.attach_regimes(test, model, train, seed_rows=10_000).orderBy("ts").toPandas()
    whole = R.regime_columns(one, model).where(F.col("ts") >= at).orderBy("ts").toPandas()
    assert len(warm) == test.count() and np.allclose(warm.regime_confidence, whole.regime_confidence) and (warm.regime == whole.regime).all()
    with pytest.raises(ValueError, match="strictly before"):
        R.attach_regimes(test, model, test)


def test_a_fit_that_does_not_converge_raises(fitted):
    with pytest.raises(RuntimeError, match="converge"):
        R.fit_hmm(fitted[0], iterations=1)


def test_the_fit_goes_on_until_a_step_gains_less_than_its_tolerance(fitted):
    """Another fifty steps from where it ended gain less than the tolerance each, whatever the size of the likelihood."""
    df, _, _, model = fitted
    rows = R.FitRows(df, R.INPUTS)
    try:
        before, now = model["log_likelihood"], model
        for _ in range(50):
            now = R._raised(now, R._statistics(rows.rows, {0: now}, R.INPUTS, rows.whole)[0], 1e-3)
        after = R._statistics(rows.rows, {0: now}, R.INPUTS, rows.whole)[0]["likelihood"]
    finally:
        rows.close()
    assert abs(after - before) < 50 * 1e-3


def test_fits_share_their_steps_and_the_criterion_finds_the_planted_number(spark):
    rng = np.random.default_rng(12)
    state = np.repeat(rng.integers(0, 3, 60), 15)
    x = CENTRES[state] * 2 + rng.normal(0, 0.4, (len(state), 4))
    found = R.select_states(frame(spark, x), (2, 3, 4), starts=2, tol=0.01)
    assert [r["k"] for r in found] == [2, 3, 4] and min(found, key=lambda r: r["bic"])["k"] == 3
    assert found[1]["n_parameters"] == 2 + 6 + 12 + 30 and found[1]["n_rows"] == len(x)
    alone = R.fit_hmm(frame(spark, x), states=3, tol=0.01)
    best = found[1]
    assert best["log_likelihood"] >= alone["log_likelihood"] - 1 and loops(best["model"], x)[3] == pytest.approx(best["log_likelihood"], abs=1e-6)


def test_rows_that_are_not_scored_may_fill_blocks(spark, fitted):
    """Unscored rows at the start, in between, over whole blocks and at block edges."""
    _, x, _, model = fitted
    off = np.zeros(len(x), bool)
    off[:70] = off[130:270] = off[319:321] = off[-3:] = True
    rows = pd.DataFrame(x, columns=R.INPUTS).assign(ts=[T0 + dt.timedelta(minutes=15 * k) for k in range(len(x))], series_id="A", is_warmup=off, ts_2="x")
    found = R.regime_columns(spark.createDataFrame(rows), model).orderBy("ts").toPandas()
    filtered, _, _, _ = loops(model, x[~off])
    names = [model["label_map"][str(k)] for k in range(4)]
    p = found[[f"regime_p_{n}" for n in names]].to_numpy(float)
    assert np.isnan(p[off]).all() and np.abs(p[~off] - filtered).max() < 1e-9
    regime, changed = found.regime.tolist(), found.regime_changed.tolist()
    for t in range(len(x)):
        want = False if regime[t] is None else None if t == 0 or regime[t - 1] is None else regime[t] != regime[t - 1]
        assert changed[t] is want or changed[t] == want


def test_nothing_to_score(spark):
    df = frame(spark, np.zeros((5, 4))).withColumn("is_warmup", F.lit(True))
    with pytest.raises(ValueError, match="scored"):
        R.fit_hmm(df)
