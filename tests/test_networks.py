"""Gradients against finite differences, training in parallel against one task, and a signal that only order shows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quillon.operators import evaluate as E
from quillon.operators import models as M
from quillon.operators import networks as N

T0 = dt.datetime(2024, 1, 1)
SMALL = {"lstm": {"units": 6}, "cnn_bilstm_attention": {"filters": 5, "units": 4}, "transformer": {"size": 8, "heads": 2, "inner": 6}}


@pytest.mark.parametrize("kind", list(SMALL))
@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_gradient_is_that_of_finite_differences(kind, dropout):
    rng = np.random.default_rng(5)
    net = N.NETWORKS[kind](7, 3, dropout=dropout, **SMALL[kind])
    w = N.first_weights(net, 1)
    w = w + 0.05 * rng.normal(size=len(w))
    x, y = rng.normal(size=(5, 7, 3)), (rng.random(5) > 0.5).astype(float)

    def at(v):
        return N.loss_and_gradient(net, v, x, y, np.random.default_rng(3))

    _, g = at(w)
    for i in rng.choice(np.flatnonzero(~N.Adam(net, 1.0).still), 80, replace=False):
        step = np.zeros_like(w)
        step[i] = 1e-5
        assert g[i] == pytest.approx((at(w + step)[0] - at(w - step)[0]) / 2e-5, rel=1e-4, abs=1e-7)


def test_networks_look_at_no_later_step():
    """A convolution and a masked attention give the same at a step, whatever comes after it."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2, 9, 3))
    p = {"c.w": N.Var(rng.normal(size=(9, 4))), "c.b": N.Var(np.zeros(4))}
    other = x.copy()
    other[:, 5:] += 1
    one, two = (N._causal(p, "c", N.const(v), 3).value for v in (x, other))
    assert np.allclose(one[:, :5], two[:, :5]) and not np.allclose(one[:, 5:], two[:, 5:])


def examples(spark, n, steps, seed, signal):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        x = rng.normal(size=(steps, 2))
        rows.append(("A", T0 + dt.timedelta(minutes=15 * k), k, "train" if k < n * 0.7 else "val", [float(v) for v in x.ravel()], float(signal(x))))
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, row_index long, part string, flat array<double>, label double")
    return df.withColumn("features", array_to_vector("flat")).drop("flat")


def test_a_step_is_the_same_whatever_the_number_of_shards(spark):
    rows = examples(spark, 90, 5, 2, lambda x: x[-1, 0] > 0).where("part = 'train'")
    mean, sd = N.feature_scale(rows, 5)
    flat = np.stack([r["features"].toArray() for r in rows.collect()]).reshape(-1, 2)
    assert np.allclose(mean, flat.mean(0)) and np.allclose(sd, flat.std(0))
    net = N.lstm(5, 2, units=4, dropout=0.0)
    w = N.first_weights(net, 3)
    got = []
    for shards in (1, 3, 40):
        blobs = N._blobs(rows, 1000, shards, 9, 5, mean, sd)
        got.append(N._gradient(blobs, net, w, 5, 0, 1, shards))
    for loss, g in got[1:]:
        assert loss == pytest.approx(got[0][0], rel=1e-6) and np.allclose(g, got[0][1], atol=1e-7)


def test_a_signal_of_order_is_learned(spark):
    """The label is whether the first input's sign turned at the step where the second is largest: no weight for single
    places can tell."""

    def signal(x):
        k = 1 + int(np.argmax(x[1:, 1]))
        return (x[k, 0] > 0) != (x[k - 1, 0] > 0)

    rows = examples(spark, 2400, 3, 8, signal).persist()
    watch = N.Plateau(patience=6)
    model = M.train(rows, "lstm", 6, 3, epochs=12, batch=420, rate=0.04, units=24, dropout=0.0, shards=4, watch=watch)
    found = M.predict(model, rows.where("part = 'val'"))
    area = E.auc(found).first()[0]
    plain = E.auc(M.predict(M.train(rows, "logistic", 6), rows.where("part = 'val'"))).first()[0]
    rows.unpersist()
    assert area == pytest.approx(max(h["val_auc"] for h in model.history), abs=1e-6)  # the best weights were kept
    assert area > 0.8 and area > plain + 0.2
    assert model.history[0]["loss"] > model.history[-1]["loss"]


def test_a_network_is_saved_and_loaded(spark, tmp_path):
    rows = examples(spark, 60, 3, 4, lambda x: x.sum() > 0)
    model = N.train_network(rows, "transformer", 3, epochs=1, batch=64, shards=2, size=8, heads=2, inner=8, blocks=1)
    M.save(model, str(tmp_path), ["a", "b"])
    again, names = M.load(str(tmp_path))
    one, two = ([r["p"] for r in M.predict(m, rows).orderBy("ts").collect()] for m in (model, again))
    assert names == ["a", "b"] and one == two and all(0 < p < 1 for p in one)


def test_plateau():
    watch, rate, seen = N.Plateau(patience=4, halve_after=2, least_rate=0.3), 1.0, []
    for figure in (0.5, 0.6, 0.6, 0.55, 0.61, 0.1, 0.1, 0.1, 0.1):
        better = watch.better(figure)
        over = watch.over()
        rate = watch.rate(rate)
        seen.append((better, rate, over))
    assert [s[0] for s in seen] == [True, True, False, False, True, False, False, False, False]
    assert [s[1] for s in seen] == [1.0, 1.0, 1.0, 0.5, 0.5, 0.5, 0.3, 0.3, 0.3] and [s[2] for s in seen] == [False] * 8 + [True]


def test_nothing_to_train_on(spark):
    with pytest.raises(ValueError, match="train"):
        N.train_network(examples(spark, 4, 3, 1, lambda x: 1.0).where("part = 'val'"), "lstm", 3)


def test_rows_of_one_class_and_no_validation(spark):
    rows = examples(spark, 30, 3, 1, lambda x: 1.0).withColumn("part", F.lit("train"))
    model = N.train_network(rows, "lstm", 3, epochs=1, shards=2, units=4)
    assert model.history[0]["val_auc"] == 0.5


def test_all_classifiers_of_the_registry_predict(spark):
    rows = examples(spark, 80, 3, 4, lambda x: x[-1, 0] > 0)
    for name in M.REGISTRY:
        found = M.predict(M.train(rows, name, 6, 3), rows).collect()
        assert len(found) == 80 and all(0 <= r["p"] <= 1 for r in found)
        assert sum((r["p"] > 0.5) == (r["y"] == 1) for r in found) > 60
