"""Neural networks over windows, trained synchronously on all cores.

Windows are packed once into blobs by (step of an epoch, shard). In a step, every shard's task takes the gradient of its
part of the step's windows, sums of gradients are formed in groups of shards, and the driver adds up one array a group
and moves the weights. After an epoch the area under the curve over the validation windows decides: the best weights
stay, the rate is halved where it doesn't rise, and training ends where it doesn't for longer.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import SERIES, TIME
from quillon.operators import evaluate as E
from quillon.operators.tape import Var, const, dropped, joined, logistic, moved, recurrent, relu, reshaped, softmax, standardised, take_back, tanh, total

#: Windows of a step, and shards whose gradients one task adds up.
BATCH, GROUP = 512, 32
#: How much of a moving statistic stays in a step.
INERTIA = 0.9


class Net(NamedTuple):
    """A network: its arrays by name, and the logits of a batch. forward(arrays, x, rng, seen) drops values at random where
    there is an rng, and puts the batch's own statistics into seen."""

    shapes: dict[str, tuple[int, ...]]
    forward: Callable[[dict[str, Var], np.ndarray, np.random.Generator | None, dict], Var]


def _lstm_shapes(name: str, inputs: int, units: int) -> dict[str, tuple[int, ...]]:
    return {f"{name}.w": (inputs, 4 * units), f"{name}.u": (units, 4 * units), f"{name}.b": (4 * units,)}


def _lstm(p: dict[str, Var], name: str, x: Var) -> Var:
    return recurrent(x, p[f"{name}.w"], p[f"{name}.u"], p[f"{name}.b"])


def _dense_shapes(name: str, inputs: int, units: int) -> dict[str, tuple[int, ...]]:
    return {f"{name}.w": (inputs, units), f"{name}.b": (units,)}


def _dense(p: dict[str, Var], name: str, x: Var) -> Var:
    return x @ p[f"{name}.w"] + p[f"{name}.b"]


def _head_shapes(inputs: int) -> dict[str, tuple[int, ...]]:
    return _dense_shapes("wide", inputs, 32) | _dense_shapes("out", 32, 1)


def lstm(steps: int, inputs: int, units: int = 64, dropout: float = 0.2) -> Net:
    """Two layers of long short-term memory, the second of half the units, and a dense layer."""
    shapes = _lstm_shapes("one", inputs, units) | _lstm_shapes("two", units, units // 2) | _head_shapes(units // 2)

    def forward(p, x, rng, seen):
        y = dropped(_lstm(p, "one", const(x)), dropout, rng)
        y = dropped(_lstm(p, "two", y)[:, -1], dropout, rng)
        return _dense(p, "out", relu(_dense(p, "wide", y)))

    return Net(shapes, forward)


def _causal(p: dict[str, Var], name: str, x: Var, kernel: int) -> Var:
    """A convolution that sees no later step: each step beside the kernel - 1 before it, zeros before the first."""
    rows, steps, inputs = x.value.shape
    shifted = []
    for k in range(kernel - 1, -1, -1):

        def back(g, k=k):
            return np.concatenate([g[:, k:], np.zeros((rows, k, inputs))], 1)

        shifted.append(Var(np.concatenate([np.zeros((rows, k, inputs)), x.value[:, : steps - k]], 1), ((x, back),)))
    return _dense(p, name, joined(shifted))


def _batch_norm(p: dict[str, Var], name: str, x: Var, training: bool, seen: dict, epsilon: float = 1e-3) -> Var:
    if training:
        seen[f"{name}.mean"], seen[f"{name}.var"] = x.value.mean((0, 1)), x.value.var((0, 1))
        y = standardised(x, (0, 1), epsilon)
    else:
        y = (x - const(p[f"{name}.mean"].value)) * const(1 / np.sqrt(p[f"{name}.var"].value + epsilon))
    return y * p[f"{name}.gain"] + p[f"{name}.shift"]


def cnn_bilstm_attention(steps: int, inputs: int, filters: int = 64, kernel: int = 3, units: int = 48, dropout: float = 0.2) -> Net:
    """Two causal convolutions, a memory that reads both ways, and a mean over steps weighted by attention."""
    shapes = _dense_shapes("conv1", kernel * inputs, filters) | _dense_shapes("conv2", kernel * filters, filters)
    for n in ("norm1", "norm2"):
        shapes |= {f"{n}.{c}": (filters,) for c in ("gain", "shift", "mean", "var")}
    shapes |= _lstm_shapes("ahead", filters, units) | _lstm_shapes("back", filters, units)
    shapes |= _dense_shapes("score", 2 * units, units) | _dense_shapes("weight", units, 1) | _head_shapes(2 * units)

    def forward(p, x, rng, seen):
        y = const(x)
        for k in (1, 2):
            y = _batch_norm(p, f"norm{k}", relu(_causal(p, f"conv{k}", y, kernel)), rng is not None, seen)
        y = joined([_lstm(p, "ahead", y), _lstm(p, "back", y[:, ::-1])[:, ::-1]])
        y = dropped(y, dropout, rng)
        weights = softmax(_dense(p, "weight", tanh(_dense(p, "score", y))), 1)
        y = dropped(relu(_dense(p, "wide", total(y * weights, 1))), dropout, rng)
        return _dense(p, "out", y)

    return Net(shapes, forward)


def transformer(steps: int, inputs: int, size: int = 64, heads: int = 4, inner: int = 128, blocks: int = 2, dropout: float = 0.2) -> Net:
    """Blocks of causal self-attention over learned positions, read at the last step."""
    shapes = _dense_shapes("in", inputs, size) | {"place": (steps, size)}
    for k in range(blocks):
        for n in ("query", "key", "value", "mix"):
            shapes |= _dense_shapes(f"{n}{k}", size, size)
        shapes |= _dense_shapes(f"up{k}", size, inner) | _dense_shapes(f"down{k}", inner, size)
        shapes |= {f"{n}{k}.{c}": (size,) for n in ("first", "second") for c in ("gain", "shift")}
    shapes |= _head_shapes(size)
    later = np.triu(np.full((steps, steps), -1e9), 1)

    def forward(p, x, rng, seen):
        rows = len(x)

        def split(name, y):
            return moved(reshaped(_dense(p, name, y), (rows, steps, heads, size // heads)), (0, 2, 1, 3))

        def norm(name, y):
            return standardised(y, (-1,), 1e-6) * p[f"{name}.gain"] + p[f"{name}.shift"]

        y = _dense(p, "in", const(x)) + p["place"]
        for k in range(blocks):
            scores = split(f"query{k}", y) @ moved(split(f"key{k}", y), (0, 1, 3, 2))
            weights = softmax(scores * const((size // heads) ** -0.5) + const(later), -1)
            seen_by_head = dropped(weights, dropout, rng) @ split(f"value{k}", y)
            y = norm(f"first{k}", y + _dense(p, f"mix{k}", reshaped(moved(seen_by_head, (0, 2, 1, 3)), (rows, steps, size))))
            y = norm(f"second{k}", y + _dense(p, f"down{k}", dropped(relu(_dense(p, f"up{k}", y)), dropout, rng)))
        y = dropped(y[:, -1], dropout, rng)
        return _dense(p, "out", relu(_dense(p, "wide", y)))

    return Net(shapes, forward)


NETWORKS: dict[str, Callable[..., Net]] = {"lstm": lstm, "cnn_bilstm_attention": cnn_bilstm_attention, "transformer": transformer}


# --- weights as one array ----------------------------------------------------------------------------------------


def _is_statistic(name: str) -> bool:
    return name.endswith((".mean", ".var"))


def first_weights(net: Net, seed: int) -> np.ndarray:
    """Matrices from a range by their sizes; gains and variances 1, forget gates 1, the rest 0."""
    rng = np.random.default_rng(seed)
    parts = []
    for name, shape in net.shapes.items():
        if len(shape) == 2:
            bound = math.sqrt(6 / sum(shape)) if name != "place" else 0.05
            parts.append(rng.uniform(-bound, bound, shape))
        else:
            parts.append(np.full(shape, 1.0 if name.endswith((".gain", ".var")) else 0.0))
            if name.split(".")[0] + ".u" in net.shapes:
                parts[-1][shape[0] // 4 : shape[0] // 2] = 1.0
    return np.concatenate([p.ravel() for p in parts])


def arrays(net: Net, weights: np.ndarray) -> dict[str, Var]:
    out, at = {}, 0
    for name, shape in net.shapes.items():
        size = math.prod(shape)
        out[name] = Var(weights[at : at + size].reshape(shape))
        at += size
    return out


def probabilities(net: Net, weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return logistic(net.forward(arrays(net, weights), x, None, {}).value[:, 0])


def loss_and_gradient(net: Net, weights: np.ndarray, x: np.ndarray, y: np.ndarray, rng: np.random.Generator | None) -> tuple[float, np.ndarray]:
    """Sum of the cross entropies of a batch and its gradient; in place of moving statistics, which have none, stand the
    batch's own times its rows."""
    p, seen = arrays(net, weights), {}
    end = net.forward(p, x, rng, seen)
    z = end.value[:, 0]
    loss = float((np.logaddexp(0, z) - y * z).sum())
    take_back(end, (logistic(z) - y)[:, None])
    grads = [seen.get(n, v.value) * len(y) if _is_statistic(n) else np.broadcast_to(v.grad, v.value.shape) for n, v in p.items()]
    return loss, np.concatenate([g.ravel() for g in grads])


class Adam:
    """Steps of the weights by running moments of the gradient; moving statistics follow the batches' own."""

    def __init__(self, net: Net, rate: float):
        self.rate, self.t = rate, 0
        self.one = self.two = 0.0
        self.still = np.concatenate([np.full(math.prod(s), _is_statistic(n)) for n, s in net.shapes.items()])

    def moved(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.one = 0.9 * self.one + 0.1 * gradient
        self.two = 0.999 * self.two + 0.001 * gradient**2
        step = self.rate * (self.one / (1 - 0.9**self.t)) / (np.sqrt(self.two / (1 - 0.999**self.t)) + 1e-7)
        return np.where(self.still, INERTIA * weights + (1 - INERTIA) * gradient, weights - step)


class Plateau:
    """Watches a figure that should rise: when the best weights change, the rate is halved, or training ends."""

    def __init__(self, patience: int = 6, halve_after: int = 3, least_rate: float = 1e-5):
        self.patience, self.halve_after, self.least_rate = patience, halve_after, least_rate
        self.best, self.stale, self.flat = -math.inf, 0, 0

    def better(self, figure: float) -> bool:
        if figure > self.best:
            self.best, self.stale, self.flat = figure, 0, 0
            return True
        self.stale += 1
        self.flat += 1
        return False

    def rate(self, rate: float) -> float:
        if self.flat >= self.halve_after:
            self.flat = 0
            return max(rate * 0.5, self.least_rate)
        return rate

    def over(self) -> bool:
        return self.stale >= self.patience


# --- training on Spark -------------------------------------------------------------------------------------------


def feature_scale(rows: DataFrame, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each input over all steps of the windows; deviations under 1e-8 count as 1."""
    if rows.isEmpty():
        raise ValueError("no window to train on")
    found = rows.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("features")).alias("s")).select("s.*").first()
    n = found["count"]
    mean = found["mean"].toArray().reshape(steps, -1)
    square = found["variance"].toArray().reshape(steps, -1) * (n - 1) / n + mean**2
    sd = np.sqrt(np.maximum(square.mean(0) - mean.mean(0) ** 2, 0))
    return mean.mean(0), np.where(sd < 1e-8, 1.0, sd)


def _blobs(rows: DataFrame, batch: int, shards: int, seed: int, steps: int, mean: np.ndarray, sd: np.ndarray) -> DataFrame:
    """(step, shard, n, x, y): scaled windows of each step and shard as single-precision bytes. Rows go to steps and shards
    by a hash of series and time, which mixes them and gives the same blobs again after a loss."""
    turns = max(1, -(-rows.count() // batch))
    place = F.pmod(F.xxhash64(F.lit(seed), SERIES, TIME), F.lit(turns * shards))
    dealt = rows.select((place % turns).cast("int").alias("step"), F.floor(place / turns).cast("int").alias("shard"), vector_to_array("features", "float32").alias("x"), "label")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group["x"].to_numpy()).reshape(len(group), steps, -1)
        x = ((x - mean) / sd).astype(np.float32)
        y = group["label"].to_numpy(np.float32)
        return pd.DataFrame({"step": group["step"].iloc[:1], "shard": group["shard"].iloc[:1], "n": [len(y)], "x": [x.tobytes()], "y": [y.tobytes()]})

    return dealt.groupBy("step", "shard").applyInPandas(pack, "step int, shard int, n int, x binary, y binary").repartition(shards, "shard")


def _gradient(blobs: DataFrame, net: Net, weights: np.ndarray, steps: int, step: int, seed: int, shards: int) -> tuple[float, np.ndarray]:
    """Mean loss and gradient over the windows of a step."""
    sent = blobs.sparkSession.sparkContext.broadcast(weights)

    def of_shard(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard, n, x, y in zip(part["shard"], part["n"], part["x"], part["y"]):
                rows = np.frombuffer(x, np.float32).reshape(n, steps, -1).astype(float)
                rng = np.random.default_rng([seed, step, shard])
                loss, g = loss_and_gradient(net, sent.value, rows, np.frombuffer(y, np.float32).astype(float), rng)
                yield pd.DataFrame({"g": [shard % math.ceil(shards / GROUP)], "n": [n], "loss": [loss], "v": [g.tobytes()]})

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        v = np.sum([np.frombuffer(b) for b in group["v"]], axis=0)
        return pd.DataFrame({"g": group["g"].iloc[:1], "n": [group["n"].sum()], "loss": [group["loss"].sum()], "v": [v.tobytes()]})

    schema = "g long, n long, loss double, v binary"
    found = blobs.where(F.col("step") == step).mapInPandas(of_shard, schema)
    if shards > GROUP:
        found = found.groupBy("g").applyInPandas(summed, schema)
    parts = found.collect()  # an array of the size of the weights for each group of shards
    sent.destroy()
    n = sum(r["n"] for r in parts)
    if not n:
        return 0.0, np.zeros_like(weights)
    return sum(r["loss"] for r in parts) / n, np.sum([np.frombuffer(r["v"]) for r in parts], axis=0) / n


class NetworkModel(NamedTuple):
    """A trained network: its kind and options, weights, scale of its inputs, and what each epoch came to."""

    kind: str
    steps: int
    options: dict
    weights: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    history: list[dict]

    def net(self) -> Net:
        return NETWORKS[self.kind](self.steps, len(self.mean), **self.options)

    def probability(self, features: Column) -> Column:
        """The probability of a rise for windows as flat arrays, oldest row first."""
        kind, steps, options, weights, mean, sd, _ = self

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            net = NETWORKS[kind](steps, len(mean), **options)
            for batch in batches:
                out = [np.zeros(0)]
                for at in range(0, len(batch), BATCH):
                    x = np.stack(batch.iloc[at : at + BATCH].to_numpy()).reshape(-1, steps, len(mean))
                    out.append(probabilities(net, weights, (x - mean) / sd))
                yield pd.Series(np.concatenate(out))

        return score(features)

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows(features, ...) with probability, as Spark's own classifiers give it."""
        p = self.probability(vector_to_array("features", "float32"))
        return rows.withColumn("_p", p).withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).drop("_p")

    def save(self, spark: SparkSession, path: str) -> None:
        row = (self.kind, self.steps, *[str(x) for x in (self.options,)], self.weights.tolist(), self.mean.tolist(), self.sd.tolist())
        spark.createDataFrame([row], "kind string, steps int, options string, weights array<double>, mean array<double>, sd array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_network(spark: SparkSession, path: str) -> NetworkModel:
    import ast

    r = spark.read.parquet(path).first()
    return NetworkModel(r["kind"], r["steps"], ast.literal_eval(r["options"]), np.array(r["weights"]), np.array(r["mean"]), np.array(r["sd"]), [])


def train_network(
    rows: DataFrame, kind: str, steps: int = 32, epochs: int = 60, batch: int = BATCH, rate: float = 1e-3, seed: int = 42, shards: int | None = None, watch: Plateau | None = None, **options
) -> NetworkModel:
    """Trains on the rows(series, time, part, features, label) of part train, and watches those of part val.

    ValueError without training rows. Where the validation part has one class only, its area is unknown and counts as 0.5.
    """
    spark = rows.sparkSession
    shards = shards or spark.sparkContext.defaultParallelism
    training, checked = rows.where("part = 'train'"), rows.where("part = 'val'")
    mean, sd = feature_scale(training, steps)
    net = NETWORKS[kind](steps, len(mean), **options)
    blobs = _blobs(training, batch, shards, seed, steps, mean, sd).persist()
    checked = checked.select("features", "label").persist()
    weights, adam, watch = first_weights(net, seed), Adam(net, rate), watch or Plateau()
    best, history = weights, []
    try:
        turns = [r[0] for r in blobs.select("step").distinct().orderBy("step").collect()]  # numbers of steps
        for epoch in range(epochs):
            losses = []
            for k in np.random.default_rng([seed, epoch]).permutation(turns):
                loss, gradient = _gradient(blobs, net, weights, steps, int(k), seed + epoch, shards)
                weights = adam.moved(weights, gradient)
                losses.append(loss)
            model = NetworkModel(kind, steps, options, weights, mean, sd, history)
            p = model.probability(vector_to_array("features", "float32"))
            area = E.auc(checked.select(p.alias("p"), F.col("label").alias("y"))).first()
            area = 0.5 if area is None or area[0] is None else area[0]
            history.append({"epoch": epoch + 1, "loss": float(np.mean(losses)), "val_auc": area, "rate": adam.rate})
            if watch.better(area):
                best = weights
            if watch.over():
                break
            adam.rate = watch.rate(adam.rate)
    finally:
        blobs.unpersist()
        checked.unpersist()
    return NetworkModel(kind, steps, options, best, mean, sd, history)
