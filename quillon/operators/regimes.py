"""Market regimes by a Gaussian hidden Markov model, decoded causally.

The rows of a series that are scored are cut into blocks. What a block does to the state probabilities is a small
matrix; the matrices of the blocks, one row each, are taken through in order, and then every block is run from the
probabilities it begins (and ends) with. So filter, smoother, Viterbi path and each step of the fit run on all cores
over one series. Statistics over the labels are plain aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from quillon.functions import SERIES, TIME, by_time, ln
from quillon.operators.blocks import in_blocks, numbered, plain, running
from quillon.operators.features import with_seed

INPUTS = ["ret_1", "ret_20", "atr_pct", "adx_14"]
NAMES = ["bull", "bear", "sideways", "high_vol"]


#: Scored rows that one task runs through.
BLOCK = 4096
SEED_ROWS = 250
#: Seeds that the k-means start of a fit tries.
STARTS = 4


def regime_inputs(df: DataFrame) -> DataFrame:
    """df with ret_1 and ret_20, differences of the logarithm of the close."""
    x = ln(F.col("close"))
    return in_blocks(df, lambda d: d.withColumns({f"ret_{n}": x - F.lag(x, n).over(by_time()) for n in (1, 20)}), 20)


def summed_return(df: DataFrame, rows: int = 20) -> DataFrame:
    """df with sum_<rows>, the sum of the last rows steps of the logarithm of the close where both ends are known. A step
    goes from the last known logarithm, so that missing closes between the ends lose nothing."""

    def build(d: DataFrame) -> DataFrame:
        d = d.withColumn("_x", ln(F.col("close")))
        d = d.withColumn("_step", F.col("_x") - F.last("_x", ignorenulls=True).over(by_time().rowsBetween(-rows, -1)))
        known = F.col("_x").isNotNull() & F.lag("_x", rows).over(by_time()).isNotNull()
        return d.withColumn(f"sum_{rows}", F.when(known, F.sum("_step").over(by_time().rowsBetween(1 - rows, 0)))).drop("_x", "_step")

    return in_blocks(df, build, 2 * rows)


class Hmm:
    """The parameters of a model as arrays, and what a block of rows needs of them."""

    def __init__(self, model: dict):
        self.start, self.trans = np.array(model["startprob"], float), np.array(model["transmat"], float)
        self.means, self.covars = np.array(model["means"], float), np.array(model["covars"], float)
        self.mean, self.std = np.array(model["scaler_mean"], float), np.array(model["scaler_std"], float)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.std

    def log_density(self, z: np.ndarray) -> np.ndarray:
        out = np.empty((len(z), len(self.means)))
        for k, (m, c) in enumerate(zip(self.means, self.covars, strict=True)):
            root = np.linalg.cholesky(c)
            part = np.linalg.solve(root, (z - m).T)
            out[:, k] = -0.5 * (part**2).sum(0) - np.log(np.diag(root)).sum() - 0.5 * z.shape[1] * np.log(2 * np.pi)
        return out

    def steps(self, logb: np.ndarray, first: bool) -> np.ndarray:
        """A matrix for each row: from the state before it to its own, times the density over its largest one. The first
        row of a series comes from the start probabilities, whatever was before."""
        out = self.trans * np.exp(logb - logb.max(axis=1, keepdims=True))[:, None, :]
        if first:
            out[0] = self.start * np.exp(logb[0] - logb[0].max())
        return out


def product(steps: np.ndarray, best: bool = False) -> np.ndarray:
    """The product of matrices in order, by halves, up to a factor. With best, entries are logarithms and the largest term
    stands for the sum."""
    while len(steps) > 1:
        tail = steps[len(steps) // 2 * 2 :]
        one, two = steps[0 : len(steps) - 1 : 2], steps[1::2]
        steps = (one[:, :, :, None] + two[:, None, :, :]).max(axis=2) if best else one @ two
        if not best:
            steps = steps / np.maximum(steps.max(axis=(1, 2), keepdims=True), 1e-300)
        steps = np.concatenate([steps, tail])
    return steps[0]


def placed(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """df by numbered rows with _b, the block of a row, and _ok: whether it is scored (no warm-up, no NULL)."""
    fine = ~F.col("is_warmup")
    for c in inputs:
        fine = fine & F.col(c).isNotNull()
    return numbered(df).withColumns({"_b": F.floor(F.col("_r") / BLOCK).cast("long"), "_ok": F.coalesce(fine, F.lit(False))})


def _logs(a: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(a)


def _shrunk(m: Hmm, z: np.ndarray, best: bool) -> tuple[np.ndarray, np.ndarray]:
    """What scored rows do to the probabilities before them, as a matrix, and what they come to as the first of a series."""
    k = len(m.start)
    if not len(z):
        return _logs(np.eye(k)) if best else np.eye(k), np.zeros(k)
    logb = m.log_density(z)
    if best:
        steps, begin = _logs(m.trans) + logb[:, None, :], _logs(m.start) + logb[0]
        return product(steps, True), (begin[:, None] + product(steps[1:], True)).max(axis=0) if len(z) > 1 else begin
    steps, begin = m.steps(logb, False), m.start * np.exp(logb[0] - logb[0].max())
    return product(steps), begin @ product(steps[1:]) if len(z) > 1 else begin


def _taken_through(group: pd.DataFrame, k: int, best: bool) -> pd.DataFrame:
    """entry and exit of a series' blocks in order, from their matrices."""
    group = group.sort_values("_b")
    matrices = [np.array(x).reshape(k, k) for x in group["_m"]]
    counts = group["_n"].to_numpy()
    begins = int(np.argmax(counts > 0)) if (counts > 0).any() else len(counts)  # the block with the first scored row
    entry, exit_ = [], [None] * len(matrices)
    p = np.zeros(k)
    for b, (m, v) in enumerate(zip(matrices, group["_v"])):
        entry.append(p)
        if counts[b]:
            p = np.array(v) if b == begins else (p[:, None] + m).max(axis=0) if best else p @ m
            p = p - p.max() if best else p / p.sum()
    if best:
        state = int(p.argmax())
        for b in range(len(matrices) - 1, -1, -1):
            exit_[b] = np.eye(k)[state]
            if counts[b] and b > begins:
                state = int((entry[b] + matrices[b][:, state]).argmax())
    else:
        later = np.ones(k)
        for b in range(len(matrices) - 1, -1, -1):
            exit_[b] = later
            later = matrices[b] @ later
            later = later / later.max()
    before = [False, *group["_last"].tolist()[:-1]]
    first = [b == begins for b in range(len(matrices))]
    return pd.DataFrame({SERIES: group[SERIES], "_b": group["_b"], "entry": entry, "exit": exit_, "before": before, "first": first})


def boundaries(rows: DataFrame, models: dict[int, dict], inputs: Sequence[str], best: bool = False) -> DataFrame:
    """(series, model, _b, entry, exit, before, first) of each block of placed rows and each model: the probabilities of the
    state before its first row, weights of the state at its last row by all that follows, whether the row before it is
    scored, and whether it has the series' first scored row. With best, entry are the best log-scores before the block
    and exit is the best path's state at its end."""
    kind = rows.schema[SERIES].dataType.simpleString()

    def shrink(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_r")
        last = bool(group["_ok"].iloc[-1])
        x = group.loc[group["_ok"], list(inputs)].to_numpy(float)
        out = []
        for key, model in models.items():
            m = Hmm(model)
            matrix, begin = _shrunk(m, m.scaled(x), best)
            out.append((group[SERIES].iloc[0], group["_b"].iloc[0], key, len(x), last, matrix.ravel(), begin))
        return pd.DataFrame(out, columns=[SERIES, "_b", "model", "_n", "_last", "_m", "_v"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        key = int(group["model"].iloc[0])
        return _taken_through(group, len(models[key]["startprob"]), best).assign(model=key)

    given = rows.select(SERIES, "_r", "_b", "_ok", *[F.col(c).cast("double").alias(c) for c in inputs])
    small = given.groupBy(SERIES, "_b").applyInPandas(shrink, f"{SERIES} {kind}, _b long, model int, _n long, _last boolean, _m array<double>, _v array<double>")
    return small.groupBy(SERIES, "model").applyInPandas(run, f"{SERIES} {kind}, _b long, model int, entry array<double>, exit array<double>, before boolean, first boolean")


def forward(steps: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, float]:
    """Filtered probabilities of each row of a block that is entered with `entry`, and the logarithm of what was divided
    out."""
    out, sums = np.empty(steps.shape[:2]), np.empty(len(steps))
    p = entry
    for t in range(len(steps)):
        p = p @ steps[t]
        sums[t] = p.sum()
        p = p / sums[t]
        out[t] = p
    return out, float(np.log(sums).sum())


def backward(steps: np.ndarray, exit_: np.ndarray) -> np.ndarray:
    """Weights of each row's state by all that follows it."""
    out = np.empty(steps.shape[:2])
    w = exit_
    for t in range(len(steps) - 1, -1, -1):
        out[t] = w
        w = steps[t] @ w
        w = w / w.max()
    return out


def best_path(logb: np.ndarray, trans: np.ndarray, start: np.ndarray | None, entry: np.ndarray, last: int) -> np.ndarray:
    """States of a block on the best path that enters with the scores `entry` and ends in `last`."""
    came = np.zeros(logb.shape, np.int64)
    score = entry
    for t in range(len(logb)):
        step = score[:, None] + (_logs(trans) if t or start is None else np.broadcast_to(_logs(start), trans.shape))
        came[t] = step.argmax(0)
        score = step.max(0) + logb[t]
    path = np.empty(len(logb), np.int64)
    path[-1] = last
    for t in range(len(logb) - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path


def _entered(m: Hmm, first: bool, entry: np.ndarray) -> np.ndarray:
    """The entry of a block; the first scored row comes from the start probabilities, whatever stands before it."""
    return np.full(len(m.start), 1.0 / len(m.start)) if first else entry


def decoded(df: DataFrame, model: dict, inputs: Sequence[str] = INPUTS, more: bool = False) -> DataFrame:
    """df with posterior and _before (the likeliest state of the row before, NULL where that is not scored); more adds
    smoothed and state, the smoothed probabilities and the Viterbi state, which look ahead and serve diagnosis only. All
    are NULL on rows that are not scored, which the recursion leaves out. Rows are dealt once, with all their columns."""
    rows = placed(df, inputs)
    bounds = boundaries(rows, {0: model}, inputs).drop("model")
    if more:
        path = boundaries(rows, {0: model}, inputs, True).select(SERIES, "_b", F.col("entry").alias("scores"), F.col("exit").alias("last"))
        bounds = bounds.join(path, [SERIES, "_b"])
    kept = [f for f in rows.schema.fields if f.name not in ("_b", "_ok")]
    made = [StructField("posterior", ArrayType(DoubleType())), StructField("_before", IntegerType())]
    made += [StructField("smoothed", ArrayType(DoubleType())), StructField("state", IntegerType())] if more else []

    def run(block: pa.Table, bound: pa.Table) -> pa.Table:
        order = np.argsort(block["_r"].to_numpy(), kind="stable")
        block, edge = block.take(pa.array(order)), bound.to_pylist()[0]
        ok = block["_ok"].to_numpy(zero_copy_only=False).astype(bool)
        at = np.flatnonzero(ok)
        m = Hmm(model)
        entry, n = np.array(edge["entry"]), block.num_rows
        posterior, before, smoothed, state = [None] * n, [None] * n, [None] * n, [None] * n
        if len(at):
            x = np.stack([block[c].cast(pa.float64()).to_numpy(zero_copy_only=False)[at] for c in inputs], 1)
            logb = m.log_density(m.scaled(x))
            steps = m.steps(logb, edge["first"])
            filtered, _ = forward(steps, _entered(m, edge["first"], entry))
            for t, row, top in zip(at.tolist(), filtered.tolist(), filtered.argmax(1).tolist()):
                posterior[t] = row
                if t + 1 < n:
                    before[t + 1] = top
            if more:
                both = filtered * backward(steps, np.array(edge["exit"]))
                path = best_path(logb, m.trans, m.start if edge["first"] else None, np.array(edge["scores"]), int(np.argmax(edge["last"])))
                for t, row, s in zip(at.tolist(), (both / both.sum(axis=1, keepdims=True)).tolist(), path.tolist()):
                    smoothed[t], state[t] = row, s
        if edge["before"]:
            before[0] = int(entry.argmax())
        out = block.select([f.name for f in kept]).append_column("posterior", pa.array(posterior, pa.list_(pa.float64()))).append_column("_before", pa.array(before, pa.int32()))
        if more:
            out = out.append_column("smoothed", pa.array(smoothed, pa.list_(pa.float64()))).append_column("state", pa.array(state, pa.int32()))
        return out

    both = rows.groupBy(SERIES, "_b").cogroup(bounds.groupBy(SERIES, "_b"))
    out = both.applyInArrow(lambda block, bound: run(block, bound), StructType([*kept, *made]))
    return out if "_r" in df.columns else plain(out)


def decode(df: DataFrame, model: dict, inputs: Sequence[str] = INPUTS, more: bool = False) -> DataFrame:
    """(series_id, ts, posterior) of scored rows, with more also smoothed and state."""
    narrow = df.select(*dict.fromkeys([SERIES, TIME, "is_warmup", *inputs, *[c for c in df.columns if c == "_r"]]))
    out = decoded(narrow, model, inputs, more).where("posterior is not null")
    return out.select(SERIES, TIME, "posterior", *(["smoothed", "state"] if more else []))


# --- fitting -----------------------------------------------------------------------------------------------------


def _statistics(rows: DataFrame, models: dict[int, dict], inputs: Sequence[str], whole: bool) -> dict[int, dict[str, np.ndarray | float]]:
    """Sums of one step of the fit for each model, over all rows of all series, by one job: log-likelihood, states, moves,
    and by state the inputs and their products. A few hundred numbers a model reach the driver. whole: every series is
    one block, so that there is nothing before or after one."""
    d = len(inputs)

    def measure(group: pd.DataFrame, edges: dict[int, tuple]) -> pd.DataFrame:
        group = group[group["_ok"]].sort_values("_r")
        out = []
        for key, (entry, exit_, first) in edges.items():
            if not len(group):
                continue
            m, k = Hmm(models[key]), len(models[key]["startprob"])
            z = m.scaled(group[list(inputs)].to_numpy(float))
            logb = m.log_density(z)
            steps = m.steps(logb, first)
            entry = _entered(m, first, entry)
            filtered, total = forward(steps, entry)
            later = backward(steps, exit_)
            gamma = filtered * later
            gamma = gamma / gamma.sum(axis=1, keepdims=True)
            before = np.concatenate([entry[None], filtered[:-1]])
            both = before[:, :, None] * steps * later[:, None, :]
            both = both / both.sum(axis=(1, 2), keepdims=True)
            moves = both[1:].sum(0) if first else both.sum(0)
            products = np.einsum("tk,ti,tj->kij", gamma, z, z)
            values = [[total + float(logb.max(axis=1).sum())], gamma[0] if first else np.zeros(k), moves.ravel(), gamma.sum(0), (gamma.T @ z).ravel(), products.ravel()]
            out.append((key, np.concatenate(values)))
        return pd.DataFrame(out, columns=["model", "v"])

    def alone(group: pd.DataFrame) -> pd.DataFrame:
        ends = {key: np.ones(len(m["startprob"])) for key, m in models.items()}
        return measure(group, {key: (e, e, True) for key, e in ends.items()})

    def beside(group: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
        return measure(group, {r.model: (np.array(r.entry), np.array(r.exit), r.first) for r in bounds.itertuples(index=False)})

    schema = "model int, v array<double>"
    if whole:
        found = rows.groupBy(SERIES, "_b").applyInPandas(alone, schema)
    else:
        found = rows.groupBy(SERIES, "_b").cogroup(boundaries(rows, models, inputs).groupBy(SERIES, "_b")).applyInPandas(beside, schema)
    sums = found.select("model", F.posexplode("v").alias("at", "x")).groupBy("model", "at").agg(F.sum("x").alias("x")).collect()
    out = {}
    for key, model in models.items():
        k = len(model["startprob"])
        v = np.array([r["x"] for r in sorted(sums) if r["model"] == key], float)
        likelihood, start, moves, weight, means, products = np.split(v, np.cumsum([1, k, k * k, k, k * d]))
        out[key] = {"likelihood": float(likelihood[0]), "start": start, "moves": moves.reshape(k, k), "weight": weight, "sums": means.reshape(k, d), "products": products.reshape(k, d, d)}
    return out


def _raised(model: dict, s: dict, floor: float) -> dict:
    """The model after one step of the fit."""
    d = s["sums"].shape[1]
    weight = np.maximum(s["weight"], 1e-12)
    means = s["sums"] / weight[:, None]
    covars = s["products"] / weight[:, None, None] - means[:, :, None] * means[:, None, :] + floor * np.eye(d)
    moves = s["moves"] + 1e-12
    return model | {"startprob": (s["start"] / s["start"].sum()).tolist(), "transmat": (moves / moves.sum(1, keepdims=True)).tolist(), "means": means.tolist(), "covars": covars.tolist()}


class FitRows:
    """The scored rows that fits share, kept while they run, with the scale of their inputs."""

    def __init__(self, df: DataFrame, inputs: Sequence[str]):
        narrow = df.select(*dict.fromkeys([SERIES, TIME, "is_warmup", *inputs, *[c for c in df.columns if c == "_r"]]))
        rows = placed(narrow, inputs).where("_ok").select(SERIES, "_r", "_b", "_ok", *[F.col(c).cast("double").alias(c) for c in inputs])
        self.inputs, self.d = list(inputs), len(inputs)
        self.rows = rows.repartition(SERIES, "_b").persist()
        *stats, self.n, last = self.rows.agg(*[F.avg(c) for c in inputs], *[F.stddev_pop(c) for c in inputs], F.count("*"), F.max("_b")).first()
        if stats[0] is None:
            self.rows.unpersist()
            raise ValueError("no row can be scored")
        self.mean, self.std = np.array(stats[: self.d]), np.array([x if x else 1.0 for x in stats[self.d :]])
        self.whole = last == 0
        z = [(F.col(c) - float(self.mean[i])) / float(self.std[i]) for i, c in enumerate(inputs)]
        spread = self.rows.agg(*[F.covar_pop(z[i], z[j]) for i in range(self.d) for j in range(self.d)]).first()
        self.spread = np.array(spread).reshape(self.d, self.d)
        # in order, so that a refit begins alike
        self.points = self.rows.sortWithinPartitions(SERIES, "_r").select(array_to_vector(F.array(*z)).alias("z")).persist()

    def close(self) -> None:
        self.rows.unpersist()
        self.points.unpersist()

    def start(self, states: int, seed: int, floor: float) -> tuple[float, dict]:
        """A model whose means are k-means centres, and how far rows lie from them."""
        found = KMeans(k=states, seed=seed, maxIter=50, featuresCol="z").fit(self.points)
        centres = np.array(found.clusterCenters())
        centres = np.concatenate([centres, np.repeat(centres[-1:], states - len(centres), 0)])  # fewer where rows are few
        model = {
            "startprob": [1 / states] * states,
            "transmat": [[(0.9 if states > 1 else 1.0) if i == j else 0.1 / max(1, states - 1) for j in range(states)] for i in range(states)],
            "means": centres.tolist(),
            "covars": [(self.spread + floor * np.eye(self.d)).tolist()] * states,
            "scaler_mean": self.mean.tolist(),
            "scaler_std": self.std.tolist(),
        }
        return found.summary.trainingCost, model


def fit_together(rows: FitRows, models: dict[int, dict], iterations: int = 200, tol: float = 1e-3, floor: float = 1e-3) -> dict[int, dict]:
    """Baum-Welch for several models at once: each step is one Spark job for all that haven't converged, which is when a
    step raises the log-likelihood by less than tol. The others have "converged" False after the last iteration."""
    done: dict[int, dict] = {}
    going, before = dict(models), dict.fromkeys(models, -np.inf)
    for _ in range(iterations):
        stats = _statistics(rows.rows, going, rows.inputs, rows.whole)
        for key, s in stats.items():
            if abs(s["likelihood"] - before[key]) < tol:
                done[key] = going.pop(key) | {"log_likelihood": s["likelihood"], "converged": True}
            else:
                before[key] = s["likelihood"]
                going[key] = _raised(going[key], s, floor)
        if not going:
            break
    return done | {key: m | {"log_likelihood": before[key], "converged": False} for key, m in going.items()}


def fit_hmm(df: DataFrame, inputs: Sequence[str] = INPUTS, states: int = 4, iterations: int = 200, tol: float = 1e-3, seed: int = 42, floor: float = 1e-3) -> dict:
    """Baum-Welch from a seeded k-means start over all scored rows of all series, standardised; every series begins anew.
    Jobs run before this returns. RuntimeError if it doesn't converge: a step that raises the log-likelihood by less than
    tol, whatever the number of rows."""
    rows = FitRows(df, inputs)
    try:
        tries = [rows.start(states, seed + k, floor) for k in range(STARTS if states > 1 else 1)]
        model = fit_together(rows, {0: min(tries, key=lambda t: t[0])[1]}, iterations, tol, floor)[0]
    finally:
        rows.close()
    if not model.pop("converged"):
        raise RuntimeError("the hidden Markov model did not converge")
    return model


def free_parameters(states: int, d: int) -> int:
    """Start and moves, means, and covariance matrices."""
    return states - 1 + states * (states - 1) + states * d + states * d * (d + 1) // 2


def select_states(df: DataFrame, ks: Sequence[int] = (2, 3, 4, 5), inputs: Sequence[str] = INPUTS, starts: int = 2, iterations: int = 200, tol: float = 1e-3, seed: int = 42, floor: float = 1e-3) -> list[dict]:
    """For each number of states the best fit of a few starts: k, log_likelihood, n_parameters, n_rows, bic, converged and
    model, by k. All fits share their steps: one job a step, whatever the number of models. Jobs run before this returns."""
    rows = FitRows(df, inputs)
    try:
        plan = [(k, seed + s) for k in ks for s in range(starts if k > 1 else 1)]
        fitted = fit_together(rows, {i: rows.start(k, at, floor)[1] for i, (k, at) in enumerate(plan)}, iterations, tol, floor)
        n = rows.n
    finally:
        rows.close()
    out = []
    for k in sorted(set(ks)):
        model = max((fitted[i] for i, (at, _) in enumerate(plan) if at == k), key=lambda m: m["log_likelihood"])
        free = free_parameters(k, len(inputs))
        out.append({"k": k, "log_likelihood": model["log_likelihood"], "n_parameters": free, "n_rows": n, "bic": free * float(np.log(n)) - 2 * model["log_likelihood"], "converged": model["converged"], "model": model})
    return out


def name_states(mean_trend: Sequence[float], mean_vol: Sequence[float]) -> dict[int, str]:
    """high_vol is the state with the largest volatility; the others are bull, sideways, bear by falling trend. With
    another number of states they are state_0, state_1, ... by falling trend."""
    k = len(mean_trend)
    order = sorted(range(k), key=lambda s: (-mean_trend[s], s))
    if k != 4:
        return {s: f"state_{i}" for i, s in enumerate(order)}
    vol = max(range(k), key=lambda s: (mean_vol[s], -s))
    return {vol: "high_vol"} | dict(zip([s for s in order if s != vol], ["bull", "sideways", "bear"], strict=True))


def fit_regimes(df: DataFrame, inputs: Sequence[str] = INPUTS, states: int = 4, **options) -> dict:
    """A fitted model with the names of its states, which follow the inputs' means over the best path (trend: the second
    input, volatility: the third), and those statistics."""
    model = fit_hmm(df, inputs, states, **options)
    table = path_statistics(df, model, inputs).collect()
    by = {r["state"]: r for r in table}
    trend = [by[s][f"mean_{inputs[1]}"] if s in by else 0.0 for s in range(states)]
    vol = [by[s][f"mean_{inputs[2]}"] if s in by else 0.0 for s in range(states)]
    names = {str(s): n for s, n in name_states(trend, vol).items()}
    return model | {"label_map": names, "state_stats": [r.asDict() for r in table]}


def path_statistics(df: DataFrame, model: dict, inputs: Sequence[str] = INPUTS) -> DataFrame:
    """By Viterbi state: rows, share and means of the inputs."""
    return state_statistics(decoded(df, model, inputs, more=True), "state", inputs)


def state_report(df: DataFrame, model: dict, inputs: Sequence[str] = INPUTS) -> DataFrame:
    """path_statistics with the states' names, returns in basis points and percent, by name."""
    labels = F.array(*[F.lit(n) for n in _names(model)])
    rows = path_statistics(df, model, inputs).withColumn("regime", F.element_at(labels, F.col("state") + 1))
    scaled = [(F.col(f"mean_{inputs[0]}") * 1e4).alias(f"mean_{inputs[0]}_bps"), (F.col(f"mean_{inputs[1]}") * 100).alias("mean_trend_pct"), *[f"mean_{c}" for c in inputs[2:]]]
    return rows.select("state", "regime", "n", (F.col("share") * 100).alias("share_pct"), *scaled).orderBy("regime")


def transition_report(spark: SparkSession, model: dict) -> DataFrame:
    """The model's own matrix by name, and how many rows a stay in each regime lasts."""
    names = _names(model)
    order = [n for n in NAMES if n in names] + sorted(set(names) - set(NAMES))
    rows = [(names[i], *[float(row[names.index(n)]) for n in order]) for i, row in enumerate(model["transmat"])]
    table = spark.createDataFrame(rows, f"from_regime string, {', '.join(f'to_{n} double' for n in order)}")
    own = F.coalesce(*[F.when(F.col("from_regime") == n, F.col(f"to_{n}")) for n in order])
    place = F.array_position(F.array(*[F.lit(n) for n in order]), F.col("from_regime"))
    return table.withColumn("expected_bars", F.when(own < 1, 1 / (1 - own))).orderBy(place)


def _names(model: dict) -> list[str]:
    return [model["label_map"][str(s)] for s in range(len(model["startprob"]))]


def regime_columns(df: DataFrame, model: dict, inputs: Sequence[str] = INPUTS) -> DataFrame:
    """df with regime_p_*, regime, confidence, changepoint, entropy and changed; NULL on rows that are not scored."""
    names = _names(model)
    found = decoded(df, model, inputs)
    p = F.col("posterior")
    labels = F.array(*[F.lit(n) for n in names])
    found = found.withColumns({f"regime_p_{n}": F.element_at(p, k + 1) for k, n in enumerate(names)})
    top = F.array_max(p)
    entropy = F.aggregate(p, F.lit(0.0), lambda a, v: a - F.when(v > 0, v * F.ln(v)).otherwise(0.0))
    found = found.withColumns(
        {
            "regime": F.when(p.isNotNull(), F.element_at(labels, F.array_position(p, top).cast("int"))),
            "regime_confidence": top,
            "regime_changepoint": 1 - top,
            "regime_entropy": F.when(p.isNotNull(), entropy),
        }
    )
    before = F.when(F.col("_before").isNotNull(), F.element_at(labels, F.col("_before") + 1))
    changed = (F.col("regime") != before) & F.col("regime").isNotNull()
    return found.withColumn("regime_changed", changed).drop("posterior", "_before")


def attach_regimes(df: DataFrame, model: dict, seed: DataFrame | None = None, inputs: Sequence[str] = INPUTS, seed_rows: int = SEED_ROWS) -> DataFrame:
    """regime_columns with a warm start: the last seed_rows rows of each series of seed go before it and are dropped again.
    Raises ValueError unless the seed ends strictly before the data begin."""
    if seed is None:
        return regime_columns(df, model, inputs)
    return regime_columns(with_seed(df, seed, seed_rows), model, inputs).where("not _seed").drop("_seed")


def runs(df: DataFrame, column: str = "regime", gaps_end: bool = False) -> DataFrame:
    """Stretches of rows with one value: first and last time, number of rows. Rows without a value are in no run; with
    gaps_end they end the one before them, else they are passed over. Runs are numbered by sums over blocks, so a long
    series has no window of its own."""
    here = F.col(column)
    rows = plain(df if gaps_end else df.where(here.isNotNull())).select(SERIES, TIME, column)
    fresh = here.isNotNull() & F.coalesce(here != F.lag(column).over(by_time()), F.lit(True))
    marked = in_blocks(numbered(rows), lambda d: d.withColumn("_new", fresh.cast("int")), 1)
    marked = running(marked, {"run_id": F.col("_new")}).where(here.isNotNull())
    return marked.groupBy(SERIES, "run_id", column).agg(F.min(TIME).alias("first_ts"), F.max(TIME).alias("last_ts"), F.count("*").alias("n_bars"))


def period_shares(df: DataFrame, form: str = "yyyy-MM-dd", names: Sequence[str] = NAMES) -> DataFrame:
    """Percent of each regime by period (months by yyyy-MM), absent ones 0."""
    counts = df.where("regime is not null").groupBy(F.date_format(TIME, form).alias("period")).pivot("regime", list(names)).count()
    counts = counts.select("period", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names])
    total = sum((F.col(n) for n in names), F.lit(0))
    return counts.select("period", *[(F.col(n) * 100.0 / total).alias(f"{n}_pct") for n in names])


def period_dominant(df: DataFrame, form: str = "yyyy-MM-dd", names: Sequence[str] = NAMES) -> DataFrame:
    """By period the last close and the commonest regime; ties go to the first name."""
    parts = df.where("regime is not null").groupBy(F.date_format(TIME, form).alias("period")).agg(
        F.max_by("close", F.struct(TIME, SERIES)).alias("close"), *[F.count_if(F.col("regime") == n).alias(n) for n in names]
    )
    most = F.greatest(*[F.col(n) for n in names])
    pick: Column = F.lit(None).cast("string")
    for n in reversed(names):
        pick = F.when(F.col(n) == most, n).otherwise(pick)
    return parts.select("period", "close", pick.alias("dominant"))


def overall_shares(df: DataFrame) -> DataFrame:
    counts = df.where("regime is not null").groupBy("regime").agg(F.count("*").alias("n"))
    return counts.withColumn("share_pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))))


def state_statistics(df: DataFrame, state: str = "regime", inputs: Sequence[str] = INPUTS) -> DataFrame:
    stats = df.where(F.col(state).isNotNull()).groupBy(state).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in inputs])
    return stats.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def transitions(df: DataFrame, column: str = "regime") -> DataFrame:
    """Observed moves between regimes of neighbouring scored rows: counts, probabilities, expected length of a stay."""
    scored = plain(df.where(F.col(column).isNotNull()).select(SERIES, TIME, column))
    scored = in_blocks(scored, lambda d: d.withColumn("_to", F.lead(column).over(by_time())), 0, ahead=1).where("_to is not null")
    counts = scored.groupBy(F.col(column).alias("from_regime"), F.col("_to").alias("to_regime")).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("from_regime"))
    out = counts.withColumn("p", p)
    stay = F.when((F.col("from_regime") == F.col("to_regime")) & (F.col("p") < 1), 1 / (1 - F.col("p")))
    return out.withColumn("expected_bars", stay)


def period_check(df: DataFrame, expected: dict[str, str], form: str = "yyyy-MM-dd") -> DataFrame:
    """For named periods: the commonest regime, its share, and whether it is the expected one."""
    some = df.withColumn("period", F.date_format(TIME, form)).where(F.col("period").isin(list(expected)) & F.col("regime").isNotNull())
    counts = some.groupBy("period", "regime").agg(F.count("*").alias("n"))
    top = counts.groupBy("period").agg(F.max_by("regime", F.struct("n", "regime")).alias("regime"), F.max("n").alias("n"), F.sum("n").alias("total"))
    want: Column = F.lit(None).cast("string")
    for k, v in expected.items():
        want = F.when(F.col("period") == k, v).otherwise(want)
    return top.select("period", "regime", (F.col("n") * 100.0 / F.col("total")).alias("share_pct"), (F.col("regime") == want).alias("ok"))
