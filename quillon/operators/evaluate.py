"""Evaluation of predicted probabilities p against outcomes y in {0, 1}."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import by_time, nz
from quillon.operators.blocks import in_blocks, keyed

#: Fixed values of the reports.
COSTS_BPS = [0.0, 1.0, 2.0, 3.0, 5.0, 7.5, 10.0]
BARS_PER_DAY, DAYS_PER_YEAR = 25, 250


def threshold_grid(df: DataFrame, low: float = 0.30, high: float = 0.70, points: int = 81, keys: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy of p >= threshold for each point of the grid; one pass, the grid is a literal array."""
    step = (high - low) / (points - 1)
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(low + k * step).alias("threshold")) for k in range(points)])).alias("g")
    hit = ((F.col("p") >= F.col("g.threshold")) == (F.col("y") == 1)).cast("int")
    parts = df.select(*keys, "y", "p", grid).groupBy(*keys, "g.k", "g.threshold").agg(F.avg(hit).alias("accuracy"), F.count("*").alias("n"))
    return parts.select(*keys, "k", "threshold", "accuracy", "n")


def pick_threshold(df: DataFrame) -> float:
    """The first threshold of the grid with the highest accuracy."""
    row = threshold_grid(df).orderBy(F.col("accuracy").desc(), "k").first()
    return 0.5 if row is None else row["threshold"]


def pick_thresholds(df: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """The same for each key: (keys, threshold)."""
    best = F.max_by("threshold", F.struct("accuracy", -F.col("k")))
    return threshold_grid(df, keys=keys).groupBy(*keys).agg(best.alias("threshold"))


#: Ranges of probabilities that ranks are counted in.
GRID = 4096


def ranked(df: DataFrame, keys: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """(keys, p, n, n1, rank): for each distinct p its rows, those with y 1, and their average rank among all rows.

    Distinct values are dealt into ranges, and ranks are places inside a range after the totals of the ranges before it,
    so no task holds more than a range. Ranges are steps of 1 / GRID, which suits probabilities; scores on another scale
    take `parts` ranges at approximate quantiles, for which a job runs before this returns. Where the cuts lie doesn't
    change the ranks. Rows without p rank below all others, NaN above.
    """
    df = df.withColumn("p", F.col("p").cast("double"))
    p = F.col("p")
    by_p = df.groupBy(*keys, "p").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("n1"))
    if parts is None:
        by_p = by_p.withColumn("_range", F.when(F.isnan(p) | (p >= 1), float(GRID)).when(p < 0, -1.0).otherwise(F.floor(p * GRID).cast("double")))
    else:
        found = df.approxQuantile("p", [k / parts for k in range(1, parts)], 0.25 / parts) if parts > 1 else []
        cuts = sorted({x for x in found if x == x and abs(x) != float("inf")}) or [0.0]  # at least two ranges
        by_p = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="p", outputCol="_range", handleInvalid="keep").transform(by_p)
    by_p = by_p.withColumn("_range", F.when(p.isNull(), -2.0).otherwise(F.col("_range")))
    totals = by_p.groupBy(*keys, "_range").agg(F.sum("n").alias("_n"))
    below = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*keys, F.col("_range"), F.coalesce(below, F.lit(0)).alias("_below"))
    inside = F.sum("n").over(Window.partitionBy(*keys, "_range").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    placed = by_p.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(totals, [*keys, "_range"])
    return placed.select(*keys, "p", "n", "n1", (F.col("_below") + F.col("_inside") + (F.col("n") + 1) / 2.0).alias("rank"))


def auc(df: DataFrame, keys: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Area under the ROC curve by average ranks, for each key; NULL with one class only. parts as in ranked."""
    sums = ranked(df, keys, parts).groupBy(*keys).agg(F.sum(F.col("rank") * F.col("n1")).alias("r"), F.sum("n1").alias("n1"), F.sum("n").alias("n"))
    n0 = F.col("n") - F.col("n1")
    value = F.when((F.col("n1") > 0) & (n0 > 0), (F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2.0) / (F.col("n1").cast("double") * n0))
    return sums.select(*keys, value.alias("auc"))


def _at(df: DataFrame, threshold: float | str) -> tuple[DataFrame, Column]:
    return (df, F.col(threshold)) if isinstance(threshold, str) else (df.withColumn("_threshold", F.lit(float(threshold))), F.col("_threshold"))


def _ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise))


def mcc(tp: Column, fp: Column, tn: Column, fn: Column, otherwise: float | None = 0.0) -> Column:
    below = (tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn)
    return F.when(below > 0, (tp.cast("double") * tn - fp.cast("double") * fn) / F.sqrt(below)).otherwise(F.lit(otherwise))


def classification_metrics(df: DataFrame, threshold: float | str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Metrics at a threshold, a number or a column that is the same for all rows of a key; 0 for 0/0."""
    df, at = _at(df, threshold)
    up, one = F.col("p") >= at, F.col("y") == 1
    counts = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.max(at).alias("threshold"),
        F.count_if(~up & ~one).alias("tn"),
        F.count_if(up & ~one).alias("fp"),
        F.count_if(~up & one).alias("fn"),
        F.count_if(up & one).alias("tp"),
        F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"),
    )
    tp, fp, tn, fn, n = (F.col(c) for c in ("tp", "fp", "tn", "fn", "n"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    out = counts.select(
        *keys, "n", "threshold", "tn", "fp", "fn", "tp",
        ((tp + tn) / n).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), mcc(tp, fp, tn, fn).alias("mcc"), "brier", ((tp + fp) / n).alias("predicted_up_rate"),
    )
    area = auc(df, keys)
    return out.join(area, list(keys)) if keys else out.crossJoin(area)  # one row on either side


def baselines(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy of always saying the commoner class and of repeating the last bar's sign."""
    rate = F.avg(F.col("y").cast("double"))
    again = F.avg(((F.col("ret_1") > 0) == (F.col("y") == 1)).cast("int"))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), rate.alias("positive_rate"), F.greatest(rate, 1 - rate).alias("majority"), again.alias("persistence"))


def baseline_lift(metrics: DataFrame, base: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Metrics with lifts over the baselines (without keys both have one row)."""
    base = base.select(*keys, "majority", "persistence")
    both = metrics.join(base, list(keys)) if keys else metrics.crossJoin(base)
    return both.withColumns(
        {
            "lift_majority": F.col("accuracy") - F.col("majority"),
            "lift_persistence": F.col("accuracy") - F.col("persistence"),
            "beats_persistence": F.col("accuracy") > F.col("persistence"),
        }
    )


def regime_breakdown(df: DataFrame, threshold: float | str, keys: tuple[str, ...] = ()) -> DataFrame:
    """By regime: rows, share of all rows, positive rate, accuracy and MCC (NULL where y or the prediction is constant),
    the commonest regime first."""
    df, at = _at(df, threshold)
    up, one = F.col("p") >= at, F.col("y") == 1
    total = df.groupBy(*keys).agg(F.count("*").alias("_all"))
    parts = df.where("regime is not null").groupBy(*keys, "regime").agg(
        F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("positive_rate"), F.avg((up == one).cast("int")).alias("accuracy"),
        F.count_if(up & one).alias("tp"), F.count_if(up & ~one).alias("fp"), F.count_if(~up & ~one).alias("tn"), F.count_if(~up & one).alias("fn"),
    )
    both = parts.join(total, list(keys)) if keys else parts.crossJoin(F.broadcast(total))  # one row
    out = both.select(*keys, "regime", "n", (F.col("n") * 100.0 / F.col("_all")).alias("share_pct"), "positive_rate", "accuracy", mcc(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"), None).alias("mcc"))
    return out.orderBy(*keys, F.col("n").desc(), "regime")


def positions(df: DataFrame, threshold: float | str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Position 1 or -1 and turnover: 0.5 for the first entry, 1 for a reversal."""
    df, at = _at(df, threshold)
    df = df.withColumn("position", F.when(F.col("p") >= at, 1.0).otherwise(-1.0))

    def build(d: DataFrame) -> DataFrame:
        return d.withColumn("turnover", F.abs(F.col("position") - F.lag("position", 1, 0.0).over(by_time())) / 2)

    return keyed(df, keys, lambda d: in_blocks(d, build, 1))


def cost_sensitivity(df: DataFrame, threshold: float | str, costs: list[float] = COSTS_BPS, keys: tuple[str, ...] = ()) -> DataFrame:
    held = positions(df, threshold, keys).groupBy(*keys).agg(F.sum(F.col("position") * F.col("fwd")).alias("gross"), F.sum("turnover").alias("flips"))
    grid = held.select(*keys, "gross", "flips", F.explode(F.array(*[F.lit(float(c)) for c in costs])).alias("cost_bps"))
    return grid.select(
        *keys, "cost_bps", (F.col("gross") * 100).alias("gross_pct"), "flips",
        ((F.col("gross") - F.col("flips") * F.col("cost_bps") / 1e4) * 100).alias("net_pct"),
        F.when(F.col("flips") > 0, F.col("gross") / F.col("flips") * 1e4).alias("break_even_bps"),
    )


def directional_strategy(df: DataFrame, threshold: float | str, cost_bps: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    held = positions(df, threshold, keys)
    held = held.withColumns({"_gross": F.col("position") * F.col("fwd"), "_cost": F.col("turnover") * cost_bps / 1e4})
    held = held.withColumn("_net", F.col("_gross") - F.col("_cost"))
    year = float(BARS_PER_DAY * DAYS_PER_YEAR)
    sd, n = F.stddev_pop("_net"), F.count("*")
    return held.groupBy(*keys).agg(
        n.alias("n"), (F.sum("_gross") * 100).alias("gross_pct"), (F.sum("_net") * 100).alias("net_pct"), (F.sum("_cost") * 100).alias("cost_pct"),
        F.avg((F.col("_gross") > 0).cast("int")).alias("hit_rate"), F.count_if(F.col("turnover") > 0).alias("position_flips"),
        (F.count_if(F.col("turnover") > 0) / (n / float(BARS_PER_DAY))).alias("flips_per_session"),
        F.when(sd > 0, F.avg("_net") / nz(sd) * F.sqrt(F.lit(year))).alias("sharpe"), (F.avg("_net") * year * 100).alias("annual_net_pct"),
    )


def persistence_agreement(df: DataFrame, threshold: float | str, keys: tuple[str, ...] = ()) -> DataFrame:
    df, at = _at(df, threshold)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(((F.col("p") >= at) == (F.col("ret_1") > 0)).cast("int")).alias("agreement"))


#: Order of the columns of a metrics table, as far as it has them.
FRONT = ["model", "part", "n", "accuracy", "persistence", "lift_persistence", "beats_persistence", "auc", "mcc", "f1", "precision", "recall", "brier", "threshold", "predicted_up_rate", "tp", "fp", "tn", "fn"]


def ordered(metrics: DataFrame) -> DataFrame:
    return metrics.select(*[c for c in FRONT if c in metrics.columns])


def with_thresholds(df: DataFrame) -> DataFrame:
    """df(model, part, y, p, ...) with the threshold that each model's validation part prefers."""
    return df.join(pick_thresholds(df.where("part = 'val'")), "model")


def metrics_by_model(df: DataFrame) -> DataFrame:
    """Metrics with lifts over the baselines of each model on each part; rows carry their threshold, y, p and ret_1."""
    keys = ("model", "part")
    return ordered(baseline_lift(classification_metrics(df, "threshold", keys), baselines(df, keys), keys))


def edge_by_model(df: DataFrame) -> DataFrame:
    """By model: agreement with persistence, break-even costs and flips for each session."""
    agree = persistence_agreement(df, "threshold", ("model",)).select("model", "agreement")
    costs = cost_sensitivity(df, "threshold", [0.0], ("model",)).select("model", "break_even_bps")
    flips = directional_strategy(df, "threshold", keys=("model",)).select("model", "flips_per_session")
    return agree.join(costs, "model").join(flips, "model")


def predictions_table(df: DataFrame, models: list[str]) -> DataFrame:
    """One row for each predicted row: series, time, y, regime and p_<model> for each model."""
    return df.groupBy("series_id", "ts").pivot("model", models).agg(F.first("p")).join(
        df.where(F.col("model") == models[0]).select("series_id", "ts", "y", "regime"), ["series_id", "ts"]
    ).select("series_id", "ts", "y", *[F.col(m).alias(f"p_{m}") for m in models], "regime")


def verdict(metrics: DataFrame) -> DataFrame:
    """The model with the best accuracy, of metrics with a model column."""
    return metrics.agg(F.max_by("model", "accuracy").alias("model"), F.max("accuracy").alias("accuracy"), F.max_by("beats_persistence", "accuracy").alias("beats_persistence"))

