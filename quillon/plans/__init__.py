"""The registered queries: each reads the given tables and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import SERIES, TIME, by_time, crossing, ln, rounded
from quillon.functions.tables import register
from quillon import sources as S
from quillon.operators import bars as B
from quillon.operators import dataset as D
from quillon.operators import evaluate as E
from quillon.operators import features as X
from quillon.operators import models as M
from quillon.operators import regimes as R
from quillon.operators.blocks import numbered, plain
from quillon.operators.scans import exponential, linear_scans, wilder

THRESHOLD = 0.5
SPLIT_AT = "2024-01-22"
#: A four-state model over two standardised returns; the names follow the states.
FIXED_MODEL = {
    "startprob": [0.25, 0.25, 0.25, 0.25],
    "transmat": [[0.91, 0.03, 0.03, 0.03], [0.03, 0.91, 0.03, 0.03], [0.03, 0.03, 0.91, 0.03], [0.03, 0.03, 0.03, 0.91]],
    "means": [[0.5, 1.0], [-0.5, -1.0], [0.0, 0.0], [0.0, 0.5]],
    "covars": [[[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0], [0.0, 1.0]], [[0.5, 0.0], [0.0, 0.5]], [[4.0, 0.0], [0.0, 4.0]]],
    "scaler_mean": [0.0, 0.0],
    "scaler_std": [1.0, 1.0],
    "label_map": {"0": "bull", "1": "bear", "2": "sideways", "3": "high_vol"},
}
FIXED_INPUTS = ["ret_1", "ret_20"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _bars(spark: SparkSession, d: str) -> DataFrame:
    """Fifteen-minute bars of the events, a series for each event type."""
    return B.bars(_t(spark, d, "events"), series="event_type", sequence="event_id")


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """The same with their places, which operators in a row share."""
    return numbered(_bars(spark, d))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Bars with returns, target and a probability that follows the last return."""
    df = D.target(R.regime_inputs(_placed(spark, d)))
    df = plain(df).withColumn("p", 1 / (1 + F.exp(-F.col("ret_1"))))
    return df.where("y is not null and p is not null")


def _for_model(spark: SparkSession, d: str) -> DataFrame:
    return R.regime_inputs(_placed(spark, d)).withColumn("is_warmup", F.lit(False))


def _decoded(spark: SparkSession, d: str) -> DataFrame:
    """Bars with the regime columns of the fixed model."""
    return plain(R.regime_columns(_for_model(spark, d), FIXED_MODEL, FIXED_INPUTS))


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    at = F.lit(SPLIT_AT).cast("timestamp_ntz")
    return df.where(F.col(TIME) < at), df.where(F.col(TIME) >= at)


def bars15(spark, d):
    return rounded(B.bars(_t(spark, d, "events"), sequence="event_id"))


def bars_by_type(spark, d):
    return rounded(_bars(spark, d))


def daily_order_bars(spark, d):
    o = _t(spark, d, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return rounded(
        o.groupBy("o_orderdate").agg(F.min_by("o_totalprice", "at").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "at").alias("close"), F.count("*").alias("n_ticks"))
    )


def supplier_moving_average(spark, d):
    li = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias(SERIES), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias(TIME), F.col("l_extendedprice").cast("double").alias("x"))
    frame = by_time().rowsBetween(-19, 0)
    out = li.withColumn("ma20", F.when(F.count("x").over(frame) == 20, F.avg("x").over(frame)))
    return rounded(out.groupBy(SERIES).agg(F.count("*").alias("n"), F.count("ma20").alias("n_ma"), F.max("ma20").alias("max_ma"), F.min("ma20").alias("min_ma")))


def session_filter(spark, d):
    return rounded(B.regular_session(_bars(spark, d)))


def session_columns(spark, d):
    return B.session_columns(B.regular_session(_bars(spark, d))).select(SERIES, TIME, "session_date", "bar_of_day", "is_session_open", "is_session_close")


def dedupe_first(spark, d):
    df = B.bars(_t(spark, d, "events"), sequence="event_id").withColumn("ingest_seq", F.lit(0))
    again = df.withColumns({"open": F.col("open") + 1, "high": F.col("high") + 2, "ingest_seq": F.lit(1)})
    return rounded(B.first_copies(again.unionByName(df)))


def quality_audit(spark, d):
    return rounded(B.integrity(_bars(spark, d)))


def session_audit(spark, d):
    return B.session_audit(B.regular_session(_bars(spark, d)))


def short_sessions(spark, d):
    return B.short_sessions(B.regular_session(_bars(spark, d)))


def null_census(spark, d):
    return B.null_census(D.target(R.regime_inputs(_bars(spark, d))))


def returns_log(spark, d):
    return rounded(R.regime_inputs(_bars(spark, d)).select(SERIES, TIME, "ret_1", "ret_20"))


def rolling_return(spark, d):
    return rounded(R.summed_return(_bars(spark, d)).select(SERIES, TIME, "sum_20"))


def true_range(spark, d):
    return rounded(X.true_range(_bars(spark, d)).select(SERIES, TIME, "true_range"))


def directional_movement(spark, d):
    return rounded(X.directional_movement(_bars(spark, d)).select(SERIES, TIME, "dm_plus", "dm_minus"))


def rma14(spark, d):
    return rounded(linear_scans(_bars(spark, d), [wilder("rma_14", "close", 14)]).select(SERIES, TIME, "rma_14"))


def sql_rma14(spark, d):
    """The average of rma14 by a table function in SQL."""
    register(spark)
    _bars(spark, d).createOrReplaceTempView("quillon_bars")
    found = spark.sql("SELECT * FROM wilder(TABLE(SELECT series_id, ts, close FROM quillon_bars) PARTITION BY (series_id) ORDER BY (ts), 'close', 14)")
    return rounded(found.select(SERIES, TIME, "rma_14"))


def ema12(spark, d):
    return rounded(linear_scans(_bars(spark, d), [exponential("ema_12", "close", 12)]).select(SERIES, TIME, "ema_12"))


def crossover(spark, d):
    df = _bars(spark, d)
    return df.select(SERIES, TIME, crossing(F.col("close"), F.col("open")).alias("cross"))


def _block(name: str, extra: tuple[str, ...] = ()):
    def run(spark, d):
        df = _bars(spark, d)
        out = X.single(name, df)
        return rounded(out.select(SERIES, TIME, *[c for c in out.columns if c not in df.columns]))

    run.__name__ = f"{name}_block"
    return run


def band_breaks_per_day(spark, d):
    df = X.bollinger(_bars(spark, d)).where("bb_break <> 0")
    return df.groupBy(SERIES, F.date_format(TIME, "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("bb_break") > 0).alias("n_up"), F.count_if(F.col("bb_break") < 0).alias("n_down"))


def bars_features(spark, d):
    return rounded(X.build_features(_bars(spark, d)))


def warmup_counts(spark, d):
    df = X.build_features(_bars(spark, d))
    flags = [c for c in df.columns if c.endswith("is_warmup")]
    return df.groupBy(SERIES).agg(F.count("*").alias("n"), *[F.count_if(F.col(c)).alias(f"n_{c}") for c in flags])


def summary_stats(spark, d):
    return rounded(X.summary(X.bollinger(_bars(spark, d)).withColumnRenamed("bb_is_warmup", "is_warmup").select("close", "bb_mid", "bb_std", "bb_pct_b", "bb_bandwidth", "bb_dist_mid_pct", "is_warmup")))


def flag_shares(spark, d):
    return rounded(X.flag_shares(X.rsi(_bars(spark, d))))


def rsi_summary(spark, d):
    train, test = _split(_bars(spark, d))
    both = X.attach_features(train, blocks=("rsi",)).withColumn("split", F.lit("train")).unionByName(X.attach_features(test, train, blocks=("rsi",)).withColumn("split", F.lit("test")))
    return rounded(X.rsi_summary(both), 4)


def rsi_export(spark, d):
    """What the RSI workbook holds, of the regular sessions."""
    return rounded(X.exported(X.rsi(B.session_columns(B.regular_session(_bars(spark, d)))), X.RSI_EXPORT))


def regime_export(spark, d):
    """What the regime workbook holds."""
    return rounded(X.exported(_decoded(spark, d).withColumn("session_date", F.date_format(TIME, "yyyy-MM-dd")), X.REGIME_EXPORT))


def warm_start(spark, d):
    """A warm start of one block with the seed of the whole matrix."""
    train, test = _split(_bars(spark, d))
    out = X.attach_features(test, train, blocks=("bollinger",))
    return rounded(out.select(SERIES, TIME, "bb_mid", "bb_std", "bb_pct_b", "bb_bandwidth_pctile", "bb_is_warmup"))


def warm_start_all(spark, d):
    """A warm start of all blocks: their flags become the same, whether any value of the row is missing."""
    train, test = _split(_bars(spark, d))
    out = X.attach_features(test, train)
    return rounded(out.select(SERIES, TIME, "rsi_14", "macd_signal_pct", "atr_pctile_1000", "adx_14", "bb_pct_b", *[c for c in out.columns if c.endswith("is_warmup")]))


def _warm_block(name: str):
    def run(spark, d):
        train, test = _split(_bars(spark, d))
        out = X.attach_block(test, name, train)
        return rounded(out.select(SERIES, TIME, *[c for c in out.columns if c not in test.columns]))

    run.__name__ = f"warm_{name}"
    return run


def leakage_check(spark, d):
    """Splits that share three bars of each series on purpose: sizes, ends and the overlap."""
    df = _bars(spark, d)
    train, test = _split(df)
    last = F.row_number().over(Window.partitionBy(SERIES).orderBy(F.col(TIME).desc()))
    test = test.unionByName(train.withColumn("_n", last).where("_n <= 3").drop("_n"))
    sides = train.groupBy(SERIES).agg(F.count("*").alias("n_train"), F.max(TIME).alias("train_end"))
    later = test.groupBy(SERIES).agg(F.count("*").alias("n_test"), F.min(TIME).alias("test_begin"))
    both = B.overlap(train, test).groupBy(SERIES).agg(F.count("*").alias("n_overlap"))
    out = sides.join(later, SERIES).join(both, SERIES, "left")
    return out.withColumn("n_overlap", F.coalesce("n_overlap", F.lit(0).cast("long"))).withColumn("ordered", F.col("train_end") < F.col("test_begin"))


def session_invariants(spark, d):
    return B.session_invariants(B.session_columns(B.regular_session(_bars(spark, d))))


def outside_sessions(spark, d):
    return B.outside_sessions(_bars(spark, d))


def column_catalogue(spark, d):
    """The columns of the matrix with block, use and number of values."""
    df = X.build_features(_bars(spark, d))
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).unpivot([], df.columns, "column_name", "n_values")
    return X.column_catalogue(df).join(counts, "column_name")


def target(spark, d):
    return rounded(D.target(_bars(spark, d)).select(SERIES, TIME, "fwd", F.col("y").cast("double").alias("y")))


def _windowed(spark, d):
    df = D.target(R.regime_inputs(_placed(spark, d)))
    return df.withColumn("is_warmup", F.col("_r") < 20)


def window_contiguity(spark, d):
    return D.usable(_windowed(spark, d), FIXED_INPUTS).select(SERIES, TIME, "usable", F.coalesce("window_ok", F.lit(False)).alias("window_ok"))


def windows32(spark, d):
    df = D.windows(_windowed(spark, d), FIXED_INPUTS)
    total = F.aggregate("x", F.lit(0.0), lambda a, row: a + row[0].cast("double"))
    return rounded(df.select(SERIES, TIME, "row_index", F.col("y").cast("double").alias("y"), F.size("x").alias("n_rows"), total.alias("sum_ret_1")), 4)


def chronological_split(spark, d):
    df = D.windows(_windowed(spark, d), FIXED_INPUTS).drop("x")
    return D.chronological_split(df).groupBy(SERIES, "part").agg(F.count("*").alias("n"), F.min(TIME).alias("first_ts"), F.max(TIME).alias("last_ts"))


def scaler_stats(spark, d):
    return rounded(D.scaler_statistics(_windowed(spark, d), FIXED_INPUTS))


def baselines(spark, d):
    return rounded(E.baselines(_scored(spark, d)))


def threshold_grid(spark, d):
    return rounded(E.threshold_grid(_scored(spark, d)))


def classification_metrics(spark, d):
    return rounded(E.classification_metrics(_scored(spark, d), THRESHOLD))


def metrics_by_series(spark, d):
    return rounded(E.classification_metrics(_scored(spark, d), THRESHOLD, (SERIES,)))


def baseline_lift(spark, d):
    df = _scored(spark, d)
    return rounded(E.baseline_lift(E.classification_metrics(df, THRESHOLD), E.baselines(df)).select("accuracy", "majority", "persistence", "lift_majority", "lift_persistence", "beats_persistence"))


def auc_rank(spark, d):
    df = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(E.auc(df.select(F.col("quality").alias("y"), F.col("n_chars").alias("p")), parts=16))


def regime_breakdown(spark, d):
    df = _scored(spark, d).join(_decoded(spark, d).select(SERIES, TIME, "regime"), [SERIES, TIME], "left")
    return rounded(E.regime_breakdown(df, THRESHOLD))


def cost_sensitivity(spark, d):
    return rounded(E.cost_sensitivity(_scored(spark, d), THRESHOLD))


def directional_strategy(spark, d):
    return rounded(E.directional_strategy(_scored(spark, d), THRESHOLD))


def persistence_agreement(spark, d):
    return rounded(E.persistence_agreement(_scored(spark, d), THRESHOLD))


def scaled_returns(spark, d):
    df = _windowed(spark, d)
    stats = D.require_fitted(D.scaler_statistics(df, FIXED_INPUTS))
    out = D.scaled(df, stats, FIXED_INPUTS)
    return rounded(out.select(SERIES, TIME, *[F.col(c).cast("double").alias(c) for c in FIXED_INPUTS]), 4)


def latest_windows(spark, d):
    """The last 1,000 windows, as a quick run takes them."""
    return rounded(D.last_windows(D.windows(_windowed(spark, d), FIXED_INPUTS), 1000).select(SERIES, TIME, "row_index", F.col("y").cast("double").alias("y")))


def _rule_models(spark, d):
    """Predictions of three rules on all windows: the last return goes on, turns, or the trend goes on."""
    df = _windowed(spark, d)
    ends = D.require_training(D.require_windows(df, FIXED_INPUTS).select(SERIES, TIME, "row_index"))
    rows = plain(df).join(ends, [SERIES, TIME]).where("part <> 'purge'").join(_decoded(spark, d).select(SERIES, TIME, "regime"), [SERIES, TIME])
    rules = {"momentum": F.col("ret_1"), "reversal": -F.col("ret_1"), "trend": F.col("ret_20")}
    rows = S.written(rows.select(SERIES, TIME, "part", "y", "fwd", "ret_1", "ret_20", "regime"), "rule-rows")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), (1 / (1 + F.exp(-x))).alias("p")) for n, x in rules.items()])).alias("m")
    return rows.select(SERIES, TIME, "part", "y", "fwd", "ret_1", "regime", each).select("*", "m.model", "m.p").drop("m")


def metrics_by_model(spark, d):
    return rounded(E.metrics_by_model(E.with_thresholds(_rule_models(spark, d))))


def _validated(spark, d):
    return E.with_thresholds(_rule_models(spark, d)).where("part = 'val'")


def breakdown_by_model(spark, d):
    return rounded(E.regime_breakdown(_validated(spark, d), "threshold", ("model",)))


def strategy_by_model(spark, d):
    return rounded(E.directional_strategy(_validated(spark, d), "threshold", keys=("model",)))


def costs_by_model(spark, d):
    return rounded(E.cost_sensitivity(_validated(spark, d), "threshold", keys=("model",)))


def edge_by_model(spark, d):
    return rounded(E.edge_by_model(_validated(spark, d)))


def verdict(spark, d):
    """The best rule on the validation part."""
    return rounded(E.verdict(E.metrics_by_model(_validated(spark, d))))


def predictions_table(spark, d):
    return rounded(E.predictions_table(_validated(spark, d), ["momentum", "reversal", "trend"]))


def hmm_filter_fixed(spark, d):
    df = R.decode(_for_model(spark, d), FIXED_MODEL, FIXED_INPUTS)
    return rounded(df.select(SERIES, TIME, *[F.element_at("posterior", k + 1).alias(f"p{k}") for k in range(4)]))


def hmm_smoother_fixed(spark, d):
    df = R.decode(_for_model(spark, d), FIXED_MODEL, FIXED_INPUTS, more=True)
    return rounded(df.select(SERIES, TIME, *[F.element_at("smoothed", k + 1).alias(f"p{k}") for k in range(4)]))


def hmm_viterbi_fixed(spark, d):
    return R.decode(_for_model(spark, d), FIXED_MODEL, FIXED_INPUTS, more=True).select(SERIES, TIME, "state")


def regime_columns(spark, d):
    df = _decoded(spark, d)
    return rounded(df.select(SERIES, TIME, *[c for c in df.columns if c.startswith("regime")]))


def regimes_warm_start(spark, d):
    """The later bars, decoded with the last 250 earlier ones before them; returns are taken in each part alone."""
    train, test = (R.regime_inputs(x).withColumn("is_warmup", F.lit(False)) for x in _split(_bars(spark, d)))
    df = R.attach_regimes(test, FIXED_MODEL, train, FIXED_INPUTS)
    return rounded(df.select(SERIES, TIME, *[c for c in df.columns if c.startswith("regime")]))


def state_report(spark, d):
    return rounded(R.state_report(_for_model(spark, d), FIXED_MODEL, FIXED_INPUTS))


def transition_report(spark, d):
    """The model's moves beside the observed ones of the decoded bars."""
    own = R.transition_report(spark, FIXED_MODEL)
    long = own.unpivot(["from_regime", "expected_bars"], [f"to_{n}" for n in R.NAMES], "to_regime", "model_p")
    long = long.select("from_regime", F.substring("to_regime", 4, 99).alias("to_regime"), "model_p", F.col("expected_bars").alias("model_bars"))
    return rounded(R.transitions(_decoded(spark, d)).join(long, ["from_regime", "to_regime"]))


def _model_inputs(spark, d):
    """Bars with the four inputs of a regime model."""
    df = X.build(R.regime_inputs(numbered(_bars(spark, d), B.PRICES)), [X.atr_block(), X.adx_block()])
    return df.withColumn("is_warmup", F.col("_r") < 70)


def hmm_states(spark, d):
    """Models of two to five states, fitted together: log-likelihood, free parameters and the Bayesian criterion."""
    found = R.select_states(_model_inputs(spark, d), tol=0.05)
    rows = [(r["k"], r["log_likelihood"], r["n_parameters"], r["n_rows"], r["bic"], r["converged"], r["bic"] == min(x["bic"] for x in found)) for r in found]
    return rounded(spark.createDataFrame(rows, "k int, log_likelihood double, n_parameters int, n_rows long, bic double, converged boolean, is_least boolean"), 3)


def hmm_fit(spark, d):
    """Regimes by a model that is fitted to the bars of all types."""
    df = _model_inputs(spark, d)
    out = R.regime_columns(df, R.fit_regimes(df))
    return out.select(SERIES, TIME, *[c for c in out.columns if c.startswith("regime")])


def regime_runs(spark, d):
    """Runs of one regime; a bar that is not scored ends its run."""
    return R.runs(_decoded(spark, d), gaps_end=True)


def regime_changed(spark, d):
    return _decoded(spark, d).select(SERIES, TIME, "regime", F.col("regime_changed").alias("changed"))


def daily_shares(spark, d):
    return rounded(R.period_shares(_decoded(spark, d)))


def daily_dominant(spark, d):
    return rounded(R.period_dominant(_decoded(spark, d)))


def overall_shares(spark, d):
    return rounded(R.overall_shares(_decoded(spark, d)))


def state_stats(spark, d):
    """By decoded regime the means of all four inputs of a model."""
    df = X.build(_bars(spark, d), [X.atr_block(), X.adx_block()]).select(SERIES, TIME, "atr_pct", "adx_14")
    found = rounded(R.state_statistics(_decoded(spark, d).join(df, [SERIES, TIME])))
    return found.withColumns({f"mean_{c}": F.round(f"mean_{c}", 4) for c in ("atr_pct", "adx_14")})


def state_names(spark, d):
    """The names that a fit would give to the decoded regimes, by their means of trend and volatility."""
    rows = state_stats(spark, d).orderBy("regime").collect()  # a row for each state
    names = R.name_states([r["mean_ret_20"] for r in rows], [r["mean_atr_pct"] for r in rows])
    return spark.createDataFrame([(r["regime"], names[k]) for k, r in enumerate(rows)], "regime string, name string")


def hmm_scaler(spark, d):
    """The scale that a fit gives to its inputs: mean and population deviation over the scored rows of all series."""
    rows = R.FitRows(_for_model(spark, d), FIXED_INPUTS)
    try:
        found = [(c, float(m), float(x), rows.n) for c, m, x in zip(FIXED_INPUTS, rows.mean, rows.std, strict=True)]
    finally:
        rows.close()
    return rounded(spark.createDataFrame(found, "column_name string, mean double, std double, n_rows long"))


def transition_table(spark, d):
    return rounded(R.transitions(_decoded(spark, d)))


def known_period_check(spark, d):
    return rounded(R.period_check(_decoded(spark, d), {"2024-01-05": "bull", "2024-01-10": "sideways", "2024-01-15": "high_vol", "2024-01-20": "bear"}))


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    """Bars with all that models read, and the target; one numbering and one decoding carry all columns along."""
    df = X.build_features(numbered(_bars(spark, d), B.PRICES)).withColumnRenamed("is_warmup", "_warmup")
    df = R.regime_columns(R.regime_inputs(df).withColumn("is_warmup", F.lit(False)), FIXED_MODEL, FIXED_INPUTS)
    return D.target(df.drop("is_warmup").withColumnRenamed("_warmup", "is_warmup"))


def model_matrix(spark, d):
    df = _matrix(spark, d)
    return rounded(df.select(SERIES, TIME, *D.final_features(df)))


def model_comparison(spark, d):
    """All registered classifiers and the recurrent network on windows of all inputs: metrics by model and part, with the
    thresholds and baselines."""
    df = S.written(_matrix(spark, d), "matrix")
    inputs = D.final_features(df)
    rows = M.predictions(D.require_windows(df, inputs), 32 * len(inputs), networks={"lstm": {"epochs": 12, "batch": 1024, "units": 32, "rate": 0.005}})
    rows = S.written(rows.join(df.select(SERIES, TIME, "ret_1", "fwd", "regime"), [SERIES, TIME]), "predictions")
    return rounded(E.metrics_by_model(E.with_thresholds(rows)))


#: Networks of a size that trains in a minute.
SMALL_NETWORKS = {
    "lstm": {"units": 16, "epochs": 3, "batch": 1024, "rate": 0.005},
    "cnn_bilstm_attention": {"filters": 16, "units": 8, "epochs": 3, "batch": 1024, "rate": 0.005},
    "transformer": {"size": 16, "heads": 2, "inner": 32, "blocks": 1, "epochs": 3, "batch": 1024, "rate": 0.005},
}


def network_comparison(spark, d):
    """The three networks on windows of returns: metrics by model and part."""
    df = S.written(_windowed(spark, d).select(SERIES, TIME, *FIXED_INPUTS, "y", "fwd", "is_warmup"), "windowed")
    rows = M.predictions(D.require_windows(df, FIXED_INPUTS), 32 * len(FIXED_INPUTS), (), SMALL_NETWORKS)
    rows = S.written(rows.join(df.select(SERIES, TIME, "ret_1", "fwd"), [SERIES, TIME]), "network-rows")
    return rounded(E.metrics_by_model(E.with_thresholds(rows)))


def log_close(spark, d):
    return rounded(_bars(spark, d).select(SERIES, TIME, ln(F.col("close")).alias("log_close")))


_NAMES = """bars15 bars_by_type daily_order_bars supplier_moving_average session_filter session_columns dedupe_first quality_audit session_audit
short_sessions session_invariants outside_sessions null_census log_close returns_log rolling_return true_range directional_movement rma14 sql_rma14 ema12
crossover band_breaks_per_day bars_features warmup_counts column_catalogue summary_stats flag_shares rsi_summary rsi_export regime_export warm_start warm_start_all leakage_check target
window_contiguity windows32 latest_windows chronological_split scaler_stats scaled_returns baselines threshold_grid classification_metrics
metrics_by_series baseline_lift auc_rank regime_breakdown cost_sensitivity directional_strategy persistence_agreement metrics_by_model
breakdown_by_model strategy_by_model costs_by_model edge_by_model verdict predictions_table hmm_filter_fixed hmm_smoother_fixed hmm_viterbi_fixed
regime_columns regimes_warm_start state_report transition_report hmm_fit hmm_states regime_runs regime_changed daily_shares daily_dominant overall_shares
state_stats state_names hmm_scaler transition_table known_period_check model_matrix model_comparison network_comparison""".split()
QUERIES = {n: globals()[n] for n in _NAMES} | {f"{b}_block": _block(b) for b in X.BLOCKS} | {f"warm_{b}": _warm_block(b) for b in X.BLOCKS}
