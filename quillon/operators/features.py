"""Indicator blocks over bars(series_id, ts, open, high, low, close). Each adds its columns and a warm-up flag."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import SERIES, TIME, any_null, by_time, crossing, diff, full_frame, no, nz, pct_change
from quillon.operators.bars import PRICES, require_after
from quillon.operators.blocks import HALO, in_blocks, numbered, plain
from quillon.operators.ranks import Rank, rank_blocks
from quillon.operators.scans import Scan, exponential, scan_blocks, wilder

WARMUP = 5  # lengths of the slowest average after which a cold start no longer shows


def true_range(df: DataFrame) -> DataFrame:
    before = F.lag("close").over(by_time())
    return df.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def directional_movement(df: DataFrame) -> DataFrame:
    up, down = diff(F.col("high")), -diff(F.col("low"))
    return df.withColumns(
        {
            "dm_plus": F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)),
            "dm_minus": F.when(up.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)),
        }
    )


def head_rows(n: int) -> Column:
    """The first n rows of a series, inside blocks."""
    return F.col("_r") < n


class Block(NamedTuple):
    """A family of columns in the steps that all blocks of a call take together: columns before the first recurrences,
    those, columns between, recurrences over these, the block's own columns, trailing ranks, and columns made of these
    without windows. reach is the number of rows that windows other than recurrences look back on, reads are the prices
    whose recurrences never forget a NULL."""

    name: str
    columns: list[str]
    after: Callable[[DataFrame], DataFrame]
    before: Callable[[DataFrame], DataFrame] = lambda df: df
    first: Sequence[Scan] = ()
    between: Callable[[DataFrame], DataFrame] = lambda df: df
    second: Sequence[Scan] = ()
    ranks: Sequence[Rank] = ()
    finish: Callable[[DataFrame], DataFrame] = lambda df: df
    reach: int = 20
    reads: Sequence[str] = ("high", "low", "close")


def build(df: DataFrame, blocks: Sequence[Block]) -> DataFrame:
    """df with the columns of the blocks, in their order; two passes of recurrences serve all of them."""

    def steps(d: DataFrame) -> DataFrame:
        for b in blocks:
            d = b.before(d)
        d = scan_blocks(d, [s for b in blocks for s in b.first])
        for b in blocks:
            d = b.between(d)
        d = scan_blocks(d, [s for b in blocks for s in b.second])
        for b in blocks:
            d = b.after(d)
        d = rank_blocks(d, [r for b in blocks for r in b.ranks])
        for b in blocks:
            d = b.finish(d)
        made = [c for b in blocks for c in b.columns]
        return d.select(*[c for c in d.columns if c in (*df.columns, "_r", "_c", "_own") and c not in made], *made)

    given = [c for c in df.columns if any(c in b.columns for b in blocks)]
    memory = [sum(max((s.memory() for s in part), default=0) for part in (b.first, b.second)) + b.reach + max((r.rows for r in b.ranks), default=0) for b in blocks]
    return in_blocks(df.drop(*given), steps, max(HALO, *memory), [c for c in PRICES if any(c in b.reads for b in blocks)])


def rsi_block(periods: tuple[int, ...] = (7, 14, 21), main: int = 14, high: float = 70.0, low: float = 30.0) -> Block:
    name, x = f"rsi_{main}", F.col(f"rsi_{main}")
    spread = f"rsi_spread_{min(periods)}_{max(periods)}"

    def before(df: DataFrame) -> DataFrame:
        step = diff(F.col("close"))
        df = df.withColumn("_step", step)
        return df.withColumns({f"_{n}": F.when(F.col("_step").isNotNull(), F.greatest(v, F.lit(0.0))) for n, v in (("gain", F.col("_step")), ("loss", -F.col("_step")))})

    def after(df: DataFrame) -> DataFrame:
        values = {}
        for p in periods:
            gain, loss = F.col(f"_g{p}"), F.col(f"_l{p}")
            value = F.when((gain == 0) & (loss == 0), 50.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / nz(loss)))
            values[f"rsi_{p}"] = F.when(gain.isNotNull(), value)
        df = df.withColumns(values)
        df = df.withColumns(
            {
                f"{name}_norm": (x - 50) / 50,
                f"{name}_chg": diff(x),
                f"{name}_slope_5": diff(x, 5) / 5,
                spread: F.col(f"rsi_{min(periods)}") - F.col(f"rsi_{max(periods)}"),
                f"{name}_overbought": no(x > high),
                f"{name}_oversold": no(x < low),
                "rsi_is_warmup": any_null([f"rsi_{p}" for p in periods]) | head_rows(WARMUP * max(periods)),
            }
        )
        return df.withColumn(f"{name}_zone", (F.col(f"{name}_overbought").cast("int") - F.col(f"{name}_oversold").cast("int")).cast("tinyint"))

    columns = [*[f"rsi_{p}" for p in periods], *[f"{name}_{c}" for c in ("norm", "chg", "slope_5")], spread, *[f"{name}_{c}" for c in ("overbought", "oversold", "zone")], "rsi_is_warmup"]
    return Block("rsi", columns, after, before, [s for p in periods for s in (wilder(f"_g{p}", "_gain", p), wilder(f"_l{p}", "_loss", p))], reads=("close",))


def macd_block(fast: int = 12, slow: int = 26, signal: int = 9) -> Block:
    def between(df: DataFrame) -> DataFrame:
        return df.withColumn("macd", F.col("_fast") - F.col("_slow"))

    def after(df: DataFrame) -> DataFrame:
        df = df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
        df = df.withColumns({f"{c}_pct": F.col(c) / nz(F.col("close")) * 100 for c in ("macd", "macd_signal", "macd_hist")})
        return df.withColumns(
            {
                "macd_hist_chg": diff(F.col("macd_hist_pct")),
                "macd_above_signal": no(F.col("macd") > F.col("macd_signal")),
                "macd_cross": crossing(F.col("macd"), F.col("macd_signal")),
                "macd_is_warmup": any_null(["macd", "macd_signal"]) | head_rows(WARMUP * (slow + signal)),
            }
        )

    columns = ["macd", "macd_signal", "macd_hist", "macd_pct", "macd_signal_pct", "macd_hist_pct", "macd_hist_chg", "macd_above_signal", "macd_cross", "macd_is_warmup"]
    return Block("macd", columns, after, first=[exponential("_fast", "close", fast), exponential("_slow", "close", slow)], between=between, second=[exponential("macd_signal", "macd", signal)], reads=("close",))


def _with_true_range(df: DataFrame) -> DataFrame:
    return df if "true_range" in df.columns else true_range(df)


def atr_block(period: int = 14, rank_rows: int = 1000, rank_least: int = 250) -> Block:
    name, rank = f"atr_{period}", f"atr_pctile_{rank_rows}"

    def after(df: DataFrame) -> DataFrame:
        x = F.col(name)
        return df.withColumns({"atr_pct": x / nz(F.col("close")) * 100, "tr_over_atr": F.col("true_range") / nz(x), "atr_chg_pct": pct_change(x) * 100})

    def finish(df: DataFrame) -> DataFrame:
        return df.withColumn("atr_is_warmup", any_null([name, "atr_pct", rank]) | head_rows(WARMUP * period))

    columns = ["true_range", name, "atr_pct", "tr_over_atr", "atr_chg_pct", rank, "atr_is_warmup"]
    return Block("atr", columns, after, _with_true_range, [wilder(name, "true_range", period)], ranks=[Rank(rank, "atr_pct", rank_rows, rank_least)], finish=finish)


def adx_block(period: int = 14, trending: float = 25.0) -> Block:
    name = f"adx_{period}"

    def between(df: DataFrame) -> DataFrame:
        df = df.withColumns({"di_plus": 100 * F.col("_plus") / nz(F.col("_tr")), "di_minus": 100 * F.col("_minus") / nz(F.col("_tr"))})
        total = F.col("di_plus") + F.col("di_minus")
        return df.withColumn("dx", F.when(total == 0, 0.0).otherwise(100 * F.abs(F.col("di_plus") - F.col("di_minus")) / nz(total)))

    def after(df: DataFrame) -> DataFrame:
        df = df.withColumns(
            {
                "di_spread": F.col("di_plus") - F.col("di_minus"),
                "adx_norm": F.col(name) / 100,
                "adx_chg": diff(F.col(name)),
                "adx_trending": no(F.col(name) > trending),
                "adx_is_warmup": any_null([name, "di_plus", "di_minus"]) | head_rows(WARMUP * 2 * period),
            }
        )
        side = F.coalesce(F.signum("di_spread"), F.lit(0.0)) * F.col("adx_trending").cast("int")
        return df.withColumn("adx_regime", side.cast("tinyint"))

    columns = ["di_plus", "di_minus", "dx", name, "di_spread", "adx_norm", "adx_chg", "adx_trending", "adx_regime", "adx_is_warmup"]
    first = [wilder("_tr", "true_range", period), wilder("_plus", "dm_plus", period), wilder("_minus", "dm_minus", period)]
    return Block("adx", columns, after, lambda df: directional_movement(_with_true_range(df)), first, between, [wilder(name, "dx", period)])


def bollinger_block(rows: int = 20, width: float = 2.0, rank_rows: int = 1000, rank_least: int = 250, squeeze: float = 0.10) -> Block:
    close = F.col("close")

    def before(df: DataFrame) -> DataFrame:
        # summed from the least value up, so that rows with the same values give the same doubles and tie in the rank
        seen = F.sort_array(full_frame(close.cast("double"), rows, F.collect_list))
        df = df.withColumns({"_seen": seen, "_least": F.element_at(seen, 1)})
        df = df.withColumn("bb_mid", F.col("_least") + F.aggregate("_seen", F.lit(0.0), lambda a, v: a + (v - F.col("_least"))) / rows)
        spread = F.aggregate("_seen", F.lit(0.0), lambda a, v: a + (v - F.col("bb_mid")) * (v - F.col("bb_mid"))) / rows
        return df.withColumn("bb_std", F.sqrt(spread)).drop("_seen", "_least")

    def after(df: DataFrame) -> DataFrame:
        df = df.withColumns({"bb_upper": F.col("bb_mid") + width * F.col("bb_std"), "bb_lower": F.col("bb_mid") - width * F.col("bb_std")})
        span, mid = F.col("bb_upper") - F.col("bb_lower"), F.col("bb_mid")
        return df.withColumns({"bb_pct_b": (close - F.col("bb_lower")) / nz(span), "bb_bandwidth": span / nz(mid) * 100, "bb_dist_mid_pct": (close - mid) / nz(mid) * 100})

    def finish(df: DataFrame) -> DataFrame:
        outside = no(close > F.col("bb_upper")).cast("int") - no(close < F.col("bb_lower")).cast("int")
        return df.withColumns(
            {
                "bb_squeeze": no(F.col("bb_bandwidth_pctile") < squeeze),
                "bb_break": outside.cast("tinyint"),
                "bb_is_warmup": any_null(["bb_mid", "bb_pct_b", "bb_bandwidth", "bb_bandwidth_pctile"]) | head_rows(rows),
            }
        )

    columns = ["bb_mid", "bb_upper", "bb_lower", "bb_std", "bb_pct_b", "bb_bandwidth", "bb_dist_mid_pct", "bb_bandwidth_pctile", "bb_squeeze", "bb_break", "bb_is_warmup"]
    return Block("bollinger", columns, after, before, ranks=[Rank("bb_bandwidth_pctile", "bb_bandwidth", rank_rows, rank_least)], finish=finish, reach=max(20, rows), reads=())


#: The families by name; another one is added by adding its maker.
BLOCKS: dict[str, Callable[..., Block]] = {"rsi": rsi_block, "macd": macd_block, "atr": atr_block, "adx": adx_block, "bollinger": bollinger_block}


def single(name: str, df: DataFrame, **options) -> DataFrame:
    """df with the columns of one block."""
    return build(df, [BLOCKS[name](**options)])


def rsi(df: DataFrame, **options) -> DataFrame:
    return single("rsi", df, **options)


def macd(df: DataFrame, **options) -> DataFrame:
    return single("macd", df, **options)


def atr(df: DataFrame, **options) -> DataFrame:
    return single("atr", df, **options)


def adx(df: DataFrame, **options) -> DataFrame:
    return single("adx", df, **options)


def bollinger(df: DataFrame, **options) -> DataFrame:
    return single("bollinger", df, **options)


#: Columns that no model reads, as their scale follows the price or they lead to others.
RAW_SCALE = ["macd", "macd_signal", "macd_hist", "true_range", "atr_14", "bb_mid", "bb_upper", "bb_lower", "bb_std"]
INTERMEDIATE = ["dx"]
SEED_BARS = 1250
#: Rows of a seed that one block needs: enough for averages to settle, and for the ranks a whole window besides.
OWN_SEED = {"rsi": 250, "macd": 250, "adx": 250, "atr": 1000 + 5 * 14, "bollinger": 1000 + 20}


def build_features(df: DataFrame, blocks: Sequence[str] = tuple(BLOCKS)) -> DataFrame:
    """All blocks side by side and is_warmup, the OR of their flags."""
    out = build(df, [BLOCKS[b]() for b in blocks])
    flags = [c for c in out.columns if c.endswith("_is_warmup")]
    return out.withColumn("is_warmup", reduce(lambda a, b: a | b, [F.col(c) for c in flags]))


def with_seed(df: DataFrame, seed: DataFrame, seed_bars: int) -> DataFrame:
    """df with the last seed_bars rows of each series of seed before it, marked by _seed. Raises ValueError unless the
    seed of every series ends strictly before its data begin."""
    require_after(seed, df)
    df = plain(df)
    placed = numbered(plain(seed).select(df.columns))
    totals = placed.groupBy(SERIES).agg(F.count("*").alias("_total"))
    tail = placed.join(totals, SERIES).where(F.col("_r") >= F.col("_total") - seed_bars).select(df.columns)
    return tail.withColumn("_seed", F.lit(True)).unionByName(df.withColumn("_seed", F.lit(False)))


def attach_features(df: DataFrame, seed: DataFrame | None = None, seed_bars: int = SEED_BARS, blocks: Sequence[str] = tuple(BLOCKS)) -> DataFrame:
    """Features of df with a warm start: the last seed_bars rows of each series of seed go before it and are dropped
    again. After a warm start every block's flag says whether any value column of the row is NULL."""
    if seed is None:
        return build_features(df, blocks)
    out = build_features(with_seed(df, seed, seed_bars), blocks).where("not _seed").drop("_seed")
    values = [c for c in out.columns if c not in df.columns and not c.endswith("is_warmup")]
    missing = any_null(values)
    return out.withColumns({c: missing for c in out.columns if c.endswith("is_warmup")})


def attach_block(df: DataFrame, name: str, seed: DataFrame | None = None, seed_bars: int | None = None) -> DataFrame:
    """One block with a warm start from as many rows as it needs (OWN_SEED) unless told."""
    out = attach_features(df, seed, OWN_SEED[name] if seed_bars is None else seed_bars, (name,))
    return out.drop("is_warmup")


def model_columns(df: DataFrame) -> list[str]:
    """Feature columns that models read, in order."""
    bars_own = {"series_id", "ts", "open", "high", "low", "close", "n_ticks", "session_date", "bar_of_day", "is_session_open", "is_session_close", "ingest_seq", "fwd", "y"}
    dropped = bars_own | set(RAW_SCALE) | set(INTERMEDIATE)
    return [c for c in plain(df).columns if c not in dropped and not c.endswith("is_warmup") and not c.startswith(("src_", "regime", "ret_"))]


def summary(df: DataFrame) -> DataFrame:
    """count, mean, sample deviation, minimum, median and maximum of every double column after the warm-up."""
    names = [c for c, t in df.dtypes if t == "double"]
    long = df.where("not is_warmup").select(*names).unpivot([], names, "column_name", "x")
    return long.groupBy("column_name").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.percentile("x", 0.5).alias("median"), F.max("x").alias("max")
    )


def flag_shares(df: DataFrame) -> DataFrame:
    """Percent of all rows with each flag."""
    names = [c for c, t in df.dtypes if t == "boolean"]
    long = df.select(*[F.col(c).cast("int").alias(c) for c in names]).unpivot([], names, "flag", "x")
    return long.groupBy("flag").agg((F.avg("x") * 100).alias("share_pct"))


#: The columns of the exported tables, and those that the RSI summary describes.
RSI_EXPORT = ["session_date", "bar_of_day", "open", "high", "low", "close", "rsi_7", "rsi_14", "rsi_21", "rsi_14_norm", "rsi_14_chg", "rsi_14_slope_5", "rsi_spread_7_21", "rsi_14_overbought", "rsi_14_oversold", "rsi_14_zone", "rsi_is_warmup"]
REGIME_EXPORT = ["session_date", "close", "regime", "regime_confidence", "regime_changepoint", "regime_entropy", "regime_changed"]
RSI_SUMMARY = ["rsi_7", "rsi_14", "rsi_21", "rsi_14_chg", "rsi_spread_7_21"]


def exported(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Series, time without a zone and those of the columns that df has, and the probabilities of regimes."""
    named = [c for c in columns if c in df.columns] + [c for c in df.columns if c.startswith("regime_p_") and "regime" in columns]
    return df.select(SERIES, F.col(TIME).cast("timestamp_ntz").alias(TIME), *named)


def rsi_summary(df: DataFrame) -> DataFrame:
    """The RSI columns described over all rows by split (a column of df), and the shares of its flags in percent."""
    long = df.unpivot(["split"], RSI_SUMMARY, "feature", "x").groupBy("feature", "split")
    values = long.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.percentile("x", 0.5).alias("median"), F.max("x").alias("max"))
    flags = {"rsi_14_overbought": "overbought_pct", "rsi_14_oversold": "oversold_pct", "rsi_is_warmup": "warmup_pct"}
    shares = df.select("split", *[(F.col(c).cast("int") * 100.0).alias(n) for c, n in flags.items()]).unpivot(["split"], list(flags.values()), "feature", "x")
    return values.unionByName(shares.groupBy("feature", "split").agg(F.avg("x").alias("mean")), allowMissingColumns=True)


def column_catalogue(df: DataFrame) -> DataFrame:
    """For each feature column its block and whether models read it."""
    reads = set(model_columns(df))
    prefix = {"rsi": "rsi", "macd": "macd", "true_range": "atr", "tr_over": "atr", "atr": "atr", "di_": "adx", "dx": "adx", "adx": "adx", "bb_": "bollinger"}
    rows = [(k, c, next((b for p, b in prefix.items() if c.startswith(p)), "bars"), c in reads) for k, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, block string, is_model_input boolean")
