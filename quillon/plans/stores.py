"""Queries whose rows go through a sink and a source of the library: written to the shared folder, read again, used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import plans as P
from quillon import sources as S
from quillon.functions import SERIES, TIME, rounded
from quillon.operators import bars as B
from quillon.operators import dataset as D
from quillon.operators import features as X
from quillon.operators import models as M
from quillon.operators import regimes as R
from quillon.sources.catalog import Catalog, append_bars


def _raw_files(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """Bars of all ticks in the raw form (text date and time with an offset) as many files: each row twice, the second time
    with other prices and in later files. Also the rows, and where the files are."""
    df = B.bars(P._t(spark, d, "events"), sequence="event_id")
    raw = df.select(F.date_format(TIME, " dd-MM-yyyy ").alias("date"), F.concat(F.date_format(TIME, "HH:mm:ss"), F.lit("+05:30")).alias("time"), "open", "high", "low", "close", F.col("n_ticks").alias("pivot"))
    again = raw.withColumns({c: F.col(c) + 1 for c in ("open", "high", "low")})
    path = S.scratch_folder(spark, "raw")
    both = raw.withColumn("_copy", F.lit(0)).unionByName(again.withColumn("_copy", F.lit(1)))
    # by ranges, so that the files' names follow the copies
    dealt = both.repartitionByRange("_copy", "date", "time").sortWithinPartitions("_copy", "date", "time").drop("_copy")
    _write_raw(dealt, path)
    return raw, path


def _write_raw(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def raw_csv_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars that went through raw files, read and cleaned: first copies, regular session, session columns."""
    clean = B.session_columns(B.regular_session(B.first_copies(S.read_raw_bars(spark, _raw_files(spark, d)[1]))))
    clean = clean.withColumn(TIME, F.col(TIME).cast("timestamp_ntz"))
    return rounded(clean.select(SERIES, TIME, "open", "high", "low", "close", "src_pivot", "session_date", "bar_of_day", "is_session_open", "is_session_close"))


def raw_csv_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Raw files with faults: bars of the tenth hour have a word for a price, those of the eleventh a date that isn't one.
    Lines by what became of them."""
    raw, path = _raw_files(spark, d)
    hour = F.substring("time", 1, 2)
    faulty = raw.where(hour.isin("10", "11")).withColumn("low", F.when(hour == "10", "n/a").otherwise(F.col("low").cast("string")))
    _write_raw(faulty.withColumn("date", F.when(hour == "11", "31-02-2024").otherwise(F.col("date"))), path)
    bars, rejected = S.scan_raw_bars(spark, path)
    return bars.select(F.lit("read").alias("outcome")).unionByName(rejected.select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n_lines"))


def stored_splits(spark: SparkSession, d: str) -> DataFrame:
    """Features of both splits, the later one warm-started, as a partitioned table; its rows by split."""
    path = S.scratch_folder(spark, "features")
    train, test = P._split(P._bars(spark, d))
    S.write_split(X.attach_features(train, blocks=("rsi",)), path, "train")
    S.write_split(X.attach_features(test, train, blocks=("rsi",)), path, "test")
    parts = [S.read_split(spark, path, n).withColumn("split", F.lit(n)) for n in ("train", "test")]
    return rounded(parts[0].unionByName(parts[1]).select("split", SERIES, TIME, "close", "rsi_14", "rsi_is_warmup"))


def incremental_features(spark: SparkSession, d: str) -> DataFrame:
    """Features that came to their table in three turns, of which the later ones read the last months alone."""
    catalog = Catalog(spark, S.scratch_folder(spark, "tables"))
    train, test = P._split(P._bars(spark, d))
    middle = F.lit("2024-01-26").cast("timestamp_ntz")
    for split, part in (("train", train), ("test", test.where(F.col(TIME) < middle)), ("test", test.where(F.col(TIME) >= middle))):
        append_bars(catalog, part, split)
    return rounded(catalog.read("features"))


def stored_regimes(spark: SparkSession, d: str) -> DataFrame:
    """Regimes by a model that went through its store, written and read again."""
    path = S.scratch_folder(spark, "regimes")
    S.write_model(spark, P.FIXED_MODEL, f"{path}/model")
    df = R.regime_columns(P._for_model(spark, d), S.read_model(spark, f"{path}/model"), P.FIXED_INPUTS)
    catalog = Catalog(spark, path)
    catalog.write(df.select(SERIES, TIME, "regime", "regime_confidence"), "regimes", "train")
    return rounded(catalog.read("regimes", "train"))


def stored_scaler(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of a scaler from its store."""
    path = S.scratch_folder(spark, "scaler")
    S.write_scaler(D.scaler_statistics(P._windowed(spark, d), P.FIXED_INPUTS), path)
    return rounded(spark.read.parquet(path))


def stored_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of the rules on the validation part from their store."""
    path = S.scratch_folder(spark, "predictions")
    S.write_predictions(P._validated(spark, d), ["momentum", "reversal", "trend"], path)
    return rounded(spark.read.parquet(path))


def stored_classifier(spark: SparkSession, d: str) -> DataFrame:
    """A logistic regression on windows of returns, saved, loaded and asked again: rows by part, and those on which the
    loaded one says something else."""
    path = S.scratch_folder(spark, "classifier")
    rows = S.written(M.examples(D.chronological_split(D.windows(P._windowed(spark, d), P.FIXED_INPUTS))), "examples")
    model = M.train(rows, "logistic", 64)
    M.save(model, path, P.FIXED_INPUTS)
    loaded, names = M.load(path)
    keys = [SERIES, TIME, "part"]
    one, two = M.predict(model, rows).select(*keys, "p"), M.predict(loaded, rows).select(*keys, F.col("p").alias("p2"))
    both = one.join(two, keys).where(F.lit(names == P.FIXED_INPUTS))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("p") - F.col("p2")) > 1e-12).alias("n_other"))


QUERIES = {f.__name__: f for f in (raw_csv_bars, raw_csv_rejects, incremental_features, stored_splits, stored_regimes, stored_scaler, stored_predictions, stored_classifier)}
