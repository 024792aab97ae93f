"""Tables by split and month: what is read, what is replaced, and features that grow with their bars."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import rounded
from quillon.operators import features as X
from quillon.sources.catalog import Catalog, append_bars

T0 = dt.datetime(2023, 11, 3)
SCHEMA = "series_id string, ts timestamp_ntz, open double, high double, low double, close double"


def bars(spark, n, seed=1, series=("A", "B"), hours=6):
    rng = np.random.default_rng(seed)
    rows = []
    for name in series:
        closes = (300 + rng.normal(0, 1, n).cumsum()).round(2)
        rows += [(name, T0 + dt.timedelta(hours=hours * k), c, c + 1.5, c - 0.5, c) for k, c in enumerate(closes.tolist())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_and_time_reach_the_scan(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    df = bars(spark, 600)
    half = dt.datetime(2024, 2, 1)
    catalog.write(df.where(F.col("ts") < F.lit(half)), "bars", "train")
    catalog.write(df.where(F.col("ts") >= F.lit(half)), "bars", "test")
    since, until = dt.datetime(2024, 2, 20), dt.datetime(2024, 3, 2, 12)
    some = catalog.read("bars", "test", since, until)
    plan = plan_of(some)
    assert "(2 paths)" in plan  # of ten partitions
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    files = some.inputFiles()
    assert len(files) == 2 and all("split=test" in f and ("month=2024-02" in f or "month=2024-03" in f) for f in files)
    want = df.where((F.col("ts") >= F.lit(since)) & (F.col("ts") < F.lit(until)))
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, want.collect()))
    assert spark.sql(f"SELECT count(*) FROM {catalog.table('bars')} WHERE split = 'train'").first()[0] == df.where(F.col("ts") < F.lit(half)).count()


def test_a_split_is_replaced_whole_and_others_stay(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    catalog.write(bars(spark, 300), "bars", "train")
    catalog.write(bars(spark, 40, 2), "bars", "test")
    catalog.write(bars(spark, 50, 3), "bars", "train")  # fewer months than before
    assert catalog.read("bars", "train").count() == 100 and catalog.read("bars", "test").count() == 80 and catalog.read("bars").count() == 180


def test_tables_are_found_again(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError, match="bars"):
        catalog.read("bars")
    with pytest.raises(ValueError, match="nothing"):
        catalog.read("nothing")
    catalog.write(bars(spark, 90), "bars", "train")
    spark.sql(f"DROP TABLE {catalog.table('bars')}")  # as a new session, which knows nothing
    again = Catalog(spark, str(tmp_path))
    assert again.read("bars", "train", dt.datetime(2023, 11, 20)).count() == 44 and set(again.read("bars").columns) == set(SCHEMA.replace(",", "").split()[::2])


def test_features_grow_as_if_built_whole(spark, tmp_path):
    """With a short seed for speed: the columns that remember no more are those of the whole series."""
    catalog = Catalog(spark, str(tmp_path))
    df = bars(spark, 900, hours=8)
    edges = [None, T0 + dt.timedelta(hours=8 * 500), T0 + dt.timedelta(hours=8 * 760), None]
    for low, high in zip(edges, edges[1:]):
        part = df if low is None else df.where(F.col("ts") >= F.lit(low))
        append_bars(catalog, part if high is None else part.where(F.col("ts") < F.lit(high)), "train" if low is None else "test", 400)
    names = ["series_id", "ts", "close", "bb_mid", "bb_pct_b", "macd_cross", "dm_plus", "rsi_7", "is_warmup"]
    names = [c for c in names if c in catalog.read("features").columns]
    got = rounded(catalog.read("features").select(names)).orderBy("series_id", "ts").collect()
    want = rounded(X.build_features(df).select(names)).orderBy("series_id", "ts").collect()
    assert len(got) == 1800 and sum(a[:-1] == b[:-1] for a, b in zip(got, want, strict=True)) == 1800
    # the last turn read the months of the last 400 bars alone
    tail = catalog.tail("bars", 400)
    months = {f.split("month=")[1][:7] for f in tail.inputFiles()}
    assert min(months) > "2024-02" and tail.count() >= 800
    assert catalog.read("bars").count() == 1800
    with pytest.raises(ValueError, match="strictly before"):
        append_bars(catalog, df.limit(5), "test")
