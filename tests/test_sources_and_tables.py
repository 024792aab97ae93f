"""Raw files with faults and over many parts; recurrences called from SQL."""

import datetime as dt

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quillon import sources as S
from quillon.functions.tables import register
from quillon.operators import bars as B
from quillon.operators.scans import exponential, linear_scans, wilder

HEAD = "date,time,open,high,low,close,pivot\n"


def line(k, price, day="05-02-2024"):
    return f" {day} ,{9 + k // 60:02d}:{k % 60:02d}:00+05:30,{price},{price + 2},{price - 2},{price + 1},7\n"


def test_the_first_copy_is_that_of_the_first_file_and_line(spark, tmp_path):
    """Many files, read in small parts that tasks get in any order: copies are told apart by file and place."""
    for name, price in (("b", 300), ("a", 100), ("c", 500)):
        (tmp_path / f"{name}.csv").write_text(HEAD + "".join(line(k, price + k) for k in range(400)) + "".join(line(k, price + 900 + k) for k in range(0, 400, 7)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = S.read_raw_bars(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 10
        found = B.first_copies(rows).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(found) == 400
    assert all(r["open"] == 100 + (r["ts"].hour - 9) * 60 + r["ts"].minute and r["src_pivot"] == 7 for r in found)
    order = [(r["ingest_seq"]["file"][-5:], r["open"]) for r in rows.orderBy("ingest_seq").collect()]
    assert order[:2] == [("a.csv", 100.0), ("a.csv", 101.0)] and order[400] == ("a.csv", 1000.0) and order[-1] == ("c.csv", 500.0 + 900 + 399)


def test_faulty_lines_are_set_apart(spark, tmp_path):
    text = HEAD + line(0, 10) + "31-02-2024,09:05:00,1,2,0,1,7\n" + "06-02-2024,10:00:00,1,2,zero,1,7\n" + "06-02-2024,10:15:00,1,2\n" + "06-02-2024,10:30:00,1,2,0,1,7,8,9\n" + "06-02-2024,10:45:00,,2,0,1,7\n" + line(1, 20)
    (tmp_path / "x.csv").write_text(text)
    bars, rejected = S.scan_raw_bars(spark, str(tmp_path))
    assert [(r["open"], r["low"]) for r in bars.orderBy("ingest_seq").collect()] == [(10.0, 8.0), (None, 0.0), (20.0, 18.0)]
    found = rejected.orderBy("ingest_seq").collect()
    assert [r["reason"] for r in found] == ["time", "low", "fields", "fields"] and '"low":"zero"' in found[1]["fields"]
    with pytest.raises(Exception, match="too few or too many fields|CAST_INVALID_INPUT|CANNOT_PARSE_TIMESTAMP|zero"):
        S.read_raw_bars(spark, str(tmp_path)).collect()


def test_columns_that_must_be_there(spark, tmp_path):
    (tmp_path / "x.csv").write_text("date,time,open\n1,2,3\n")
    with pytest.raises(ValueError, match="high, low, close"):
        S.read_raw_bars(spark, str(tmp_path))


def test_sql_recurrences_are_those_of_the_scans(spark):
    rng = np.random.default_rng(77)
    rows = []
    for name, n in (("A", 60), ("B", 9), ("C", 40), (None, 30)):
        for k in range(n):
            gone = (name == "C" and k == 25) or (name == "A" and k < 3)
            rows.append((name, dt.datetime(2024, 3, 1) + dt.timedelta(hours=k), None if gone else float(rng.normal(50, 4)), k))
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, close double, other int").repartition(5)
    register(spark)
    df.createOrReplaceTempView("some_bars")
    for name, out, scan in (("wilder", "rma_14", wilder("y", "close", 14)), ("exponential", "ema_5", exponential("y", "close", 5))):
        size = out.split("_")[1]
        got = spark.sql(f"SELECT * FROM {name}(TABLE(some_bars) PARTITION BY (series_id) ORDER BY (ts), 'close', {size})")
        assert got.columns == ["series_id", "ts", "close", "other", out]
        want = linear_scans(df.where("series_id is not null"), [scan])
        both = got.join(want.select("series_id", "ts", "y"), ["series_id", "ts"])
        assert both.count() == 109 and both.where(F.col(out).isNull() != F.col("y").isNull()).count() == 0
        assert both.where(F.abs(F.col(out) - F.col("y")) > 1e-9).count() == 0 and got.where("series_id is null").count() == 30


@pytest.mark.parametrize("call", ["TABLE(some_bars), 'nothing', 3", "TABLE(some_bars), 'close', 0", "TABLE(some_bars), 'series_id', 3", "1, 'close', 3", "TABLE(some_bars), 'close', 'x'"])
def test_wrong_arguments_are_found_when_a_query_is_analysed(spark, call):
    register(spark)
    spark.sql("SELECT 'A' AS series_id, 1.0D AS close").createOrReplaceTempView("some_bars")
    with pytest.raises(AnalysisException):
        spark.sql(f"SELECT * FROM wilder({call})")
