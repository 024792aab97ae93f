"""Readers and writers: raw bar CSV, Parquet tables, model parameters, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillon.functions import SERIES, TIME
from quillon.operators import bars as B
from quillon.operators import evaluate as E

REQUIRED = ["date", "time", "open", "high", "low", "close"]
#: Fixed value: how raw files write a time, without its offset.
CLOCK = "dd-MM-yyyy HH:mm:ss"
#: Vendor columns that the raw file may have.
VENDOR = ["pivot", "200_EMA", "Supertrend(12,3)", "Supertrend(11,2)", "Supertrend(10,1)"]


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """Lines of raw CSV files as text columns, with _line (the line where it has too few or too many fields, else NULL) and
    ingest_seq: the file, the byte at which the part that a task reads begins, and the place inside that part. Ordered by
    it, lines are in the order of file names and of lines in a file, however files are cut and dealt to tasks."""
    header = spark.read.option("header", True).csv(path).schema
    missing = [c for c in REQUIRED if c not in header.names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    schema = StructType([StructField(n, StringType()) for n in header.names]).add("_line", StringType())
    lines = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").csv(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    return lines.select("*", place.alias("ingest_seq"))


def _typed(raw: DataFrame, series_id: str, strict: bool) -> DataFrame:
    """Typed bars of raw lines; text that isn't a time or a number raises when it is read, or becomes NULL."""
    clock = F.concat_ws(" ", F.trim("date"), F.substring("time", 1, 8))
    time = (F.to_timestamp if strict else F.try_to_timestamp)(clock, F.lit(CLOCK) if not strict else CLOCK)

    def number(c: str) -> Column:
        return F.col(f"`{c}`").cast("double") if strict else F.col(f"`{c}`").try_cast("double")

    prices = [number(c).alias(c) for c in ("close", "open", "high", "low")]
    vendor = [number(c).alias(f"src_{c}") for c in VENDOR if c in raw.columns]
    return raw.select(F.lit(series_id).alias(SERIES), time.alias(TIME), *prices, *vendor, "ingest_seq", *([] if strict else [F.struct(*[f"`{c}`" for c in raw.columns if c != "ingest_seq"]).alias("_raw")]))


def read_raw_bars(spark: SparkSession, path: str, series_id: str = "ALL") -> DataFrame:
    """Raw CSV, one file or many, as typed bars: columns are read as text and cast by name; `ingest_seq` orders lines by
    file, then by their place in it.

    Raises ValueError when a required column is missing; a malformed time or price, and a line with too few or too many
    fields, raise when they are read.
    """
    raw = _raw(spark, path)
    broken = F.raise_error(F.concat(F.lit("a line has too few or too many fields: "), F.col("_line")))
    raw = raw.withColumn("date", F.when(F.col("_line").isNotNull(), broken).otherwise(F.col("date")))
    return _typed(raw.drop("_line"), series_id, True)


def scan_raw_bars(spark: SparkSession, path: str, series_id: str = "ALL") -> tuple[DataFrame, DataFrame]:
    """(bars, rejected): as read_raw_bars, but lines that can't be read go to a table of their own, with ingest_seq, the
    first reason (fields, time, or the name of a price) and the line's fields as JSON. An empty price is no fault."""
    rows = _typed(_raw(spark, path), series_id, False)
    reason = F.when(F.col("_raw._line").isNotNull(), "fields").when(F.col(TIME).isNull(), "time")
    for c in ("open", "high", "low", "close"):
        reason = reason.when(F.col(c).isNull() & F.col(f"_raw.{c}").isNotNull(), c)
    rows = rows.withColumn("reason", reason)
    bars = rows.where("reason is null").drop("reason", "_raw")
    return bars, rows.where("reason is not null").select(SERIES, "ingest_seq", "reason", F.to_json("_raw").alias("fields"))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the session names in spark.checkpoint.dir, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in a scratch folder: what several steps read is made once and outlives lost executors, and nothing
    stays in their memory."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """One split of a table that write_split wrote; a missing one raises FileNotFoundError."""
    try:
        df = spark.read.parquet(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{folder} is missing: write it with write_split first") from e
        raise
    return df.where(F.col("split") == split).drop("split")


def write_split(df: DataFrame, folder: str, split: str) -> None:
    """Replaces one split of a partitioned table and leaves the others."""
    writer = df.withColumn("split", F.lit(split)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("split").parquet(folder)


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("overwrite").format(form).save(path)


def write_model(spark: SparkSession, params: dict, path: str) -> None:
    """Parameters of a fitted model as one JSON row, in a store that Spark reaches."""
    import json

    spark.createDataFrame([(json.dumps(params),)], "params string").coalesce(1).write.mode("overwrite").text(path)


def read_model(spark: SparkSession, path: str) -> dict:
    import json

    return json.loads("".join(r[0] for r in spark.read.text(path).collect()))


def report_text(row: dict, title: str) -> str:
    """A one-row audit as a markdown list."""
    return "\n".join([f"# {title}", "", *[f"- {k}: {v}" for k, v in row.items()], ""])


def quality_report(bars: DataFrame, title: str, earlier: DataFrame | None = None) -> str:
    """The audits of bars with session columns as markdown: for each series its integrity, its sessions and the shortest
    ones; with an earlier split, how many rows are in both."""
    sessions = {r[SERIES]: r.asDict() for r in B.session_audit(bars).collect()}
    short = B.short_sessions(bars).collect()
    out = []
    for r in B.integrity(bars).orderBy(SERIES).collect():
        row = r.asDict() | sessions.get(r[SERIES], {})
        out.append(report_text(row, f"{title}: {r[SERIES]}"))
        out += [f"- short session {s['session_date']}: {s['n_bars']} bars" for s in short if s[SERIES] == r[SERIES]]
    if earlier is not None:
        out.append(f"- rows in both splits: {B.overlap(earlier, bars).count()}")
    return "\n".join(out) + "\n"


def write_predictions(df: DataFrame, models: list[str], path: str) -> None:
    """Predictions of several models beside each other, with outcome and regime."""
    write_table(E.predictions_table(df, models), path)


def write_scaler(statistics: DataFrame, path: str) -> None:
    write_table(statistics.coalesce(1), path)
