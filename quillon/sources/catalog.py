"""The library's tables under one base folder: bars, features, regimes and predictions by split and month.

Tables are known to the session's catalog, so SQL reads them, too. A reader names a split and a stretch of time; both
reach the scan, the first as partitions that are not listed, the second also as row groups that are passed over. How far
back the last bars of a series reach is found from counts by month, for which no other column is read.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.config import TABLES, Layout
from quillon.functions import SERIES, TIME
from quillon.operators.bars import require_after
from quillon.operators.blocks import HALO, plain
from quillon.operators.features import build_features, with_seed

PARTS = ["split", "month"]


def _month(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM")


class Catalog:
    """Tables of one base folder in a session. Another session that opens the same folder finds what was written."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.layout = spark, Layout(base)
        self.prefix = f"quillon_{uuid.uuid5(uuid.NAMESPACE_URL, base).hex[:12]}"

    def table(self, name: str) -> str:
        """The table's name in SQL."""
        if name not in TABLES:
            raise ValueError(f"no table is named {name}: there are {', '.join(TABLES)}")
        return f"{self.prefix}_{name}"

    def _known(self, name: str) -> bool:
        """Whether the table exists; one that another session wrote becomes known here."""
        full = self.table(name)
        if self.spark.catalog.tableExists(full):
            return True
        try:
            schema = self.spark.read.parquet(self.layout.table(name)).schema
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return False
            raise
        columns = ", ".join(f"`{f.name}` {'STRING' if f.name in PARTS else f.dataType.simpleString()}" for f in schema.fields)
        self.spark.sql(f"CREATE TABLE {full} ({columns}) USING parquet PARTITIONED BY (split, month) LOCATION '{self.layout.table(name)}'")
        self.spark.sql(f"ALTER TABLE {full} RECOVER PARTITIONS")
        return True

    def _put(self, df: DataFrame, name: str, split: str, mode: str) -> None:
        full = self.table(name)
        rows = plain(df).withColumns({"split": F.lit(split), "month": _month(F.col(TIME))})
        rows = rows.select(*[c for c in rows.columns if c not in PARTS], *PARTS)
        # a month's rows lie together and in order, so that a row group has a short stretch of time
        rows = rows.repartitionByRange("month", TIME, SERIES).sortWithinPartitions("month", TIME, SERIES)
        if not self._known(name):
            rows.write.partitionBy(*PARTS).option("path", self.layout.table(name)).saveAsTable(full)
        elif mode == "append":
            rows.write.insertInto(full)
        else:
            view = f"put_{uuid.uuid4().hex}"
            rows.drop("split").createOrReplaceTempView(view)
            columns = ", ".join(f"`{c}`" for c in rows.columns if c != "split")
            self.spark.sql(f"INSERT OVERWRITE TABLE {full} PARTITION (split = '{split}', month) SELECT {columns} FROM {view}")
            self.spark.catalog.dropTempView(view)
        self.spark.catalog.refreshTable(full)

    def write(self, df: DataFrame, name: str, split: str) -> None:
        """Replaces a split of a table, all its months, and leaves the others."""
        self._put(df, name, split, "overwrite")

    def append(self, df: DataFrame, name: str, split: str) -> None:
        self._put(df, name, split, "append")

    def read(self, name: str, split: str | None = None, since: dt.datetime | None = None, until: dt.datetime | None = None) -> DataFrame:
        """Rows of a split, or of all, from since on and before until. FileNotFoundError where nothing was written."""
        if not self._known(name):
            raise FileNotFoundError(f"table {name} is missing under {self.layout.base}: write it first")
        rows = self.spark.table(self.table(name))
        if split is not None:
            rows = rows.where(F.col("split") == split)
        if since is not None:
            rows = rows.where((F.col("month") >= since.strftime("%Y-%m")) & (F.col(TIME) >= F.lit(since).cast("timestamp_ntz")))
        if until is not None:
            rows = rows.where((F.col("month") <= until.strftime("%Y-%m")) & (F.col(TIME) < F.lit(until).cast("timestamp_ntz")))
        return rows.drop(*PARTS)

    def tail(self, name: str, bars: int) -> DataFrame:
        """The months that hold the last `bars` rows of every series, whatever the split; earlier ones are not read.

        How far back that is follows from counts by month and series, which need no column but these."""
        full = self.spark.table(self.table(name))
        counts = full.groupBy(SERIES, "month").agg(F.count("*").alias("n"))
        later = F.sum("n").over(Window.partitionBy(SERIES).orderBy(F.col("month").desc()).rowsBetween(Window.unboundedPreceding, -1))
        first = counts.withColumn("later", F.coalesce(later, F.lit(0))).where(F.col("later") < bars).agg(F.min("month")).first()[0]
        return full.where(F.col("month") >= F.lit(first)).drop(*PARTS)


def append_bars(catalog: Catalog, new: DataFrame, split: str, seed_bars: int = HALO) -> None:
    """Adds later bars and their features to tables that may have a long history.

    Only the months with the last seed_bars rows of the series are read again; by default as many rows as any feature
    remembers, so that the tables end as if they had been built whole. ValueError unless the new bars of each series
    begin after its last one. Jobs run before this returns.
    """
    if catalog._known("bars"):
        history = catalog.tail("bars", seed_bars)
        seed = history.select(new.columns)
        require_after(seed, new)
        features = build_features(with_seed(new, seed, seed_bars)).where("not _seed").drop("_seed")
    else:
        features = build_features(new)
    catalog.append(features, "features", split)
    catalog.append(new, "bars", split)
