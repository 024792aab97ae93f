"""Long series in blocks, so that windows over a single series run on all cores.

Rows are numbered from counts by (series, stretch of days), of which there is one row each, so no task sees a whole
series. A block is a fixed number of neighbouring rows; before its own rows it repeats the last ones of the block
before (the halo), which is what a warm start is, and after them, where a window looks ahead, the first ones of the next.
Windows by series then run inside (series, block). Sums over all rows so far are sums inside a block and totals of the
blocks before it.

Rows that have been numbered keep their place in _r, so that operators in a row share one numbering; `plain` takes it off.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import ORDER, SERIES, TIME

#: Rows that linear recurrences sum up together; blocks are whole numbers of them.
CHUNK = 256
BLOCK = 32 * CHUNK
#: Rows before a block that windows may look back on: a rank over 1000 rows of an average that needs as many to settle.
HALO = 8 * CHUNK
STRETCH_DAYS = 32


def numbered(df: DataFrame, gaps: Sequence[str] = ()) -> DataFrame:
    """df with _r, the place of a row in its series from 0 on, and for each column of gaps _gap_<column>: whether there
    is a NULL up to this row that comes after a value. Rows need a series and a time; rows that have all this are left as
    they are."""
    if "_r" in df.columns and all(f"_gap_{c}" in df.columns for c in gaps):
        return df
    df = plain(df)
    day = F.datediff(F.to_date(TIME), F.lit("1970-01-01").cast("date"))
    df = df.withColumn("_stretch", F.floor(day / STRETCH_DAYS).cast("int"))
    inside = Window.partitionBy(SERIES, "_stretch").orderBy(TIME)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(SERIES).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    made = [F.count("*").alias("_rows")]
    for k, c in enumerate(gaps):
        made += [F.count(c).alias(f"_some{k}"), F.max(F.when(F.col(c).isNull(), F.col(TIME))).alias(f"_null{k}"), F.min(F.when(F.col(c).isNotNull(), F.col(TIME))).alias(f"_first{k}")]
    sizes = df.groupBy(SERIES, "_stretch").agg(*made)
    given = [F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before")]
    for k in range(len(gaps)):
        first = F.min(f"_first{k}").over(before)
        gap = F.coalesce(F.max(f"_null{k}").over(before) > first, F.lit(False))
        given += [first.isNotNull().alias(f"_seen{k}"), gap.alias(f"_gap_before{k}")]
    joined = df.join(sizes.select(SERIES, "_stretch", *given), [SERIES, "_stretch"])
    out = {"_r": F.row_number().over(inside) - 1 + F.col("_rows_before")}
    for k, c in enumerate(gaps):
        seen = F.col(f"_seen{k}") | (F.count(c).over(upto) > 0)
        out[f"_is_gap{k}"] = F.col(c).isNull() & seen
    joined = joined.withColumns(out)
    joined = joined.withColumns({f"_gap_{c}": F.col(f"_gap_before{k}") | F.max(f"_is_gap{k}").over(upto) for k, c in enumerate(gaps)})
    return joined.drop("_stretch", "_rows_before", *[f"_{x}{k}" for k in range(len(gaps)) for x in ("seen", "gap_before", "is_gap")])


def plain(df: DataFrame) -> DataFrame:
    """df without what numbered adds."""
    return df.drop("_r", *[c for c in df.columns if c.startswith("_gap_")])


@contextmanager
def _chunks_first():
    """Inside, windows by time order by (_c, time): the same order, of which windows by chunk are a part, so that all
    windows share one sort."""
    before = ORDER.set(("_c",))
    try:
        yield
    finally:
        ORDER.reset(before)


def in_blocks(df: DataFrame, build: Callable[[DataFrame], DataFrame], halo: int = HALO, gaps: Sequence[str] = (), rows: int = BLOCK, ahead: int = 0) -> DataFrame:
    """build(df) block by block; build adds columns from windows over by_time() that look back on at most halo rows and
    forward to at most ahead rows.

    An average that never forgets a NULL is told of one that lies before the halo by a NULL in the halo's second row.
    """
    if "_c" in df.columns:
        return build(df)
    kept_place = "_r" in df.columns
    halo = -(-halo // CHUNK) * CHUNK
    rows = max(rows, 4 * halo, 4 * ahead)
    gaps = [c for c in gaps if c in df.columns]
    own = F.floor(F.col("_r") / rows).cast("int")
    near = [F.when(F.col("_r") % rows >= rows - halo, own + 1)] + ([F.when((F.col("_r") % rows < ahead) & (own > 0), own - 1)] if ahead else [])
    blocks = F.array_compact(F.array(own, *near))
    placed = numbered(df, gaps).withColumn("_block", F.explode(blocks)).withColumns({"_own": F.col("_block") == own, "_c": F.floor(F.col("_r") / CHUNK).cast("int")})
    into = F.col("_r") - (F.col("_block").cast("long") * rows - halo)
    head: dict[str, Column] = {}
    for c in gaps:
        lost = ~F.col("_own") & F.col(f"_gap_{c}")
        head[c] = F.when(lost & (into == 1), F.lit(None)).when(lost & (into == 0), F.coalesce(F.col(c), F.lit(1).cast(df.schema[c].dataType))).otherwise(F.col(c))
    placed = placed.withColumns({**head, SERIES: F.struct(SERIES, "_block")}).drop("_block")
    if not kept_place:
        placed = placed.drop(*[c for c in placed.columns if c.startswith("_gap_")])
    # blocks are few bytes and much work: by number, so that partitions are not put together by their size
    placed = placed.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), SERIES)
    with _chunks_first():
        built = build(placed)
    made = [c for c in built.columns if c not in {*df.columns, "_r", "_c", "_own"} and not c.startswith("_gap_")]
    kept = [F.col(f"{SERIES}.{SERIES}").alias(SERIES) if c == SERIES else F.col(f"`{c}`") for c in df.columns]
    return built.where("_own").select(*kept, *made)


def keyed(df: DataFrame, keys: Sequence[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run(df) where a series is one of each value of keys: every model's rows of a series, say, are a series of their own."""
    if not keys:
        return run(df)
    both = plain(df).withColumns({SERIES: F.struct(*keys, SERIES)})
    out = run(both)
    return out.withColumn(SERIES, F.col(f"{SERIES}.{SERIES}"))


def running(df: DataFrame, sums: dict[str, Column], rows: int = BLOCK) -> DataFrame:
    """df with the sum of each expression over all rows of its series so far. Only totals by block are summed in a row."""
    placed = numbered(df).withColumn("_part", F.floor(F.col("_r") / rows).cast("int"))
    placed = placed.withColumns({f"_x{k}": x for k, x in enumerate(sums.values())})
    totals = placed.groupBy(SERIES, "_part").agg(*[F.sum(f"_x{k}").alias(f"_t{k}") for k in range(len(sums))])
    before = Window.partitionBy(SERIES).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(SERIES, "_part", *[F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0)).alias(f"_t{k}") for k in range(len(sums))])
    inside = Window.partitionBy(SERIES, "_part").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(totals, [SERIES, "_part"]).withColumns({c: F.col(f"_t{k}") + F.sum(f"_x{k}").over(inside) for k, c in enumerate(sums)})
    out = out.drop("_part", *[f"_{x}{k}" for x in "xt" for k in range(len(sums))])
    return out if "_r" in df.columns else plain(out)
