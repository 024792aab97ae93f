"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import stored, table, word_count

#: Seeded order of documents: 52 bits of a digest, so that they are exact in every SQL engine.
HASH_HEX = 13
BINS = 1024


def seeded_rank(doc_id: Column, body: Column, seed: int) -> Column:
    """A reproducible 52-bit number of a document's id and text, so that texts without an id differ, too."""
    digest = F.md5(F.coalesce(body.cast("string"), F.lit("")).cast("binary"))
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), digest)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_HEX), 16, 10).cast("long")


def water_fill(sources: DataFrame, budget_ratio: float, max_epochs: float) -> DataFrame:
    """Targets of sources(_source, _weight, _total).

    Every round shares what the clamped sources leave over the free ones by weight and clamps those above
    max_epochs times their size, until none is above. Only two sums reach the driver in a round; the table has a
    row for each source. Rounds end as each clamps at least one source.
    """
    filled = sources.withColumn("_cap", F.col("_total") * F.lit(float(max_epochs))).withColumn("_clamped", F.lit(False))
    budget = sources.agg(F.sum("_total")).first()[0]
    budget = float(budget or 0) * budget_ratio
    level = 0.0
    while True:
        row = filled.agg(F.sum(F.when(F.col("_clamped"), F.col("_cap"))), F.sum(F.when(~F.col("_clamped"), F.col("_weight")))).first()
        spent, weight = float(row[0] or 0), float(row[1] or 0)
        if not weight:
            break
        level = max(0.0, budget - spent) / weight
        above = ~F.col("_clamped") & (F.col("_weight") * F.lit(level) > F.col("_cap"))
        if not filled.where(above).limit(1).count():
            break
        filled = stored(filled.withColumn("_clamped", F.col("_clamped") | above), "mix-fill")
    target = F.when(F.col("_clamped"), F.col("_cap")).otherwise(F.col("_weight") * F.lit(level))
    return filled.withColumn("_target", target.cast("double")).drop("_cap", "_clamped")


def plan_mix(
    sized: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), budget_ratio: float = 1.5, max_epochs: float = 2.0
) -> DataFrame:
    """One row for each source of sized(_source, _size, _rank): its target, whole repetitions and last rank of the
    fractional one.

    The fractional repetition takes documents in the seeded order until its share of words is reached. The place
    where it ends is found from word counts by (source, bin of rank) and then inside that one bin, so no task sees
    a whole source.
    """
    totals = sized.groupBy("_source").agg(F.sum("_size").alias("_total"))
    position = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = totals.withColumn("_weight", F.element_at(cycle, (position % len(weights) + 1).cast("int")))
    filled = water_fill(stored(weighted, "mix-sources"), budget_ratio, max_epochs)
    ratio = F.when(F.col("_total") > 0, F.col("_target") / F.col("_total")).otherwise(0.0)
    filled = filled.withColumn("_whole", F.floor(ratio).cast("long")).withColumn(
        "_need", F.col("_target") - F.col("_whole") * F.col("_total")
    )
    filled = stored(filled, "mix-targets")

    width = 16**HASH_HEX // BINS
    binned = sized.withColumn("_bin", F.floor(F.col("_rank") / width))
    by_bin = binned.groupBy("_source", "_bin").agg(F.sum("_size").alias("_words"))
    upto = F.sum("_words").over(Window.partitionBy("_source").orderBy("_bin"))
    near = by_bin.withColumn("_upto", upto)
    same = F.col("s._source").eqNullSafe(F.col("b._source"))
    edge = (
        filled.alias("s")
        .join(near.alias("b"), same)
        .where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_words") < F.col("_need")))
        .select("s._source", "_bin", (F.col("_need") - F.col("_upto") + F.col("_words")).alias("_left"))
    )
    same = F.col("e._source").eqNullSafe(F.col("d._source")) & (F.col("e._bin") == F.col("d._bin"))
    inside = (
        binned.alias("d")
        .join(edge.alias("e"), same)
        .groupBy("d._source", "_rank")
        .agg(F.sum("_size").alias("_words"), F.first("_left").alias("_left"), F.first("e._bin").alias("_bin"))
    )
    upto = F.sum("_words").over(Window.partitionBy("_source").orderBy("_rank"))
    cut = (
        inside.withColumn("_upto", upto)
        .groupBy("_source")
        .agg(
            # a document is in when at least half of it lies below the line
            F.max(F.when(F.col("_upto") - F.col("_words") / 2 <= F.col("_left"), F.col("_rank"))).alias("_in"),
            (F.first("_bin") * width - 1).alias("_below"),
        )
        .select("_source", F.coalesce("_in", "_below").alias("_cut"))
    )
    same = F.col("s._source").eqNullSafe(F.col("c._source"))
    return stored(
        filled.alias("s")
        .join(cut.alias("c"), same, "left")
        .select("s._source", "_total", "_target", "_whole", F.coalesce("_cut", F.lit(-1)).alias("_cut")),
        "mix-plan",
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    budget_ratio: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """All rows of docs with mix_size, mix_source_size, mix_target, mix_copies and mix_taken (words, repeats counted).

    Sources in code-point order, null last, get the weights in turn and share budget_ratio of all words; a target
    stops at max_epochs times its source's words and the excess goes to the others by weight. Whole repetitions go
    to every document, the fractional one to a seeded part. Null texts have size 0 and take nothing; a null source
    is a source; rows with equal id and text, null ids included, are decided alike; empty tables give no rows; columns of these names in docs are
    replaced.
    """
    rank = seeded_rank(F.col(id_col), F.col(text_col), seed)
    sized = docs.select(F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size"), rank.alias("_rank"))
    plan = plan_mix(stored(sized, "mix-sizes"), weights, budget_ratio, max_epochs)
    made = ["mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken"]
    rows = docs.drop(*made)
    same = F.col(f"d.{source_col}").eqNullSafe(F.col("p._source"))
    size = word_count(F.col(f"d.{text_col}"))
    copies = F.col("_whole") + (seeded_rank(F.col(f"d.{id_col}"), F.col(f"d.{text_col}"), seed) <= F.col("_cut")).cast("long")
    return (
        rows.alias("d")
        .join(plan.alias("p"), same)
        .select(
            "d.*",
            size.alias("mix_size"),
            F.col("_total").alias("mix_source_size"),
            F.col("_target").alias("mix_target"),
            copies.alias("mix_copies"),
        )
        .withColumn("mix_taken", F.col("mix_size") * F.col("mix_copies"))
    )


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
        F.col("mix_copies").alias("copies"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('17:' || COALESCE(doc_id::VARCHAR, '') || ':' || md5(COALESCE(text, ''))), 1, 13))::BIGINT AS rank
  FROM documents),
s AS (SELECT source, SUM(size)::DOUBLE AS total,
             [5.0, 2.0, 1.0][((ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
      FROM d GROUP BY source),
r AS (SELECT *, 2 * total AS cap, 2 * total / w AS ratio FROM s),
p AS (SELECT *, COALESCE(SUM(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
             SUM(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
             SUM(total) OVER () * 1.5 AS budget FROM r),
c AS (SELECT *, BOOL_AND(cap < w * ((budget - spent) / free)) OVER (ORDER BY ratio, source NULLS LAST) AS clamped FROM p),
l AS (SELECT ANY_VALUE(budget) - COALESCE(SUM(cap) FILTER (clamped), 0) AS rest, SUM(w) FILTER (NOT clamped) AS free FROM c),
t AS (SELECT source, total, CASE WHEN clamped THEN cap ELSE w * (rest / l.free) END AS target FROM c, l),
n AS (SELECT *, CASE WHEN total > 0 THEN FLOOR(target / total)::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT d.source, rank, SUM(size) AS words FROM d GROUP BY d.source, rank),
m AS (SELECT g.source, rank, n.target - n.whole * n.total AS need, words,
             SUM(words) OVER (PARTITION BY g.source ORDER BY rank) AS upto
      FROM g JOIN n ON g.source IS NOT DISTINCT FROM n.source),
k AS (SELECT source, MAX(rank) FILTER (need > 0 AND upto - words / 2 <= need) AS cut FROM m GROUP BY source)
SELECT d.doc_id, d.size, n.total::BIGINT AS source_size, n.target,
       (d.size * (n.whole + (d.rank <= COALESCE(k.cut, -1))::BIGINT))::BIGINT AS taken,
       (n.whole + (d.rank <= COALESCE(k.cut, -1))::BIGINT)::BIGINT AS copies
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""
