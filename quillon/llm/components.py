"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges(u, v), u > v: hang the neighbours of each node under its smallest one.

    Only minima are grouped, so a node with very many neighbours is never collected; the join back can be split.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    hung = joined.where(F.col("v") > F.col("u")) if large else joined
    out = hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that links(a, b) name; component is the smallest node reachable.

    Steps repeat until nothing changes, about the logarithm of the longest chain; each is written to the shared
    folder. Two numbers of a step reach the driver. No links give no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stored(edges, "components")
    mark = None
    while True:
        row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(row) == mark or not row[0]:
            break
        mark = tuple(row)
        edges = stored(_star(_star(edges, True), False), "components")
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return ends.unionByName(roots)
