"""Connected components of an edge table, distributed: alternating large-star and small-star rounds.

(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.) Every round is two
groupings by node that keep one minimum per node (map-side combined) and a join of that
minimum back to the edges, so a hub with any number of edges never sits in one task's memory
and the edge table never reaches the driver. Each round's edges are a table in the shared
folder. The rounds end as soon as the edges are stars, which one grouping by node tells: every
edge leads to a smaller node, so the middle of a star is its smallest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import cut, discard


def _hook(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation over edges (a, b), a > b."""
    if large:
        sym = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    else:
        sym = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    low = sym.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = sym.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
    return out.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (a, b), a > b, are stars: no node has two smaller ones, or one on either side."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count_if(F.expr("up > 1 or (up = 1 and down = 1)"))).first()[0] == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) in any order and number -> (node, component), component the smallest node; nodes without edges are absent.

    Null ends and loops are ignored; an empty table gives an empty table.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(e):
        after = cut(_hook(_hook(e, large=True), large=False), "edges")
        discard(e)
        e = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
