"""Connected components of an edge table, by alternating large-star and small-star steps.

No step gathers a component: minima are pre-aggregated and joined back, where there are many edges with salted keys, so
that a hub with very many of them is dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltstone.llm.shared import join_salted, saved, unestimated


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """Points each node's neighbours (the larger ones, or the smaller and itself) at its least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = join_salted(both, least, "u", "v", 2 * rows).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = join_salted(edges, least, "u", "v", rows).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): the least node that it reaches; nodes without edges are left out."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    rows, before = edges.count(), None
    edges = unestimated(saved(edges, rows))
    while True:
        # a table between the two keeps plans small, as each step reads its input several times
        edges = unestimated(saved(_star(unestimated(saved(_star(edges, True, rows), 2 * rows)), False, 2 * rows), rows))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, rows = now, now[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
