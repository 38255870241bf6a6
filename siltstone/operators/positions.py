"""Rows by position: numbers over a whole table, and tables joined side by side.

Rows are dealt by ranges of their order, sorted inside them and written once to the checkpoint folder; the counts of the ranges
(one row a range) give each its first number.  No task sees more than its range.

Defined results: nulls come first; rows that the order doesn't tell apart are numbered in any order, so name a
column that does; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.operators.sessions import checkpoint_folder


def numbered(rows: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """rows with their number, from 0, in an order."""
    checkpoint_folder(rows.sparkSession)
    whole = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), F.struct(*order).alias("_order"))
    ranged = whole.repartitionByRange("_order").sortWithinPartitions("_order").select("_row").checkpoint()
    placed = ranged.withColumn("_at", F.monotonically_increasing_id())  # the partition, and the place in it
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", "_first", before.alias("_before"))  # as many rows as there are partitions
    out = placed.withColumn("_part", part).join(F.broadcast(counts), "_part")
    return out.select("_row.*", (F.col("_before") + F.col("_at") - F.col("_first")).alias(name))


def zipped(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], longest: bool = False) -> DataFrame:
    """(position, left, right): the rows of two tables side by side as structures, as far as the shorter one goes, or the longer one."""
    a = numbered(left, *left_order, name="_position").select(F.col("_position").alias("position"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("left"))
    b = numbered(right, *right_order, name="_position").select(F.col("_position").alias("position"), F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("right"))
    return a.join(b, "position", "full" if longest else "inner")
