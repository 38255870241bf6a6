"""Retries of a crawl, sums of sessions, capacity and the activity feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Seconds that a crawl waits before its second and third try of a page.
WAITS = (2.0, 5.0)


def retried(attempts: DataFrame, key: str, order: str, ok: str, error: str) -> DataFrame:
    """(key, status, tries, waited, error) of pages whose tries are recorded in order.

    A page is tried again after WAITS while tries fail; tries beyond that, or after a success, are not made and not counted.
    The last error is kept where all fail.
    """
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    made = attempts.select(key, F.col(order).alias("_o"), F.col(ok).alias("_ok"), F.col(error).alias("_e"), n.alias("_n")).where(F.col("_n") <= len(WAITS) + 1)
    folded = made.groupBy(key).agg(F.min(F.when(F.col("_ok"), F.col("_n"))).alias("_first"), F.max("_n").alias("_all"), F.max_by(F.col("_e"), F.col("_n")).alias("_last"))
    tries = F.coalesce("_first", "_all")
    waited = sum((F.when(tries > i, seconds).otherwise(0.0) for i, seconds in enumerate(WAITS, 1)), F.lit(0.0))
    return folded.select(key, F.when(F.col("_first").isNotNull(), "scraped").otherwise("failed").alias("status"), tries.cast("long").alias("tries"), waited.alias("waited"), F.when(F.col("_first").isNull(), F.col("_last")).alias("error"))


def session_sums(steps: DataFrame, session: str, chars: Column, ok: Column) -> DataFrame:
    """(session, sources, succeeded, failed, char_count) of scrape steps; characters count for steps that succeeded."""
    return steps.groupBy(session).agg(F.count("*").alias("sources"), F.count_if(ok).alias("succeeded"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"), F.coalesce(F.sum(F.when(ok, chars)), F.lit(0)).cast("long").alias("char_count"))


def capacity(points: DataFrame, group: str, most: int) -> DataFrame:
    """(group, docs, free, full_percent): how full each index is."""
    n = F.count("*")
    return points.groupBy(group).agg(n.alias("docs"), F.greatest(F.lit(most) - n, F.lit(0)).alias("free"), F.round(n * 100.0 / most, 2).alias("full_percent"))


def feed(jobs: DataFrame, ts: str, tie: str, kinds: list[str] | None = None, kind: str = "kind", most: int = 50) -> DataFrame:
    """The latest jobs, newest first (rank from 1): a take-ordered, not a sort of the table."""
    chosen = jobs if kinds is None else jobs.where(F.col(kind).isin(*kinds))
    last = chosen.orderBy(F.desc(ts), tie).limit(most)
    return last.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(ts), tie)))  # of at most that many rows
