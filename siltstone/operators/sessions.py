"""Sessions, monitors, conversations, crawls and event folds."""

from __future__ import annotations

import difflib
import os
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.operators.metrics import slot


def idle_sessions(events: DataFrame, key: str, ts: str, order: str, idle_s: int) -> DataFrame:
    """Sessions that end after idle_s seconds without an event."""
    by = Window.partitionBy(key).orderBy(ts, order)
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    gap = seconds - F.lag(seconds).over(by)
    marked = events.withColumn("_new", F.when(gap.isNull() | (gap >= idle_s), 1).otherwise(0)).withColumn("session", F.sum("_new").over(by))
    return marked.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("last"), F.count("*").alias("events"))


def page_changes(fetches: DataFrame, key: str, order: list[str], content: str) -> DataFrame:
    """Monitor verdicts: changed if there was earlier, non-empty content and it differs; with both lengths."""
    before = F.lag(content).over(Window.partitionBy(key).orderBy(*order))
    changed = (F.coalesce(before, F.lit("")) != "") & (before != F.col(content))
    return fetches.withColumn("changed", F.coalesce(changed, F.lit(False))).withColumn("previous_length", F.length(before)).withColumn("current_length", F.length(content))


def new_urls(results: DataFrame, monitor: str, url: str, ts: str, order: str, ttl_days: int = 90) -> DataFrame:
    """Results that a monitor hasn't seen in the last ttl_days (seen marks are set once and lapse)."""
    by = Window.partitionBy(monitor, url).orderBy(ts, order)
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    gap = seconds - F.lag(seconds).over(by)
    return results.withColumn("is_new", gap.isNull() | (gap >= ttl_days * 86_400))


def unified_diff(pairs: DataFrame, id_col: str, old: str, new: str, max_lines: int = 100) -> DataFrame:
    """(id, diff): unified diffs with three lines of context, cut at max_lines."""

    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(list(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), "previous", "current", lineterm="", n=3))[:max_lines]) for x, y in zip(a, b, strict=True)])

    return pairs.select(id_col, diff(old, new).alias("diff"))


def numbered_refs(turns: DataFrame, key: str, order: str) -> DataFrame:
    """Step numbers from 0 and reference names of a session's steps."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return turns.withColumn("step", n).withColumn("ref", F.concat(F.lit("ref_"), n.cast("string"), F.lit("_1")))


def context(rows: DataFrame, key: str, order: str, text: str, chars: int) -> DataFrame:
    """Numbered context of each key's texts, each cut to a number of characters."""
    piece = F.concat(F.lit("["), F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("string"), F.lit("] "), F.substring(text, 1, chars))
    parts = rows.select(key, order, piece.alias("piece"))
    return parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "piece"))), lambda x: x["piece"]), "\n").alias("context"))


def fold_events(events: DataFrame, key: str, order: str, kind: str, payload: str) -> DataFrame:
    """Final state of each research run: last status and answer, sources merged by URL in first-seen order, tokens joined.

    Kinds: status, answer, token, source, error.  Fields fold by themselves, without a Python loop over events.
    """
    of = lambda name: F.when(F.col(kind) == name, F.col(payload))
    last = lambda name: F.max_by(of(name), F.when(F.col(kind) == name, F.col(order)))
    ordered = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col(kind) == name, F.struct(order, payload)))), lambda x: x[payload])
    return events.groupBy(key).agg(last("status").alias("status"), last("answer").alias("answer"), F.array_join(ordered("token"), "").alias("text"), F.array_distinct(ordered("source")).alias("sources"), F.bool_or(F.col(kind) == "error").alias("failed"))


def crawl_levels(pages: DataFrame, edges: DataFrame, start: DataFrame, max_depth: int, max_pages: int, allowed: Column | None = None) -> DataFrame:
    """Breadth-first crawl over a link table: (url, depth, seq) in the order of visits.

    pages: (url), what can be fetched; edges: (src, dst, pos); start: (url, seq).  Level by level: the frontier
    joins the edges, loses what was seen (anti-join), and gets rising numbers in order of (seq of the page it came from, pos).
    Each level is written once to the shared checkpoint folder, which cuts the lineage.
    """
    spark = pages.sparkSession
    checkpoint_folder(spark)
    level = start.join(pages, "url", "left_semi").select("url", F.lit(0).alias("depth"), "seq").checkpoint()
    total = level.count()
    if total > max_pages:
        level = level.orderBy("seq").limit(max_pages).checkpoint()
        total = max_pages
    seen = level
    last = level.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    for depth in range(1, max_depth + 1):
        if total >= max_pages:
            break
        links = level.join(edges, level["url"] == edges["src"]).select(F.col("dst").alias("url"), F.struct("seq", "pos").alias("via"))
        links = links.groupBy("url").agg(F.min("via").alias("via"))
        if allowed is not None:
            links = links.where(allowed)
        fresh = links.join(seen.select("url"), "url", "left_anti").join(pages.select("url"), "url", "left_semi").checkpoint()
        n = fresh.count()
        if not n:
            break
        if total + n > max_pages:
            n = max_pages - total
            fresh = fresh.orderBy("via", "url").limit(n)
        # a global sort leaves partitions in order, so these numbers follow it without one task seeing all rows
        ranked = fresh.orderBy("via", "url").withColumn("seq", F.monotonically_increasing_id() + F.lit(last + 1))
        level = ranked.select("url", F.lit(depth).alias("depth"), "seq").checkpoint()
        last = level.agg(F.max("seq")).first()[0]
        total += n
        seen = seen.unionByName(level)
    return seen


def checkpoint_folder(spark) -> None:
    """Sets the checkpoint folder if the session has none: what spark.checkpoint.dir names, or a temporary one on a single machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix=f"siltstone-{os.getpid()}-"))


def expired(rows: DataFrame, created: str, ttl_s: int, as_of: Column) -> DataFrame:
    """Rows with live: whether less than ttl_s seconds have passed, and freshness: fresh (a quarter), aging (half) or stale."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(created).cast("timestamp"))) / 1e6
    return rows.withColumn("live", age < ttl_s).withColumn("freshness", F.when(age < ttl_s / 4, "fresh").when(age < ttl_s / 2, "aging").otherwise("stale"))


def tumbling(events: DataFrame, ts: str, seconds: int, keys: list[str]) -> DataFrame:
    return events.groupBy(slot(F.col(ts), seconds).alias("window"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
