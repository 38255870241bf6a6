"""Rows handed to site adapters, best match first; those that an adapter fails on go to the next match.

An adapter's source is a function from pending rows to a table with at most one row for each key: ``markdown``,
``metadata`` (a map of texts) and ``error``.  A row without error, with some Markdown, is a success.

Turn after turn: a row's turn-th match decides its source, all sources of a turn run as one job, and successes leave
the pending rows by an anti-join, so no row is handed on after a success.  There are as many turns as the row with
the most matches has, which the fixed list of patterns bounds.

Defined results: rows that no pattern matches, or all of whose adapters fail, come back with a null adapter and
the last error; adapters without a source fail with "no source", a row that a source does not return fails with "no
result"; rows with a null key or address match nothing; repeated keys are one; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from siltstone.operators.sessions import checkpoint_folder
from siltstone.sources.adapters import matching

Source = Callable[[DataFrame], DataFrame]
_META = "map<string,string>"


def _asked(source: Source, rows: DataFrame, key: str, name: str, turn: int) -> DataFrame:
    """One row for each of rows: what the source found, or why not."""
    got = source(rows)
    has = lambda c, t: (got[c] if c in got.columns else F.lit(None)).cast(t).alias(c)
    found = got.select(key, has("markdown", "string"), has("metadata", _META), has("error", "string"), F.lit(True).alias("_found"))
    out = rows.select(key).join(found, key, "left")
    error = F.when(F.col("_found").isNull(), "no result").when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce("markdown", F.lit("")) == "", "empty")
    return out.select(key, F.lit(turn).alias("turn"), F.lit(name).alias("adapter"), "markdown", "metadata", error.alias("error"))


def dispatch(rows: DataFrame, sources: dict[str, Source], key: str = "url", url_col: str = "url") -> tuple[DataFrame, DataFrame]:
    """(key, adapter, markdown, metadata, error) of every key, and the attempts (key, turn, adapter, error)."""
    checkpoint_folder(rows.sparkSession)
    wanted = rows.select(key).distinct()
    pending = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("_matches", F.coalesce(matching(F.col(url_col)), F.array().cast("array<string>"))).where(F.size("_matches") > 0).checkpoint()
    tries, turn = [], 0
    while not pending.isEmpty():
        now = pending.withColumn("_adapter", F.get("_matches", F.lit(turn)))
        names = [r["_adapter"] for r in now.select("_adapter").distinct().collect()]  # as many as there are patterns, at most
        parts = []
        for name in sorted(names):
            mine = now.where(F.col("_adapter") == name).drop("_adapter", "_matches")
            if name in sources:
                parts.append(_asked(sources[name], mine, key, name, turn))
            else:
                parts.append(mine.select(key, F.lit(turn).alias("turn"), F.lit(name).alias("adapter"), F.lit(None).cast("string").alias("markdown"), F.lit(None).cast(_META).alias("metadata"), F.lit("no source").alias("error")))
        tries.append(reduce(DataFrame.unionByName, parts).checkpoint())
        turn += 1
        pending = pending.where(F.size("_matches") > turn).join(tries[-1].where("error is null"), key, "left_anti").checkpoint()
    if not tries:
        none = wanted.select(key, *[F.lit(None).cast(t).alias(c) for c, t in (("adapter", "string"), ("markdown", "string"), ("metadata", _META), ("error", "string"))])
        return none, none.limit(0).select(key, F.lit(0).alias("turn"), "adapter", "error")
    made = reduce(DataFrame.unionByName, tries)
    failed = made.groupBy(key).agg(F.max_by("error", "turn").alias("_last"))
    done = made.where("error is null").select(key, "adapter", "markdown", "metadata")
    out = wanted.join(done, key, "left").join(failed, key, "left")
    return out.select(key, "adapter", "markdown", "metadata", F.col("_last").alias("error")), made.select(key, "turn", "adapter", "error")
