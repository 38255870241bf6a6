"""Streaming operators over event streams, and a way to run them over what is there.

Batch and stream share their semantics; tests compare them.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, schema: StructType, ts: str = "ts", late: str = "1 day", files_per_batch: int = 1) -> DataFrame:
    """Files of events as a stream with a watermark."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def run_available(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, name: str | None = None, mode: str = "append") -> None:
    """Processes all that is there, then ends.  The checkpoint must be in a shared folder on a cluster."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer = writer.foreachBatch(sink) if sink else writer.format("memory").queryName(name)
    writer.start().awaitTermination()


def window_counts(events: DataFrame, width: str, keys: list[str], slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Counts in tumbling or sliding windows."""
    return events.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, key: str, gap: str, ts: str = "ts") -> DataFrame:
    """Sessions that end after a gap without events."""
    return events.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("events")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def first_seen(results: DataFrame, keys: list[str]) -> DataFrame:
    """The search monitor: each key once within the watermark."""
    return results.dropDuplicatesWithinWatermark(keys)


def fixed_window_limit(requests: DataFrame, key: str, limit: int, width: str, ts: str = "ts") -> DataFrame:
    """(key, start, requests, allowed) of each rate-limit window."""
    counts = window_counts(requests, width, [key], ts=ts)
    return counts.select(key, "start", F.col("n").alias("requests"), F.least(F.col("n"), F.lit(limit)).alias("allowed"))


#: Seconds of event time after which the state of a silent key goes.
TTL_S = 30 * 86_400


def _until(state: GroupState, times: pd.Series, ttl_s: float) -> None:
    """The state goes when the watermark is ttl_s past the last of times."""
    last = max(int(pd.Timestamp(t).timestamp() * 1000) for t in (times.min(), times.max()))
    state.setTimeoutTimestamp(max(last + int(ttl_s * 1000), state.getCurrentWatermarkMs() + 1))


def page_monitor(fetches: DataFrame, key: str, content: str, ts: str = "ts", order: str = "event_id", ttl_s: float = TTL_S) -> DataFrame:
    """Change verdicts of fetched pages: each fetch against the last content of its key, kept as state until the key is silent for ttl_s."""
    kind = lambda c: fetches.schema[c].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values([ts, order])
        changed = []
        for now in rows[content].tolist():
            changed.append(bool(before) and before != now)
            before = now
        state.update((before,))
        _until(state, rows[ts], ttl_s)
        yield pd.DataFrame({key: rows[key], order: rows[order], "changed": changed})

    return fetches.groupBy(key).applyInPandasWithState(step, f"{key} {kind(key)}, {order} {kind(order)}, changed boolean", "last string", "append", GroupStateTimeout.EventTimeTimeout)


def breaker(calls: DataFrame, key: str, ok: str, ts: str = "ts", order: str = "event_id", failures: int = 5, cooldown: float = 30.0, ttl_s: float = TTL_S) -> DataFrame:
    """The circuit breaker with its state (name, failures in a row, time it opened) kept between batches, until the key is silent for ttl_s."""
    kind = lambda c: calls.schema[c].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state, bad, opened = held.get if held.exists else ("closed", 0, 0.0)
        rows = pd.concat(list(frames)).sort_values([ts, order])
        states = []
        for at, good in zip(rows[ts].tolist(), rows[ok].tolist(), strict=True):
            now = at.replace(tzinfo=datetime.UTC).timestamp() if at.tzinfo is None else at.timestamp()
            if state == "open" and now - opened >= cooldown:
                state = "half_open"
            states.append(state)
            if state == "open":
                continue
            if good:
                state, bad = "closed", 0
            else:
                bad += 1
                if state == "half_open" or bad >= failures:
                    state, opened = "open", now
        held.update((state, bad, opened))
        _until(held, rows[ts], ttl_s)
        yield pd.DataFrame({key: rows[key], order: rows[order], "state": states})

    return calls.groupBy(key).applyInPandasWithState(step, f"{key} {kind(key)}, {order} {kind(order)}, state string", "state string, bad int, opened double", "append", GroupStateTimeout.EventTimeTimeout)


def crawl_progress(every: int, emit: Callable[[dict], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that tells of each batch of pages and of progress each ``every`` pages."""
    seen = {"n": 0}

    def sink(batch: DataFrame, batch_id: int) -> None:
        n = batch.count()
        before, seen["n"] = seen["n"], seen["n"] + n
        emit({"type": "pages", "batch": batch_id, "count": n})
        for k in range(before // every + 1, seen["n"] // every + 1):
            emit({"type": "progress", "completed": k * every})

    return sink
