"""Counters, gauges, histograms, rates, quantiles, alerts and limiters over event tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Upper bounds of the default latency buckets, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, 30.0, 60.0)


def counter(samples: DataFrame, labels: list[str], value: Column | None = None) -> DataFrame:
    return samples.groupBy(*labels).agg(F.sum(value if value is not None else F.lit(1.0)).alias("total"))


def gauge(samples: DataFrame, labels: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value of each label set."""
    return samples.groupBy(*labels).agg(F.max_by(value, F.struct(*order)).alias("last"))


def histogram(samples: DataFrame, labels: list[str], value: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(labels, le, count): cumulative counts of values up to each bound, +Inf included.

    One pass with a conditional count a bound; the bounds become rows after aggregation.
    """
    counts = [F.count_if(F.col(value) <= b) for b in bounds] + [F.count(value)]
    names = [str(b) for b in bounds] + ["+Inf"]
    folded = samples.groupBy(*labels).agg(F.array(*[F.struct(F.lit(n).alias("le"), c.alias("count")) for n, c in zip(names, counts, strict=True)]).alias("b"), F.sum(value).alias("sum"), F.count(value).alias("n"))
    return folded.select(*labels, F.explode("b").alias("b")).select(*labels, "b.le", "b.count")


def quantile(samples: DataFrame, labels: list[str], value: str, q: float, bounds: tuple[float, ...]) -> DataFrame:
    """The quantile that a histogram gives: linear within the bucket it falls in; the last finite bound if it falls beyond."""
    counts = F.array(*[F.count_if(F.col(value) <= b) for b in bounds])
    rows = samples.groupBy(*labels).agg(counts.alias("c"), F.count(value).alias("n"))
    edges = F.array(*[F.lit(float(b)) for b in bounds])
    rank = F.col("n") * F.lit(q)
    at = F.array_position(F.transform("c", lambda x: x >= rank), True)  # from 1; 0: beyond
    i = at.cast("int")
    lower, below = F.when(i > 1, F.get(edges, i - 2)).otherwise(0.0), F.when(i > 1, F.get("c", i - 2)).otherwise(0)
    inside = F.get("c", i - 1) - below
    value_ = lower + (F.get(edges, i - 1) - lower) * F.when(inside > 0, (rank - below) / inside).otherwise(1.0)
    return rows.select(*labels, F.when(at > 0, value_).otherwise(float(bounds[-1])).alias("quantile"))


def slot(ts: Column, seconds: int) -> Column:
    """Start of the window of a timestamp, in seconds of the epoch."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000)) * seconds


def rate(samples: DataFrame, labels: list[str], ts: str, seconds: int) -> DataFrame:
    """Events a second in each window, and their number (increase)."""
    return samples.groupBy(slot(F.col(ts), seconds).alias("window"), *labels).agg(F.count("*").alias("increase"), (F.count("*") / seconds).alias("rate"))


def mean_latency(samples: DataFrame, labels: list[str], value: str) -> DataFrame:
    return samples.groupBy(*labels).agg(F.try_divide(F.sum(value), F.count(value)).alias("mean"))


def alerts(windows: DataFrame, labels: list[str], firing: Column, seconds: int, hold: int) -> DataFrame:
    """Stretches of consecutive windows in which a condition holds for ``hold`` seconds or longer.

    windows: (window, labels...), window being the start in seconds.
    """
    on = windows.where(firing)
    n = F.row_number().over(Window.partitionBy(*labels).orderBy("window"))
    islands = on.withColumn("island", F.col("window") - n * seconds)
    spans = islands.groupBy(*labels, "island").agg(F.min("window").alias("since"), (F.max("window") + seconds).alias("until"), F.count("*").alias("windows"))
    return spans.where(F.col("until") - F.col("since") >= hold).drop("island")


def fixed_window_limit(requests: DataFrame, key: str, ts: str, order: list[str], limit: int, seconds: int) -> DataFrame:
    """Each request's place in its key's window, whether it is allowed, and what remains."""
    by = Window.partitionBy(key, slot(F.col(ts), seconds)).orderBy(*order)
    out = requests.withColumn("place", F.row_number().over(by))
    return out.withColumn("allowed", F.col("place") <= limit).withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("place")))


def _in_order(rows: DataFrame, start: Callable[[], Callable], columns: str) -> DataFrame:
    """(key, row, columns) by a state machine for each key, over rows (key, row, at, ...) in order of time, then row.

    start() gives a fresh machine, which is called with a row's remaining columns and returns its results.  Keys share
    partitions and rows stream through in order, so a task holds a batch and one key's state, however long its history is.
    """
    more = [c for c in rows.columns if c not in ("key", "row")]
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, current = start(), object()
        for pdf in batches:
            out = []
            for key, *rest in zip(pdf["key"].tolist(), *(pdf[c].tolist() for c in more), strict=True):
                if key != current:
                    machine, current = start(), key
                out.append(machine(*rest))
            yield pd.DataFrame({"key": pdf["key"], "row": pdf["row"]} | {n: [x[i] for x in out] for i, n in enumerate(names)})

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.repartition("key").sortWithinPartitions("key", "at", "row").mapInPandas(run, f"key {kind['key']}, row {kind['row']}, {columns}")


def sliding_window_limit(requests: DataFrame, key: str, ts: str, id_col: str, limit: int, seconds: float) -> DataFrame:
    """A true sliding window: only accepted requests take a slot, so each verdict depends on earlier ones.

    A sequential state machine for each key; a key's requests pass one task in
    order, as (time, id) pairs.
    """

    def start():
        held: deque[float] = deque()  # accepted requests in the window: limit of them, at most

        def verdict(at: float) -> tuple[bool]:
            while held and at - held[0] >= seconds:
                held.popleft()
            if len(held) >= limit:
                return (False,)
            held.append(at)
            return (True,)

        return verdict

    read = requests.select(F.col(key).alias("key"), F.col(id_col).alias("row"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at"))
    out = _in_order(read, start, "allowed boolean")
    return out.select(F.col("row").alias(id_col), F.col("key").alias(key), "allowed")


def breaker_states(calls: DataFrame, key: str, ts: str, id_col: str, ok: Column, failures: int = 5, cooldown: float = 30.0) -> DataFrame:
    """State of a circuit breaker before each call (closed, open, half_open) and whether the call is let through.

    ``failures`` failures in a row open it; after ``cooldown`` seconds one probe is let through, whose result closes or reopens it.
    """

    def start():
        state, bad, opened = "closed", 0, 0.0

        def call(at: float, good: bool) -> tuple[str, bool]:
            nonlocal state, bad, opened
            if state == "open" and at - opened >= cooldown:
                state = "half_open"
            before = state
            if before == "open":
                return before, False
            if good:
                state, bad = "closed", 0
            else:
                bad += 1
                if before == "half_open" or bad >= failures:
                    state, opened = "open", at
            return before, True

        return call

    read = calls.select(F.col(key).alias("key"), F.col(id_col).alias("row"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at"), ok.alias("ok"))
    out = _in_order(read, start, "state string, passed boolean")
    return out.select(F.col("row").alias(id_col), F.col("key").alias(key), "state", "passed")


def backoff(attempt: Column, base: float = 0.5, most: float = 10.0) -> Column:
    """Seconds before a retry: base doubled with each attempt from 0, bounded."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def exposition(samples: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Metrics text lines, labels in order of name: name{a="x",b="y"} value."""
    pairs = [F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"')) for c in sorted(labels)]
    return samples.select(F.concat(F.lit(name + "{"), F.concat_ws(",", *pairs), F.lit("} "), F.col(value).cast("string")).alias("line"))


def health(samples: DataFrame, label: str, failing: Column) -> DataFrame:
    """ok, degraded (some failing) or down (all failing) for each label."""
    n, bad = F.count("*"), F.count_if(failing)
    return samples.groupBy(label).agg(n.alias("total"), bad.alias("failing"), F.when(bad == 0, "ok").when(bad == n, "down").otherwise("degraded").alias("status"))
