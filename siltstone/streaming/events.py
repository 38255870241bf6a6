"""Typed event streams of jobs, with ids, progress, heartbeats and an end, by a stateful processor with timers.

Input rows say what happened in a job: a kind (page, search_result, token, ...), a text, and errors and ends
by their own kinds.  Each becomes an event with the job's next id; every ``every`` counted rows a progress event follows.  A job
without rows for ``heartbeat`` seconds of event time gets a heartbeat, and after ``ttl`` seconds an error event; then, as after
the end, its state goes.  Rows that come after a job's end are left out, until its state has gone.

State is a few numbers a job, in the state store with its checkpoint: a query that is started again goes on with the next id, and rows
of a micro-batch are read chunk by chunk.  Timers follow the watermark.  Ids rise in the order of time inside a chunk of a batch.

Needs a state store with timers: see ``configure``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "job string, id long, type string, detail string, at timestamp"
_STATE = "next long, counted long, failed long, last long, closed boolean"


def configure(spark: SparkSession) -> None:
    """The state store that processors with timers need; before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class JobEvents(StatefulProcessor):
    def __init__(self, counted: tuple[str, ...] = ("page",), every: int = 5, heartbeat: float = 15.0, ttl: float = 86_400.0, failure: str = "error", end: str = "done"):
        self.counted, self.every, self.heartbeat, self.ttl, self.failure, self.end = counted, every, int(heartbeat * 1000), int(ttl * 1000), failure, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, counted, failed, last, closed = self.job.get() if self.job.exists() else (0, 0, 0, 0, False)
        for frame in rows:
            out = []
            for at, kind, detail in frame.sort_values(["at", "place"])[["at", "kind", "detail"]].itertuples(index=False):
                if closed:
                    break
                last = max(last, int(at.timestamp() * 1000))
                closed = kind == self.end
                failed += kind == self.failure
                if closed:
                    detail = f"{counted} counted, {failed} failed"
                out.append((key[0], number, kind, detail, at))
                number += 1
                if kind in self.counted:
                    counted += 1
                    if counted % self.every == 0:
                        out.append((key[0], number, "progress", str(counted), at))
                        number += 1
            yield _frame(out)
        self.job.update((number, counted, failed, last, closed))
        self._wake(last + (self.ttl if closed else self.heartbeat))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        if not self.job.exists():
            return
        number, counted, failed, last, closed = self.job.get()
        at = pd.Timestamp(now, unit="ms")
        if closed or now - last >= self.ttl:
            self.job.clear()
            if not closed:
                yield _frame([(key[0], number, self.failure, "no rows until the state's end", at)])
            return
        yield _frame([(key[0], number, "heartbeat", str(counted), at)])
        self.job.update((number + 1, counted, failed, last, closed))
        self._wake(min(now + self.heartbeat, last + self.ttl))

    def _wake(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["job", "id", "type", "detail", "at"]).astype({"at": "datetime64[us]"})


def job_events(rows: DataFrame, job: str, kind: str, detail: str, ts: str = "ts", order: str | None = None, late: str = "1 minute", **options) -> DataFrame:
    """(job, id, type, detail, at): the events of a stream of rows; options are those of ``JobEvents``."""
    read = rows.select(F.col(job).cast("string").alias("job"), F.col(ts).cast("timestamp").alias("at"), F.col(kind).alias("kind"), F.col(detail).cast("string").alias("detail"), (F.col(order).cast("long") if order else F.lit(0).cast("long")).alias("place"))
    held = read if read.isStreaming and "EventTimeWatermark" in read._jdf.queryExecution().logical().toString() else read.withWatermark("at", late)
    return held.groupBy("job").transformWithStateInPandas(JobEvents(**options), EVENT, "Append", "EventTime")
