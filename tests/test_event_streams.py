"""Typed event streams of jobs: ids over restarts, progress, heartbeats, ends and expiry."""

import datetime

import pytest
from pyspark.sql import functions as F

from siltstone.streaming import events as E, queries as Q

SCHEMA = "id long, job string, s long, kind string, detail string"


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    E.configure(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


class Feed:
    """Files of rows that arrive one after the other, and a query that is started anew for each."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options, self.n = spark, folder, options, 0

    def __call__(self, *rows):
        table = self.spark.createDataFrame(rows, SCHEMA).select("id", "job", F.timestamp_seconds(F.col("s") + 1000).alias("ts"), "kind", "detail")
        table.coalesce(1).write.parquet(f"{self.folder}/in/b{self.n}")
        self.n += 1
        stream = self.spark.readStream.schema(table.schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/in")
        out = []
        Q.run_available(E.job_events(stream, "job", "kind", "detail", order="id", late="0 seconds", **self.options), f"{self.folder}/check", sink=lambda df, _: out.extend(tuple(r) for r in df.collect()))
        return sorted((job, number, kind, detail, int(at.replace(tzinfo=datetime.UTC).timestamp()) - 1000) for job, number, kind, detail, at in out)


def test_crawl_events(spark, store, tmp_path):
    feed = Feed(spark, tmp_path, heartbeat=15, ttl=100)
    first = feed(*[(i, "a", i, "page", f"u{i}") for i in range(7)], (9, "b", 3, "error", "bad"), (10, "b", 4, "page", "x"))
    assert first == [("a", 0, "page", "u0", 0), ("a", 1, "page", "u1", 1), ("a", 2, "page", "u2", 2), ("a", 3, "page", "u3", 3), ("a", 4, "page", "u4", 4), ("a", 5, "progress", "5", 4), ("a", 6, "page", "u5", 5), ("a", 7, "page", "u6", 6), ("b", 0, "error", "bad", 3), ("b", 1, "page", "x", 4)]
    second = feed((20, "a", 10, "page", "u20"), (21, "c", 60, "page", "y"))
    assert second == [("a", 8, "page", "u20", 10), ("a", 9, "heartbeat", "8", 60), ("b", 2, "heartbeat", "1", 60), ("c", 0, "page", "y", 60)]
    third = feed((22, "a", 70, "done", ""), (23, "a", 71, "page", "late"), (24, "c", 90, "token", "z"))
    assert third == [("a", 10, "done", "8 counted, 0 failed", 70), ("b", 3, "heartbeat", "1", 90), ("c", 1, "token", "z", 90)]
    fourth = feed((25, "c", 150, "page", "y"), (26, "a", 150, "page", "after the end"))
    assert fourth == [("b", 4, "error", "no rows until the state's end", 150), ("c", 2, "page", "y", 150)]
    fifth = feed((27, "c", 300, "page", "y"))  # the ended job's state goes by the watermark
    assert ("c", 3, "page", "y", 300) in fifth and not any(x[0] == "a" for x in fifth)
    assert feed((28, "a", 310, "page", "anew"))[0] == ("a", 0, "page", "anew", 310)
    everything = first + second + third + fourth + fifth
    assert len({x[:2] for x in everything}) == len(everything)


def test_search_events(spark, store, tmp_path):
    feed = Feed(spark, tmp_path, counted=("search_result", "scrape_result"), every=2, heartbeat=1000)
    rows = [("search_result", "a"), ("search_result", "b"), ("scrape_result", "a"), ("error", "b"), ("scrape_result", "c"), ("token", "x"), ("done", "")]
    got = [x[2:4] for x in feed(*[(i, "q", 1, kind, text) for i, (kind, text) in enumerate(rows)])]
    assert got == [("search_result", "a"), ("search_result", "b"), ("progress", "2"), ("scrape_result", "a"), ("error", "b"), ("scrape_result", "c"), ("progress", "4"), ("token", "x"), ("done", "4 counted, 1 failed")]
