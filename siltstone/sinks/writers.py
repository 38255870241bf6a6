"""Sinks: webhooks, text trees, job logs."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.functions import urls as U
from siltstone.functions.text import slugify

ATTEMPTS = 3
#: Fixed value: seconds to wait before the second and the third attempt.
WAITS = (2.0, 4.0)


def signature(body: bytes, secret: str) -> str:
    return "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def signed(events: DataFrame, body_col: str, secret: str) -> DataFrame:
    """events with the HMAC-SHA-256 signature of their body, in Arrow batches (Spark has no HMAC of its own)."""

    @F.pandas_udf("string")
    def sign(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: signature(b.encode(), secret), na_action="ignore")

    return events.withColumn("signature", sign(body_col))


def deliver(body: bytes, send: Callable[[bytes], int], wait: Callable[[float], None]) -> tuple[bool, int]:
    """Sends until a status below 500 or ATTEMPTS are used up: (below 400, attempts)."""
    for n in range(1, ATTEMPTS + 1):
        try:
            status = send(body)
        except OSError:
            status = 599
        if status < 500:
            return status < 400, n
        if n < ATTEMPTS:
            wait(WAITS[n - 1])
    return False, ATTEMPTS


def webhook_batches(wanted: list[str], secret: str, send: Callable[[bytes, str], int], wait: Callable[[float], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for tables (event, body): filters events and delivers from the executors.

    Delivery is at least once; receivers tell repeats by the signature of equal bodies.
    """

    def partition(rows) -> None:
        for r in rows:
            deliver(r.body.encode(), lambda b, s=r.signature: send(b, s), wait)

    def sink(batch: DataFrame, _: int) -> None:
        chosen = batch.where(F.col("event").isin(*wanted)) if wanted else batch
        signed(chosen, "body", secret).select("body", "signature").foreachPartition(partition)

    return sink


def by_domain(sources: DataFrame, url_col: str = "url") -> DataFrame:
    """(domain, sources, urls) in order of domain; unknown where there is no host."""
    host = F.lower(U.netloc(url_col))
    named = F.when(host == "", "unknown").otherwise(host)
    return sources.groupBy(named.alias("domain")).agg(F.count("*").alias("sources"), F.array_sort(F.collect_list(url_col)).alias("urls")).orderBy("domain")


def write_pyramid(answers: DataFrame, path: str, query_col: str = "query", answer_col: str = "answer", sources_col: str = "sources") -> None:
    """Three text trees: level 1 the answers, level 2 their sources by domain, level 3 the sources' texts; partitioned by query.

    sources is an array of (url, title, text).
    """
    named = answers.withColumn("slug", slugify(F.col(query_col)))
    head = F.concat(F.lit("# "), query_col, F.lit("\n\n"), answer_col)
    named.select("slug", head.alias("value")).write.mode("overwrite").partitionBy("slug").text(f"{path}/L1")
    each = named.select("slug", F.explode(sources_col).alias("s")).withColumn("domain", F.lower(U.netloc("s.url")))
    link = F.concat(F.lit("- ["), "s.title", F.lit("]("), "s.url", F.lit(")"))
    listed = each.groupBy("slug", "domain").agg(F.array_join(F.array_sort(F.collect_list(link)), "\n").alias("l"))
    listed.select("slug", F.concat(F.lit("## "), "domain", F.lit("\n\n"), "l").alias("value")).write.mode("overwrite").partitionBy("slug").text(f"{path}/L2")
    whole = F.concat(F.lit("# "), "s.title", F.lit("\n\n"), "s.text")
    each.select("slug", "domain", whole.alias("value")).write.mode("overwrite").partitionBy("slug", "domain").text(f"{path}/L3")


def append_events(events: DataFrame, path: str) -> None:
    """Job events are only ever appended; a job's state is a fold over them."""
    events.write.mode("append").parquet(path)


def index_rows(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """An index after an upsert of whole rows: new ones replace those with their key."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without(existing: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return existing.join(gone.select(key), key, "left_anti")


def migrated(points: DataFrame, name: str, vector: Column) -> DataFrame:
    """points with one more named vector in their map of vectors."""
    return points.withColumn("vectors", F.map_concat(F.map_filter("vectors", lambda k, _: k != name), F.create_map(F.lit(name), vector)))
