"""A memory of research as a log: entries are only ever appended, and what is live is a fold over them.

A row of the log is (memory_id, version, op, user_id, query, embedding, artifact, created_at, ttl_s); op is store or delete, and
the version is a whole number that rises with every write (a batch of writes shares one).  Of an id the row
with the highest version counts (a delete before a store of the same version); it is live if it is a store whose time to live has not passed.

store, delete, sweep and batches append a file each; compact writes the live rows, and rows of deleted ids that are younger than
``keep``, anew: no answer changes.  Readers of the old files are not disturbed, as a compaction is a new folder.

Defined results: an id that was never stored is not live; deleting it does nothing; a null ttl never ends; a question
without a user is asked among all entries, one with a user among their own; empty logs give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.operators.vectors import dot, top_k

LOG = "memory_id string, version long, op string, user_id string, query string, embedding array<float>, artifact string, created_at timestamp, ttl_s long"
_FIELDS = ("memory_id", "version", "op", "user_id", "query", "embedding", "artifact", "created_at", "ttl_s")
#: Least similarity of a hit, and how many candidates are looked at.
THRESHOLD, CANDIDATES = 0.85, 5


def stores(entries: DataFrame, version: int) -> DataFrame:
    """Rows of the log that store entries (memory_id, user_id, query, embedding, artifact, created_at, ttl_s)."""
    return entries.withColumn("version", F.lit(version).cast("long")).withColumn("op", F.lit("store")).select(*_FIELDS)


def deletes(ids: DataFrame, version: int) -> DataFrame:
    """Rows of the log that delete entries (memory_id)."""
    empty = {"user_id": "string", "query": "string", "embedding": "array<float>", "artifact": "string", "created_at": "timestamp", "ttl_s": "long"}
    return ids.select("memory_id").distinct().withColumns({"version": F.lit(version).cast("long"), "op": F.lit("delete")} | {c: F.lit(None).cast(t) for c, t in empty.items()}).select(*_FIELDS)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def _latest(log: DataFrame) -> DataFrame:
    """Of each id the row that counts.  Narrow columns are compared; whole rows are joined to the winners."""
    rank = F.struct("version", "op")  # "store" comes after "delete"
    top = log.groupBy("memory_id").agg(F.max(rank).alias("top")).select("memory_id", "top.*")
    return log.join(top, ["memory_id", "version", "op"], "left_semi").dropDuplicates(["memory_id"])


def _in_time(as_of: Column) -> Column:
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros("created_at")) / 1e6
    return F.col("ttl_s").isNull() | (age < F.col("ttl_s"))


def live(log: DataFrame, as_of: Column) -> DataFrame:
    """The entries that are stored and in time, with freshness: fresh in the first quarter of their time, aging in the second, then stale."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros("created_at")) / 1e6
    fresh = F.when(F.col("ttl_s").isNull() | (age < F.col("ttl_s") / 4), "fresh").when(age < F.col("ttl_s") / 2, "aging").otherwise("stale")
    return _latest(log).where("op = 'store'").where(_in_time(as_of)).withColumn("freshness", fresh)


def get(log: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    return live(log, as_of).join(ids.select("memory_id").distinct(), "memory_id", "left_semi")


def expired(log: DataFrame, as_of: Column, version: int) -> DataFrame:
    """The sweep: rows that delete what is stored and out of time."""
    return deletes(_latest(log).where("op = 'store'").where(~_in_time(as_of)), version)


def hits(log: DataFrame, asked: DataFrame, as_of: Column, threshold: float = THRESHOLD, candidates: int = CANDIDATES) -> DataFrame:
    """(query_id, memory_id, similarity, artifact, freshness): for each of asked (query_id, query, user_id) the nearest entry among the first candidates that is similar enough and live.

    Candidates are drawn from all that was stored, as an index has them that is swept later; entries that are gone are passed over.
    Questions of a user are asked among the user's entries (an equi-join), those without a user among all.
    """
    stored = log.where("op = 'store'")
    known = stored.join(_latest(stored).select("memory_id", "version"), ["memory_id", "version"], "left_semi").dropDuplicates(["memory_id"]).where("embedding is not null")
    near = top_k(known.select("memory_id", "embedding"), asked.where("user_id is null").select("query_id", "query"), candidates, "memory_id", digits=12)
    pairs = known.select("user_id", "memory_id", "embedding").join(asked.where("user_id is not null"), "user_id").select("query_id", "memory_id", dot(F.col("embedding"), F.col("query")).alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id")
    own = pairs.withColumn("place", F.row_number().over(by)).where(F.col("place") <= candidates)
    now = live(log, as_of).select("memory_id", "artifact", "freshness")
    ok = near.unionByName(own).where(F.col("score") >= threshold).join(now, "memory_id")
    best = ok.groupBy("query_id").agg(F.min_by(F.struct("memory_id", F.round("score", 6).alias("similarity"), "artifact", "freshness"), "place").alias("hit"))
    return best.select("query_id", "hit.*")


def compacted(log: DataFrame, as_of: Column, keep: int = 0) -> DataFrame:
    """The log without rows that no answer needs: old versions, entries out of time, and deletes up to version keep.

    A delete is kept while writers may still append a store of a lower version, which it must outdo.
    """
    latest = _latest(log)
    return latest.where((F.col("op") == "store") & _in_time(as_of) | (F.col("op") == "delete") & (F.col("version") > keep)).select(*_FIELDS)
