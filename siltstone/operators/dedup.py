"""First-wins dedup, joins of crawl state, cache and history logic.

Wherever order decides, it is an explicit column, so results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.functions.text import strip


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key.  Pre-aggregated where it is read: a hot key sends one row a task."""
    rank = F.struct(*order)
    row = F.struct(*[df[c] for c in df.columns])
    return df.groupBy(*[df[k].alias(f"_{k}") for k in keys]).agg(F.min_by(row, rank).alias("row")).select("row.*")


def first_wins_union(*frames: DataFrame, key: str, order: str) -> DataFrame:
    """Lists after each other, each key from the first list that has it; adds list_no."""
    union = None
    for n, df in enumerate(frames):
        one = df.withColumn("list_no", F.lit(n))
        union = one if union is None else union.unionByName(one, allowMissingColumns=True)
    return first_per_key(union, [key], ["list_no", order])


def content_hash(text: Column) -> Column:
    """Hash for content dedup; null for blank text, which is never a duplicate."""
    return F.when(strip(F.coalesce(text, F.lit(""))) != "", F.sha2(text, 256))


def content_dedup(df: DataFrame, order_col: str, text_col: str = "text") -> DataFrame:
    """df with content_hash, first_seen (order of the first row with that content) and duplicate.

    The minimum is taken by a pre-aggregated group-by and joined back, so that a text with
    very many copies is a key that Spark can split.
    """
    hashed = df.withColumn("content_hash", content_hash(F.col(text_col)))
    first = hashed.where("content_hash is not null").groupBy("content_hash").agg(F.min(order_col).alias("first_seen"))
    out = hashed.join(first, "content_hash", "left")
    return out.withColumn("duplicate", F.coalesce(F.col("first_seen") < F.col(order_col), F.lit(False)))


def canonical_dedup(pages: DataFrame, order_col: str, url_col: str, canonical_col: str) -> DataFrame:
    """Marks pages whose canonical address is the address of a page that came earlier."""
    earlier = pages.groupBy(F.col(url_col).alias("_target")).agg(F.min(order_col).alias("_seen"))
    out = pages.join(earlier, pages[canonical_col] == earlier["_target"], "left")
    dup = (F.col("_seen") < F.col(order_col)) & (F.col(canonical_col) != F.col(url_col))
    return out.withColumn("canonical_duplicate", F.coalesce(dup, F.lit(False))).drop("_target", "_seen")


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return rows.join(seen.select(key), key, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Index entries after new pages: first_indexed_at stays, crawl_count goes up by one for each new page."""
    e, n = existing.alias("e"), new.alias("n")
    there = F.col(f"n.{key}").isNotNull()
    return e.join(n, key, "full_outer").select(
        key, F.when(there, F.col("n.title")).otherwise(F.col("e.title")).alias("title"), F.coalesce("e.first_indexed_at", as_of).alias("first_indexed_at"), F.when(there, as_of).otherwise(F.col("e.last_indexed_at")).alias("last_indexed_at"),
        (F.coalesce("e.crawl_count", F.lit(0)) + there.cast("int")).alias("crawl_count"), F.coalesce("e.access_count", F.lit(0)).alias("access_count"),
    )


def point_id(url: Column) -> Column:
    """The first 64 bits of a URL's SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(url, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def cache_decision(age_ms: Column, has_data: Column, max_age_ms: int | None, min_age_ms: int | None) -> Column:
    """bypass, miss, error, hit or stale; age_ms is null where nothing is cached."""
    limit, least = max_age_ms or 0, min_age_ms or 0
    if limit <= 0 and least <= 0:
        return F.lit("bypass")
    absent = F.when(age_ms.isNull(), "error" if least > 0 else "miss")
    if least > 0:
        absent = absent.when(~has_data, "error")
        return (absent.when(age_ms >= limit, "stale") if limit > 0 else absent).otherwise("hit")
    return absent.when(age_ms < limit, "hit").otherwise("stale")


# Cache lifetimes in seconds.
TTL, TTL_MIN, TTL_MAX, TTL_VOLATILE = 3600, 60, 86400, 300


def adaptive_ttl(base: Column, change_count: Column, has_prior: Column) -> Column:
    """Twice as long for stable content, half for content that changed 3 times or more, at most 5 minutes from 5 changes on."""
    factor = F.when((change_count == 0) & has_prior, 2.0).when(change_count >= 3, 0.5).otherwise(1.0)
    bound = F.greatest(F.lit(TTL_MIN), F.least((base * factor).cast("long"), F.lit(TTL_MAX)))
    return F.when(change_count >= 5, F.least(bound, F.lit(TTL_VOLATILE))).otherwise(bound)


def suffix_lookup(hosts: DataFrame, policies: DataFrame, host_col: str, suffix_col: str, value_col: str) -> DataFrame:
    """hosts with the value of the longest suffix (on label borders) that a policy names; null if none does.

    Each host's suffixes are listed and joined by equality; no pair of host and policy is formed in vain.
    """
    labels = F.split(host_col, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    names = hosts.select(host_col).distinct().withColumn("_suffix", F.explode(suffixes))
    found = names.join(policies.select(F.col(suffix_col).alias("_suffix"), F.col(value_col).alias("_value")), "_suffix")
    best = found.groupBy(host_col).agg(F.max_by("_value", F.length("_suffix")).alias(value_col))
    return hosts.join(best, host_col, "left")


def change_history(rows: DataFrame, key: str, order: str, hash_col: str) -> DataFrame:
    """fetch_count and change_count of each fetch of a key, and whether it changed."""
    by = Window.partitionBy(key).orderBy(order)
    changed = F.coalesce(F.lag(hash_col).over(by) != F.col(hash_col), F.lit(False))
    out = rows.withColumn("changed", changed).withColumn("fetch_count", F.row_number().over(by))
    return out.withColumn("change_count", F.sum(F.col("changed").cast("int")).over(by))


def last_n(rows: DataFrame, key: str, order: list[Column], n: int = 50) -> DataFrame:
    """The last n rows of each key (Spark limits each group before the shuffle)."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)


def crawl_delay(rows: DataFrame, key: str, ts: str, delay_s: float) -> DataFrame:
    """Seconds since the previous fetch of a key, and the wait that politeness asks for."""
    by = Window.partitionBy(key).orderBy(ts)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = (micros(F.col(ts)) - micros(F.lag(ts).over(by))) / 1e6
    return rows.withColumn("gap_s", gap).withColumn("wait_s", F.greatest(F.lit(0.0), F.lit(float(delay_s)) - F.col("gap_s")))


def job_states(events: DataFrame, job: str, order: str, status: str) -> DataFrame:
    """Final status of each job: the first that is not "processing" wins; later ones don't count."""
    done = F.col(status) != "processing"
    return events.groupBy(job).agg(F.coalesce(F.min_by(F.when(done, F.col(status)), F.when(done, F.col(order))), F.lit("processing")).alias("state"), F.count("*").alias("events"))


def page_of(rows: DataFrame, order: str, offset: int, size: int) -> DataFrame:
    """Rows offset..offset+size-1 of an order, with next: the offset after them, or null at the end."""
    ordered = rows.orderBy(order).offset(offset).limit(size + 1)
    held = ordered.withColumn("n", F.row_number().over(Window.orderBy(order)))
    more = F.when(F.count("*").over(Window.partitionBy()) > size, F.lit(offset + size))
    return held.withColumn("next", more).where(F.col("n") <= size).drop("n")
