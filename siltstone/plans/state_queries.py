"""Dedup, cache and history, vector search, retention."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siltstone.operators import dedup as D
from siltstone.operators import vector_index as VI
from siltstone.operators import vectors as V
from siltstone.plans.registry import Family, table
from siltstone.plans.url_queries import CATEGORY, HOST

family = Family()
AS_OF = "TIMESTAMP_NTZ '2024-02-01 00:00:00'"
_AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"


@family.query("SELECT doc_id, content_hash, min(CASE WHEN content_hash IS NOT NULL THEN doc_id END) OVER (PARTITION BY content_hash) AS first_seen, content_hash IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY content_hash) AS duplicate FROM (SELECT doc_id, CASE WHEN regexp_replace(text, '\\s', '', 'g') <> '' THEN sha256(text) END AS content_hash FROM documents)")
def dedup_content_hash(spark, sf_dir):
    return D.content_dedup(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "content_hash", "first_seen", "duplicate")


@family.query(f"SELECT host, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM (SELECT page_id, url, {HOST} AS host FROM pages) GROUP BY host")
def dedup_first_url(spark, sf_dir):
    from siltstone.functions import urls as U

    pages = table(spark, sf_dir, "pages").select("page_id", "url", U.hostname("url").alias("host"))
    return D.first_per_key(pages, ["host"], ["page_id"])


@family.query("""WITH a AS (SELECT doc_id, 0 AS list_no FROM labels WHERE quality = 1), b AS (SELECT doc_id, 1 AS list_no FROM documents WHERE doc_id % 3 = 0), c AS (SELECT doc_id, 2 AS list_no FROM documents)
SELECT doc_id, min(list_no) AS list_no FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY doc_id""")
def union_first_wins(spark, sf_dir):
    labels, docs = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), table(spark, sf_dir, "documents").select("doc_id")
    return D.first_wins_union(labels, docs.where("doc_id % 3 = 0"), docs, key="doc_id", order="doc_id")


@family.query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def seen_anti(spark, sf_dir):
    return D.unseen(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@family.query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_sources(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi").select("doc_id", "source")


@family.query(f"""WITH e AS (SELECT page_id, 'old ' || page_id AS title, TIMESTAMP '2024-01-01 00:00:00' AS first_indexed_at, CAST(page_id % 5 AS INTEGER) AS crawl_count, CAST(page_id % 3 AS INTEGER) AS access_count FROM pages WHERE page_id % 2 = 0), n AS (SELECT page_id, 'new ' || page_id AS title FROM pages WHERE page_id % 3 = 0)
SELECT coalesce(e.page_id, n.page_id) AS page_id, coalesce(n.title, e.title) AS title, coalesce(first_indexed_at, {_AS_OF}) AS first_indexed_at, CASE WHEN n.page_id IS NOT NULL THEN {_AS_OF} ELSE first_indexed_at END AS last_indexed_at, coalesce(crawl_count, 0) + CASE WHEN n.page_id IS NOT NULL THEN 1 ELSE 0 END AS crawl_count, coalesce(access_count, 0) AS access_count FROM e FULL JOIN n ON e.page_id = n.page_id""")
def upsert_merge(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id")
    old = pages.where("page_id % 2 = 0").selectExpr("page_id", "'old ' || page_id AS title", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS first_indexed_at", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS last_indexed_at", "int(page_id % 5) AS crawl_count", "int(page_id % 3) AS access_count")
    return D.upsert(old, pages.where("page_id % 3 = 0").selectExpr("page_id", "'new ' || page_id AS title"), "page_id", F.expr(AS_OF))


@family.query("SELECT page_id, CAST(('0x' || substr(sha256(url), 1, 16))::UBIGINT AS DECIMAL(20, 0)) AS point_id FROM pages")
def point_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", D.point_id(F.col("url")).alias("point_id"))


_AGE = "CASE WHEN page_id % 4 = 0 THEN NULL ELSE page_id * 1000 END"


@family.query(f"""SELECT page_id, CASE WHEN age IS NULL THEN 'miss' WHEN age < 100000 THEN 'hit' ELSE 'stale' END AS by_max, CASE WHEN age IS NULL OR NOT has THEN 'error' ELSE 'hit' END AS by_min, CASE WHEN age IS NULL OR NOT has THEN 'error' WHEN age >= 100000 THEN 'stale' ELSE 'hit' END AS by_both, 'bypass' AS by_none FROM (SELECT page_id, {_AGE} AS age, page_id % 5 <> 0 AS has FROM pages)""")
def cache_decision(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", f"{_AGE} AS age", "page_id % 5 <> 0 AS has")
    one = lambda a, b: D.cache_decision(F.col("age"), F.col("has"), a, b)
    return rows.select("page_id", one(100_000, None).alias("by_max"), one(None, 1).alias("by_min"), one(100_000, 1).alias("by_both"), one(0, None).alias("by_none"))


@family.query("""SELECT page_id, CASE WHEN c >= 5 THEN least(b, 300) ELSE b END AS ttl FROM (SELECT page_id, page_id % 7 AS c, greatest(60, least(CAST(floor((page_id % 50) * 2000 * CASE WHEN page_id % 7 = 0 AND page_id % 2 = 0 THEN 2.0 WHEN page_id % 7 >= 3 THEN 0.5 ELSE 1.0 END) AS BIGINT), 86400)) AS b FROM pages)""")
def adaptive_ttl(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", D.adaptive_ttl(F.expr("page_id % 50 * 2000"), F.expr("page_id % 7"), F.expr("page_id % 2 = 0")).alias("ttl"))


@family.query(f"""WITH hosts AS (SELECT DISTINCT {HOST} AS host FROM pages), policies AS (SELECT DISTINCT array_to_string(string_split(host, '.')[-2:], '.') AS suffix, 600 AS ttl FROM hosts UNION ALL SELECT DISTINCT array_to_string(string_split(host, '.')[-3:], '.'), 1200 FROM hosts WHERE starts_with(host, 'blog.'))
SELECT host, arg_max(ttl, length(suffix)) AS ttl FROM hosts JOIN policies ON host = suffix OR ends_with(host, '.' || suffix) GROUP BY host""")
def ttl_longest_suffix(spark, sf_dir):
    from siltstone.functions import urls as U

    hosts = table(spark, sf_dir, "pages").select(U.hostname("url").alias("host")).distinct()
    tail = lambda n: F.array_join(F.slice(F.split("host", r"\."), F.greatest(F.size(F.split("host", r"\.")) - (n - 1), F.lit(1)), n), ".")
    policies = hosts.select(tail(2).alias("suffix"), F.lit(600).alias("ttl")).distinct().union(hosts.where(F.col("host").startswith("blog.")).select(tail(3), F.lit(1200)).distinct())
    return D.suffix_lookup(hosts, policies, "host", "suffix", "ttl")


@family.query("""WITH f AS (SELECT event_id, user_id, ts, md5(CAST(floor(value / 50) AS VARCHAR)) AS h FROM events), c AS (SELECT *, coalesce(lag(h) OVER w <> h, false) AS changed, row_number() OVER w AS fetch_count FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, changed, fetch_count, sum(CAST(changed AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS change_count FROM c""")
def change_count(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("h", F.md5(F.floor(F.col("value") / 50).cast("string")))
    return D.change_history(rows, "user_id", "event_id", "h").select("event_id", "changed", "fetch_count", "change_count")


@family.query("SELECT event_id, user_id, place FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 50")
def history_last50(spark, sf_dir):
    return D.last_n(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", "place")


@family.query("SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0 AS gap_s, greatest(0.0, 3600.0 - (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0) AS wait_s FROM (SELECT DISTINCT ON (user_id, ts) * FROM events ORDER BY user_id, ts, event_id)")
def crawl_delay_lag(spark, sf_dir):
    rows = D.first_per_key(table(spark, sf_dir, "events"), ["user_id", "ts"], ["event_id"])
    gap = D.crawl_delay(rows, "user_id", "ts", 3600.0)
    return gap.select("event_id", "gap_s", F.when(F.col("gap_s").isNull(), F.lit(0.0)).otherwise(F.col("wait_s")).alias("wait_s"))


_STATUS = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled' ELSE 'processing' END"


@family.query(f"SELECT user_id, coalesce(arg_min(s, event_id) FILTER (WHERE s <> 'processing'), 'processing') AS state, count(*) AS events FROM (SELECT event_id, user_id, {_STATUS} AS s FROM events) GROUP BY user_id")
def job_fold(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("s", F.expr(_STATUS))
    return D.job_states(events, "user_id", "event_id", "s")


@family.query("SELECT doc_id, 150 AS \"next\" FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def pagination(spark, sf_dir):
    return D.page_of(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, 50)


_QUERIES = "SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 50 = 0"
_DOT = "list_sum(list_transform(list_zip(embedding, query), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_RANKED = f"SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM (SELECT query_id, vec_id, {_DOT} AS score FROM embeddings, ({_QUERIES}))"


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@family.query(f"SELECT query_id, vec_id, score, place FROM ({_RANKED}) WHERE place <= 10")
def vector_topk(spark, sf_dir):
    return V.top_k(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 10)


@family.query()
def vector_index_topk(spark, sf_dir):
    """The same searches through an inverted-file index; its recall against vector_topk is tested."""
    return VI.nearest(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 10)


_FAR = "place - CASE WHEN vec_id % 3 = 0 THEN 30 ELSE 0 END"


@family.query(f"SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_FAR}) AS INT) AS place FROM ({_RANKED}) WHERE place <= 20")
def vector_rerank(spark, sf_dir):
    """The candidates of each query's own search in another order (here a second score that favours every third one)."""
    near = V.top_k(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 20)
    by = Window.partitionBy("query_id").orderBy(F.expr(_FAR))
    return near.withColumn("place", F.row_number().over(by)).select("query_id", "vec_id", "score", "place")


_KEYWORD = "SELECT doc_id AS vec_id, row_number() OVER (ORDER BY doc_id) AS place FROM documents WHERE contains(text, 'the') ORDER BY doc_id LIMIT 20"


@family.query(f"""WITH near AS (SELECT query_id, vec_id, place FROM ({_RANKED}) WHERE place <= 20), keyword AS ({_KEYWORD}), both_lists AS (SELECT query_id, k.vec_id, k.place, 0 AS list_no FROM (SELECT DISTINCT query_id FROM near) CROSS JOIN keyword k UNION ALL SELECT query_id, vec_id, place, 1 FROM near)
SELECT query_id, vec_id, min(list_no) AS list_no, arg_min(place, list_no) AS place FROM both_lists GROUP BY query_id, vec_id""")
def vector_hybrid_merge(spark, sf_dir):
    """For each query keyword hits (20, by id), then its nearest vectors; the first list that has a point wins."""
    near = V.top_k(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 20).select("query_id", "vec_id", F.col("place").cast("long").alias("place"))
    words = table(spark, sf_dir, "documents").where("contains(text, 'the')").select(F.col("doc_id").alias("vec_id")).orderBy("vec_id").limit(20)
    hits = words.agg(F.transform(F.array_sort(F.collect_list("vec_id")), lambda v, i: F.struct(v.alias("vec_id"), (i + 1).cast("long").alias("place"))).alias("hits"))
    keyword = near.select("query_id").distinct().join(F.broadcast(hits)).select("query_id", F.inline("hits"))  # one row of 20 hits
    both = keyword.withColumn("list_no", F.lit(0)).unionByName(near.withColumn("list_no", F.lit(1)))
    return D.first_per_key(both, ["query_id", "vec_id"], ["list_no", "place"]).select("query_id", "vec_id", "list_no", "place")


@family.query(f"SELECT query_id, vec_id, score FROM ({_RANKED}) WHERE place <= 15")
def find_similar(spark, sf_dir):
    """Nearest by cosine of each query page; the page itself is among them."""
    return V.top_k(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 15).select("query_id", "vec_id", "score")


@family.query(f"SELECT query_id, arg_min(vec_id, place) AS vec_id, arg_min(score, place) AS score FROM ({_RANKED}) WHERE place <= 5 AND score >= 0.3 AND vec_id % 4 <> 0 GROUP BY query_id")
def memory_threshold_hit(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings")
    return V.memory_hits(points, _queries(spark, sf_dir), points.where("vec_id % 4 <> 0"), threshold=0.3)


_WEIGHT = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.MULTIPLIERS.items()) + " ELSE 0.8 END"
_SCORED = f"""SELECT page_id, category, round({_WEIGHT} * coalesce(greatest(0.1, least(1.0, exp(-greatest(floor((epoch_us({_AS_OF}) - epoch_us(last_ts)) / 86400000000.0), 0) / 90.0))), 0.5) + least(coalesce(access_count, 0), 100) * 0.01 + least(coalesce(crawl_count, 0), 20) * 0.05, 4) AS score
FROM (SELECT page_id, {CATEGORY} AS category FROM pages) LEFT JOIN (SELECT user_id AS page_id, max(ts) AS last_ts, count(*) FILTER (WHERE event_type = 'view') AS access_count, count(*) FILTER (WHERE event_type = 'click') AS crawl_count FROM events GROUP BY user_id) USING (page_id)"""


def _scored(spark, sf_dir):
    count = lambda kind: F.count_if(F.col("event_type") == kind)
    activity = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("page_id")).agg(F.max("ts").alias("last_ts"), count("view").alias("access_count"), count("click").alias("crawl_count"))
    return V.scored_pages(table(spark, sf_dir, "pages"), activity, F.expr(AS_OF)).select("page_id", "category", "score")


@family.query(_SCORED)
def retention_score(spark, sf_dir):
    return _scored(spark, sf_dir)


@family.query(f"SELECT page_id, score FROM ({_SCORED}) ORDER BY score, page_id LIMIT (SELECT CASE WHEN count(*) <= 100 THEN 0 ELSE count(*) - 100 + 100 END FROM pages)")
def evict_lowest(spark, sf_dir):
    return V.evicted(_scored(spark, sf_dir).select("page_id", "score"), 100, "page_id")
