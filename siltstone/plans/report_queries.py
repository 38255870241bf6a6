"""Compositions of several operators: the corpus report, search and answer pipelines."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siltstone.functions import html as H
from siltstone.functions import text as T
from siltstone.functions import urls as U
from siltstone.operators import dedup as D
from siltstone.operators import vectors as V
from siltstone.plans import text_queries as TQ
from siltstone.plans.registry import Family, table
from siltstone.plans.state_queries import _RANKED, _queries
from siltstone.plans.url_queries import CATEGORY, CRAWL, HOST, P, Q, SCORE, _sorted

family = Family()

_PAGE_TEXT = f"""WITH body AS (SELECT page_id, url, {TQ._CLEAN} AS raw FROM pages), decoded AS (SELECT page_id, url, replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS raw FROM body),
texts AS (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(raw, chr(10)), lambda x: {TQ._STRIP.format(x='x')}), lambda x: x <> ''), chr(10)) AS text FROM decoded)"""


@family.query(
    f"""{_PAGE_TEXT}, kept AS (SELECT * FROM texts WHERE text = '' OR page_id = (SELECT min(t.page_id) FROM texts t WHERE sha256(t.text) = sha256(texts.text))),
counts AS (SELECT page_id, url, text, {TQ._STRIP.format(x='text')} AS t, len({TQ._LINES}) AS n_lines, len(list_filter({TQ._LINES}, lambda x: {TQ._LINKED})) AS links, len(list_filter({TQ._LINES}, lambda x: length(x) > 60 AND NOT {TQ._LINKED})) AS solid FROM kept),
hit AS (SELECT *, {TQ._HITS} AS hits FROM counts), scored AS (SELECT page_id, url, {TQ._BOILER} AS b, {TQ._COMPLETE} AS c, {TQ._BLOCK} AS k FROM hit),
judged AS (SELECT page_id, {CATEGORY} AS category, {SCORE} AS url_score, {CRAWL} || {_sorted(Q)} AS url, CAST(floor((30 * b + 30 * c + 40 * k + 50) / 100.0) AS BIGINT) AS hundredths FROM scored)
SELECT category, count(*) AS pages, round(sum(hundredths) * 1.0 / count(*) / 100, 6) AS mean_quality, sum(url_score) AS url_scores, arg_min(url, (-hundredths, page_id)) AS best_url FROM judged GROUP BY category"""
)
def corpus_report(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", H.visible_text(F.col("html")).alias("text"))
    kept = D.content_dedup(pages, "page_id").where("not duplicate")
    judged = kept.select("page_id", U.category("url").alias("category"), U.extractability("url").alias("url_score"), U.normalize_crawl("url").alias("url"), F.round(T.quality(F.col("text"))["score"] * 100).cast("long").alias("hundredths"))
    return judged.groupBy("category").agg(
        F.count("*").alias("pages"), F.round(F.sum("hundredths") * 1.0 / F.count("*") / 100, 6).alias("mean_quality"), F.sum("url_score").alias("url_scores"), F.min_by("url", F.struct(-F.col("hundredths"), "page_id")).alias("best_url")
    )


@family.query(
    f"""WITH near AS (SELECT query_id, vec_id AS doc_id, place, 1 AS list_no FROM ({_RANKED}) WHERE place <= 10), words AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place, 0 AS list_no FROM (SELECT doc_id FROM documents WHERE contains(lower(text), 'the') ORDER BY doc_id LIMIT 4)),
lists AS (SELECT query_id, w.doc_id, w.place, w.list_no FROM (SELECT DISTINCT query_id FROM near) CROSS JOIN words w UNION ALL SELECT query_id, doc_id, place, list_no FROM near),
merged AS (SELECT query_id, doc_id, min(list_no) AS list_no, arg_min(place, list_no) AS place FROM lists GROUP BY query_id, doc_id), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY list_no, place) AS n FROM merged QUALIFY n <= 8)
SELECT query_id, string_agg('[' || n || '] ' || substr(text, 1, 100), chr(10) ORDER BY n) AS context, count(*) AS sources FROM top JOIN documents USING (doc_id) GROUP BY query_id"""
)
def answer_context(spark, sf_dir):
    """For each query keyword hits (4, by id), then vector hits, first wins; the first 8 as a numbered context."""
    docs = table(spark, sf_dir, "documents")
    near = V.top_k(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 10).select("query_id", F.col("vec_id").alias("doc_id"), F.col("place").cast("long").alias("place"))
    words = docs.where(F.lower("text").contains("the")).select("doc_id").orderBy("doc_id").limit(4)
    hits = words.agg(F.transform(F.array_sort(F.collect_list("doc_id")), lambda v, i: F.struct(v.alias("doc_id"), (i + 1).cast("long").alias("place"))).alias("hits"))
    keyword = near.select("query_id").distinct().join(F.broadcast(hits)).select("query_id", F.inline("hits"))  # one row of 4 hits
    both = keyword.withColumn("list_no", F.lit(0)).unionByName(near.withColumn("list_no", F.lit(1)))
    merged = D.first_per_key(both, ["query_id", "doc_id"], ["list_no", "place"])
    top = merged.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("list_no", "place"))).where("n <= 8")
    piece = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.substring("text", 1, 100))
    rows = docs.select("doc_id", "text").join(top, "doc_id").select("query_id", "n", piece.alias("piece"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "\n").alias("context"), F.count("*").alias("sources"))


@family.query(f"SELECT page_id, url, score FROM (SELECT page_id, url, {SCORE} AS score, {HOST} AS host, row_number() OVER (PARTITION BY {HOST} ORDER BY {SCORE} DESC, page_id) AS n FROM pages WHERE NOT regexp_matches({P}, '{U.LOW_VALUE_PATHS}')) WHERE n <= 2 AND score > -1000")
def discover_per_host(spark, sf_dir):
    """Source discovery: pages worth a scrape, two a host at most."""
    rows = table(spark, sf_dir, "pages").where(~U.is_low_value("url")).select("page_id", "url", U.hostname("url").alias("host"), U.extractability("url").alias("score"))
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("score"), "page_id")))
    return best.where("n <= 2 and score > -1000").select("page_id", "url", "score")
