"""Pages acquired in tiers, from tables of what was fetched."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltstone.functions import html as H
from siltstone.functions import urls as U
from siltstone.operators import acquisition as A
from siltstone.plans import text_queries as TQ
from siltstone.plans.registry import Family, table
from siltstone.sinks.office import as_docx
from siltstone.sources import adapters, records
from siltstone.sources.dispatch import dispatch
from siltstone.sources.documents import parse_documents

family = Family()

#: What results must score here: most texts of these tables score well, so a high bar leaves work for every tier.
THRESHOLD = 0.85


def _tiers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[A.Tier]]:
    """Pages with three sources: documents as their cached text, their own HTML, and the listing of their site."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    cached = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("markdown"))
    answers = pages.select("page_id", F.lit(200).alias("status"), F.lit("text/html; charset=utf-8").alias("content_type"), F.col("html").alias("body"))
    listed = H.listings(pages.select("page_id", "url", U.hostname("url").alias("host"), H.title(F.col("html")).alias("title")), "host", "page_id")
    sites = listed.select("host", F.lit(200).alias("status"), F.col("listing").alias("body"))
    tiers = [A.Tier("cache", A.from_table(cached, "page_id")), A.Tier("negotiation", A.negotiated(answers, "page_id")), A.Tier("site", A.site_texts(sites, "page_id"))]
    return pages.select("page_id", "url"), tiers


@cache
def _sql() -> str:
    main, listing = TQ.family.oracle_sql()["page_main_content"], TQ.family.oracle_sql()["page_llmstxt"]
    judged = TQ._QUALITY.replace("FROM documents", "FROM candidate").removeprefix("WITH ")
    return f"""WITH found AS (SELECT page_id, 0 AS place, 'cache' AS tier, text AS md FROM pages JOIN documents ON doc_id = page_id UNION ALL SELECT page_id, 1, 'negotiation', markdown FROM ({main}) WHERE length(markdown) > 50
 UNION ALL SELECT page_id, 2, 'site', listing FROM pages JOIN ({listing}) ON host = {TQ.HOST}),
candidate AS (SELECT page_id * 10 + place AS doc_id, md AS text FROM found),
{judged},
rated AS (SELECT page_id, place, tier, md, CASE WHEN regexp_replace(md, '\\s', '', 'g') = '' THEN 'empty' WHEN length(md) < 100 AND (contains(lower(md), 'rate limit') OR contains(lower(md), 'too many requests')) THEN 'barrier: rate-limit' WHEN score >= {THRESHOLD} THEN 'ok' ELSE 'low quality' END AS reason, score AS own
 FROM found JOIN judged ON doc_id = page_id * 10 + place),
attempt AS (SELECT page_id, place, tier, md, reason, reason = 'ok' AS accepted, CASE WHEN reason IN ('ok', 'low quality') THEN own END AS score FROM rated r
 WHERE NOT EXISTS (SELECT 1 FROM rated e WHERE e.page_id = r.page_id AND e.place < r.place AND e.reason = 'ok'))"""


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, tiers = _tiers(spark, sf_dir)
    return A.acquire(rows, tiers, "page_id", THRESHOLD, F.md5)


@family.query(
    f"""{_sql()}, chosen AS (SELECT page_id, arg_min(place, (CASE WHEN accepted THEN 0 ELSE 1 END, -coalesce(score, 0), place)) AS place FROM attempt WHERE accepted OR score IS NOT NULL GROUP BY page_id)
SELECT p.page_id, coalesce(tier, 'none') AS tier, score, md5(md) AS text_md5, CASE WHEN NOT accepted THEN printf('Suboptimal content: quality (%.2f) below threshold (%.2f)', score, {THRESHOLD}::DOUBLE) END AS warning FROM pages p LEFT JOIN (SELECT a.* FROM attempt a JOIN chosen USING (page_id, place)) c ON c.page_id = p.page_id"""
)
def tier_chain(spark, sf_dir):
    """Each page's text from the first tier that is good enough."""
    return _both(spark, sf_dir)[0].select("page_id", "tier", "score", F.col("markdown").alias("text_md5"), "warning")


@family.query(f"{_sql()} SELECT page_id, place, tier, score, accepted, reason FROM attempt")
def tier_attempts(spark, sf_dir):
    """What was tried: no tier is asked for a page that an earlier one has satisfied."""
    return _both(spark, sf_dir)[1]


_URL = "CASE doc_id % 6 WHEN 0 THEN 'https://github.com/' || source || '/r' || doc_id || '/issues/7' WHEN 1 THEN 'https://github.com/' || source || '/r' || doc_id WHEN 2 THEN 'cve:CVE-2024-' || (10000 + doc_id) WHEN 3 THEN 'https://' || source || '.example.com/p/' || doc_id WHEN 4 THEN 'https://shop.example.com/products/p/' || doc_id ELSE 'https://example.com/' || doc_id END"


def _record(c: str) -> Column:
    """JSON of a document as a repository's record."""
    fields = F.struct(F.concat("source", F.lit("/r"), "doc_id").alias("full_name"), F.substring("text", 1, 200).alias("description"), F.col("n_chars").alias("stargazers_count"), F.col("lang").alias("language"), F.array("source", "lang").alias("topics"))
    return F.to_json(fields).alias(c)



@family.query(
    f"""WITH rows AS (SELECT *, {_URL} AS url FROM documents), matched AS (SELECT *, list_filter([{', '.join(f"CASE WHEN regexp_matches(url, '{p}') THEN '{n}' END" for n, p, _ in sorted(adapters.ADAPTERS, key=lambda a: -a[2]))}], lambda x: x IS NOT NULL) AS m FROM rows),
turns AS (SELECT doc_id, n_chars, text, lang, source, unnest(m) AS adapter, unnest(range(0, len(m))) AS turn FROM matched),
judged AS (SELECT *, CASE adapter WHEN 'github_social' THEN CASE WHEN n_chars % 2 = 1 THEN 'not JSON' END WHEN 'github' THEN NULL WHEN 'cveorg' THEN CASE WHEN n_chars % 3 = 0 THEN 'gone' END WHEN 'substack' THEN CASE WHEN n_chars % 2 = 1 THEN 'no result' END ELSE 'no source' END AS error FROM turns),
tried AS (SELECT * FROM judged j WHERE NOT EXISTS (SELECT 1 FROM judged e WHERE e.doc_id = j.doc_id AND e.turn < j.turn AND e.error IS NULL)),
last AS (SELECT doc_id, arg_max(adapter, turn) AS adapter, max(turn) + 1 AS turns FROM tried GROUP BY doc_id),
done AS (SELECT t.*, turns FROM tried t JOIN last USING (doc_id, adapter)),
shown AS (SELECT *, '## Repository: ' || source || '/r' || doc_id || chr(10) || chr(10) || '| Field | Value |' || chr(10) || '|---|---|' || CASE WHEN substr(text, 1, 200) <> '' THEN chr(10) || '| Description | ' || replace(regexp_replace(substr(text, 1, 200), '\\s*\\n\\s*', ' ', 'g'), '|', '\\|') || ' |' ELSE '' END
 || chr(10) || '| Stars | ' || n_chars || ' |' || chr(10) || '| Language | ' || lang || ' |' || chr(10) || chr(10) || '### Topics' || chr(10) || chr(10) || '- ' || source || chr(10) || '- ' || lang AS md FROM done)
SELECT d.doc_id, CASE WHEN s.error IS NULL THEN s.adapter END AS adapter, s.error, CASE WHEN s.error IS NULL THEN md5(md) END AS text_md5, coalesce(s.turns, 0)::BIGINT AS turns FROM documents d LEFT JOIN shown s USING (doc_id)"""
)
def adapter_fallthrough(spark, sf_dir):
    """Addresses made from documents, handed to adapters whose sources fail for a part of them."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.expr(_URL).alias("url"))
    good = docs.select("doc_id", "n_chars", _record("raw"))
    half = F.col("n_chars") % 2 == 0
    sources = {
        "github_social": records.source(good.withColumn("raw", F.when(half, F.col("raw")).otherwise("{bad")), "doc_id", "github"),
        "github": records.source(good, "doc_id", "github"),
        "cveorg": records.source(good.withColumn("error", F.when(F.col("n_chars") % 3 == 0, "gone")), "doc_id", "github"),
        "substack": records.source(good.where(half), "doc_id", "github"),
    }
    out, tries = dispatch(rows, sources, "doc_id")
    turns = tries.groupBy("doc_id").agg(F.count("*").alias("turns"))
    return out.join(turns, "doc_id", "left").select("doc_id", "adapter", "error", F.md5("markdown").alias("text_md5"), F.coalesce("turns", F.lit(0)).alias("turns"))


@family.query(f"SELECT doc_id, 'ok' AS status, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {TQ._STRIP.format(x='x')}), lambda x: x <> ''), {TQ._BREAK}) AS t FROM documents)")
def office_documents(spark, sf_dir):
    """Documents as .docx files, and what the parser of such files reads: their lines, one paragraph each."""
    read = parse_documents(as_docx(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return read.select(F.regexp_extract("path", "^[0-9]+", 0).cast("long").alias("doc_id"), "status", F.length("markdown").cast("long").alias("n_chars"), F.md5("markdown").alias("text_md5"))
