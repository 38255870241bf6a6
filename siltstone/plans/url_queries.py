"""URL algebra and links of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import urls as U
from siltstone.operators import links as L
from siltstone.plans.registry import Family, sql_any, sql_list, table

family = Family()

_RE = U.RFC3986
S, N, P, Q, G = (f"regexp_extract(url, '{_RE}', {i})" for i in range(1, 6))
HOST = f"lower(regexp_extract({N}, '^(?:.*@)?([^:@]*)', 1))"
PORT = f"TRY_CAST(nullif(regexp_extract({N}, ':([0-9]{{1,5}})$', 1), '') AS INTEGER)"
SORTED = "array_to_string(list_sort(string_split({q}, '&')), '&')"
CLEAN = f"CASE WHEN {P} IN ('', '/') THEN '/' ELSE '/' || array_to_string(list_filter(string_split({P}, '/'), lambda s: s <> '' AND s <> '.'), '/') END"


def _sorted(q: str) -> str:
    return f"CASE WHEN {q} <> '' THEN '?' || {SORTED.format(q=q)} ELSE '' END"


CRAWL = f"lower({S}) || '://' || {HOST} || CASE WHEN {PORT} IS NULL OR (lower({S}) = 'http' AND {PORT} = 80) OR (lower({S}) = 'https' AND {PORT} = 443) THEN '' ELSE ':' || {PORT} END || {CLEAN}"
SCORE = f"""CASE WHEN {sql_any(f'lower({P})', U.SKIP_PATHS)} THEN -9999 WHEN contains({Q}, 'utm_') THEN -5000 ELSE
 CASE WHEN ends_with({HOST}, '.edu') THEN 2 ELSE 0 END + CASE WHEN contains({HOST}, 'wikipedia.org') THEN 2 ELSE 0 END + CASE WHEN contains({HOST}, 'github.com') THEN 2 ELSE 0 END
 + CASE WHEN {sql_any(HOST, ('youtube.com', 'youtu.be'))} THEN 2 ELSE 0 END + CASE WHEN {sql_any(HOST, U.HIGH_QUALITY)} THEN 2 ELSE 0 END + CASE WHEN ends_with({HOST}, '.gov') OR ends_with({HOST}, '.org') THEN 1 ELSE 0 END
 + CASE WHEN {sql_any(HOST, U.KNOWN_BLOGS)} THEN 1 ELSE 0 END - CASE WHEN {sql_any(HOST, U.LOW_QUALITY)} THEN 1 ELSE 0 END
 + CASE WHEN length({P}) - length(replace({P}, '/', '')) >= 2 THEN 1 WHEN {P} IN ('', '/') THEN -1 ELSE 0 END END"""
BARE = f"regexp_replace(lower({N}), '^www\\.', '')"
CATEGORY = (
    f"CASE WHEN {BARE} = '' THEN 'unknown' "
    + " ".join(f"WHEN {sql_any(BARE, parts, 'starts_with')} THEN '{name}'" for name, parts in U.CATEGORY_PREFIXES)
    + " "
    + " ".join(f"WHEN {sql_any(BARE, parts)} THEN '{name}'" for name, parts in U.DOMAIN_CATEGORIES)
    + " ELSE 'unknown' END"
)
VIDEO = f"({HOST} IN {sql_list(U.VIDEO_HOSTS)} OR regexp_replace({HOST}, '^www\\.', '') IN {sql_list(U.VIDEO_HOSTS)})"


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


@family.query(f"SELECT page_id, {CRAWL} || {_sorted(Q)} AS normalized, {CRAWL} AS without_query FROM pages")
def url_normalize_crawl(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.normalize_crawl("url").alias("normalized"), U.normalize_crawl("url", ignore_query=True).alias("without_query"))


@family.query(
    f"""SELECT page_id, lower({S}) || '://' || lower({N}) || CASE WHEN {P} = '/' THEN '/' ELSE regexp_replace(lower({P}), '/+$', '') END
 || {_sorted(f'lower({Q})')} || CASE WHEN {G} <> '' THEN '#' || {G} ELSE '' END AS cache_url FROM pages"""
)
def url_normalize_cache(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.normalize_cache("url").alias("cache_url"))


@family.query(f"SELECT page_id, {HOST} AS domain, CASE WHEN {HOST} = '' THEN '' ELSE lower({S}) || '://' || {HOST} || CASE WHEN {PORT} IS NULL THEN '' ELSE ':' || {PORT} END END AS origin FROM pages")
def url_domain(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.domain("url").alias("domain"), U.domain("url", True).alias("origin"))


@family.query(f"SELECT page_id, {SCORE} AS score FROM pages")
def url_score(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.extractability("url").alias("score"))


@family.query(f"SELECT page_id, url, {SCORE} AS score FROM pages WHERE {SCORE} > -1000 ORDER BY score DESC, page_id LIMIT 20")
def url_rank_topk(spark, sf_dir):
    scored = _pages(spark, sf_dir).select("page_id", "url", U.extractability("url").alias("score")).where("score > -1000")
    return scored.orderBy(F.desc("score"), "page_id").limit(20)


@family.query(f"SELECT page_id, {CATEGORY} AS category FROM pages")
def url_category(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.category("url").alias("category"))


@family.query(f"SELECT page_id, regexp_matches({P}, '{U.LOW_VALUE_PATHS}') AS low_value FROM pages")
def url_low_value(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.is_low_value("url").alias("low_value"))


_INCLUDE, _EXCLUDE = ["/en/**", "/fr/*", "/de/**"], ["/**/1*", "/de/?"]
_SQL_IN = "|".join(f"(?:{U.glob_to_regex(p)})" for p in _INCLUDE)
_SQL_OUT = "|".join(f"(?:{U.glob_to_regex(p)})" for p in _EXCLUDE)


@family.query(f"SELECT page_id, NOT regexp_matches({P}, '{_SQL_OUT}') AND regexp_matches({P}, '{_SQL_IN}') AS allowed FROM pages")
def url_path_filter(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.path_allowed("url", _INCLUDE, _EXCLUDE).alias("allowed"))


@family.query(
    f"""SELECT page_id, CASE {' '.join(f"WHEN regexp_matches({P}, '{U.glob_to_regex(p)}') THEN 'exclude_paths'" for p in _EXCLUDE)} WHEN NOT regexp_matches({P}, '{_SQL_IN}') THEN 'include_paths' END AS reason,
 CASE {' '.join(f"WHEN regexp_matches({P}, '{U.glob_to_regex(p)}') THEN '{p}'" for p in _EXCLUDE)} END AS pattern FROM pages"""
)
def url_filter_reason(spark, sf_dir):
    return _pages(spark, sf_dir).withColumn("why", U.filter_reason("url", _INCLUDE, _EXCLUDE)).select("page_id", "why.reason", "why.pattern")


@family.query(f"SELECT page_id, {VIDEO} AS video, row_number() OVER (ORDER BY {VIDEO}, page_id) AS place FROM pages ORDER BY place LIMIT 10")
def url_video_split(spark, sf_dir):
    """Preferred pages first, video platforms only to fill the quota of 10."""
    ordered = _pages(spark, sf_dir).select("page_id", U.is_video("url").alias("video")).orderBy("video", "page_id").limit(10)
    return L.numbered(ordered, ["video", "page_id"], "place")


def _address(i: int) -> str:
    return f"CASE WHEN page_id % 3 = {i} THEN (page_id * 7919 % 256) || '.' || (page_id * 104729 % 256) || '.' || (page_id % 256) || '.7'"


_RAW = f"CASE WHEN page_id % 3 = 0 THEN (page_id * 7919 % 256) || '.' || (page_id * 31 % 256) || '.' || (page_id % 256) || '.7' WHEN page_id % 3 = 1 THEN '' ELSE 'svc' || page_id || '.docker.internal' END"
_OCTET = "CAST(string_split(h, '.')[{}] AS BIGINT)"
_NUMBER = " + ".join(f"{_OCTET.format(i + 1)} * {256 ** (3 - i)}" for i in range(4))


@family.query(
    f"""WITH hosts AS (SELECT page_id, {_RAW} AS h FROM pages),
numbered AS (SELECT page_id, h, CASE WHEN page_id % 3 = 0 THEN {_NUMBER} END AS n FROM hosts)
SELECT page_id, CASE WHEN h = '' OR ends_with(h, '.docker.internal') THEN true ELSE {' OR '.join(f'n BETWEEN {a} AND {b}' for a, b in U.v4_ranges())} OR n = 1684301000 END AS private FROM numbered"""
)
def url_private_hosts(spark, sf_dir):
    """Addresses made from page ids against the private ranges."""
    host = F.expr(_RAW)
    return _pages(spark, sf_dir).select("page_id", U.is_private(F.concat(F.lit("http://"), host, F.lit("/"))).alias("private"))


_HREFS = "list_distinct(regexp_extract_all(html, '<a href=\"(/[^\"#]*)', 1))"


@family.query(
    f"""WITH found AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)', 1), 1) AS n FROM pages),
first AS (SELECT page_id, url, href, min(n) AS n FROM found GROUP BY ALL)
SELECT page_id, lower({S}) || '://' || {N} || href AS link, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) AS INTEGER) AS position FROM first"""
)
def links_extract(spark, sf_dir):
    return L.page_links(_pages(spark, sf_dir))


@family.query("SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)', 1))) AS internal, CAST(0 AS BIGINT) AS subdomain, CAST(0 AS BIGINT) AS \"external\" FROM pages WHERE contains(html, '<a href=\"')")
def links_classify(spark, sf_dir):
    edges = L.page_links(_pages(spark, sf_dir), keep=("url",))
    kind = U.link_class("link", U.hostname("url"))
    count = lambda k: F.count_if(kind == k).alias(k)
    return edges.groupBy("page_id").agg(count("internal"), count("subdomain"), count("external"))


@family.query(
    f"""WITH found AS (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)', 1)) AS href FROM pages)
SELECT page_id, href AS link_path FROM found WHERE starts_with(href, regexp_replace({P}, '/+$', '') || '/') AND href <> regexp_replace({P}, '/+$', '')"""
)
def links_child_paths(spark, sf_dir):
    edges = L.page_links(_pages(spark, sf_dir), keep=("url",))
    return edges.where(U.below("link", "url")).select("page_id", U.path("link").alias("link_path")).distinct()


@family.query(
    f"""WITH found AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)', 1), 1) AS n FROM pages),
first AS (SELECT page_id, url, href, min(n) AS n FROM found GROUP BY ALL), placed AS (SELECT *, lower({S}) || '://' || {N} AS url_base, row_number() OVER (PARTITION BY page_id ORDER BY n) AS place FROM first)
SELECT page_id, lower({S}) || '://' || {N} || href AS link FROM placed WHERE place <= 5 AND contains(lower(url_base || href), 'an')"""
)
def map_links(spark, sf_dir):
    """Per page: scope filter, then the limit of 5, and only then the search text."""
    return L.site_map(_pages(spark, sf_dir), limit=5, search="an")


@family.query(f"SELECT {HOST} AS host, count(*) AS pages, sum(len(regexp_extract_all(html, '<a href=\"'))) AS links, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) AS page_ids FROM pages GROUP BY ALL")
def link_counts_by_host(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("page_id", U.hostname("url").alias("host"), F.regexp_count("html", F.lit('<a href="')).alias("n"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("page_id")), lambda x: x.cast("string")), ",")
    return rows.groupBy("host").agg(F.count("*").alias("pages"), F.sum("n").alias("links"), ids.alias("page_ids"))
