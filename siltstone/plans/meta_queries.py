"""Page metadata, response signals and routing, over heads and headers written by one SQL expression, which Spark and DuckDB then parse each in its own way."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import html as H
from siltstone.functions import text as T
from siltstone.functions import urls as U
from siltstone.operators import search as S
from siltstone.plans.registry import Family, sql_any, table

family = Family()


#: SQL that Spark and DuckDB read alike: heads with tags in both orders, with either quote, in capitals, repeated, empty, broken or left out.
_NAMED = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_Q = "chr(39)"
_HEAD = f"""CASE WHEN page_id % 7 = 6 THEN '<html><body>no head ' || url || '</body></html>' ELSE '<html lang="' || CASE page_id % 3 WHEN 0 THEN 'en-GB' WHEN 1 THEN 'de' ELSE '' END || '"><head><meta http-equiv="content-language" content="fr-CA">'
 || CASE page_id % 4 WHEN 0 THEN '<meta property="og:title" content="' || {_NAMED} || '">' WHEN 1 THEN '<META CONTENT=' || {_Q} || {_NAMED} || {_Q} || ' PROPERTY=' || {_Q} || 'og:title' || {_Q} || '/>' WHEN 2 THEN '<meta property="og:title" content=""><meta data-x="1" property="og:title"  content=" ' || {_NAMED} || ' ">' ELSE '<meta property="og:title" content="' || {_NAMED} || '"><meta property="og:title" content="Second ' || page_id || '">' END
 || '<meta property="og:url" content="' || url || '">' || CASE page_id % 5 WHEN 0 THEN '<meta property="og:image" content="a' || page_id || '.png"><meta property="og:image" content="b.png"/>' WHEN 1 THEN '<meta property="og:image">' WHEN 2 THEN '<meta content="c' || page_id || '.png" property="og:image">' WHEN 3 THEN '' ELSE '<meta property="og:image" content="d.png' END
 || CASE page_id % 3 WHEN 0 THEN '<meta name="twitter:card" content="summary"><meta name="twitter:card" content="' || url || '">' WHEN 1 THEN '<meta property="twitter:card" content="large' || page_id || '"><meta name="twitter:site" content="@s">' ELSE '<meta name="twitter:card" content=" ">' END
 || CASE page_id % 5 WHEN 0 THEN '<meta name="description" content="' || {_NAMED} || '">' WHEN 1 THEN '<meta content="About ' || page_id || '" name="description">' WHEN 2 THEN '<meta name="description" content="">' WHEN 3 THEN '<meta name="Description" content=" Page ' || page_id || ' ">' ELSE '' END
 || CASE page_id % 2 WHEN 0 THEN '<meta property="article:published_time" content="2024-01-0' || (page_id % 9 + 1) || 'T00:00:00Z">' ELSE '' END
 || CASE page_id % 4 WHEN 0 THEN '<link rel="canonical" href="' || url || '">' WHEN 1 THEN '<link href="https://c/' || page_id || '" rel="canonical">' WHEN 2 THEN '<link rel="alternate" href="/x">' ELSE '<LINK REL="canonical" HREF="' || url || '#top">' END
 || '<script type="application/ld+json">' || CASE page_id % 6 WHEN 0 THEN '{{"@graph":[{{"@type":"Article","name":"N' || page_id || '"}},{{"note":"no type"}}]}}' WHEN 1 THEN '[{{"@type":"Person","name":"P' || page_id || '"}},{{"url":"' || url || '"}}]' WHEN 2 THEN '{{broken' WHEN 3 THEN '{{"@type":"Thing","name":"' || url || '"}}' WHEN 4 THEN '{{"note":1}}' ELSE '' END || '</script></head><body>x</body></html>' END"""
_METAS = "regexp_extract_all(head, '(?is)<meta\\s[^>]*>')"
_CONTENT = "trim(regexp_extract({x}, '(?is)\\bcontent=[\"'']([^\"'']*)[\"'']', 1))"
_HEADS = f"heads AS (SELECT page_id, url, {_HEAD} AS head FROM pages)"


def _named(prefix: str, attribute: str) -> str:
    """Pairs of name and content of the tags with a prefix, in order."""
    name = f"regexp_extract(x, '(?is)\\b{attribute}=[\"'']{prefix}([^\"'']+)[\"'']', 1)"
    return f"list_filter(list_transform({_METAS}, lambda x: {{'name': {name}, 'content': {_CONTENT.format(x='x')}}}), lambda p: p.name <> '' AND p.content <> '')"


def _heads(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_HEAD).alias("html"))


@family.query(
    f"""WITH {_HEADS}, og AS (SELECT page_id, {_named('og:', 'property')} AS p FROM heads)
SELECT page_id, list_filter(p, lambda x: x.name = 'title')[1].content AS title, len(list_filter(p, lambda x: x.name = 'title')) AS titles, list_filter(p, lambda x: x.name = 'url')[1].content AS address, array_to_string(list_transform(list_filter(p, lambda x: x.name = 'image'), lambda x: x.content), ',') AS images FROM og"""
)
def page_open_graph(spark, sf_dir):
    og, none = H.open_graph(F.col("html")), F.array().cast("array<string>")
    of = lambda name: F.coalesce(F.try_element_at("og", F.lit(name)), none)
    return _heads(spark, sf_dir).withColumn("og", og).select("page_id", F.get(of("title"), 0).alias("title"), F.size(of("title")).cast("long").alias("titles"), F.get(of("url"), 0).alias("address"), F.array_join(of("image"), ",").alias("images"))


@family.query(f"WITH {_HEADS}, t AS (SELECT page_id, {_named('twitter:', '(?:name|property)')} AS p FROM heads) SELECT page_id, list_filter(p, lambda x: x.name = 'card')[-1].content AS card, len(list_distinct(list_transform(p, lambda x: x.name))) AS tags FROM t")
def page_twitter_card(spark, sf_dir):
    """The last card, and how many tags have different names."""
    return _heads(spark, sf_dir).withColumn("t", H.twitter_card(F.col("html"))).select("page_id", F.try_element_at("t", F.lit("card")).alias("card"), F.size("t").cast("long").alias("tags"))


@family.query(
    f"""WITH {_HEADS}, block AS (SELECT page_id, regexp_extract(head, '(?is)<script[^>]*type="application/ld.json"[^>]*>(.*?)</script>', 1) AS raw FROM heads),
good AS (SELECT page_id, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM block),
each AS (SELECT page_id, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') WHEN json_type(json_extract(j, '$."@graph"')) = 'ARRAY' THEN json_extract(j, '$."@graph"[*]') ELSE [j] END) AS item FROM good WHERE j IS NOT NULL),
kept AS (SELECT page_id, list({{'t': json_extract_string(item, '$."@type"'), 'n': json_extract_string(item, '$.name')}}) AS items FROM each WHERE json_extract(item, '$."@type"') IS NOT NULL OR json_extract(item, '$.name') IS NOT NULL OR json_extract(item, '$.url') IS NOT NULL GROUP BY page_id)
SELECT p.page_id, coalesce(len(items), 0)::INTEGER AS items, items[1].t || ':' || items[1].n AS named FROM pages p LEFT JOIN kept USING (page_id)"""
)
def page_json_ld(spark, sf_dir):
    """Items that have a type, a name or an address, out of lists and @graph; what doesn't parse is left out."""
    items = H.json_ld_items(F.col("html"))
    first = F.get(items, F.lit(0))
    named = F.concat(F.try_variant_get(first, "$['@type']", "string"), F.lit(":"), F.try_variant_get(first, "$.name", "string"))
    return _heads(spark, sf_dir).select("page_id", F.size(items).alias("items"), named.alias("named"))


_TAG = "(regexp_extract_all(head, '(?is)<{tag}\\s[^>]*{test}[^>]*>'))[1]"


@family.query(
    f"""WITH {_HEADS}, tags AS (SELECT page_id, {_TAG.format(tag='link', test="rel=[\"'']canonical[\"'']")} AS link, list_filter({_METAS}, lambda x: regexp_matches(x, '(?is)\\bname=[\"'']description[\"'']') AND {_CONTENT.format(x='x')} <> '')[1] AS said, {_TAG.format(tag='meta', test="property=[\"'']article:published_time[\"'']")} AS dated, regexp_extract(head, '(?is)<html[^>]*lang="([^"]*)"', 1) AS own, regexp_extract(head, '(?is)http-equiv="content-language" content="([^"]*)"', 1) AS other FROM heads)
SELECT page_id, nullif(regexp_extract(link, '(?is)href=[\"'']([^\"'']*)[\"'']', 1), '') AS canonical, nullif(split_part(CASE WHEN own <> '' THEN own ELSE other END, '-', 1), '') AS language, nullif({_CONTENT.format(x='said')}, '') AS description, nullif({_CONTENT.format(x='dated')}, '') AS published FROM tags"""
)
def page_standard_meta(spark, sf_dir):
    return _heads(spark, sf_dir).withColumn("m", H.standard_meta(F.col("html"))).select("page_id", "m.canonical", "m.language", "m.description", "m.published")


_TITLED = f"CASE page_id % 5 WHEN 0 THEN {_NAMED} || ' - Just a MOMENT...' WHEN 1 THEN upper('ddos-guard ' || {_NAMED}) WHEN 2 THEN replace({_NAMED}, ' ', '-') ELSE {_NAMED} END"
_AT = "CASE page_id % 7 WHEN 0 THEN url || '?__CF_chl_tk=1' WHEN 1 THEN 'https://ddos-guard.net/' || page_id WHEN 2 THEN url || '/cf-chl' ELSE url END"


@family.query(f"SELECT page_id, {sql_any(f'lower({_TITLED})', [x.lower() for x in T.CLOUDFLARE + T.DDOS_GUARD])} OR {sql_any(f'lower({_AT})', ['cf_chl', 'challenge-platform', 'ddos-guard'])} AS challenge FROM pages")
def bot_challenge(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.is_bot_challenge(F.expr(_TITLED), F.expr(_AT)).alias("challenge"))


_EMBED = "html || CASE page_id % 6 WHEN 0 THEN '<IFRAME src=\"' || url || '/report.PDF\">' WHEN 1 THEN '<embed src=\"plain\">' WHEN 2 THEN '<a href=\"x.pdf\">' WHEN 3 THEN '<object data=\"https://docs.google.com/' || page_id || '\">' WHEN 4 THEN '<iframe src=\"/download/' || page_id || '\">' ELSE '' END"


@family.query(f"SELECT page_id, {sql_any('h', ['<iframe', '<embed', '<object'])} AND {sql_any('h', [*T.EMBED_ENDINGS, *T.EMBED_HOSTS, '/pdf/', '/download/'])} AS embedded FROM (SELECT page_id, lower({_EMBED}) AS h FROM pages)")
def embedded_document(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.has_embedded_document(F.expr(_EMBED)).alias("embedded"))


_OTHER = "CASE page_id % 6 WHEN 0 THEN upper(url) WHEN 1 THEN replace(url, 'https://', 'http://') WHEN 2 THEN replace(url, 'http://', 'https://') WHEN 3 THEN url || '/more?q=1' WHEN 4 THEN replace(url, '.example.', ':8080.example.') ELSE 'https://www.example.com/' || page_id END"
_ORIGIN = "regexp_extract(lower({x}), '^([a-z][a-z0-9+.-]*://[^/?#]*)', 1)"


@family.query(f"SELECT page_id, {_ORIGIN.format(x='url')} = {_ORIGIN.format(x=_OTHER)} AS same FROM pages")
def same_origin(spark, sf_dir):
    """Addresses of pages and other spellings of them: capitals, another scheme, path or port, another host."""
    return table(spark, sf_dir, "pages").select("page_id", U.same_origin("url", F.expr(_OTHER)).alias("same"))


_HEADERS = """page_id, url, CASE page_id % 3 WHEN 0 THEN url || '/' WHEN 1 THEN lower(url) ELSE url END AS final_url, CASE page_id % 11 WHEN 3 THEN 503 WHEN 7 THEN 404 WHEN 8 THEN 301 ELSE 200 END AS status,
CASE page_id % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'Image/PNG; q=1' WHEN 2 THEN 'text/html; charset=utf-8' WHEN 3 THEN 'application/json' WHEN 4 THEN 'application/zip;x' ELSE NULL END AS content_type,
CASE page_id % 5 WHEN 0 THEN CAST(length(html) AS varchar(20)) WHEN 1 THEN 'unknown' WHEN 2 THEN '17' WHEN 3 THEN '1024' ELSE NULL END AS content_length, CASE page_id % 4 WHEN 0 THEN 'Challenge' WHEN 1 THEN 'none' ELSE NULL END AS mitigated"""
_TYPE = "trim(lower(split_part(coalesce(content_type, ''), ';', 1)))"


@family.query(
    f"SELECT page_id, lower(coalesce(mitigated, '')) = 'challenge' OR status >= 400 AS shielded, url <> final_url AS redirected, {sql_any(_TYPE, S.BINARY_STARTS, 'starts_with')} OR {sql_any(_TYPE, S.BINARY_TYPES, 'starts_with')} AS is_binary, coalesce(status = 200 AND try_cast(content_length AS BIGINT) < 1024, false) AS is_empty FROM (SELECT {_HEADERS} FROM pages)"
)
def head_signals(spark, sf_dir):
    """What the headers of a response say before its body is fetched."""
    table(spark, sf_dir, "pages").createOrReplaceTempView("_pages_of_head_signals")
    rows = spark.sql(f"SELECT {_HEADERS} FROM _pages_of_head_signals")
    return S.routing_signals(rows, "page_id").select("page_id", "shielded", "redirected", "is_binary", "is_empty")


_CATEGORIES = "CASE page_id % 5 WHEN 0 THEN 'news,images' WHEN 1 THEN 'general,news' WHEN 2 THEN 'newsletter' WHEN 3 THEN '' ELSE 'images' END"


@family.query(f"SELECT page_id, CASE WHEN list_contains(c, 'images') THEN 'images' WHEN list_contains(c, 'news') THEN 'news' ELSE 'web' END AS route FROM (SELECT page_id, string_split({_CATEGORIES}, ',') AS c FROM pages)")
def search_route(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("categories", F.split(F.expr(_CATEGORIES), ","))
    return S.routed(pages).select("page_id", "route")


@family.query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'short' ELSE substr(text, 1, 3000) END AS content FROM documents WHERE text <> ''")
def rich_contents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("text")).otherwise("").alias("markdown"), F.lit("short").alias("description"))
    return S.rich_contents(docs).select("doc_id", "content")


_ANSWER = f"CASE page_id % 4 WHEN 0 THEN {_NAMED} || ' [1], [2] and [9]; [1] again, not [2](x)' WHEN 1 THEN '[02] ' || {_NAMED} || ' [0] [3]' WHEN 2 THEN 'no marks in ' || url ELSE '[2][1] ' || url || ' [12] [1](y)' END"


def _linked(x: str, n: int, url: str) -> str:
    """SQL that links the marks of a source, but for those that are links already."""
    kept = f"regexp_replace({x}, '\\[(0*{n})\\]\\(', chr(1) || '\\1' || chr(2), 'g')"
    return f"replace(replace(regexp_replace({kept}, '\\[0*{n}\\]', '[{n}](' || {url} || ')', 'g'), chr(1), '['), chr(2), '](')"


@family.query(
    f"""WITH a AS (SELECT page_id, url, {_ANSWER} AS answer FROM pages), bare AS (SELECT *, regexp_replace(answer, '\\[[0-9]+\\]\\(', '', 'g') AS marks FROM a)
SELECT page_id, {_linked(_linked('answer', 1, 'url'), 2, "'http://b'")} AS linked, regexp_matches(marks, '\\[0*1\\]')::INTEGER + regexp_matches(marks, '\\[0*2\\]')::INTEGER AS cited FROM bare"""
)
def citations_compact(spark, sf_dir):
    """Marks of two sources, the page's own address and another, in answers made of titles."""
    from siltstone.operators.research import cite

    return table(spark, sf_dir, "pages").withColumn("c", cite(F.expr(_ANSWER), F.array("url", F.lit("http://b")), "compact")).select("page_id", F.col("c.text").alias("linked"), F.size("c.citations").alias("cited"))
