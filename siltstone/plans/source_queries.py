"""Sources, search results and activity: sitemaps, robots files and media written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import urls as U
from siltstone.operators import activity as A
from siltstone.operators import search as S
from siltstone.operators.extraction import extract_pages
from siltstone.plans.registry import Family, table
from siltstone.plans.url_queries import HOST
from siltstone.sources import sitemaps as M

family = Family()


@family.query(f"SELECT DISTINCT 'https://' || {HOST} || '/sitemap_index.xml' AS root, url AS loc FROM pages WHERE {HOST} <> ''")
def sitemap_pages(spark, sf_dir):
    """Each host's pages as two sitemaps below an index, read back by following it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", U.hostname("url").alias("host")).where("host <> ''")
    entry = F.concat(F.lit("<url><loc> "), F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(" </loc><lastmod>2024-01-01</lastmod></url>"))
    part = F.concat(F.lit("https://"), "host", F.lit("/map"), (F.col("page_id") % 2).cast("string"), F.lit(".xml"))
    wrap = lambda name, inner: F.concat(F.lit(f'<?xml version="1.0"?><{name} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), inner, F.lit(f"</{name}>"))
    leaves = pages.groupBy("host", part.alias("location")).agg(wrap("urlset", F.concat_ws("", F.collect_list(entry))).alias("text"))
    child = F.concat(F.lit("<sitemap><loc>"), "location", F.lit("</loc></sitemap>"))
    index = leaves.groupBy("host").agg(wrap("sitemapindex", F.concat_ws("", F.collect_list(child))).alias("text")).withColumn("location", F.concat(F.lit("https://"), "host", F.lit("/sitemap_index.xml")))
    files = leaves.select("location", F.encode("text", "UTF-8").alias("content")).unionByName(index.select("location", F.encode("text", "UTF-8").alias("content")))
    return M.sitemap_urls(files, index.select("location"))


#: SQL that Spark and DuckDB read alike: a robots file for each host.
_ROBOTS = """'# file of ' || host || chr(10) || 'User-agent: other' || chr(10) || 'Disallow: /' || chr(10) || CASE length(host) % 5 WHEN 0 THEN 'User-Agent: *' || chr(10) || 'Disallow: /fr/' || chr(10) || 'Crawl-delay: 2.5' WHEN 1 THEN 'user-agent: BOT' || chr(10) || 'Disallow:' || chr(10) || 'disallow: /*/1' || chr(10) || 'crawl-delay: x'
 WHEN 2 THEN 'User-agent: *' || chr(10) || 'Disallow: /en/' || length(host) || '$' || chr(10) || 'Disallow: /de' || chr(10) || 'Allow: /de/5' WHEN 3 THEN 'User-agent: x' || chr(10) || 'Disallow: /en' ELSE 'User-agent: *' || chr(10) || chr(10) || 'Disallow: /es/*5$' || chr(10) || 'User-agent: y' || chr(10) || 'Disallow: /' END"""
_PATH = "coalesce(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')"


@family.query(
    f"""WITH hosts AS (SELECT DISTINCT {HOST} AS host FROM pages), files AS (SELECT host, {_ROBOTS} AS text FROM hosts),
lines AS (SELECT host, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM files),
named AS (SELECT host, pos, lower(trim(split_part(line, ':', 1))) AS name, trim(substr(line, strpos(line, ':') + 1)) AS value FROM lines WHERE trim(line) <> '' AND NOT starts_with(line, '#')),
state AS (SELECT *, last_value(CASE WHEN name = 'user-agent' THEN lower(value) IN ('*', 'bot') END IGNORE NULLS) OVER (PARTITION BY host ORDER BY pos) AS applies FROM named),
rules AS (SELECT host, '^' || replace(regexp_replace(regexp_replace(value, '\\$$', ''), '([.+?^(){{}}|-])', '\\\\\\1', 'g'), '*', '.*') || CASE WHEN ends_with(value, '$') THEN '$' ELSE '' END AS rule FROM state WHERE applies AND name = 'disallow' AND value <> ''),
delays AS (SELECT host, arg_max(try_cast(value AS DOUBLE), pos) AS crawl_delay FROM state WHERE applies AND name = 'crawl-delay' GROUP BY host)
SELECT page_id, EXISTS (SELECT 1 FROM rules r WHERE r.host = {HOST} AND regexp_matches({_PATH}, rule)) AS blocked, crawl_delay FROM pages LEFT JOIN delays ON delays.host = {HOST}"""
)
def robots_verdicts(spark, sf_dir):
    """Which pages their hosts' robots files disallow, and the delays that these ask for."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url").withColumn("host", U.hostname("url"))
    files = pages.select("host").distinct().select(F.col("host").alias("domain"), F.expr(_ROBOTS).alias("text"))
    rules = M.robots_rules(files)
    out = M.robots_verdict(pages, rules).join(rules.select(F.col("domain").alias("host"), "crawl_delay"), "host", "left")
    return out.select("page_id", "blocked", "crawl_delay")


_MEDIA = """'<body>' || CASE page_id % 4 WHEN 0 THEN '<img src="/i' || page_id || '.png" alt="Picture ' || page_id || '" width="640" height="480">' WHEN 1 THEN '<IMG alt="x" SRC="https://cdn.example.org/' || page_id || '.jpg" width="wide"/><img src="data:image/png;base64,AA">' WHEN 2 THEN '<img alt="none"><img src=" /two.png " height="7">' ELSE '' END
 || '<p>See <code>f(' || page_id || ')</code></p>' || CASE page_id % 3 WHEN 0 THEN '<pre><code>print(' || page_id || ')</code></pre><code>f(' || page_id || ')</code>' WHEN 1 THEN '<code> </code>' ELSE '' END || '</body>'"""
_IMG = "list_filter(list_transform(regexp_extract_all(media, '(?i)<img[^>]*>'), lambda x: {{'src': trim(regexp_extract(x, '(?i)src=\"([^\"]*)\"', 1)), 'alt': regexp_extract(x, '(?i)alt=\"([^\"]*)\"', 1), 'w': regexp_extract(x, 'width=\"([0-9]+)\"', 1), 'h': regexp_extract(x, 'height=\"([0-9]+)\"', 1)}}), lambda i: i.src <> '' AND NOT starts_with(i.src, 'data:'))"


@family.query(
    f"""WITH made AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) AS origin, {_MEDIA} AS media FROM pages), found AS (SELECT page_id, origin, {_IMG.replace('{{', '{').replace('}}', '}')} AS i, list_transform(regexp_extract_all(media, '<pre><code>([^<]*)</code></pre>', 1), lambda x: x) AS first, list_filter(regexp_extract_all(media, '<code>([^<]*)</code>', 1), lambda x: trim(x) <> '') AS every FROM made)
SELECT page_id, array_to_string(list_transform(i, lambda x, n: n || ' ' || CASE WHEN starts_with(x.src, '/') THEN origin || x.src ELSE x.src END || ' ' || x.alt || ' ' || coalesce(nullif(x.w, ''), '-') || ' ' || coalesce(nullif(x.h, ''), '-')), ',') AS images, array_to_string(list_concat(first, list_filter(list_distinct(every), lambda c: NOT list_contains(first, c))), ',') AS code FROM found"""
)
def page_images_code(spark, sf_dir):
    """Images with their places and sizes, and code (blocks first, once each) of pages written from ids and addresses."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_MEDIA).alias("html"))
    shown = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    image = lambda i: F.concat_ws(" ", i["position"].cast("string"), i["url"], i["alt"], shown(i["width"]), shown(i["height"]))
    return extract_pages(pages).select("page_id", F.array_join(F.transform("images", image), ",").alias("images"), F.array_join("code", ",").alias("code"))


@family.query("SELECT doc_id, nullif(regexp_extract(said, '^([0-9]+)\\s*[×x]\\s*([0-9]+)', 1), '')::INTEGER AS width, nullif(regexp_extract(said, '^([0-9]+)\\s*[×x]\\s*([0-9]+)', 2), '')::INTEGER AS height FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN n_chars || ' × ' || doc_id WHEN 1 THEN n_chars || 'x' || doc_id || ' pixels' WHEN 2 THEN 'of ' || n_chars || ' x 5' ELSE source END AS said FROM documents)")
def image_sizes(spark, sf_dir):
    """Sizes from the descriptions of image results."""
    said = F.expr("CASE doc_id % 4 WHEN 0 THEN n_chars || ' × ' || doc_id WHEN 1 THEN n_chars || 'x' || doc_id || ' pixels' WHEN 2 THEN 'of ' || n_chars || ' x 5' ELSE source END")
    return table(spark, sf_dir, "documents").withColumn("s", S.image_size(said)).select("doc_id", "s.width", "s.height")


_ASKED = "CASE event_id % 6 WHEN 0 THEN 'web,news' WHEN 1 THEN 'social' WHEN 2 THEN event_type WHEN 3 THEN 'images,video' ELSE '' END"
_KINDS = "CASE event_id % 5 WHEN 0 THEN 'research,github' WHEN 1 THEN 'pdf' WHEN 2 THEN 'news,' || event_type ELSE '' END"
_NAMES = lambda names, x: "CASE {x} ".format(x=x) + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {x} END"


@family.query(
    f"""WITH named AS (SELECT event_id, list_concat(list_transform(string_split({_ASKED}, ','), lambda x: {_NAMES(S.SOURCES, 'x')}), list_transform(string_split({_KINDS}, ','), lambda x: {_NAMES(S.CATEGORIES, 'x')})) AS c FROM events),
kept AS (SELECT event_id, list_filter(c, lambda x, i: x <> '' AND list_position(c, x) = i) AS c FROM named) SELECT event_id, CASE WHEN len(c) = 0 THEN 'general' ELSE array_to_string(c, ',') END AS categories FROM kept"""
)
def category_translation(spark, sf_dir):
    """Names of sources and categories as the search engine calls them, each once in order."""
    found = S.search_categories(F.split(F.expr(_ASKED), ","), F.split(F.expr(_KINDS), ","))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(found, ",").alias("categories"))


@family.query("""WITH asked AS (SELECT user_id, event_type AS engine, count(*) FILTER (WHERE value > 60) AS results FROM events GROUP BY ALL), health AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE results > 0) AS responding FROM asked GROUP BY user_id),
found AS (SELECT DISTINCT user_id FROM events WHERE value > 95) SELECT h.user_id, total, responding, responding < total / 2.0 AS degraded, responding > 0 AND f.user_id IS NULL AS empty FROM health h LEFT JOIN found f USING (user_id)""")
def engine_health(spark, sf_dir):
    """Engines by the events of a user: which responded, and whether results came back."""
    events = table(spark, sf_dir, "events")
    engines = events.groupBy("user_id", F.col("event_type").alias("engine")).agg(F.count_if(F.col("value") > 60).alias("results"))
    results = events.where("value > 95").select("user_id", F.col("event_id").cast("string").alias("url"))
    return S.engine_health(engines, results, "user_id")


_TRY = "CASE WHEN page_id % 3 = 0 THEN 'https://www.youtube.com/watch?v=' || page_id ELSE url END"


@family.query(
    f"""WITH tries AS (SELECT page_id, {HOST} AS host, page_id % 3 = 0 AS video, length(html) % 3 <> 0 AS ok FROM pages), text AS (SELECT *, coalesce(sum(ok::INTEGER) OVER (PARTITION BY host, video ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY host, video ORDER BY page_id) AS n, greatest(3 - coalesce(sum(ok::INTEGER) FILTER (WHERE NOT video) OVER (PARTITION BY host), 0), 0) AS missing FROM tries)
SELECT page_id, ok FROM text WHERE CASE WHEN video THEN before < missing AND n <= 2 * missing ELSE before < 3 END"""
)
def early_stop(spark, sf_dir):
    """Attempts of a host until three succeed: texts first, then as many videos as are missing."""
    rows = table(spark, sf_dir, "pages").select("page_id", U.hostname("url").alias("host"), F.expr(_TRY).alias("address"), (F.length("html") % 3 != 0).alias("ok"))
    return S.until_enough(rows, "host", "address", "page_id", "ok", 3).select("page_id", "ok")


@family.query("SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 5")
def search_budget(spark, sf_dir):
    """The searches that a request may make."""
    return S.budgeted(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id")


@family.query(
    """WITH pairs AS (SELECT b.item_id AS item_id, doc_id, list_distinct(regexp_extract_all(lower(b.text), '[^\\s]+')) AS q, list_distinct(regexp_extract_all(lower(d.text), '[^\\s]+')) AS t FROM documents d JOIN benchmark b ON b.item_id = doc_id % 40),
scored AS (SELECT item_id, doc_id, CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, t)) * 1.0 / len(q) END AS score FROM pairs)
SELECT item_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS place FROM scored QUALIFY place <= 10"""
)
def rerank_lexical(spark, sf_dir):
    """Candidates of each benchmark item by a plug-in model: here the share of the item's words that a text has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("item_id"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    return S.rerank(docs.join(items, "item_id"), "item_id", "query", "text", "doc_id", 10).withColumn("score", F.round("score", 9))


@family.query(
    """WITH tries AS (SELECT user_id, event_type <> 'error' AND value > 40 AS ok, event_type || ' ' || event_id AS error, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events QUALIFY n <= 3), folded AS (SELECT user_id, min(n) FILTER (WHERE ok) AS first, max(n) AS every, arg_max(error, n) AS last FROM tries GROUP BY user_id)
SELECT user_id, CASE WHEN first IS NULL THEN 'failed' ELSE 'scraped' END AS status, coalesce(first, every) AS tries, CASE coalesce(first, every) WHEN 1 THEN 0.0 WHEN 2 THEN 2.0 ELSE 7.0 END::DOUBLE AS waited, CASE WHEN first IS NULL THEN last END AS error FROM folded"""
)
def crawl_retries(spark, sf_dir):
    """Pages (here users) tried up to three times, after 2 and 5 seconds; the last error is kept."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("event_type") != "error") & (F.col("value") > 40)).alias("ok"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("error"))
    return A.retried(rows, "user_id", "event_id", "ok", "error")


@family.query("SELECT conv_id, count(*) AS sources, count(*) FILTER (WHERE role = 'user') AS succeeded, count(*) FILTER (WHERE role IS DISTINCT FROM 'user') AS failed, coalesce(sum(length(text)) FILTER (WHERE role = 'user'), 0)::BIGINT AS char_count FROM conversations GROUP BY conv_id")
def session_sums(spark, sf_dir):
    """Sums of the steps of a session: here a conversation's turns, those of its user as successes."""
    return A.session_sums(table(spark, sf_dir, "conversations"), "conv_id", F.length("text"), F.col("role") == "user")


@family.query("SELECT label, count(*) AS docs, greatest(30 - count(*), 0) AS free, round(count(*) * 100.0 / 30, 2) AS full_percent FROM embeddings GROUP BY label")
def index_capacity(spark, sf_dir):
    return A.capacity(table(spark, sf_dir, "embeddings"), "label", 30)


@family.query("SELECT event_id, event_type, row_number() OVER (ORDER BY ts DESC, event_id)::INTEGER AS rank FROM events WHERE event_type IN ('purchase', 'signup') QUALIFY rank <= 50")
def activity_feed(spark, sf_dir):
    """The latest jobs of some kinds, newest first."""
    return A.feed(table(spark, sf_dir, "events"), "ts", "event_id", ["purchase", "signup"], "event_type").select("event_id", "event_type", "rank")
