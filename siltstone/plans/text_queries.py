"""Quality, barriers, metadata and clean-up of texts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import html as H
from siltstone.functions import text as T
from siltstone.functions import urls as U
from siltstone.operators.main_content import main_content
from siltstone.plans.registry import Family, sql_any, sql_list, table
from siltstone.plans.url_queries import HOST, S, N

family = Family()

_SPACE = "\\s"
_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_LINES = f"list_filter(list_transform(string_split({_STRIP.format(x='text')}, chr(10)), lambda x: {_STRIP.format(x='x')}), lambda x: x <> '')"
_LINKED = "regexp_matches(x, '\\[.*?\\]\\(.*?\\)')"
_COUNTS = f"SELECT doc_id, text, {_STRIP.format(x='text')} AS t, len({_LINES}) AS n_lines, len(list_filter({_LINES}, lambda x: {_LINKED})) AS links, len(list_filter({_LINES}, lambda x: length(x) > 60 AND NOT {_LINKED})) AS solid FROM documents"
_BOILER = "CASE WHEN t = '' THEN 0 WHEN links * 1.0 / n_lines > 0.7 AND solid < 2 THEN 20 WHEN links * 1.0 / n_lines > 0.5 AND solid < 2 THEN 40 WHEN solid >= 5 THEN 100 WHEN solid >= 3 THEN 85 WHEN solid >= 1 THEN 60 ELSE 30 END"
_BOILER_STATUS = "CASE {x} WHEN 100 THEN 'pass' WHEN 85 THEN 'pass' WHEN 60 THEN 'warn' WHEN 40 THEN 'warn' ELSE 'fail' END"
_PARAS = "len(list_filter(string_split(t, chr(10) || chr(10)), lambda p: regexp_replace(p, '\\s', '', 'g') <> '')) >= 2"
_COMPLETE = f"CASE WHEN t = '' THEN 0 WHEN length(t) < 200 AND NOT ({_PARAS}) THEN 10 WHEN length(t) < 200 THEN 30 WHEN NOT ({_PARAS}) THEN 40 WHEN length(t) >= 1000 THEN 100 WHEN length(t) >= 500 THEN 85 ELSE 60 END"
_COMPLETE_STATUS = "CASE {x} WHEN 100 THEN 'pass' WHEN 85 THEN 'pass' WHEN 0 THEN 'fail' WHEN 10 THEN 'fail' ELSE 'warn' END"
_HITS = " + ".join("CAST(regexp_matches(lower(text), '{}') AS INTEGER)".format(p.replace("'", "''")) for p in T.BLOCK_PATTERNS)
_ERRORS = " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in T.ERROR_WORDS)
_BLOCK = f"CASE WHEN t = '' THEN 0 WHEN hits >= 3 THEN 5 WHEN hits = 2 THEN 15 WHEN hits = 1 THEN 30 WHEN length(t) < 200 AND {_ERRORS} >= 2 THEN 20 ELSE 100 END"
_BLOCK_STATUS = "CASE {x} WHEN 100 THEN 'pass' WHEN 30 THEN 'warn' ELSE 'fail' END"
_QUALITY = f"""WITH counts AS ({_COUNTS}), hit AS (SELECT *, {_HITS} AS hits FROM counts), scored AS (SELECT *, {_BOILER} AS b, {_COMPLETE} AS c, {_BLOCK} AS k FROM hit),
judged AS (SELECT doc_id, floor((30 * b + 30 * c + 40 * k + 50) / 100.0) / 100 AS score, {_BOILER_STATUS.format(x='b')} AS boilerplate, {_COMPLETE_STATUS.format(x='c')} AS completeness, {_BLOCK_STATUS.format(x='k')} AS block_detected, b, c, k, hits FROM scored)"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@family.query(f"{_QUALITY} SELECT doc_id, b AS hundredths, boilerplate AS status FROM judged")
def quality_boilerplate(spark, sf_dir):
    return _docs(spark, sf_dir).withColumn("v", T.boilerplate(F.col("text"))).select("doc_id", "v.hundredths", "v.status")


@family.query(f"{_QUALITY} SELECT doc_id, c AS hundredths, completeness AS status FROM judged")
def quality_completeness(spark, sf_dir):
    return _docs(spark, sf_dir).withColumn("v", T.completeness(F.col("text"))).select("doc_id", "v.hundredths", "v.status")


@family.query(f"{_QUALITY} SELECT doc_id, hits, k AS hundredths, block_detected AS status FROM judged")
def quality_block(spark, sf_dir):
    return _docs(spark, sf_dir).withColumn("v", T.block_page(F.col("text"))).select("doc_id", T.block_matches(F.col("text")).alias("hits"), "v.hundredths", "v.status")


@family.query(
    f"""{_QUALITY} SELECT doc_id, score, boilerplate, completeness, block_detected, CASE WHEN boilerplate = 'pass' AND completeness = 'pass' AND block_detected = 'pass' THEN 'all checks passed' ELSE
 concat_ws(', ', CASE WHEN boilerplate <> 'pass' THEN 'boilerplate:' || boilerplate END, CASE WHEN completeness <> 'pass' THEN 'completeness:' || completeness END, CASE WHEN block_detected <> 'pass' THEN 'block:' || block_detected END) END AS detail FROM judged"""
)
def quality_composite(spark, sf_dir):
    return _docs(spark, sf_dir).withColumn("q", T.quality(F.col("text"))).select("doc_id", "q.score", "q.checks.*", "q.detail")


@family.query(
    f"""{_QUALITY}, candidates AS (SELECT d.source, j.doc_id, j.score, j.score >= 0.3 AND d.doc_id % 5 <> 0 AS accepted, d.doc_id % 7 AS tier FROM judged j JOIN documents d USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY accepted DESC, CASE WHEN accepted THEN tier ELSE 0 END, score DESC, doc_id) AS n FROM candidates)
SELECT source, doc_id, score, accepted FROM placed WHERE n = 1"""
)
def quality_gate_best(spark, sf_dir):
    """Best candidate of each group: the earliest acceptable tier, else the highest score."""
    rows = _docs(spark, sf_dir).withColumn("score", T.quality(F.col("text"))["score"]).withColumn("accepted", (F.col("score") >= T.MIN_QUALITY) & (F.col("doc_id") % 5 != 0)).withColumn("tier", F.col("doc_id") % 7)
    rank = F.struct(F.when(F.col("accepted"), 0).otherwise(1), F.when(F.col("accepted"), F.col("tier")).otherwise(F.lit(0)), -F.col("score"), "doc_id")
    return rows.groupBy("source").agg(F.min_by(F.struct("doc_id", "score", "accepted"), rank).alias("best")).select("source", "best.*")


_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
_LOWS = {name: f"lower({x})" for name, x in (("title", _TITLE), ("url", "url"), ("html", "html"))}
_SIGNS = f"""list_filter([CASE WHEN length(html) < 100 THEN 'empty' END, CASE WHEN {sql_any(_LOWS['title'], [x.lower() for x in T.CLOUDFLARE] + ['attention required', '403 forbidden'])} THEN 'cloudflare-title' END,
 CASE WHEN {sql_any('lower(url)', ['cf_chl', 'challenge-platform'])} THEN 'cloudflare-url' END, CASE WHEN {sql_any(_LOWS['title'], [x.lower() for x in T.DDOS_GUARD])} THEN 'ddos-guard-title' END, CASE WHEN contains(lower(url), 'ddos-guard') THEN 'ddos-guard-url' END,
 CASE WHEN {sql_any('lower(html)', ['rate limit', 'too many requests'])} THEN 'rate-limit' END, CASE WHEN {sql_any('lower(url)', T.FRAME_REDIRECTS)} OR {sql_any('lower(html)', T.FRAME_REDIRECTS)} THEN 'substack-redirect' END], lambda s: s IS NOT NULL)"""


@family.query(
    f"""WITH signs AS (SELECT page_id, CASE WHEN len({_SIGNS}) = 0 AND {sql_any('lower(html)', [x.lower() for x in T.CLOUDFLARE + T.DDOS_GUARD + T.FRAME_REDIRECTS])} THEN ['content-match'] ELSE {_SIGNS} END AS s FROM pages)
SELECT page_id, len(s) > 0 AS detected, CASE WHEN len(s) = 0 THEN 0.0 ELSE least(50 + 20 * len(s), 95) / 100.0 END AS confidence, CASE WHEN len(s) = 0 THEN 'No barrier signals detected' ELSE 'Matched signals: ' || array_to_string(list_sort(s), ', ') END AS detail FROM signs"""
)
def barrier_classify(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("title", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1))
    return pages.withColumn("b", T.barrier(F.col("title"), F.col("url"), F.col("html"), F.col("html"))).select("page_id", "b.detected", "b.confidence", "b.detail")


@family.query(
    f"""WITH lines AS (SELECT doc_id, list_transform(string_split(substr({_STRIP.format(x='text')}, 1, 2000), chr(10)), lambda x: {_STRIP.format(x='x')}) AS l FROM documents)
SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(x, '^#{{1,3}} '))) + len(list_filter(l, lambda x: regexp_matches(x, '^[-*] '))) + len(list_filter(l, lambda x: starts_with(x, '```'))) + len(list_filter(l, lambda x: regexp_matches(x, '^\\[.+\\]\\(.+\\)'))) >= 3 AS markdown FROM lines"""
)
def markdown_heuristic(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.looks_like_markdown(F.col("text")).alias("markdown"))


@family.query(f"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length({_STRIP.format(x='lower(x)')}) < 30 OR {sql_any('lower(x)', T.BOILERPLATE)})) AS boilerplate_lines, len(string_split(text, chr(10))) AS n_lines FROM documents")
def boilerplate_lines(spark, sf_dir):
    lines = F.split("text", "\n")
    return _docs(spark, sf_dir).select("doc_id", F.size(F.filter(lines, T.is_boilerplate_line)).cast("long").alias("boilerplate_lines"), F.size(lines).cast("long").alias("n_lines"))


_RE2 = [(p.replace("'", "''"), to.replace("$1", "\\1")) for p, to in T.REDACTIONS]


def _sql_redacted(x: str) -> str:
    for p, to in _RE2:
        x = f"regexp_replace({x}, '{p}', '{to}', 'g')"
    return x


_SALTED = "text || ' ?token=' || md5(text) || '&x=1 Bearer ' || md5(text) || ' sk-' || md5(text) || ' PASSWORD: ' || doc_id"


@family.query(f"SELECT doc_id, {_sql_redacted(_SALTED)} AS redacted FROM documents")
def redact_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.redact(F.expr(_SALTED)).alias("redacted"))


@family.query("SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '[^a-z0-9\\s-]', '', 'g'), '[\\s-]+', '-', 'g'), '^-|-$', '', 'g'), 1, 60), '-+$', '') AS slug FROM documents")
def slugify(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.slugify(F.col("text")).alias("slug"))


@family.query("SELECT lang, count(*) AS docs, sum(length(text)) AS chars, sum(strlen(text)) AS bytes, sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS words FROM documents GROUP BY lang")
def word_counts(spark, sf_dir):
    n = lambda c: F.sum(c.cast("long"))
    return _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("docs"), n(F.length("text")).alias("chars"), n(F.octet_length("text")).alias("bytes"), n(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("words"))


_DESC = f"""WITH lines AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format(x='x')}) AS l FROM documents),
good AS (SELECT doc_id, text, list_filter(l, lambda x: x <> '' AND NOT regexp_matches(x, '^[#!\\[>]') AND length(x) >= 30 AND NOT {sql_any('lower(x)', T.BOILERPLATE)}) AS g, list_filter(l, lambda x: length(x) >= 30 AND NOT regexp_matches(x, '^[#!]')) AS f FROM lines),
chosen AS (SELECT doc_id, text, CASE WHEN len(g) > 0 THEN g ELSE f[1:1] END AS c FROM good),
grown AS (SELECT doc_id, text, CASE WHEN len(c) = 0 THEN '' ELSE list_reduce(c, lambda a, x, i: CASE WHEN length(a) < 100 OR (length(a) = 100 AND i <= 2) THEN a || ' ' || x ELSE a END) END AS d FROM chosen)
SELECT doc_id, CASE WHEN text = '' THEN '' WHEN d = '' THEN {_STRIP.format(x='substr(text, 1, 300)')} WHEN regexp_matches(substr(d, 101), '[.!?](?:\\s|$)') THEN substr(d, 1, 100) || regexp_extract(substr(d, 101), '(?s)^(.*?[.!?])(?:\\s|$)', 1) WHEN length(d) > 300 THEN regexp_replace(substr(d, 1, 300), '\\s+$', '') || '...' ELSE d END AS description FROM grown"""


@family.query(_DESC)
def description_extract(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.description(F.col("text")).alias("description"))


@family.query(f"SELECT page_id, {_TITLE} AS title, regexp_extract(regexp_extract(html, '(?is)<html[^>]*\\blang=\"([^\"]*)\"', 1), '^[^-]*') AS language FROM pages")
def page_language(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.title(F.col("html")).alias("title"), H.language(F.col("html")).alias("language"))


_CLEAN = "regexp_replace(regexp_replace(html, '(?is)<(script|style|nav|footer|header)\\b[^>]*>.*?</(script|style|nav|footer|header)>', '', 'g'), '(?s)<!--.*?-->|<[^>]*>', chr(10), 'g')"


@family.query(
    f"""WITH body AS (SELECT page_id, {_TITLE} AS title, {_CLEAN} AS raw FROM pages), decoded AS (SELECT page_id, title, replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS raw FROM body)
SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, array_to_string(list_filter(list_transform(string_split(raw, chr(10)), lambda x: {_STRIP.format(x='x')}), lambda x: x <> ''), chr(10)) AS t FROM decoded)"""
)
def page_structural_text(spark, sf_dir):
    text = H.visible_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("text_md5"))


_ENTITIES = ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "\'\'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")


def _sql_decoded(x: str) -> str:
    for name, char in _ENTITIES:
        x = f"replace({x}, '{name}', '{char}')"
    return x


_ARTICLE = "regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|<footer>|$)', 1), '\\s+', ' ', 'g')"
_BREAK = "chr(10) || chr(10)"
_MARKED = f"regexp_replace(regexp_replace({_ARTICLE}, '<p><b>([^<]*)<br>', {_BREAK} || '**\\1**' || {_BREAK}, 'g'), '<h1>([^<]*)</h1>', {_BREAK} || '# \\1' || {_BREAK}, 'g')"
_LINES_OF = "array_to_string(list_transform(string_split({x}, chr(10)), lambda x: " + _STRIP.format(x="x") + "), chr(10))"


@family.query(
    f"""WITH body AS (SELECT page_id, html, {_sql_decoded(f"regexp_replace({_MARKED}, '</?[a-z]+>', {_BREAK}, 'g')")} AS md FROM pages),
tidy AS (SELECT page_id, {_STRIP.format(x=f"regexp_replace({_LINES_OF.format(x='md')}, '{chr(10)}{{3,}}', {_BREAK}, 'g')")} AS md, {_STRIP.format(x=_sql_decoded(_TITLE))} AS title, {_sql_decoded(_CLEAN)} AS raw FROM body)
SELECT page_id, CASE WHEN length(md) >= 50 THEN 'main' ELSE 'structural' END AS how, CASE WHEN length(md) >= 50 THEN md ELSE substr(concat_ws({_BREAK}, nullif('# ' || title, '# '), nullif(array_to_string(list_filter(list_transform(string_split(raw, chr(10)), lambda x: {_STRIP.format(x='x')}), lambda x: x <> ''), chr(10)), '')), 1, 10000) END AS markdown FROM tidy"""
)
def page_main_content(spark, sf_dir):
    """Main content by scores.  The SQL takes the article by its tag, which is where scores must lead on these pages."""
    return main_content(table(spark, sf_dir, "pages"))


@family.query("SELECT page_id, len(regexp_extract_all(html, '(?is)<nav\\b[^>]*>.*?</nav>')) AS navs, len(regexp_extract_all(html, '(?is)<footer\\b[^>]*>.*?</footer>')) AS footers, len(regexp_extract_all(html, '(?is)<article\\b[^>]*>.*?</article>')) AS articles, md5(regexp_extract(html, '(?is)<nav\\b[^>]*>(.*?)</nav>', 1)) AS nav_md5 FROM pages")
def page_sections(spark, sf_dir):
    page = F.col("html")
    count = lambda tag: F.size(H.sections(page, tag)).cast("long")
    first = F.coalesce(F.get(H.sections(page, "nav"), 0), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", count("nav").alias("navs"), count("footer").alias("footers"), count("article").alias("articles"), F.md5(first).alias("nav_md5"))


@family.query(f"SELECT host, '# ' || host || chr(10) || string_agg('- [' || title || '](' || url || ')', chr(10) ORDER BY page_id) AS listing FROM (SELECT page_id, url, {HOST} AS host, {_TITLE} AS title FROM pages) GROUP BY host")
def page_llmstxt(spark, sf_dir):
    """A listing of each site's pages, in order of page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", U.hostname("url").alias("host"), H.title(F.col("html")).alias("title"))
    return H.listings(pages, "host", "page_id")


@family.query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_MSG = "CASE event_id % 9 WHEN 0 THEN 'Name or service not known' WHEN 1 THEN 'Connection refused by peer' WHEN 2 THEN 'HTTP 503' WHEN 3 THEN 'status code 404' WHEN 4 THEN 'request timed out' WHEN 5 THEN 'connection timed out' WHEN 6 THEN 'parse failure' WHEN 7 THEN 'TIMEOUT reached' ELSE event_type END"
_CODE = "CASE WHEN event_id % 11 = 0 THEN 'AUTH_ERROR' WHEN event_id % 13 = 0 THEN 'CAPTCHA_UNRESOLVED' ELSE '' END"


@family.query(f"SELECT event_id, CASE {' '.join(f'''WHEN {_CODE} = '{c}' THEN '{k}' ''' for c, k in T.ERROR_CODES.items())} {' '.join(f'''WHEN {sql_any(f'lower({_MSG})', parts)} THEN '{k}' ''' for k, parts in T.ERROR_KINDS)} ELSE 'scrape_error' END AS error_type FROM events")
def error_classify(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.error_type(F.expr(_MSG), F.expr(_CODE)).alias("error_type"))


@family.query("SELECT doc_id, source || ' ' || CASE WHEN contains(text, chr(10) || chr(10)) THEN split_part(text, chr(10) || chr(10), 1) ELSE substr(text, 1, 500) END AS search FROM documents")
def keyword_query(spark, sf_dir):
    """Title (here the source) and whole first paragraph; 500 characters are the operator's own limit for texts without paragraphs."""
    return _docs(spark, sf_dir).select("doc_id", T.keyword_query(F.col("source"), F.col("text")).alias("search"))


@family.query("SELECT doc_id, regexp_extract(substr(text, 1, 120), '^(?s)(.*) ', 1) AS highlight FROM documents WHERE length(text) > 120")
def highlight_trim(spark, sf_dir):
    """Highlights cut at a word's edge."""
    return _docs(spark, sf_dir).where(F.length("text") > 120).select("doc_id", F.regexp_extract(F.substring("text", 1, 120), "(?s)^(.*) ", 1).alias("highlight"))
