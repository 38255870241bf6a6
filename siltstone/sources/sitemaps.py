"""Sitemaps and robots files as tables."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.functions import urls as U
from siltstone.functions.text import strip

MAX_NESTING = 3
#: Fixed value: user agents whose rules apply.
AGENTS = ("*", "bot")


def decoded(content: bytes | None) -> str:
    """Text of a file that may be gzipped: UTF-8 (with or without a mark), else Latin-1."""
    if not content:
        return ""
    if content[:2] == b"\x1f\x8b":
        try:
            content = gzip.decompress(content)
        except (OSError, EOFError, zlib.error):
            return ""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def _entries(text: str) -> list[tuple[str, bool]]:
    """(address, is an index's child) of a sitemap; nothing for malformed files."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return []
    local = lambda e: e.tag.rpartition("}")[2]
    index = local(root) == "sitemapindex"
    found = [(loc.text or "").strip() for item in root if local(item) in ("url", "sitemap") for loc in item if local(loc) == "loc"]
    return [(x, index) for x in dict.fromkeys(found) if x.startswith(("http://", "https://"))]


def read_sitemaps(files: DataFrame, location_col: str = "location", bytes_col: str = "content") -> DataFrame:
    """(location, pos, loc, is_index) of sitemap files; malformed ones give no rows."""
    kind = pa.list_(pa.struct([("loc", pa.string()), ("is_index", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"loc": a, "is_index": b} for a, b in _entries(decoded(x))] for x in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("location"), pa.array(found, kind)], ["location", "entries"])

    read = files.select(F.col(location_col).alias("location"), F.col(bytes_col).alias("content"))
    out = read.mapInArrow(run, "location string, entries array<struct<loc:string,is_index:boolean>>")
    return out.select("location", F.posexplode("entries").alias("pos", "e")).select("location", "pos", "e.*")


def sitemap_urls(files: DataFrame, roots: DataFrame, limit: int | None = None) -> DataFrame:
    """(root, loc) of all pages reached from root sitemaps; indexes are followed MAX_NESTING levels deep, by joins."""
    entries = read_sitemaps(files)
    frontier = roots.select(F.col("location").alias("root"), "location")
    pages = None
    for _ in range(MAX_NESTING + 1):
        step = frontier.join(entries, "location")
        found = step.where("not is_index").select("root", "loc")
        pages = found if pages is None else pages.unionByName(found)
        frontier = step.where("is_index").select("root", F.col("loc").alias("location")).distinct()
    pages = pages.distinct()
    if limit is None:
        return pages
    return pages.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("loc"))).where(F.col("n") <= limit).drop("n")


def seeds(pages: DataFrame, start: str, max_pages: int, url_col: str = "loc") -> DataFrame:
    """Crawl seeds (url, seq): limited to max_pages - 1, then thin index pages dropped, put before the start page in reverse order."""
    first = pages.orderBy(url_col).limit(max_pages - 1).withColumn("n", F.row_number().over(Window.orderBy(url_col)))
    kept = first.where(~U.is_low_value(url_col)).select(U.normalize_crawl(url_col).alias("url"), (-F.col("n")).cast("long").alias("seq"))
    kept = kept.groupBy("url").agg(F.max("seq").alias("seq"))
    begin = pages.sparkSession.range(1).select(U.normalize_crawl(F.lit(start)).alias("url"), F.lit(0).cast("long").alias("seq"))
    return begin.unionByName(kept.join(begin.select("url"), "url", "left_anti"))


def robots_rules(files: DataFrame, domain_col: str = "domain", text_col: str = "text", agent: str | None = None) -> DataFrame:
    """(domain, rules, crawl_delay, sitemaps): rules are patterns of disallowed paths.

    A user-agent line switches whether the lines after it apply; there are no allow rules and
    no longest match.  The state of a line is the last user-agent line before it.
    """
    lines = files.select(F.col(domain_col).alias("domain"), F.posexplode(F.split(text_col, r"\r\n|\r|\n")).alias("pos", "line")).withColumn("line", strip(F.col("line")))
    lines = lines.where("line <> '' and not startswith(line, '#')")
    name = F.lower(strip(F.substring_index("line", ":", 1)))
    value = strip(F.regexp_replace("line", "^[^:]*:", ""))
    lines = lines.withColumn("name", name).withColumn("value", value)
    names = (*AGENTS, agent.lower()) if agent else AGENTS
    is_agent = F.col("name") == "user-agent"
    before = Window.partitionBy("domain").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("applies", F.last(F.when(is_agent, F.lower("value").isin(*names)), ignorenulls=True).over(before)).where("applies")
    ordered = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("pos", "value")))), lambda x: x["value"])
    delay = F.when(F.col("name") == "crawl-delay", F.col("value").try_cast("double"))
    out = lines.groupBy("domain").agg(ordered((F.col("name") == "disallow") & (F.col("value") != "")).alias("paths"), F.max_by(delay, F.when(delay.isNotNull(), F.col("pos"))).alias("crawl_delay"), ordered(F.col("name") == "sitemap").alias("sitemaps"))
    return out.select("domain", F.transform("paths", robots_pattern).alias("rules"), "crawl_delay", "sitemaps")


def robots_pattern(path: Column) -> Column:
    """A pattern for a disallowed path: * is anything, a final $ the end."""
    quoted = F.regexp_replace(F.regexp_replace(path, r"\$$", ""), r"([.^$+?{}\[\]\\|()\-])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(path.endswith("$"), "$").otherwise(""))


def robots_verdict(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with blocked: whether the rules of the page's host disallow its path (hosts without a file allow all)."""
    path = F.when(U.path(url_col) == "", "/").otherwise(U.path(url_col))
    named = pages.withColumn("_host", U.hostname(url_col)).withColumn("_path", path)
    out = named.join(rules.select(F.col("domain").alias("_host"), "rules"), "_host", "left")
    blocked = F.exists(F.coalesce("rules", F.array().cast("array<string>")), lambda r: F.regexp_like(F.col("_path"), r))
    return out.withColumn("blocked", blocked).drop("_host", "_path", "rules")

