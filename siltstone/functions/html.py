"""HTML metadata and text by patterns (column expressions); for well-formed pages.

Pages that need a real parser go through ``siltstone.operators.extraction``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.functions.text import strip

_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
SKIPPED = ("script", "style", "nav", "footer", "header")
MAX_TEXT = 10_000


def title(html: Column) -> Column:
    return F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)


def meta(html: Column, name: str, attribute: str = "name") -> Column:
    """Content of a meta tag, whichever attribute comes first; null if there is none."""
    before = F.regexp_extract(html, rf'(?is)<meta\s[^>]*?\b{attribute}=["\']{name}["\'][^>]*?\bcontent=["\']([^"\']*)["\']', 1)
    after = F.regexp_extract(html, rf'(?is)<meta\s[^>]*?\bcontent=["\']([^"\']*)["\'][^>]*?\b{attribute}=["\']{name}["\']', 1)
    return F.coalesce(F.nullif(strip(before), F.lit("")), F.nullif(strip(after), F.lit("")))


def metas(html: Column, prefix: str, attribute: str) -> Column:
    """All tags with content whose name begins with a prefix, as an array of (name, content) in order."""
    tags = F.regexp_extract_all(html, F.lit(rf'(?is)<meta\s[^>]*?\b{attribute}=["\']{prefix}[^"\']+["\'][^>]*?>'), F.lit(0))
    found = F.transform(tags, lambda t: F.struct(strip(F.regexp_extract(t, rf'(?is)\b{attribute}=["\']{prefix}([^"\']+)["\']', 1)).alias("name"), strip(F.regexp_extract(t, r'(?is)\bcontent=["\']([^"\']*)["\']', 1)).alias("content")))
    return F.filter(found, lambda x: x["content"] != "")


def open_graph(html: Column) -> Column:
    """Map of name to all contents, in order."""
    found = metas(html, "og:", "property")
    names = F.array_distinct(F.transform(found, lambda x: x["name"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.transform(F.filter(found, lambda x: x["name"] == n), lambda x: x["content"]))))


def twitter_card(html: Column) -> Column:
    """Map of name to the last content."""
    found = metas(html, "twitter:", "(?:name|property)")
    names = F.array_distinct(F.transform(found, lambda x: x["name"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.element_at(F.filter(found, lambda x: x["name"] == n), -1)["content"])))


def json_ld(html: Column) -> Column:
    """Array of the JSON-LD blocks that parse, as variants."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type=["\']application/ld\+json["\'][^>]*>(.*?)</script>'), F.lit(1))
    return F.filter(F.transform(blocks, lambda b: F.try_parse_json(b)), lambda v: v.isNotNull())


def json_ld_items(html: Column) -> Column:
    """The items of all JSON-LD blocks, out of lists and @graph, that have a type, a name or an address."""
    as_list = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    graphs = lambda v: F.coalesce(F.try_variant_get(v, "$['@graph']", "array<variant>"), F.array(v))
    items = F.flatten(F.transform(F.flatten(F.transform(json_ld(html), as_list)), graphs))
    has = lambda v, path: F.try_variant_get(v, path, "variant").isNotNull()
    return F.filter(items, lambda v: has(v, "$['@type']") | has(v, "$.name") | has(v, "$.url"))


def language(html: Column) -> Column:
    own = F.regexp_extract(html, r'(?is)<html[^>]*\blang="([^"]*)"', 1)
    return F.substring_index(F.when(own != "", own).otherwise(F.coalesce(meta(html, "content-language", "http-equiv"), F.lit(""))), "-", 1)


def canonical(html: Column) -> Column:
    rel_first = F.regexp_extract(html, r'(?is)<link\s[^>]*?\brel=["\']canonical["\'][^>]*?\bhref=["\']([^"\']*)["\']', 1)
    href_first = F.regexp_extract(html, r'(?is)<link\s[^>]*?\bhref=["\']([^"\']*)["\'][^>]*?\brel=["\']canonical["\']', 1)
    return F.coalesce(F.nullif(rel_first, F.lit("")), F.nullif(href_first, F.lit("")))


def standard_meta(html: Column) -> Column:
    """Struct of the usual page metadata; null where a page has none."""
    named = {n: meta(html, n).alias(n) for n in ("description", "author", "viewport", "robots", "generator", "keywords")}
    published, modified = (meta(html, f"article:{n}_time", "property").alias(n) for n in ("published", "modified"))
    return F.struct(canonical(html).alias("canonical"), F.nullif(language(html), F.lit("")).alias("language"), *named.values(), published, modified)


def metadata(html: Column) -> Column:
    return F.struct(json_ld(html).alias("json_ld"), open_graph(html).alias("og"), twitter_card(html).alias("twitter"), standard_meta(html).alias("meta"))


def sections(html: Column, tag: str) -> Column:
    """Contents of all elements of a tag (that don't nest in themselves)."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))


def decoded(text: Column) -> Column:
    for name, char in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def visible_text(html: Column) -> Column:
    """Text outside of scripts, styles, navigation, header and footer: one line per run, no blank lines."""
    names = "|".join(SKIPPED)
    bare = F.regexp_replace(F.regexp_replace(html, rf"(?is)<({names})\b[^>]*>.*?</({names})>", ""), "(?s)<!--.*?-->|<[^>]*>", "\n")
    return F.array_join(F.filter(F.transform(F.split(decoded(bare), "\n"), strip), lambda x: x != ""), "\n")


def structural_text(html: Column) -> Column:
    """Title, meta description and visible text, cut at MAX_TEXT characters."""
    parts = [F.when(title(html) != "", F.concat(F.lit("# "), strip(decoded(title(html))))), F.nullif(strip(meta(html, "description")), F.lit("")), F.nullif(visible_text(html), F.lit(""))]
    return F.substring(F.concat_ws("\n\n", *parts), 1, MAX_TEXT)


def listings(pages: DataFrame, site_col: str, order_col: str, title_col: str = "title", url_col: str = "url") -> DataFrame:
    """(site, listing): a text that lists each site's pages with titles and links."""
    line = F.concat(F.lit("- ["), title_col, F.lit("]("), url_col, F.lit(")"))
    lines = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), line.alias("l"))))
    out = pages.groupBy(site_col).agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("lines"))
    return out.select(site_col, F.concat(F.lit("# "), site_col, F.lit("\n"), "lines").alias("listing"))
