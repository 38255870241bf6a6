"""Links of pages: extraction from HTML, classification, site maps, numbering."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from siltstone.functions import urls as U


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.base: str | None = None
        self.hrefs: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("a", "base"):
            href = next((v for k, v in attrs if k == "href"), None)
            if tag == "a" and href is not None:
                self.hrefs.append(href)
            elif tag == "base" and href and self.base is None:
                self.base = href


def extract_links(html: str | None, base_url: str) -> list[str]:
    """Absolute links of a page in order, once each: a <base> applies, fragments go, other schemes than http(s) are left out."""
    if not html:
        return []
    page = _Anchors()
    page.feed(html)
    base = urljoin(base_url, page.base) if page.base else base_url
    out: dict[str, None] = {}
    for href in page.hrefs:
        href = href.strip()
        if not href or href.startswith("#"):
            continue
        try:
            link = urljoin(base, href)
            scheme = urlsplit(link).scheme
        except ValueError:
            continue
        if scheme in ("http", "https", ""):
            out.setdefault(link.split("#", 1)[0])
    return [x for x in out if x]


def page_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., link, position): one row per distinct link of each page.  HTML is parsed in Arrow batches, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [extract_links(h, u or "") for h, u in zip(batch.column("_html").to_pylist(), batch.column("_url").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(links, pa.list_(pa.string()))], [*names, "_links"])

    names = [id_col, *keep]
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in names)
    read = pages.select(*[pages[c] for c in names], pages[url_col].alias("_url"), pages[html_col].alias("_html"))
    out = read.mapInArrow(run, f"{kinds}, _links array<string>")
    return out.select(*names, F.posexplode("_links").alias("position", "link")).withColumn("position", F.col("position") + 1)


def classified(links: DataFrame, link_col: str = "link", base_col: str = "url") -> DataFrame:
    return links.withColumn("kind", U.link_class(link_col, U.hostname(base_col)))


def site_map(pages: DataFrame, limit: int, search: str | None = None, allow_subdomains: bool = False, allow_external: bool = False, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Links in scope of each page; the limit comes before the search, so fewer than limit may remain."""
    edges = page_links(pages, id_col, url_col, keep=(url_col,) if url_col != id_col else ())
    edges = edges.where(U.in_scope("link", U.hostname(url_col), allow_subdomains, allow_external))
    first = edges.withColumn("n", F.row_number().over(Window.partitionBy(id_col).orderBy("position"))).where(F.col("n") <= limit)
    return (first.where(F.lower("link").contains(search.lower())) if search else first).select(id_col, "link")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Numbers from 1 over a bounded result (after a limit); not for whole tables."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
