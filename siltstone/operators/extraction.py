"""Extraction that needs an HTML parser: Markdown, sections, images, code."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HIDDEN = {"script", "style", "noscript", "template", "head"}
_BLOCK = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "ul", "ol", "table", "blockquote", "form", "figure", "tr", "body"}
#: Categories of the sectioning elements.
SECTIONS = {"header": "header", "nav": "navigation", "main": "main", "article": "article", "section": "section", "aside": "sidebar", "footer": "footer"}
COMPACT_CHARS = 300


class MarkdownWriter(HTMLParser):
    """Headings, paragraphs, lists, links, emphasis, code and quotes in Markdown; other text as it is."""

    def __init__(self, include: set[str] | None = None, exclude: set[str] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.stack: list[str] = []
        self.open_tags: Counter[str] = Counter()
        self.links: list[tuple[str, int]] = []
        self.lists: list[list] = []
        self.marks: list[int] = []
        self.include, self.exclude = include, exclude
        self.hidden = self.left_out = self.inside = self.pre = 0

    def _open(self) -> bool:
        return not self.hidden and not self.left_out and (self.include is None or self.inside > 0)

    def _put(self, text: str) -> None:
        if self._open():
            self.parts.append(text)

    def handle_starttag(self, tag: str, attrs) -> None:
        kind = SECTIONS.get(tag)
        self.hidden += tag in _HIDDEN
        self.left_out += kind in self.exclude if kind else 0
        self.inside += self.include is not None and kind in self.include if kind else 0
        if tag not in VOID:
            self.stack.append(tag)
            self.open_tags[tag] += 1
        if re.fullmatch("h[1-6]", tag):
            self._put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            if self.lists and self.lists[-1][0] == "ol":
                self.lists[-1][1] += 1
                self._put(f"\n{'  ' * (len(self.lists) - 1)}{self.lists[-1][1]}. ")
            else:
                self._put(f"\n{'  ' * max(0, len(self.lists) - 1)}- ")
        elif tag in ("ul", "ol"):
            self._put("\n\n" if not self.lists else "")
            self.lists.append([tag, 0])
        elif tag == "a":
            self.links.append((dict(attrs).get("href") or "", len(self.parts)))
        elif tag in ("b", "strong"):
            self._begin("**")
        elif tag in ("i", "em"):
            self._begin("*")
        elif tag == "pre":
            self.pre += 1
            self._put("\n\n```\n")
        elif tag == "code" and not self.pre:
            self._put("`")
        elif tag == "br":
            self._put("\n")
        elif tag == "hr":
            self._put("\n\n---\n\n")
        elif tag == "blockquote":
            self._put("\n\n> ")
        elif tag == "img" and dict(attrs).get("src"):
            self._put(f"![{dict(attrs).get('alt') or ''}]({dict(attrs)['src']})")
        elif tag in ("td", "th"):
            self._put(" | ")
        elif tag in _BLOCK:
            self._put("\n\n" if tag != "tr" else "\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or not self.open_tags[tag]:
            return
        while self.stack:
            top = self.stack.pop()
            self.open_tags[top] -= 1
            self._close(top)
            if top == tag:
                break

    def _close(self, tag: str) -> None:
        if re.fullmatch("h[1-6]", tag):
            self._put("\n\n")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self._put("\n\n" if not self.lists else "")
        elif tag == "a" and self.links:
            href, at = self.links.pop()
            label = "".join(self.parts[at:])
            if self._open() and href and label.strip():
                self.parts[at:] = [f"[{' '.join(label.split())}]({href})"]
        elif tag in ("b", "strong"):
            self._finish("**")
        elif tag in ("i", "em"):
            self._finish("*")
        elif tag == "pre":
            self.pre -= 1
            self._put("\n```\n\n")
        elif tag == "code" and not self.pre:
            self._put("`")
        elif tag in _BLOCK and tag not in ("tr", "table"):
            self._put("\n\n")
        kind = SECTIONS.get(tag)
        self.hidden -= tag in _HIDDEN
        self.left_out -= kind in self.exclude if kind else 0
        self.inside -= self.include is not None and kind in self.include if kind else 0

    def handle_data(self, data: str) -> None:
        self._put(data if self.pre else re.sub(r"\s+", " ", data))

    def _begin(self, mark: str) -> None:
        self.marks.append(len(self.parts) if self._open() else -1)
        self._put(mark)

    def _finish(self, mark: str) -> None:
        """The end of an emphasis: before the white space that ends it, and without its beginning if it is empty."""
        first, at = self.marks.pop(), len(self.parts)
        if first < 0:
            return
        while at > first + 1 and self.parts[at - 1].isspace():
            at -= 1
        if at == first + 1:
            del self.parts[first]
        else:
            self.parts.insert(at, mark)

    def text(self) -> str:
        """What was written, without white space at the ends of lines and more than one blank line."""
        lines = [x.strip() if not x.startswith("  ") else x.rstrip() for x in "".join(self.parts).split("\n")]
        return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def to_markdown(html: str | None, include: list[str] | None = None, exclude: list[str] | None = None, verbosity: str = "standard") -> str:
    """Markdown of a page; section categories can be chosen or left out; compact cuts it short."""
    if not html:
        return ""
    page = MarkdownWriter(set(include) if include else None, set(exclude or ()))
    page.feed(html)
    page.close()
    text = page.text()
    return text if verbosity != "compact" or len(text) <= COMPACT_CHARS else text[:COMPACT_CHARS] + "\n..."


class _Media(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.images: list[dict[str, str | None]] = []
        self.code: list[tuple[bool, str]] = []
        self.depth = self.pre = 0
        self.text: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "img":
            self.images.append(dict(attrs))
        self.pre += tag == "pre"
        if tag == "code":
            self.depth += 1
            self.text = []

    def handle_endtag(self, tag):
        if tag == "code" and self.depth:
            self.depth -= 1
            self.code.append((self.pre > 0, "".join(self.text)))
        self.pre -= tag == "pre" and self.pre > 0

    def handle_data(self, data):
        if self.depth:
            self.text.append(data)


def page_media(html: str | None, base_url: str, drop_data_urls: bool = True, max_code: int = 10) -> tuple[list[dict], list[str]]:
    """Images (url, alt, width, height, position from 1) and code blocks (those in pre first, once each)."""
    page = _Media()
    page.feed(html or "")
    number = lambda x: int(x) if x and re.fullmatch(r"[0-9]{1,9}", x.strip()) else None
    images = []
    for a in page.images:
        src = (a.get("src") or "").strip()
        if not src or drop_data_urls and src.startswith("data:"):
            continue
        images.append({"url": urljoin(base_url, src), "alt": a.get("alt") or "", "width": number(a.get("width")), "height": number(a.get("height")), "position": len(images) + 1})
    code = dict.fromkeys(x.strip() for first in (True, False) for inside, x in page.code if inside == first and x.strip())
    return images, list(code)[:max_code]


_IMAGE = pa.struct([("url", pa.string()), ("alt", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("position", pa.int32())])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", include: list[str] | None = None, exclude: list[str] | None = None, verbosity: str = "standard") -> DataFrame:
    """(id, markdown, images, code) of each page, parsed in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            htmls, urls = batch.column("html").to_pylist(), batch.column("url").to_pylist()
            media = [page_media(h, u or "") for h, u in zip(htmls, urls, strict=True)]
            texts = [to_markdown(h, include, exclude, verbosity) for h in htmls]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), pa.array([m[0] for m in media], pa.list_(_IMAGE)), pa.array([m[1] for m in media], pa.list_(pa.string()))], ["id", "markdown", "images", "code"])

    kind = pages.schema[id_col].dataType.simpleString()
    read = pages.select(pages[id_col].alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = read.mapInArrow(run, f"id {kind}, markdown string, images array<struct<url:string,alt:string,width:int,height:int,position:int>>, code array<string>")
    return out.withColumnRenamed("id", id_col)
