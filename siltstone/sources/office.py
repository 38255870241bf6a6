"""Text of office files and PDFs: members of a zip container, and the streams of a PDF, read under limits.

Sizes are settled before anything is inflated: a container whose members claim more than ``MAX_INFLATED`` bytes is
refused, and no member or stream is inflated further than that, whatever it claims.  XML with a document type is refused.

docx: paragraphs with headings and list items, tables where they stand.  pptx: slides in order, with tables and notes.
xlsx: one table a sheet, in the workbook's order, with shared and inline strings.  pdf: the text of pages by
their content streams, with fonts' own tables of characters; what is only an image has none.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

from siltstone.sources.markup import table_markdown

MAX_INFLATED = 256 << 20
#: A PDF's nested lists and page trees are followed so deep.
_DEEP = 64


class TooLarge(ValueError):
    """More bytes than may be inflated."""


# containers


class Container:
    """Members of a zip file by name."""

    def __init__(self, content: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except (zipfile.BadZipFile, NotImplementedError) as e:
            raise ValueError(str(e)) from e
        self.names = set(self.zip.namelist())
        if sum(i.file_size for i in self.zip.infolist()) > MAX_INFLATED:
            raise TooLarge("container")
        self.left = MAX_INFLATED

    def read(self, name: str) -> bytes:
        try:
            with self.zip.open(name) as f:
                data = f.read(self.left + 1)
        except (KeyError, RuntimeError, zipfile.BadZipFile, zlib.error, EOFError) as e:
            raise ValueError(f"{name}: {e}") from e
        self.left -= len(data)
        if self.left < 0:
            raise TooLarge(name)
        return data

    def xml(self, name: str) -> ElementTree.Element:
        data = self.read(name)
        if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
            raise ValueError(f"{name}: document types are not read")
        try:
            return ElementTree.fromstring(data)
        except ElementTree.ParseError as e:
            raise ValueError(f"{name}: {e}") from e

    def relations(self, name: str) -> dict[str, tuple[str, str]]:
        """Targets, as names of members, and kinds by id, of what a member refers to."""
        folder, base = posixpath.split(name)
        path = f"{folder}/_rels/{base}.rels"
        if path not in self.names:
            return {}
        return {r.get("Id", ""): (posixpath.normpath(posixpath.join(folder, r.get("Target", ""))).lstrip("/"), r.get("Type", "").rsplit("/", 1)[-1]) for r in self.xml(path)}


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _below(e: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in e.iter() if _local(x) == name)


def _first(e: ElementTree.Element, name: str) -> ElementTree.Element | None:
    return next(_below(e, name), None)


def _said(e: ElementTree.Element) -> str:
    """Text of a paragraph: runs, tabs and breaks."""
    parts = {"t": lambda x: x.text or "", "tab": lambda x: "\t", "br": lambda x: "\n", "cr": lambda x: "\n"}
    return "".join(parts[_local(x)](x) for x in e.iter() if _local(x) in parts).strip()


def _table(e: ElementTree.Element) -> str:
    return table_markdown([[" ".join(filter(None, map(_said, _below(cell, "p")))) for cell in row if _local(cell) == "tc"] for row in e if _local(row) == "tr"])


def docx(content: bytes) -> tuple[str, dict]:
    body = _first(Container(content).xml("word/document.xml"), "body")
    out, listed, paragraphs, tables = [], False, 0, 0
    for x in [] if body is None else body:
        part, item = "", False
        if _local(x) == "tbl":
            tables += 1
            part = _table(x)
        elif _local(x) == "p":
            paragraphs += 1
            part, style = _said(x), _first(x, "pStyle")
            heading = re.fullmatch(r"(?:Heading|heading) ?([1-6])|(Title)", (_attribute(style, "val") if style is not None else None) or "")
            item = bool(part) and not heading and _first(x, "numPr") is not None
            if part and heading:
                part = "#" * (1 if heading[2] else int(heading[1])) + " " + part
            elif item:
                part = "- " + part
        if part:
            out.append(("\n" if item and listed else "\n\n") + part)
            listed = item
    return "".join(out).strip(), {"paragraphs": paragraphs, "tables": tables}


def pptx(content: bytes) -> tuple[str, dict]:
    box = Container(content)
    main = box.relations("ppt/presentation.xml")
    order = [main[i][0] for s in _below(box.xml("ppt/presentation.xml"), "sldId") if (i := _id(s)) in main]
    out = []
    for n, name in enumerate(order, 1):
        parts = [f"## Slide {n}", *_shapes(box.xml(name))]
        notes = [p for target, kind in box.relations(name).values() if kind == "notesSlide" for p in _shapes(box.xml(target))]
        out.append("\n\n".join(parts + (["### Notes", *notes] if notes else [])))
    return "\n\n---\n\n".join(out), {"slides": len(order)}


def _id(e: ElementTree.Element) -> str:
    """The relation that an element names (its other id has no namespace)."""
    return next((v for k, v in e.attrib.items() if k.endswith("}id")), "")


def _shapes(slide: ElementTree.Element) -> list[str]:
    out: list[str] = []
    todo = [slide]
    while todo:
        x = todo.pop()
        if _local(x) == "tbl":
            out.append(_table(x))
        elif _local(x) == "p":
            out.append(_said(x))
        elif not (_local(x) == "sp" and any(_attribute(p, "type") == "sldNum" for p in _below(x, "ph"))):
            todo += reversed(list(x))
    return [x for x in out if x]


def xlsx(content: bytes) -> tuple[str, dict]:
    box = Container(content)
    rel = box.relations("xl/workbook.xml")
    shared = [_said(s) if _first(s, "r") is None else "".join(t.text or "" for t in _below(s, "t")) for s in _below(box.xml("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in box.names else []
    out, sheets = [], [s for s in _below(box.xml("xl/workbook.xml"), "sheet")]
    for s in sheets:
        target = rel.get(_id(s), ("", ""))[0]
        rows = [_cells(r, shared) for r in _below(box.xml(target), "row")] if target in box.names else []
        if any(map(any, rows)):
            out.append(f"### Sheet: {s.get('name')}\n\n{table_markdown(rows)}")
    return "\n\n".join(out), {"sheets": len(sheets)}


def _cells(row: ElementTree.Element, shared: list[str]) -> list[str]:
    out: list[str] = []
    for c in row:
        place = re.match("[A-Z]{1,3}", c.get("r") or "")
        if place:  # cells without a value are left out of a row
            at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(place[0]))) - 1
            out += [""] * (at - len(out))
        v = _first(c, "v")
        value = (v.text or "") if v is not None else ""
        kind = c.get("t")
        if kind == "s":
            value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
        elif kind == "inlineStr":
            value = "".join(t.text or "" for t in _below(c, "t"))
        elif kind == "b":
            value = {"1": "TRUE", "0": "FALSE"}.get(value, value)
        out.append(value)
    return out


# PDF


class Name(str):
    """A PDF name."""


class Word(str):
    """A PDF operator or delimiter."""


class Ref(int):
    """The number of an object that is referred to."""


_SPACES = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)+")
_PIECE = re.compile(rb"<<|>>|[\[\]{}]|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|<[0-9A-Fa-f\s]*>|[+-]?(?:\d+\.?\d*|\.\d+)(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])|[^\x00\t\n\x0c\r ()<>\[\]{}/%]+|.", re.S)
_IN_STRING = re.compile(rb"[^()\\]+|\\(?:[0-7]{1,3}|\r\n|.)|[()]", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
_OBJECT = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+obj\b")


def _pieces(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Names, numbers, strings and words of PDF syntax, and where each ends."""
    while at < len(data):
        if m := _SPACES.match(data, at):
            at = m.end()
            continue
        if data[at : at + 1] == b"(":
            depth, parts, at = 1, [], at + 1
            while depth and (m := _IN_STRING.match(data, at)):
                x, at = m[0], m.end()
                depth += {b"(": 1, b")": -1}.get(x, 0)
                if x[:1] == b"\\":
                    x = _ESCAPES.get(x[1:], bytes([int(x[1:], 8) & 255]) if x[1:2].isdigit() and x[1:2] < b"8" else x[1:])
                if depth:
                    parts.append(x)
            if depth:
                return
            yield b"".join(parts), at
            continue
        m = _PIECE.match(data, at)
        x, at = m[0], m.end()
        if x[:1] == b"/":
            yield Name(re.sub("#([0-9A-Fa-f]{2})", lambda h: chr(int(h[1], 16)), x[1:].decode("latin-1"))), at
        elif x[:1] == b"<" and x != b"<<":
            digits = re.sub(rb"\s", b"", x[1:-1])
            yield bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()) if x[-1:] == b">" else Word("<"), at
        elif x[:1].isdigit() or x[:1] in b"+-." and re.fullmatch(rb"[+-]?[\d.]+", x):
            yield (float(x) if b"." in x else int(x)) if re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)", x) else 0, at
        else:
            yield Word(x.decode("latin-1")), at


def _value(data: bytes, at: int = 0) -> tuple[object, int]:
    """The first object of PDF syntax at a place, and where it ends."""
    stack: list[list] = [[]]
    marks: list[str] = []
    for x, at in _pieces(data, at):
        if x in ("[", "<<") and isinstance(x, Word):
            stack.append([])
            marks.append(x)
            if len(stack) > _DEEP:
                raise ValueError("too deep")
            continue
        if isinstance(x, Word) and x in ("]", ">>"):
            if not marks:
                break
            inner, mark = stack.pop(), marks.pop()
            x = inner if mark == "[" else {k: v for k, v in zip(inner[::2], inner[1::2], strict=False) if isinstance(k, Name)}
        elif isinstance(x, Word) and x == "R" and len(stack[-1]) > 1 and isinstance(stack[-1][-2], int):
            x = Ref(stack[-1][-2])
            del stack[-1][-2:]
        elif isinstance(x, Word):
            if x not in ("true", "false", "null"):
                break
            x = {"true": True, "false": False, "null": None}[x]
        stack[-1].append(x)
        if not marks and not isinstance(x, int):
            break
    return (stack[0][0] if stack[0] else None), at


class Pdf:
    """Objects of a PDF: dictionaries, and streams beside them."""

    def __init__(self, data: bytes):
        if not data.lstrip()[:5] == b"%PDF-":
            raise ValueError("no PDF")
        self.left, self.objects, self.streams = MAX_INFLATED, {}, {}
        at, trailers = 0, []
        while m := _OBJECT.search(data, at):
            number = int(m[1])
            self.objects[number], at = _value(data, m.end())
            at = max(at, m.end())
            begin = re.compile(rb"\s*stream\r?\n").match(data, at) or re.compile(rb"stream\r?\n").match(data, max(at - 8, 0))
            if begin and isinstance(self.objects[number], dict):
                size = self.objects[number].get("Length")
                end = begin.end() + size if type(size) is int and data[begin.end() + size : begin.end() + size + 20].lstrip().startswith(b"endstream") else data.find(b"endstream", begin.end())
                end = len(data) if end < 0 else end
                self.streams[number], at = data[begin.end() : end], end
        for m in re.finditer(rb"trailer", data):
            trailers.append(_value(data, m.end())[0])
        kinds = lambda k: [o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == k]
        trailers = [t for t in [*trailers, *kinds("XRef")] if isinstance(t, dict)]
        if any("Encrypt" in t for t in trailers):
            raise ValueError("encrypted")
        for number in [n for n, o in self.objects.items() if isinstance(o, dict) and o.get("Type") == "ObjStm"]:
            self._unpack(number)
        roots = [self.get(t["Root"]) for t in trailers if "Root" in t] + kinds("Catalog")
        self.root = next((r for r in roots if isinstance(r, dict) and "Pages" in r), None)
        if self.root is None:
            raise ValueError("no pages")

    def get(self, x: object) -> object:
        for _ in range(_DEEP):
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(int(x))
        return None

    def stream(self, x: object) -> bytes:
        """The bytes of a stream, inflated; none for filters that hold no text."""
        about = self.get(x)
        if not isinstance(x, Ref) or not isinstance(about, dict):
            return b""
        data = self.streams.get(int(x), b"")
        filters = self.get(about.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if f != "FlateDecode":
                return b""
            inflate = zlib.decompressobj()
            try:
                data = inflate.decompress(data, self.left + 1)
            except zlib.error as e:
                raise ValueError(str(e)) from e
            self.left -= len(data)
            if self.left < 0:
                raise TooLarge("stream")
        return data

    def _unpack(self, number: int) -> None:
        about, data = self.objects[number], self.stream(Ref(number))
        first = about.get("First")
        if type(first) is not int or "Predictor" in str(about.get("DecodeParms")):
            return
        places = [x for x, _ in _pieces(data[:first]) if type(x) is int]
        for n, at in zip(places[::2], places[1::2], strict=False):
            self.objects.setdefault(n, _value(data, first + at)[0])

    def pages(self) -> list[dict]:
        """Pages in order, with what they inherit."""
        out, seen, todo = [], set(), [(self.root["Pages"], {})]
        while todo:
            ref, inherited = todo.pop()
            page = self.get(ref)
            if not isinstance(page, dict) or id(page) in seen:
                continue
            seen.add(id(page))
            inherited = inherited | {k: page[k] for k in ("Resources",) if k in page}
            kids = self.get(page.get("Kids"))
            if isinstance(kids, list):
                todo += [(k, inherited) for k in reversed(kids)]
            else:
                out.append(inherited | page)
        return out

    def fonts(self, page: dict) -> dict[str, tuple[int, dict[int, str]]]:
        """Bytes of a code, and characters by code, of a page's fonts."""
        resources = self.get(page.get("Resources"))
        named = self.get(resources.get("Font")) if isinstance(resources, dict) else None
        out = {}
        for name, ref in named.items() if isinstance(named, dict) else ():
            font = self.get(ref)
            if isinstance(font, dict):
                out[name] = (2 if font.get("Subtype") == "Type0" else 1, _characters(self.stream(font.get("ToUnicode"))))
        return out


def _characters(table: bytes) -> dict[int, str]:
    """Characters by code, of a font's own table."""
    out: dict[int, str] = {}
    held: list = []
    text = lambda b: b.decode("utf-16-be", "replace") if len(b) > 1 else b.decode("latin-1")
    code = lambda b: int.from_bytes(b, "big")
    for x, _ in _pieces(table):
        if not isinstance(x, Word):
            held.append(x)
        elif x == "[" or x == "]":
            held.append(x)
        else:
            if x == "endbfchar":
                strings = [h for h in held if type(h) is bytes]
                out.update((code(a), text(b)) for a, b in zip(strings[::2], strings[1::2], strict=False))
            elif x == "endbfrange":
                i = 0
                while i + 2 < len(held):
                    low, high, to = held[i : i + 3]
                    i += 3
                    if type(low) is not bytes or type(high) is not bytes:
                        continue
                    span = min(code(high) - code(low), 0xFFFF)
                    if type(to) is bytes and to:
                        out.update((code(low) + k, text((code(to) + k).to_bytes(len(to) + 1, "big")[1:])) for k in range(span + 1))
                    elif to == "[":
                        end = held.index("]", i) if "]" in held[i:] else len(held)
                        out.update((code(low) + k, text(s)) for k, s in enumerate(held[i:end]) if type(s) is bytes)
                        i = end + 1
            held = []
    return out


def _shown(data: bytes, fonts: dict[str, tuple[int, dict[int, str]]]) -> str:
    """Text that a content stream shows, a line for each move of the line."""
    out: list[str] = []
    held: list = []
    lists: list[list] = []
    width, table = 1, {}

    def put(raw: object) -> None:
        if type(raw) is bytes:
            codes = [int.from_bytes(raw[i : i + width], "big") for i in range(0, len(raw), width)]
            out.append("".join(table.get(c) or (bytes([c]).decode("cp1252", "replace") if width == 1 else "") for c in codes))

    for x, _ in _pieces(data):
        if not isinstance(x, Word):
            (lists[-1] if lists else held).append(x)
        elif x == "[":
            lists.append([])
        elif x == "]":
            if lists:
                held.append(lists.pop())
        else:
            if x == "Tf" and len(held) > 1:
                width, table = fonts.get(str(held[-2]), (1, {}))
            elif x == "Tj" and held:
                put(held[-1])
            elif x in ("'", '"') and held:
                out.append("\n")
                put(held[-1])
            elif x == "TJ" and held and isinstance(held[-1], list):
                for part in held[-1]:
                    if isinstance(part, (int, float)) and part < -200:
                        out.append(" ")  # a gap as wide as a blank
                    put(part)
            elif x in ("Td", "TD") and len(held) > 1:
                out.append("\n" if held[-1] else " ")
            elif x in ("T*", "Tm", "ET"):
                out.append("\n")
            held = []
    lines = [" ".join(line.split()) for line in "".join(out).split("\n")]
    return "\n".join(line for line in lines if line)


def pdf(content: bytes) -> tuple[str, dict]:
    file = Pdf(content)
    pages = file.pages()
    texts = []
    for page in pages:
        parts = file.get(page.get("Contents"))
        refs = parts if isinstance(parts, list) else [page.get("Contents")]
        texts.append(_shown(b"\n".join(file.stream(r) for r in refs), file.fonts(page)))
    return "\n\n".join(t for t in texts if t), {"pages": len(pages)}
