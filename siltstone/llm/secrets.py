"""Secret scans by assignment-aware lexing.

Beside three fixed patterns (``BASE``), source and configuration syntax is read
as name-literal pairs: ``name = "x"``, ``"name": "x"``, ``name: x``, ``NAME=x``,
``name := 'x'``, ``name: str = "x"``, ``export NAME=x``.  A value is a sum of
literals and of names assigned before in the same text (``$NAME``, ``${NAME}``, ``name``, ``f"{name}"``),
so constants reach the name under which they are used.  Strings may have prefixes, three quotes, or stand side by side in
brackets; ``key="name" value="x"``, ``name: |`` with indented lines, ``#define NAME "x"``, ``ENV NAME x`` and
``getenv("NAME", "x")`` are pairs too.  Each literal is scored by
the most sensitive name that it reaches and by how random it looks;
literals of 8 characters that score ``THRESHOLD`` or more are spans of kind ``lexed``.

Rows are independent: no shuffle, no state; time and memory follow the longest text, however
its assignments refer to each other.

Defined results: null text is empty and has no spans; ties of spans keep the
order of kinds; repeated rows give equal results; null ids pass through; an empty
table gives no rows; columns beside id and text are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.llm.shared import lean

THRESHOLD = 0.6
KINDS = ("assign", "access", "hex", "lexed")

# Patterns and least lengths that the results must equal.
_NAMES = "password|passwd|secret|token|api_?key"
_ASSIGN = re.compile("(" + re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", _NAMES) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that have 32 or more
_LEAST_VALUE, _LEAST_ACCESS = 8, 16

#: Parts of names, and how sensitive each makes its target.
_SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0, "credential": 1.0, "credentials": 1.0, "pat": 0.7,
    "bearer": 0.9, "auth": 0.6, "authorization": 0.8, "key": 0.6, "private": 0.4, "access": 0.3, "client": 0.2, "api": 0.4, "signing": 0.4, "encryption": 0.4, "master": 0.3, "jwt": 0.8, "cookie": 0.5, "session": 0.4, "salt": 0.5, "dsn": 0.6,
}
#: Parts that, at the end of a name, say that its value only describes a secret.
_HARMLESS = {"id", "name", "url", "uri", "path", "file", "type", "length", "count", "ttl", "expiry", "policy", "hint", "field", "label", "public", "header", "regex", "pattern", "prefix"}
_PLACEHOLDER = re.compile(r"example|changeme|change_me|placeholder|redacted|your[_-]|dummy|x{4,}|\*{3,}|^<.*>$|^\[.*\]$|^\$\{|^%\(", re.I | re.A)

_MARK = re.compile(r":=|=>|={1,3}|:{1,2}|[!<>+*/%&|^-]=")
_ASSIGNS = (":=", "=>", "=", ":")
_OPEN = re.compile(r"""[rRbBuUfF]{0,2}(\"{3}|'{3}|["'`])""")
_REST = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*{q}") for q in "\"'`"}
_WORD = re.compile(r"""\$\{?(?P<ref>[A-Za-z_][A-Za-z0-9_.]*)\}?|(?P<word>[^\s;,#"'`(){}\[\]<>&|+]+(?:\+[^\s;,#"'`(){}\[\]<>&|+]+)*)""")
_INSERTED = re.compile(r"\$?\{([A-Za-z_][A-Za-z0-9_.]*)[^{}\n]*\}")
_PLUS = re.compile(r"[ \t]*+(?:(?:\+|\.\.?|~)[ \t]*+)?+\\?+\n?+[ \t]*+(?=[\"'`$A-Za-z_])")
_NEXT = re.compile(r"\s*+(?:\+\s*+)?+(?=[rRbBuUfF]{0,2}[\"'`])")
_BRACKET = re.compile(r"[(\[]\s*+(?=[rRbBuUfF]{0,2}[\"'`])")
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[+-]?[ \t]*\n")
_QUOTES = frozenset("rRbBuUfF\"'`")
_INDENT = re.compile(r"[ \t]*")
#: Names and values without a mark between them: macros, settings of images, and what a lookup gives where its name is not set.
_DIRECTIVES = re.compile(r"(?m)^[ \t]*(?:#[ \t]*define|ENV|ARG)[ \t]+(?P<name>[A-Za-z_][A-Za-z0-9_]*)[ \t]+(?=[^\s=])")
_LOOKUPS = re.compile(r"""(?:getenv|environ\.get|getProperty|\.get|\benv)(?P<call>\()\s*["'](?P<name>[A-Za-z0-9_.-]+)["']\s*,\s*""")
_ATTRIBUTES = re.compile(r"""\b(?:key|name)\s*=\s*["'](?P<name>[^"'\n]*)["']\s+(?:value|content|default)\s*=\s*(?=["'])""")
#: Characters of names, and those that a name can begin with.
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$.-")
_FIRST = _NAME - frozenset("0123456789.-")
#: Strings put together from parts are spelled out up to this length to look for placeholders across parts; beyond it each part is looked at.
_SPELLED = 256
_CALLS = re.compile(r"[ \t]*+[(\[]")
_ANNOTATION = re.compile(r"[ \t]*+=(?!=)")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    return _short_name_score(name) if len(name) <= _SPELLED else _name_score(name)


@lru_cache(4096)
def _short_name_score(name: str) -> float:
    return _name_score(name)


def _name_score(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts:
        return 0.0
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    score = sum(sorted((_SENSITIVE.get(p, 0.0) for p in [*parts, *joined]), reverse=True)[:2])
    return max(0.0, min(score, 1.0) - 0.7 * (parts[-1] in _HARMLESS))


class _Node:
    """The value of an assignment: its own literals, the values it refers to, and a summary of the string they spell.

    The summary is made when a value refers to this one, or when the score asks for it; what it refers to has its own by then.
    """

    __slots__ = ("source", "literals", "refs", "score", "n", "text", "length", "share", "held")

    def __init__(self, source: str, literals: list[tuple[int, int]], refs: list["_Node"], score: float):
        self.source, self.literals, self.refs, self.score = source, literals, refs, score
        self.n = len(literals)
        for x in refs:
            self.n += x.n
            x.summarise()
        self.n = min(self.n, 2)  # only "more than one" matters
        self.share: dict[str, float] | None = None

    def summarise(self) -> None:
        if self.share is not None:
            return
        texts = [self.source[s:e] for s, e in self.literals]
        parts = [(x, len(x), _shares(x), False) for x in texts] + [(x.text, x.length, x.share, x.held) for x in self.refs]
        self.length = float(min(sum(p[1] for p in parts), 1e15))
        whole = "".join(p[0] for p in parts)
        self.text = whole if len(whole) <= _SPELLED else ""
        self.held = any(p[3] for p in parts) or (not self.text and any(_PLACEHOLDER.search(p[0]) for p in parts))
        if len(parts) == 1:
            self.share = parts[0][2]
        else:
            self.share = {}
            for _, length, share, _ in parts:
                for c, x in share.items():
                    self.share[c] = self.share.get(c, 0.0) + x * length / max(self.length, 1.0)

    def worth(self) -> float:
        """value_score of the whole string, from its summary."""
        self.summarise()
        if self.length < _LEAST_VALUE or self.held or _PLACEHOLDER.search(self.text):
            return 0.0
        return _randomness(self.share)


def _shares(value: str) -> dict[str, float]:
    """Shares of characters; those beyond ASCII are counted under 128 stand-ins, so that no summary grows with the alphabet."""
    counts: Counter[str] = Counter()
    for c, k in Counter(value).items():
        counts[c if c < "\x80" else chr(0x80 + ord(c) % 128)] += k
    return {c: k / len(value) for c, k in counts.items()}


def _kind(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


def _randomness(share: dict[str, float]) -> float:
    bits = -sum(x * math.log2(x) for x in share.values() if x > 0)
    return min(1.0, 0.4 + 0.1 * bits + 0.1 * (len(set(map(_kind, share))) - 1) - 0.4 * (" " in share))


def value_score(value: str) -> float:
    if len(value) < _LEAST_VALUE or _PLACEHOLDER.search(value):
        return 0.0
    return _randomness(_shares(value))


def _target(text: str, at: int) -> str:
    """The name that ends before a mark, at any distance on its line; each character is passed once."""
    while at and text[at - 1] in " \t":
        at -= 1
    while at and text[at - 1] in "\"']":
        at -= 1
    end = at
    while at and text[at - 1] in _NAME:
        at -= 1
    while at < end and text[at] not in _FIRST:
        at += 1
    return text[at:end]


def _string(text: str, at: int) -> tuple[int, int, int, bool] | None:
    """Start and end of the literal of a string at a place, the end of the string, and whether names are inserted into it."""
    m = _OPEN.match(text, at)
    if not m:
        return None
    begin, mark = m.end(), m[1]
    inserts = mark == "`" or "f" in text[at : m.start(1)].lower()
    if len(mark) == 3:
        end = text.find(mark, begin)
        if end >= 0:
            return begin, end, end + 3, inserts
        begin, mark = m.start(1) + 1, mark[0]
    rest = _REST[mark].match(text, begin)
    return (begin, rest.end() - 1, rest.end(), inserts) if rest else None


def _value(text: str, at: int, stop: int, known: dict[str, "_Node"]) -> tuple[list, list, int, bool]:
    """Literals (start, end) and earlier values that make up the value at a place, where it ends, and whether it is one bare word.

    stop: where a bare word ends at the latest.
    """
    found: list = []
    refs: list = []
    more, first = _PLUS, True
    if text[at : at + 1] in ("(", "[") and (m := _BRACKET.match(text, at)):
        more, at = _NEXT, m.end()
    while True:
        if text[at : at + 1] in _QUOTES and (s := _string(text, at)):
            begin, end, at, inserts = s
            for m in _INSERTED.finditer(text, begin, end) if inserts else ():
                found.append((begin, m.start()))
                begin = m.end()
                if m[1] in known:
                    refs.append(known[m[1]])
            found.append((begin, end))
        else:
            m = _WORD.match(text, at, stop)
            if not m:
                return found, refs, at, False
            name = m["ref"] or m["word"]
            at = m.end()
            if not m["ref"] and _CALLS.match(text, at):
                return [], [], at, False  # what a call returns isn't known
            if name in known:
                refs.append(known[name])
            elif m["ref"] is None:
                return ([m.span("word")], [], at, True) if first else (found, refs, at, False)
        first = False
        m = more.match(text, at)
        if not m or more is _PLUS and not m[0].strip(" \t\\\n"):
            return found, refs, at, False
        at = m.end()


def _block(text: str, mark: int, at: int) -> tuple[list, list, int, bool]:
    """The indented lines below a key, as one literal."""
    begin = text.rfind("\n", 0, mark) + 1
    depth, first, end = _INDENT.match(text, begin).end() - begin, None, at
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        inner = _INDENT.match(text, at).end()
        if inner < stop:
            if inner - at <= depth:
                break
            first, end = inner if first is None else first, stop
        at = stop + 1
    return ([] if first is None else [(first, end)]), [], end, False


def _pairs(text: str) -> list[tuple[int, int, str, str]]:
    """Where values stand: (place of the mark, of the value, operator, name of its own), in order."""
    out = [(m.start(), m.end(), m[0], "") for m in _MARK.finditer(text) if m[0] in _ASSIGNS]
    if "define" in text or "ENV" in text or "ARG" in text:
        out += [(m.start("name"), m.end(), "", m["name"]) for m in _DIRECTIVES.finditer(text)]
    if "env" in text or "get" in text:
        out += [(m.start("call"), m.end(), "", m["name"]) for m in _LOOKUPS.finditer(text)]
    return sorted(out)


def lexed(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of the literals that reach a sensitive name.

    Assignments are a graph: a value points at its own literals and at the values of the names in it.
    Every value is read once, as what has been read is passed over; a bare word after a colon ends at the next mark.
    Names only refer back, so one pass from the last assignment to the first pushes the best score of
    the targets down to the literals; no literal is copied, and work is linear in the text.
    """
    known: dict[str, _Node] = {}
    nodes: list[_Node] = []
    marks, calls, done = _pairs(text), {}, 0
    attributes = {m.end(): m["name"] for m in _ATTRIBUTES.finditer(text)} if "value" in text or "content" in text or "default" in text else {}
    for i, (at, start, op, own) in enumerate(marks):
        name = own or _target(text, at)
        if at < done or not name:
            continue
        while start < len(text) and text[start] in " \t":
            start += 1
        stop = marks[i + 1][0] if op == ":" and i + 1 < len(marks) else len(text)
        if stop < start:
            continue
        kind = ""
        if op == ":" and text[start : start + 1] in ("|", ">") and (m := _BLOCK.match(text, start)):
            found, refs, end, bare = _block(text, at, m.end())
        else:
            found, refs, end, bare = _value(text, start, stop, known)
        if op == ":" and bare and (m := _ANNOTATION.match(text, end)):  # name: type = value
            kind, start = text[start:end], m.end()
            while start < len(text) and text[start] in " \t":
                start += 1
            found, refs, end, bare = _value(text, start, len(text), known)
        done = max(done, end)  # what a literal holds is no code
        name = name.lstrip("$")
        if not found and not refs:
            calls[end] = name
            continue
        score = name_score(name)
        for other in (kind, attributes.get(start, ""), calls.get(at, "") if not op else ""):
            if other:
                score = max(score, name_score(other))
        if not score and not found and len(refs) == 1:
            known[name] = refs[0]  # another name for the same value
            continue
        node = known[name] = _Node(text, found, refs, score)
        nodes.append(node)
    alone: dict[int, float] = {}  # by value: the best score of a name that it reaches
    whole: dict[int, float] = {}  # the same, times the score of the whole string under that name
    best: dict[tuple[int, int], float] = {}
    for node in reversed(nodes):
        a = max(alone.get(id(node), 0.0), node.score)
        b = whole.get(id(node), 0.0)
        if node.score and node.n > 1:
            b = max(b, node.score * node.worth())
        if not a:
            continue
        for x in node.refs:
            alone[id(x)], whole[id(x)] = max(alone.get(id(x), 0.0), a), max(whole.get(id(x), 0.0), b)
        for s, e in node.literals:
            worth = max(a * value_score(text[s:e]), b)
            if worth >= THRESHOLD and e - s >= _LEAST_VALUE:
                best[s, e] = max(best.get((s, e), 0.0), worth)
    return [(s, e, round(v, 4)) for (s, e), v in sorted(best.items())]


def scan(text: str) -> list[tuple[int, int, int, int, int, float]]:
    """(start, kind, end, start of value, end of value, score), in order of start, then kind; counted in characters."""
    out = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end(), m.start(2), m.end(2), 1.0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end(), 1.0) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST_ACCESS]
    out += [(m.start(), 2, m.end(), m.start(), m.end(), 1.0) for m in _HEX.finditer(text)]
    if "=" in text or ":" in text:
        out += [(s, 3, e, s, e, v) for s, e, v in lexed(text)]
    return sorted(out)


def redacted(text: str, spans: list[tuple], mark: str) -> str:
    """text with each secret value, and values that overlap taken together, replaced."""
    out, at = [], 0
    for s, e in sorted((x[3], x[4]) for x in spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()), ("value_end", pa.int64()), ("score", pa.float64())])
_SPAN_SQL = "array<struct<kind:string,start:bigint,end:bigint,value_start:bigint,value_end:bigint,score:double>>"


def _found(spans: list[tuple]) -> list[dict]:
    return [{"kind": KINDS[k], "start": s, "end": e, "value_start": a, "value_end": b, "score": v} for s, k, e, a, b, v in spans]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id and spans (kind, start, end, value_start, value_end, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([_found(scan(t.as_py() or "")) for t in texts], pa.list_(_SPAN))], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return read.mapInArrow(lean(run), f"id {kind}, spans {_SPAN_SQL}").withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", length_col: str | None = None) -> DataFrame:
    """docs with the values of all secrets replaced by mark and, if named, the column of lengths taken anew; null texts and other columns stay as they are."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: t if t is None else redacted(t, scan(t), mark))

    clean = F.pandas_udf(lean(run), "string")  # rows themselves stay in the JVM
    out = docs.withColumn(text_col, clean(docs[text_col]))
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col else out


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(out: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "lexed")
    return out.select(id_col, *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
