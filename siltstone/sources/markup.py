"""Markdown that several parsers write."""

from __future__ import annotations


def table_markdown(rows: list[list[str]]) -> str:
    """A Markdown table whose first row is the header; cells are padded to their column."""
    width = max((len(r) for r in rows), default=0)
    full = [[str(c).replace("|", "\\|").replace("\n", " ") for c in r] + [""] * (width - len(r)) for r in rows]
    sizes = [max([3, *(len(r[i]) for r in full)]) for i in range(width)]
    line = lambda r: "| " + " | ".join(c.ljust(n) for c, n in zip(r, sizes, strict=True)) + " |"
    return "\n".join([line(full[0]), "|" + "|".join("-" * (n + 2) for n in sizes) + "|", *map(line, full[1:])]) if full else ""
