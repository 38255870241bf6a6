"""Uploaded files as Markdown: dispatch by extension, size limit, parsers."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.operators.extraction import to_markdown
from siltstone.sources import office
from siltstone.sources.markup import table_markdown

MAX_BYTES = 50 * 1024 * 1024


def _csv(content: bytes) -> tuple[str, dict]:
    rows = list(csv.reader(io.StringIO(content.decode("utf-8", "replace"))))
    return table_markdown(rows), {"rows": len(rows)}


def _text(content: bytes) -> tuple[str, dict]:
    text = content.decode("utf-8", "replace")
    return text.strip(), {"chars": len(text)}


def _html(content: bytes) -> tuple[str, dict]:
    return to_markdown(content.decode("utf-8", "replace")), {}


def _json(content: bytes) -> tuple[str, dict]:
    text = content.decode("utf-8", "replace")
    try:
        return "```json\n" + json.dumps(json.loads(text), indent=2, ensure_ascii=False) + "\n```", {}
    except ValueError:
        return text.strip(), {}


#: What a file's extension is parsed by; callers may add to it.
PARSERS: dict[str, Callable[[bytes], tuple[str, dict]]] = {"csv": _csv, "html": _html, "htm": _html, "json": _json, "docx": office.docx, "pptx": office.pptx, "xlsx": office.xlsx, "pdf": office.pdf} | dict.fromkeys(("txt", "md", "markdown", "log", "py", "js", "xml", "yaml", "yml", "rst"), _text)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of all files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def parse_documents(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, status, markdown, metadata as JSON): status is ok, unsupported, too_large or failed.

    Size and type are settled before any content is passed on to Python; what would inflate beyond its limit is too_large.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = dict(PARSERS)
    status = F.when(F.col("length") > max_bytes, "too_large").when(~ext.isin(*known), "unsupported").otherwise("ok")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, state, content in zip(*(batch.column(c).to_pylist() for c in ("ext", "status", "content")), strict=True):
                text, meta = None, {"format": kind}
                if state == "ok":
                    try:
                        text, more = known[kind](content or b"")
                        meta |= more
                    except office.TooLarge:
                        state = "too_large"
                    except (ValueError, csv.Error):
                        state = "failed"
                out.append((state, text, json.dumps(meta)))
            arrays = [batch.column("path"), *(pa.array([r[i] for r in out], pa.string()) for i in range(3))]
            yield pa.RecordBatch.from_arrays(arrays, ["path", "status", "markdown", "metadata"])

    read = files.select("path", ext.alias("ext"), status.alias("status"), F.when(status == "ok", F.col("content")).alias("content"))
    return read.mapInArrow(run, "path string, status string, markdown string, metadata string")
