"""Texts as office files, for readers that ask for them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_MAIN = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_TYPES = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
#: Characters that XML can't hold.
_FORBIDDEN = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def docx_file(text: str) -> bytes:
    """A document with a paragraph for each line; lines that begin with # are headings."""
    parts = []
    for line in text.split("\n"):
        level = len(m[0]) - 1 if (m := re.match("#{1,6} ", line)) else 0
        style = f'<w:pPr><w:pStyle w:val="Heading{level}"/></w:pPr>' if level else ""
        shown = escape(_FORBIDDEN.sub("", line[level + 1 if level else 0 :]))
        parts.append(f'<w:p>{style}<w:r><w:t xml:space="preserve">{shown}</w:t></w:r></w:p>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_MAIN}"><w:body>{"".join(parts)}</w:body></w:document>')):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def as_docx(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(path, length, content) of a .docx file for each text, as ``binaryFile`` reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [docx_file(x.as_py() or "") for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(files, pa.binary())], ["path", "content"])

    rows = docs.select(F.concat(F.col(id_col).cast("string"), F.lit(".docx")).alias("path"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "path string, content binary").select("path", F.length("content").cast("long").alias("length"), "content")
