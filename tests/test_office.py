"""Office files and PDFs built here, and what must be read from them."""

import io
import json
import zipfile
import zlib

import pytest

from siltstone.sinks.office import docx_file
from siltstone.sources import documents as D, office as O

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def rels(*rows):
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="http://x/{kind}" Target="{target}"/>' for i, kind, target in rows) + "</Relationships>"


def word(body):
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def test_docx():
    p = lambda text, more="": f"<w:p><w:pPr>{more}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    item = "<w:numPr><w:numId w:val='1'/></w:numPr>"
    cell = lambda text: f"<w:tc>{p(text)}</w:tc>"
    body = p("A title", '<w:pStyle w:val="Title"/>') + p("Part &amp; more", '<w:pStyle w:val="Heading2"/>') + p("") + "<w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t><w:tab/><w:t>3</w:t></w:r></w:p>" + p("x", item) + p("y", item) + f"<w:tbl><w:tr>{cell('a')}{cell('b|c')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>" + p("end")
    text, about = O.docx(word(body))
    assert text == "# A title\n\n## Part & more\n\nOne two\t3\n\n- x\n- y\n\n| a   | b\\|c |\n|-----|------|\n| 1   | 2    |\n\nend" and about == {"paragraphs": 7, "tables": 1}
    assert O.docx(docx_file("# Head\nline <1>\n\n\x00two & three")) == ("# Head\n\nline <1>\n\ntwo & three", {"paragraphs": 4, "tables": 0})


def test_pptx():
    para = lambda *texts: "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in texts)
    slide = lambda inner: f'<p:sld xmlns:p="p" {A}><p:sp><p:txBody>{inner}</p:txBody></p:sp></p:sld>'
    number = f'<p:sld xmlns:p="p" {A}><p:sp><p:nvSpPr><p:nvPr><p:ph type="sldNum"/></p:nvPr></p:nvSpPr><p:txBody>{para("7")}</p:txBody></p:sp><p:sp>{para("note")}</p:sp></p:sld>'
    table = f"<a:tbl><a:tr><a:tc>{para('h')}</a:tc></a:tr><a:tr><a:tc>{para('v', 'w')}</a:tc></a:tr></a:tbl>"
    files = {
        "ppt/presentation.xml": f'<p:presentation xmlns:p="p" {R}><p:sldIdLst><p:sldId id="256" r:id="b"/><p:sldId id="257" r:id="a"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rels(("a", "slide", "slides/slide1.xml"), ("b", "slide", "slides/slide2.xml")),
        "ppt/slides/slide1.xml": slide(para("First", "text")), "ppt/slides/slide2.xml": slide(para("Second") + table), "ppt/slides/_rels/slide1.xml.rels": rels(("n", "notesSlide", "../notesSlides/n.xml")), "ppt/notesSlides/n.xml": number,
    }
    text, about = O.pptx(zipped(files))
    assert text == "## Slide 1\n\nSecond\n\n| h   |\n|-----|\n| v w |\n\n---\n\n## Slide 2\n\nFirst\n\ntext\n\n### Notes\n\nnote" and about == {"slides": 2}


def test_xlsx():
    files = {
        "xl/workbook.xml": f'<workbook {R}><sheets><sheet name="Two" r:id="r2"/><sheet name="One" r:id="r1"/><sheet name="Empty" r:id="r3"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels(("r1", "worksheet", "worksheets/sheet1.xml"), ("r2", "worksheet", "/xl/worksheets/sheet2.xml"), ("r3", "worksheet", "worksheets/sheet3.xml")),
        "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c></row><row><c r="A2"><v>1.5</v></c><c r="B2" t="b"><v>1</v></c><c r="C2" t="s"><v>9</v></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>1</v></c></row></sheetData></worksheet>', "xl/worksheets/sheet3.xml": "<worksheet><sheetData/></worksheet>",
    }
    text, about = O.xlsx(zipped(files))
    assert text == "### Sheet: Two\n\n| rich |\n|------|\n\n### Sheet: One\n\n| name |      | in  |\n|------|------|-----|\n| 1.5  | TRUE |     |" and about == {"sheets": 3}


def pdf_file(contents, fonts="", more=(), compress=True, trailer="", packed=False):
    """A PDF with a page for each content stream."""
    objects, n = {}, len(contents)
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[2] = ("<< /Type /Pages /Kids [" + " ".join(f"{10 + 2 * i} 0 R" for i in range(n)) + f"] /Count {n} /Resources << /Font << {fonts} >> >> >>").encode()
    for i, c in enumerate(contents):
        data = zlib.compress(c) if compress else c
        objects[10 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R >>".encode()
        objects[11 + 2 * i] = b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode" if compress else b"", data)
    objects.update(more)
    if packed:
        held = {k: objects.pop(k) for k in (1, 2)}
        places, body = "", b""
        for k, v in held.items():
            places += f"{k} {len(body)} "
            body += v + b" "
        data = zlib.compress(places.encode() + body)
        objects[5] = b"<< /Type /ObjStm /N 2 /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(places), len(data), data)
        objects[6] = b"<< /Type /XRef /Root 1 0 R >>\nstream\n\nendstream"
        trailer = None
    out = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, v) for k, v in objects.items())
    return out if trailer is None else out + f"trailer << /Root 1 0 R {trailer} >>\n%%EOF".encode()


@pytest.mark.parametrize("compress", [True, False])
def test_pdf_text(compress):
    one = rb"BT /F1 12 Tf 72 700 Td (Hello \(world\)) Tj 0 -14 Td [(spl) 20 (it) -300 (words)] TJ T* (caf\351 \101) ' ET"
    text, about = O.pdf(pdf_file([one, b"BT <48 69> Tj ET"], "/F1 4 0 R", {4: b"<< /Type /Font /Subtype /Type1 >>"}, compress))
    assert text == "Hello (world)\nsplit words\ncafé A\n\nHi" and about == {"pages": 2}


def test_pdf_with_characters_of_its_own_and_packed_objects():
    table = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0048> <0002> <D83DDE42> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <0079007A>] endbfrange"
    more = {4: b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >>", 7: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(table), table)}
    content = b"BT /F1 9 Tf <00010010001100120002> Tj 0 -9 Td <00200021> Tj ET"
    for packed in (False, True):
        assert O.pdf(pdf_file([content], "/F1 4 0 R", more, packed=packed))[0] == "Habc\U0001f642\nxyz"


def test_what_cannot_be_read(monkeypatch):
    for bad in (b"", b"%PDF-1.4 nothing", b"no pdf", pdf_file([b""], trailer="/Encrypt 9 0 R"), b"%PDF-1 " + b"[" * 5000, b"%PDF-1 1 0 obj " + b"<<" * 5000):
        with pytest.raises(ValueError):
            O.pdf(bad)
    for parse in (O.docx, O.pptx, O.xlsx):
        for bad in (b"", b"PK\x03\x04broken", zipped({"a": "b"}), zipped({"word/document.xml": "<!DOCTYPE x><x/>", "ppt/presentation.xml": "<x", "xl/workbook.xml": "<!DOCTYPE x><x/>"})):
            with pytest.raises(ValueError):
                parse(bad)
    monkeypatch.setattr(O, "MAX_INFLATED", 100_000)
    bomb = word("<w:p><w:r><w:t>" + "a" * 200_000 + "</w:t></w:r></w:p>")
    with pytest.raises(O.TooLarge):
        O.docx(bomb)
    lying = bytearray(bomb)  # members that claim to be small
    at = lying.rfind(b"PK\x01\x02")
    lying[at + 24 : at + 28] = (10).to_bytes(4, "little")
    with pytest.raises(ValueError):
        O.docx(bytes(lying))
    with pytest.raises(O.TooLarge):
        O.pdf(pdf_file([b"(a) Tj " * 100_000]))


def test_files_become_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(O, "MAX_INFLATED", 100_000)
    for name, content in {"a.docx": docx_file("# T\nx"), "b.pdf": pdf_file([b"BT (Hi) Tj ET"]), "c.xlsx": b"broken", "d.docx": docx_file("b" * 200_000)}.items():
        (tmp_path / name).write_bytes(content)
    files = D.read_files(spark, str(tmp_path))
    out = {r.path.rsplit("/", 1)[1]: r for r in D.parse_documents(files).collect()}
    assert {k: r.status for k, r in out.items()}.items() >= {"a.docx": "ok", "b.pdf": "ok", "c.xlsx": "failed"}.items()
    assert out["a.docx"].markdown == "# T\n\nx" and json.loads(out["b.pdf"].metadata) == {"format": "pdf", "pages": 1}
