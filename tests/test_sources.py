import io
import zipfile

import pytest

from quire.sources import convert, office, pdf
from quire.streaming.frames import capped_chunks

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
O = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"'  # noqa: E741
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


def docx():
    run = lambda t, p="": f"<w:r><w:rPr>{p}</w:rPr><w:t>{t}</w:t></w:r>"
    para = lambda body, p="": f"<w:p><w:pPr>{p}</w:pPr>{body}</w:p>"
    cell = lambda *runs: f"<w:tc>{para(''.join(map(run, runs)))}</w:tc>"
    body = (
        para(run("Doc"), '<w:pStyle w:val="Title"/>') + para(run("Part"), '<w:pStyle w:val="Heading1"/>') + para(run("b", "<w:b/>") + run("i", "<w:i/>") + run("s", "<w:strike/>") + run("off", '<w:b w:val="false"/>'))
        + para(run("one"), '<w:numPr><w:ilvl w:val="0"/></w:numPr>') + para(run("two"), '<w:numPr><w:ilvl w:val="1"/></w:numPr>') + para(run("x &amp; y"))
        + f"<w:tbl><w:tr>{cell('h1')}{cell('h2')}</w:tr><w:tr>{cell('a', 'b')}{cell('c')}</w:tr></w:tbl>"
    )
    return zipped([("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")])


def test_docx():
    text = office.docx(docx())
    assert text.startswith("## Doc\n\n### Part\n\n**b** *i* ~~s~~ off\n\n  * one  \n    * two  \n")
    assert "x & y" in text and "| h1 | h2 |\n|---|---|\n| ab | c |\n" in text
    assert "| a | b | c |" in office.docx(docx(), compat=True)


def odt(body):
    return zipped([("mimetype", "application/vnd.oasis.opendocument.text"), ("content.xml", f"<office:document-content {O}><office:body>{body}</office:body></office:document-content>")])


def test_opendocument():
    body = (
        "<text:h>Head</text:h><text:p>para <text:span>two</text:span></text:p><text:list><text:list-item><text:p>it</text:p></text:list-item></text:list>"
        "<table:table><table:table-row><table:table-cell><text:p>a</text:p></table:table-cell></table:table-row></table:table><table:table/>"
    )
    text = office.opendocument(odt(body))
    assert text.startswith("### Head\n\npara two\n\n * it  \n") and "| a |\n|---|\n" in text
    assert convert.zip_type(odt(body)) == "odt" and convert.zip_type(odt(body), compat=True) == "zip"


def test_slides():
    slide = lambda t: f'<p:sld {A}><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r><a:br/><a:r><a:t>z</a:t></a:r></a:p></p:txBody></p:sp></p:sld>'
    data = zipped([("ppt/slides/slide2.xml", slide("two")), ("ppt/slides/slide1.xml", slide("one"))])
    assert office.pptx(data).startswith("<!-- S-TITLE: Slide number 1 -->\n# two")
    assert [m for _, m, _ in office.slides(data, numeric=True)] == ["ppt/slides/slide1.xml", "ppt/slides/slide2.xml"]


def xlsx():
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c></row><row r="2"><c r="A2"><v>3.0</v></c><c r="B2" t="b"><v>1</v></c></row></sheetData></worksheet>'
    return zipped([
        ("xl/workbook.xml", f'<workbook {main}><sheets><sheet name="S" r:id="r1"/><sheet name="E" r:id="r2"/></sheets></workbook>'),
        ("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>'),
        ("xl/sharedStrings.xml", f"<sst {main}><si><r><t>sh</t></r><r><t>ared</t></r></si></sst>"),
        ("xl/worksheets/sheet1.xml", sheet), ("xl/worksheets/sheet2.xml", f"<worksheet {main}><sheetData/></worksheet>"),
    ])


def test_workbooks():
    assert office.workbook(xlsx()) == "# S\n\n| shared |  | in |\n|---|---|---|\n| 3 | true |  |\n\n"
    body = '<table:table table:name="T"><table:table-row><table:table-cell table:number-columns-repeated="2"><text:p>v</text:p></table:table-cell><table:table-cell table:number-columns-repeated="999"/></table:table-row><table:table-row table:number-rows-repeated="9"><table:table-cell/></table:table-row></table:table>'
    assert office.workbook(odt(body), "ods") == "# T\n\n| v | v |\n|---|---|\n\n"
    with pytest.raises(ValueError, match="No readable sheets"):
        office.workbook(odt(""), "ods")


def test_csv_errors():
    assert convert.csv_table('a;b\n"x\ny";2\n') == "| a | b |\n|---|---|\n| x\ny | 2 |\n"
    assert convert.delimiter("a,b;c") == ";" and convert.delimiter("abc") == "|"
    with pytest.raises(ValueError):
        convert.csv_table("a,b\n1\n")


PDF = b"""%PDF-1.4
1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj
2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj
3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >> endobj
5 0 obj << /Type /Font /Subtype /Type1 >> endobj
4 0 obj << /Length 132 >>
stream
BT /F1 12 Tf 40 700 Td (Hello \\(you\\)) Tj 0 -20 Td [(Wor) -10 (ld)] TJ ET
40 600 m 80 600 l S 40 500 20 30 re S 10 10 m 90 80 l f
endstream endobj
trailer << /Root 1 0 R >>"""


def test_pdf():
    (units,) = pdf.page_units(PDF)
    assert [u.text for u in units if u.kind == "text"] == ["Hello (you)", "World"]
    assert sum(u.kind == "line" for u in units) == 5
    text = pdf.pdf(PDF)
    assert text.startswith("<!-- S-TITLE: Page number 1 -->\n```pdf\n") and "Hello (you)" in text and "───" in text


def test_convert_files(spark):
    inner = zipped([("n.md", "deep")])
    outer = zipped([("a.md", "# x"), ("d/", ""), ("t.csv", "a,b\n1,2\n"), ("bin.dat", b"\xff\xfe\x00"), ("in.zip", inner)])
    rows = [("a/r.MD", b"# hi"), ("x.py", b"print()"), ("bad.txt", b"\xff"), ("d.docx", docx()), ("z.zip", outer), ("e.docx", b"no"), ("s.xlsx", xlsx()), ("p.pdf", PDF), ("none", None)]
    d = convert.to_markdown(spark.createDataFrame(rows, "path string, content binary"))
    got = {r["path"]: r["result"] for r in d.collect()}
    assert got["a/r.MD"]["md"] == "# hi\n\n" and got["x.py"]["md"] == "```py\nprint()\n```"
    assert got["bad.txt"]["md"] is None and got["bad.txt"]["error"] and got["e.docx"]["error"]
    assert got["d.docx"]["md"].startswith("## Doc") and got["s.xlsx"]["md"].startswith("# S") and "Hello" in got["p.pdf"]["md"]
    zipped_md = got["z.zip"]["md"]
    assert "# `a.md`\n\n# x" in zipped_md and "| 1 | 2 |" in zipped_md and "# `bin.dat`\n\n**[Failed Reading:" in zipped_md and "deep" in zipped_md
    assert got["none"]["md"] is None and got["none"]["error"] is None
    names = [r["name"] for r in convert.members(spark.createDataFrame([("z", outer)], "path string, content binary")).orderBy("place").collect()]
    assert names == ["a.md", "t.csv", "bin.dat", "in.zip"]


def test_read_csv_and_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a;b\n"x\ny";\n1;2\n')
    rows = [tuple(r) for r in convert.read_csv(spark, str(tmp_path / "t.csv")).collect()]
    assert rows == [("x\ny", ""), ("1", "2")]
    assert convert.read_files(spark, str(tmp_path), "*.csv", longest=5).count() == 0
    assert convert.read_files(spark, str(tmp_path), "*.csv").count() == 1


def test_capped_chunks(spark):
    d = spark.createDataFrame([("u", k, 4) for k in range(5)], "url string, ord int, size int")
    assert capped_chunks(d, 10).count() == 2


def test_grid_keeps_long_runs_and_tall_pages():
    text = "x" * 2500 + "end"
    assert pdf.grid([pdf.Unit("text", 0, 0, text=text)]) == [text]
    assert pdf.grid([pdf.Unit("text", 9000, 5, text="far")]) == [" " * 2250 + "far"]
    tall = pdf.grid([pdf.Unit("text", 0, 5, text="low"), pdf.Unit("text", 0, 25_000, text="high")])
    assert tall[0] == "high" and tall[-1] == "low" and len(tall) == 2500
    with pytest.raises(ValueError):
        pdf.grid([pdf.Unit("line", 0, 0, 1e9, 0)])
