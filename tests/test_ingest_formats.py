"""XLSX and DOCX ingest from minimal hand-built files (no writer library needed)."""
import os
import tempfile
import zipfile

from spanmask.sources.files import read_documents

S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _xlsx(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {S} {R}><sheets>'
                   '<sheet name="Clienti" sheetId="1" r:id="rId1"/><sheet name="Vuoto" sheetId="2" r:id="rId2"/>'
                   '</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
                   '<Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {S}><si><t>Nome</t></si><si><t>Email</t></si>'
                   '<si><t>Mario Rossi</t></si><si><t>mario.rossi@example.com</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {S}><sheetData>'
                   '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
                   '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2" t="s"><v>3</v></c><c r="C2" t="b"><v>1</v></c></row>'
                   '</sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {S}><sheetData/></worksheet>')


def _docx(path):
    body = (f'<w:document {W}><w:body>'
            '<w:p><w:r><w:t>Fornitore: ACME Srl</w:t></w:r></w:p><w:p><w:r><w:t>  </w:t></w:r></w:p>'
            '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>P.IVA</w:t></w:r></w:p></w:tc>'
            '<w:tc><w:p><w:r><w:t>01114601006</w:t></w:r></w:p></w:tc></w:tr>'
            '<w:tr><w:tc><w:p/></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>'
            '</w:body></w:document>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/footer1.xml", f'<w:ftr {W}><w:p><w:r><w:t>Tel 011 1234567</w:t></w:r></w:p></w:ftr>')


def test_xlsx_and_docx_ingest(spark):
    d = tempfile.mkdtemp(prefix="spanmask-fmt-")
    _xlsx(os.path.join(d, "clienti.xlsx"))
    _docx(os.path.join(d, "contratto.docx"))
    docs, errors = read_documents(spark, d)
    got = {r.file: r.text for r in docs.collect()}
    assert errors.count() == 0
    assert got["clienti.xlsx"] == ("[Sheet: Clienti]\nNome | Email\n"
                                   "Row 2: Nome: Mario Rossi | Email: mario.rossi@example.com | YES")
    assert got["contratto.docx"] == "Fornitore: ACME Srl\nP.IVA | 01114601006\nTel 011 1234567"


def test_docx_breaks_sections_and_nested_tables(spark):
    d = tempfile.mkdtemp(prefix="spanmask-docx-")
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    tc = lambda x: f"<w:tc>{x}</w:tc>"
    inner = f"<w:tbl><w:tr>{tc(p('i1'))}{tc(p('i2'))}</w:tr></w:tbl>"
    ref = lambda kind, n: f'<w:{kind}Reference w:type="default" r:id="{kind}{n}"/>'
    body = (f'<w:document {W} {R}><w:body>'
            '<w:p><w:r><w:t>Fornitore: ACME Srl</w:t><w:br/><w:t>Tel:</w:t><w:tab/><w:t>011 1234567</w:t></w:r></w:p>'
            f"<w:tbl><w:tr>{tc(p(' a ') + p('b') + inner)}{tc('')}{tc(p('c'))}</w:tr><w:tr>{tc('')}{tc(p(' '))}</w:tr></w:tbl>"
            f"{p('dopo')}<w:p><w:pPr><w:sectPr>{ref('header', 1)}{ref('footer', 1)}</w:sectPr></w:pPr></w:p>"
            f"<w:sectPr>{ref('header', 2)}</w:sectPr></w:body></w:document>")
    with zipfile.ZipFile(os.path.join(d, "s.docx"), "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   + "".join(f'<Relationship Id="{k}{n}" Target="{k}{n}.xml"/>' for k, n in (("header", 1), ("footer", 1), ("header", 2)))
                   + "</Relationships>")
        for k, n in (("header", 1), ("footer", 1), ("header", 2)):
            z.writestr(f"word/{k}{n}.xml", f"<w:x {W}>{p(f'{k} {n}')}</w:x>")
    with zipfile.ZipFile(os.path.join(d, "empty.docx"), "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body/></w:document>")
    docs, errors = read_documents(spark, d)
    got = {r.file: r.text for r in docs.collect()}
    assert errors.count() == 0 and got["empty.docx"] == ""
    assert got["s.docx"] == ("Fornitore: ACME Srl\nTel:\t011 1234567\ndopo\na b i1 | i2 |  | c\n"
                             "header 1\nfooter 1\nheader 2\nfooter 1")


def test_every_file_is_kept(spark):
    from spanmask.sources.files import collect_files, collect_unsupported_files
    d = tempfile.mkdtemp(prefix="spanmask-all-")
    for name, content in (("_fattura.txt", b"uno"), (".note.txt", b"due"), ("empty.txt", b""), ("blank.csv", b"\n\n"), ("bad.xlsx", b"no"),
                          ("x.pdf", b"%PDF"), ("empty.rtf", b""), ("ok.txt", b"tre")):
        with open(os.path.join(d, name), "wb") as f:
            f.write(content)
    os.mkdir(os.path.join(d, "folder.txt"))
    assert {r.name for r in collect_files(spark, d).collect()} == {"_fattura.txt", ".note.txt", "empty.txt", "blank.csv", "bad.xlsx", "x.pdf", "ok.txt"}
    assert [r.name for r in collect_unsupported_files(spark, d).collect()] == ["empty.rtf"]
    docs, errors = read_documents(spark, d)
    assert {r.file: r.text for r in docs.collect()} == {"_fattura.txt": "uno", ".note.txt": "due", "empty.txt": "", "blank.csv": "", "ok.txt": "tre"}
    assert {r.file for r in errors.collect()} == {"bad.xlsx", "x.pdf"}


def test_listing_order_and_tsv(spark):
    from spanmask.sources.files import collect_files
    d = tempfile.mkdtemp(prefix="spanmask-tsv-")
    with open(os.path.join(d, "b.TSV"), "w", encoding="utf-8") as f:
        f.write("Nome\tTelefono\tNote\nMario Rossi\t+39 333 1234567\t\n\n12\t34\n")
    with open(os.path.join(d, "A.txt"), "w") as f:
        f.write("x")
    with open(os.path.join(d, "c.txt"), "w") as f:
        f.write("y")
    assert [r.name for r in collect_files(spark, d).collect()] == ["A.txt", "b.TSV", "c.txt"]
    docs, _ = read_documents(spark, d)
    got = {r.file: r.text for r in docs.collect()}
    # the blank line 3 is dropped but still takes a row number
    assert got["b.TSV"] == ("Nome | Telefono | Note\nRow 2: Nome: Mario Rossi | Telefono: +39 333 1234567\n"
                            "Row 4: Nome: 12 | Telefono: 34")


def test_bom_aware_decoding(spark):
    d = tempfile.mkdtemp(prefix="spanmask-bom-")
    with open(os.path.join(d, "u8.txt"), "wb") as f:
        f.write("﻿Città: Torino".encode("utf-8"))
    with open(os.path.join(d, "u16.txt"), "wb") as f:
        f.write("Società: ACME\r\n".encode("utf-16"))
    docs, errors = read_documents(spark, d)
    got = {r.file: r.text for r in docs.collect()}
    assert got == {"u8.txt": "Città: Torino", "u16.txt": "Società: ACME\n"}
    assert errors.count() == 0
