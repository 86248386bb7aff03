"""Workbooks, documents and slides, whole and damaged."""

import random
from datetime import datetime

import pytest

from strataflow.operators import tables
from strataflow.sources import files, office

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def workbook(sheet: str, styles: str = "", strings: str = "", settings: str = "") -> bytes:
    members = {
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{office._OFFICE}">{settings}<sheets><sheet name="s" r:id="rId1"/></sheets></workbook>',
        "xl/worksheets/a.xml": f'<worksheet xmlns="{MAIN}">{sheet}</worksheet>',
        "xl/styles.xml": f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}">{strings}</sst>',
    }
    return office.package_bytes(members, "xl/workbook.xml", {"xl/workbook.xml": [("worksheet", "xl/worksheets/a.xml"), ("styles", "xl/styles.xml"), ("sharedStrings", "xl/sharedStrings.xml")]})


def cells(content: bytes, fill_merged: bool = False):
    return [[(c["name"], c["value"]) for c in row] for *_, row in office.workbook_tables(content, fill_merged)]


def test_kinds_of_cells():
    sheet = """<sheetData><row r="2"><c r="A2" t="inlineStr"><is><t>name</t></is></c><c r="C2" t="s"><v>0</v></c></row>
<row r="5"><c r="A5" t="b"><v>1</v></c><c r="B5" t="e"><v>#N/A</v></c><c r="C5" t="str"><f>A1</f><v>so</v></c><c r="AA5"><v>3.0</v></c></row>
<row r="6"><c r="A6" s="1"><v>59</v></c><c r="B6" s="1"><v>61.5</v></c><c r="C6" s="2"><v>61.5</v></c><c s="3"><v>0.25</v></c><c s="4"><v>1e3</v></c></row><row r="7"/></sheetData>"""
    styles = """<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="&quot;day&quot;0.0[Red]"/></numFmts>
<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="20"/><xf numFmtId="165"/></cellXfs>"""
    rows = cells(workbook(sheet, styles, "<si><r><t>ri</t></r><r><t>ch_x000a_</t></r><rPh><t>no</t></rPh></si>"))
    assert [c[0] for c in rows[0][:3]] == ["name", "Unnamed: 1", "rich\n"]
    assert [c[1] for c in rows[0][:3]] == ["True", None, "so"] and rows[0][26] == ("Unnamed: 26", "3")
    assert [c[1] for c in rows[1]] == ["1900-02-28 00:00:00", "1900-03-01 12:00:00", "1900-03-01 12:00:00", "06:00:00", "1000"]


def test_days_from_1904_and_merged_cells():
    styles = '<cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs>'
    sheet = '<sheetData><row r="1"><c r="A1"><v>1</v></c><c r="B1"><v>1</v></c></row><row r="2"><c r="A2" s="1"><v>1</v></c></row><row r="3"><c r="C3"><v>5</v></c></row></sheetData><mergeCells><mergeCell ref="A2:B3"/></mergeCells>'
    content = workbook(sheet, styles, settings='<workbookPr date1904="1"/>')
    day = "1904-01-02 00:00:00"
    assert cells(content) == [[("1", day), ("1.1", None)], [("1", None), ("1.1", None), ("Unnamed: 2", "5")]]
    assert cells(content, True) == [[("1", day), ("1.1", day)], [("1", day), ("1.1", day), ("Unnamed: 2", "5")]]


def test_large_sheets_stream():
    rows = [["n", "t"], *([i, f"text {i % 7}"] for i in range(20_000))]
    got = cells(office.workbook_bytes([("s", rows)]))
    assert len(got) == 20_000 and got[-1] == [("n", "19999"), ("t", "text 0")]


def test_documents_in_order():
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = """<w:p><w:pPr><w:pStyle w:val="h"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p/>
<w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t><w:br/></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>
<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc></w:tr>
<w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc><w:tc><w:tbl><w:tr><w:tc><w:p><w:r><w:t>in</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>
<w:p><w:r><w:drawing><a:blip xmlns:a="a" r:embed="rId2"/></w:drawing></w:r></w:p>"""
    members = {"word/document.xml": f'<w:document xmlns:w="{ns}" xmlns:r="{office._OFFICE}"><w:body>{body}</w:body></w:document>', "word/styles.xml": f'<w:styles xmlns:w="{ns}"><w:style w:styleId="h"><w:name w:val="heading 1"/></w:style></w:styles>', "word/media/i.png": ""}
    content = office.package_bytes(members, "word/document.xml", {"word/document.xml": [("styles", "word/styles.xml"), ("image", "word/media/i.png")]})
    assert list(office.document_elements(content)) == [(0, "text", "heading 1", "Title"), (0, "text", None, "one\ttwo\nlink"), (0, "table", None, "wide\t\na b\tin"), (0, "image", None, "word/media/i.png")]


def test_folders(spark, tmp_path):
    (tmp_path / "book.xlsx").write_bytes(office.workbook_bytes([("one", [["k", "v"], [1, "x"], [None, datetime(2020, 1, 2)]]), ("two", [["z"], [True]])]))
    (tmp_path / "text.docx").write_bytes(office.document_bytes([("Title", "Of  things"), (None, [["a", "b"], ["1", ""]]), (None, "the end")]))
    (tmp_path / "show.PPTX").write_bytes(office.slides_bytes([["first", "slide"], ["last"]]))
    (tmp_path / "cut.docx").write_bytes(office.document_bytes([(None, "x" * 100)])[:-60])
    (tmp_path / "old.xlsx").write_bytes(office.COMPOUND + b"\x00" * 600)
    (tmp_path / "empty.pptx").write_bytes(b"PK")
    (tmp_path / "bad.xlsx").write_bytes(workbook('<sheetData><row r="1"><c r="A1" t="s"><v>7</v></c></row></sheetData>'))
    found = files.load_tables(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["table_idx"], r["sequence"], [(c["name"], c["value"]) for c in r["cells"]]) for r in found) == [
        ("book", 0, 0, [("k", "1"), ("v", "x")]), ("book", 0, 1, [("k", None), ("v", "2020-01-02 00:00:00")]), ("book", 1, 0, [("z", "True")]), ("text", 0, 0, [("a", "1"), ("b", None)]),
    ]
    assert {r["doc_id"]: r["text"] for r in files.load_documents(spark, str(tmp_path)).collect()} == {"text": "Of things the end", "show": "first slide last"}
    assert {r["path"].rsplit("/", 1)[-1] for r in files.left_out(spark, str(tmp_path)).collect()} == {"cut.docx", "old.xlsx", "empty.pptx", "bad.xlsx"}
    chunks = tables.cell_summaries(files.load_tables(spark, str(tmp_path))).collect()
    assert {r["chunk_id_str"] for r in chunks} == {"book_table0_summary_0", "book_table1_summary_0", "text_table0_summary_0"}
    assert files.file_chunks(spark, str(tmp_path)).count() == 5


@pytest.mark.parametrize("kind", ["xlsx", "docx", "pptx"])
def test_damage_is_an_error_of_the_file(kind):
    """Changed bytes give rows or one of the errors that are caught."""
    rng = random.Random(kind)
    whole = {"xlsx": office.workbook_bytes([("s", [["a"], [1.5], ["x"]])]), "docx": office.document_bytes([("T", "x"), (None, [["a"]])]), "pptx": office.slides_bytes([["a"], ["b"]])}[kind]
    read = {"xlsx": lambda c: office.workbook_tables(c, True), "docx": office.document_elements, "pptx": office.slide_elements}[kind]
    for _ in range(1500):
        content = bytearray(whole)
        for _ in range(rng.randint(1, 8)):
            content[rng.randrange(len(content))] = rng.randrange(256)
        office._problem(read, bytes(content))
    for text in ("<", "<a/>", '<worksheet><sheetData><row r="x"><c r="" t="s" s="-9"><v>-1</v></c></row></sheetData></worksheet>', '<w><row r="1"><c r="A1"><v>1e999</v></c></row></w>'):
        assert office._problem(lambda c: office.workbook_tables(c, True), office.package_bytes({"xl/w.xml": text, "xl/workbook.xml": f'<w xmlns:r="{office._OFFICE}"><sheet r:id="rId1"/></w>'}, "xl/workbook.xml", {"xl/workbook.xml": [("worksheet", "xl/w.xml")]})) != 0


def test_small_files_are_read_once_and_large_ones_again(monkeypatch):
    monkeypatch.setattr(office, "BATCH", 5)
    reads = []

    def read(content):
        reads.append(content)
        for i in range(content[0]):
            yield (i, "x")
        if content[1:]:
            raise ValueError("cut")

    assert [len(list(office._sound(read, bytes(c)))) for c in ([5], [6], [5, 0], [6, 0])] == [5, 6, 0, 0]
    assert reads == [b"\x05", b"\x06", b"\x06", b"\x05\x00", b"\x06\x00"]
