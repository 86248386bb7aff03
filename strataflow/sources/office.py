"""Workbooks, documents and slides of the Office Open XML formats, read inside tasks and streamed out as rows.

A file is a row ``path, content``. Its members are decompressed as streams and parsed element by element: what a task holds of a
file is its bytes and a workbook's shared strings. Damaged, encrypted and oversized files give no rows; ``problems`` tells why.
"""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORKBOOKS, DOCUMENTS, SLIDES = (".xlsx",), (".docx",), (".pptx",)
#: A member may have so many bytes once it is decompressed, and be so many times as large as it is stored.
MOST_MEMBER, MOST_RATIO = 1 << 30, 1000
#: Rows, and characters or cells, that a task hands on at once.
BATCH, BATCH_CHARS = 1000, 1 << 20
# Fixed values of the standard: numbers of built-in formats of dates and times, and the first bytes of encrypted and of older files.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
COMPOUND = bytes.fromhex("d0cf11e0a1b11ae1")


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attribute(element: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if _name(k) == name), None)


class Package:
    """A file's members."""

    def __init__(self, content: bytes):
        if content[:8] == COMPOUND:
            raise ValueError("encrypted, or of an older format")
        self.zip = zipfile.ZipFile(BytesIO(content))
        for info in self.zip.infolist():
            if info.flag_bits & 1:
                raise ValueError("encrypted")
            if info.file_size > MOST_MEMBER or info.file_size > 1 << 20 and info.file_size > MOST_RATIO * max(1, info.compress_size):
                raise ValueError("a member is too large")
        self.names = set(self.zip.namelist())

    def events(self, member: str, starts: bool = False) -> Iterator[tuple[str, ElementTree.Element]]:
        """Elements of a member as they begin (with starts) and end."""
        if member in self.names:
            with self.zip.open(member) as stream:
                yield from ElementTree.iterparse(stream, ("start", "end") if starts else ("end",))

    def related(self, member: str) -> dict[str, str]:
        """The members that a member names by ids."""
        folder, name = posixpath.split(member)
        out = {}
        for _, e in self.events(posixpath.join(folder, "_rels", f"{name}.rels")):
            if _name(e.tag) == "Relationship" and e.get("TargetMode") != "External":
                target = e.get("Target", "")
                out[e.get("Id", "")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        return out

    def main(self) -> str:
        """The member that the file is about."""
        for _, e in self.events("_rels/.rels"):
            if _name(e.tag) == "Relationship" and e.get("Type", "").endswith("/officeDocument"):
                return e.get("Target", "").lstrip("/")
        raise ValueError("no main part")


# --- workbooks ---


def _is_date(code: str) -> bool:
    """Whether a number format has parts of a date or time outside quotes, escapes and brackets (but those of elapsed time)."""
    return bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.lower()).split(";")[0].replace("general", "")))


def date_styles(package: Package, member: str) -> list[bool]:
    """For each style of cells, whether it shows dates."""
    own, out = {}, []
    for _, e in package.events(member):
        if _name(e.tag) == "numFmt":
            own[int(e.get("numFmtId", "0"))] = _is_date(e.get("formatCode", ""))
        elif _name(e.tag) == "cellXfs":
            out = [int(x.get("numFmtId", "0")) for x in e]
    return [own.get(n, n in DATE_FORMATS) for n in out]


def moment(serial: float, from_1904: bool) -> str | None:
    """A day's number as a date and time; the first system has a day that never was, the sixtieth."""
    if not 0 <= serial < 2_958_466:
        return None
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 31) if serial < 60 else datetime(1899, 12, 30)
    return (start + timedelta(seconds=round(serial * 86400))).strftime("%Y-%m-%d %H:%M:%S") if serial >= 1 or from_1904 else (start + timedelta(seconds=round(serial * 86400))).strftime("%H:%M:%S")


def _said(element: ElementTree.Element) -> str:
    """The text of a string's runs, without what tells how to read it aloud."""
    out = []
    for child in element:
        if _name(child.tag) == "t":
            out.append(child.text or "")
        elif _name(child.tag) == "r":
            out += [t.text or "" for t in child if _name(t.tag) == "t"]
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), "".join(out))


def column_number(reference: str) -> int:
    """``A1`` is 0, ``AB7`` is 27."""
    n = 0
    for c in reference.rstrip("0123456789").upper():
        n = 26 * n + ord(c) - 64
    return n - 1


def _plain_number(text: str) -> str:
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1e16 else repr(value)


def _value(cell: ElementTree.Element, strings: list[str], dates: list[bool], from_1904: bool) -> str | None:
    kind, raw = cell.get("t", "n"), next((x for x in cell if _name(x.tag) in ("v", "is")), None)
    if raw is None or kind == "e":
        return None
    if kind == "inlineStr":
        return _said(raw) or None
    text = raw.text or ""
    if kind == "s":
        return strings[int(text)] or None
    if kind == "b":
        return "True" if text.strip() == "1" else "False"
    if kind == "n" and text:
        style = int(cell.get("s", "0"))
        return moment(float(text), from_1904) or _plain_number(text) if style < len(dates) and dates[style] else _plain_number(text)
    return text.replace("T", " ") if kind == "d" else text or None


def _merged(package: Package, member: str) -> list[tuple[int, int, int, int]]:
    """First and last row and column of merged cells."""
    out = []
    for _, e in package.events(member):
        if _name(e.tag) == "mergeCell":
            a, _, b = e.get("ref", "").partition(":")
            out.append((int(re.sub(r"\D", "", a)), int(re.sub(r"\D", "", b or a)), column_number(a), column_number(b or a)))
        elif _name(e.tag) in ("row", "c"):
            e.clear()
    return out


def sheets(package: Package) -> Iterator[tuple[int, str, str]]:
    """(place, name, member) of a workbook's sheets that are no charts."""
    main = package.main()
    related, at = package.related(main), 0
    for _, e in package.events(main):
        if _name(e.tag) == "sheet" and (member := related.get(_attribute(e, "id") or "", "")) in package.names and "chartsheet" not in member:
            yield at, e.get("name", ""), member
            at += 1


def sheet_rows(package: Package, member: str, strings: list[str], dates: list[bool], from_1904: bool, fill_merged: bool) -> Iterator[list[str | None]]:
    """A sheet's rows that have a value, by columns."""
    spans, held, row_number = (_merged(package, member) if fill_merged else []), {}, 0
    root = None
    for event, e in package.events(member, starts=True):
        root = e if root is None else root
        if event != "end" or _name(e.tag) != "row":
            continue
        row_number = int(e.get("r", row_number + 1))
        values: dict[int, str | None] = {}
        for i, cell in enumerate(c for c in e if _name(c.tag) == "c"):
            at = column_number(cell.get("r")) if cell.get("r") else i
            values[at] = _value(cell, strings, dates, from_1904)
        for span in spans:
            if span[0] <= row_number <= span[1]:
                held.setdefault(span, values.get(span[2]))
                values |= dict.fromkeys(range(span[2], span[3] + 1), held[span])
        e.clear()
        if any(v is not None for v in values.values()):
            yield [values.get(i) for i in range(max(values) + 1)]
        if root is not e and len(root):
            for child in root:
                if _name(child.tag) == "sheetData":
                    child.clear()


def named(header: list[str | None]) -> list[str]:
    """Names of columns: those without one are numbered, repeated ones get a number behind."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(header):
        name = f"Unnamed: {i}" if name is None else name
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def workbook_tables(content: bytes, fill_merged: bool) -> Iterator[tuple[int, str, int, list[dict]]]:
    """(sheet's place, its name, row, cells) of all sheets, the first row of each naming its columns."""
    package = Package(content)
    main = package.main()
    members = set(package.related(main).values())
    strings = [_said(e) for m in members if m.endswith("sharedStrings.xml") for _, e in package.events(m) if _name(e.tag) == "si"]
    dates = [d for m in members if m.endswith("styles.xml") for d in date_styles(package, m)]
    from_1904 = any(e.get("date1904") in ("1", "true") for _, e in package.events(main) if _name(e.tag) == "workbookPr")
    for at, name, member in sheets(package):
        rows = sheet_rows(package, member, strings, dates, from_1904, fill_merged)
        names = named(next(rows, []))
        for i, row in enumerate(rows):
            more = [f"Unnamed: {j}" for j in range(len(names), len(row))]
            yield at, name, i, [{"name": n, "value": row[j] if j < len(row) else None} for j, n in enumerate(names + more)]


# --- documents and slides ---


def _paragraph(p: ElementTree.Element) -> str:
    """A paragraph's text; deleted runs and the codes of fields are no ``t``."""
    breaks = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}
    return "".join(e.text or "" if (n := _name(e.tag)) == "t" else breaks.get(n, "") for e in p.iter() if _name(e.tag) in ("t", *breaks))


def _table(tbl: ElementTree.Element) -> str:
    """Rows as lines, cells between tabs; a cell that spans columns is followed by empty ones."""
    lines = []
    for row in (r for r in tbl if _name(r.tag) == "tr"):
        cells = []
        for cell in (c for c in row if _name(c.tag) == "tc"):
            text = " ".join(" ".join(_paragraph(p).split()) for p in cell.iter() if _name(p.tag) == "p")
            span = next((int(_attribute(e, "val") or 1) for e in cell.iter() if _name(e.tag) == "gridSpan"), None) or int(cell.get("gridSpan", "1"))
            cells += [text.strip(), *[""] * (span - 1)]
        lines.append("\t".join(cells))
    return "\n".join(lines)


def _blocks(root_events: Iterator[tuple[str, ElementTree.Element]], related: dict[str, str], styles: dict[str, str]) -> Iterator[tuple[str, str | None, str]]:
    """(kind, style, text) of the paragraphs, tables and images of a part in order; a table's paragraphs belong to it."""
    inside = 0
    for event, e in root_events:
        name = _name(e.tag)
        if name == "tbl":
            inside += 1 if event == "start" else -1
            if event == "end" and not inside:
                yield "table", None, _table(e)
                e.clear()
        elif name == "p" and event == "end" and not inside and not e.tag.startswith("{http://schemas.openxmlformats.org/presentationml"):
            style = next((_attribute(x, "val") for x in e.iter() if _name(x.tag) == "pStyle"), None)
            text = _paragraph(e)
            if text.strip():
                yield "text", styles.get(style or "", style), text
            yield from (("image", None, related[r]) for x in e.iter() if _name(x.tag) == "blip" and (r := _attribute(x, "embed")) in related)
            e.clear()
        elif name == "pic" and event == "end" and e.tag.startswith("{http://schemas.openxmlformats.org/presentationml"):
            yield from (("image", None, related[r]) for x in e.iter() if _name(x.tag) == "blip" and (r := _attribute(x, "embed")) in related)


def document_elements(content: bytes) -> Iterator[tuple[int, str, str | None, str]]:
    """(0, kind, style, text) of a document's body."""
    package = Package(content)
    main = package.main()
    related, styles = package.related(main), {}
    for member in (m for m in related.values() if m.endswith("styles.xml")):
        for _, e in package.events(member):
            if _name(e.tag) == "style":
                styles[_attribute(e, "styleId") or ""] = next((_attribute(x, "val") or "" for x in e if _name(x.tag) == "name"), "")
    for block in _blocks(package.events(main, starts=True), related, styles):
        yield 0, *block


def slide_elements(content: bytes) -> Iterator[tuple[int, str, str | None, str]]:
    """(slide, kind, null, text) in the order of the slides."""
    package = Package(content)
    main = package.main()
    related = package.related(main)
    order = [related.get(_attribute(e, "id") or "") for _, e in package.events(main) if _name(e.tag) == "sldId" for e in [_relation(e)]]
    for i, member in enumerate(m for m in order if m in package.names):
        for block in _blocks(package.events(member, starts=True), package.related(member), {}):
            yield i, *block


def _relation(e: ElementTree.Element) -> ElementTree.Element:
    """A slide has a number of its own beside the id of the relation, which is in a namespace."""
    return ElementTree.Element("r", {k: v for k, v in e.attrib.items() if "}" in k})


# --- as tables ---

PROBLEMS = (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError, IndexError, NotImplementedError, EOFError, OSError, zipfile.zlib.error)


def _rows(files: DataFrame, readers: dict[str, Callable], ddl: str, schema: pa.Schema) -> DataFrame:
    """``path`` and what the suffix's reader yields for each file's bytes, streamed; a damaged file gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for path, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content, read = value.as_py() or b"", readers["." + path.rsplit(".", 1)[-1].lower()]
                for row in _sound(read, content):
                    held.append((path, *row))
                    chars += _size(row)
                    if len(held) == BATCH or chars > BATCH_CHARS:
                        yield made()
                        held, chars = [], 0
        if held:
            yield made()

    return files.select("path", "content").mapInArrow(run, ddl)


def _size(row: tuple) -> int:
    return sum(len(x) for x in row if isinstance(x, str | list))


def _sound(read, content: bytes) -> Iterable[tuple]:
    """The rows of a file, none of a damaged one: held until it has been gone through, or read again where they are more than a task hands on at once."""
    held, chars, whole = [], 0, True
    try:
        for row in read(content):
            if whole:
                held.append(row)
                chars += _size(row)
                if len(held) > BATCH or chars > BATCH_CHARS:
                    held, whole = [], False
    except PROBLEMS:
        return []
    return held if whole else read(content)


def _problem(read, content: bytes | None) -> str | None:
    try:
        for _ in read(content or b""):
            pass
    except PROBLEMS as e:
        return str(e) or type(e).__name__
    return None


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def workbook_rows(files: DataFrame, fill_merged: bool = False) -> DataFrame:
    """``path, sheet, name, sequence, cells array<struct<name, value>>``: the rows of all sheets; with fill_merged all merged cells have the first one's value."""
    cells = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    schema = pa.schema([("path", pa.string()), ("sheet", pa.int32()), ("name", pa.string()), ("sequence", pa.int64()), ("cells", cells)])
    own = files.where(suffix(F.col("path")).isin(*WORKBOOKS))
    return _rows(own, dict.fromkeys(WORKBOOKS, lambda content: workbook_tables(content, fill_merged)), "path string, sheet int, name string, sequence long, cells array<struct<name: string, value: string>>", schema)


def elements(files: DataFrame) -> DataFrame:
    """``path, elem_idx, page, kind, style, text`` of documents and slides in order. kind: ``text``, ``table`` (lines, cells between tabs) or ``image`` (its member)."""
    schema = pa.schema([("path", pa.string()), ("elem_idx", pa.int32()), ("page", pa.int32()), ("kind", pa.string()), ("style", pa.string()), ("text", pa.string())])
    ddl = "path string, elem_idx int, page int, kind string, style string, text string"

    def numbered(read):
        return lambda content: ((i, *row) for i, row in enumerate(read(content)))

    readers = dict.fromkeys(DOCUMENTS, numbered(document_elements)) | dict.fromkeys(SLIDES, numbered(slide_elements))
    return _rows(files.where(suffix(F.col("path")).isin(*readers)), readers, ddl, schema)


def problems(files: DataFrame) -> DataFrame:
    """``path, reason`` of the files of these formats that can't be read."""
    readers = {".xlsx": lambda c: workbook_tables(c, False), ".docx": document_elements, ".pptx": slide_elements}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, _problem(readers["." + p.rsplit(".", 1)[-1].lower()], c.as_py())) for p, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            found = [f for f in found if f[1] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], names=["path", "reason"])

    own = files.where(suffix(F.col("path")).isin(*readers))
    return own.select("path", "content").mapInArrow(run, "path string, reason string")


def tables(found: DataFrame) -> DataFrame:
    """``path, table_idx, sequence, cells array<struct<name, value>>``: the rows of tables in documents and slides, the first of each naming its columns; empty cells are null."""
    place = (F.row_number().over(W.partitionBy("path").orderBy("elem_idx")) - 1).alias("table_idx")
    own = found.where(F.col("kind") == "table").select("path", place, F.transform(F.split("text", "\n"), lambda r: F.split(r, "\t")).alias("rows"))
    body = own.select("path", "table_idx", F.element_at("rows", 1).alias("names"), F.posexplode(F.slice("rows", 2, F.size("rows"))).alias("sequence", "row"))
    width = F.greatest(F.size("names"), F.size("row"))
    name = lambda i: F.coalesce(F.nullif(F.get("names", i), F.lit("")), F.concat(F.lit("Unnamed: "), i.cast("string")))
    cells = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.struct(name(i).alias("name"), F.nullif(F.get("row", i), F.lit("")).alias("value")))
    return body.select("path", "table_idx", F.col("sequence").cast("long").alias("sequence"), cells.alias("cells"))


def texts(found: DataFrame) -> DataFrame:
    """``path, text``: the text elements of each file with empty lines between; a file's own text is held by a task."""
    said = F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("elem_idx", "text"))))
    return found.groupBy("path").agg(F.array_join(F.transform(said, lambda x: x["text"]), "\n\n").alias("text"))


# --- writing ---

_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_PACKAGE, _OFFICE = "http://schemas.openxmlformats.org/package/2006/", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _escaped(text: str) -> str:
    """Without characters that XML doesn't have."""
    plain = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", text)
    return plain.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def package_bytes(members: dict[str, str], main: str, related: dict[str, list[tuple[str, str]]]) -> bytes:
    """A file of members. related: for a member the (type, member) that it names as rId1, rId2 and so on."""
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/{m}" ContentType="application/xml"/>' for m in members)
        z.writestr("[Content_Types].xml", f'{_XML}<Types xmlns="{_PACKAGE}content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{types}</Types>')
        for member, targets in {"": [("officeDocument", main)], **related}.items():
            folder, name = posixpath.split(member)
            rows = "".join(f'<Relationship Id="rId{i + 1}" Type="{_OFFICE}/{kind}" Target="/{target}"/>' for i, (kind, target) in enumerate(targets))
            z.writestr(posixpath.join(folder, "_rels", f"{name}.rels"), f'{_XML}<Relationships xmlns="{_PACKAGE}relationships">{rows}</Relationships>')
        for member, text in members.items():
            z.writestr(member, _XML + text)
    return out.getvalue()


def column_name(n: int) -> str:
    return (column_name(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)


def workbook_bytes(tables: list[tuple[str, list[list]]]) -> bytes:
    """A workbook of (sheet's name, rows): texts are shared, numbers are numbers, dates have the style of dates, None is no cell."""
    ns, strings, members = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", {}, {}

    def cell(row: int, column: int, value) -> str:
        at = f"{column_name(column)}{row}"
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, datetime):
            return f'<c r="{at}" s="1"><v>{(value - datetime(1899, 12, 30)) / timedelta(days=1)!r}</v></c>'
        if isinstance(value, int | float):
            return f'<c r="{at}"><v>{value!r}</v></c>'
        return f'<c r="{at}" t="s"><v>{strings.setdefault(value, len(strings))}</v></c>'

    for i, (_, rows) in enumerate(tables):
        body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows, 1))
        members[f"xl/worksheets/sheet{i + 1}.xml"] = f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>'
    listed = "".join(f'<sheet name="{_escaped(name).replace(chr(34), "&quot;")}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, (name, _) in enumerate(tables))
    own = [("worksheet", m) for m in members] + [("sharedStrings", "xl/sharedStrings.xml"), ("styles", "xl/styles.xml")]
    members["xl/sharedStrings.xml"] = f'<sst xmlns="{ns}">{"".join(f"""<si><t xml:space="preserve">{_escaped(s)}</t></si>""" for s in strings)}</sst>'
    members["xl/styles.xml"] = f'<styleSheet xmlns="{ns}"><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>'
    members["xl/workbook.xml"] = f'<workbook xmlns="{ns}" xmlns:r="{_OFFICE}"><sheets>{listed}</sheets></workbook>'
    return package_bytes(members, "xl/workbook.xml", {"xl/workbook.xml": own})


def document_bytes(blocks: list[tuple[str | None, str | list[list[str]]]]) -> bytes:
    """A document of (style, text) paragraphs and (null, rows) tables."""
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    styles = sorted({s for s, _ in blocks if s})

    def paragraph(text: str, style: str | None = None) -> str:
        own = f'<w:pPr><w:pStyle w:val="S{styles.index(style)}"/></w:pPr>' if style else ""
        return f'<w:p>{own}<w:r><w:t xml:space="preserve">{_escaped(text)}</w:t></w:r></w:p>'

    def table(rows: list[list[str]]) -> str:
        return f'<w:tbl>{"".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows)}</w:tbl>'

    body = "".join(paragraph(x, style) if isinstance(x, str) else table(x) for style, x in blocks)
    members = {"word/document.xml": f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>'}
    members["word/styles.xml"] = f'<w:styles xmlns:w="{ns}">{"".join(f"""<w:style w:styleId="S{i}"><w:name w:val="{_escaped(s)}"/></w:style>""" for i, s in enumerate(styles))}</w:styles>'
    return package_bytes(members, "word/document.xml", {"word/document.xml": [("styles", "word/styles.xml")]})


def slides_bytes(slides: list[list[str]]) -> bytes:
    """Slides of paragraphs."""
    p, a = "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main"
    members = {}
    for i, said in enumerate(slides):
        body = "".join(f"<a:p><a:r><a:t>{_escaped(t)}</a:t></a:r></a:p>" for t in said)
        members[f"ppt/slides/slide{i + 1}.xml"] = f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree><p:sp><p:txBody>{body}</p:txBody></p:sp></p:spTree></p:cSld></p:sld>'
    listed = "".join(f'<p:sldId id="{256 + i}" r:id="rId{i + 1}"/>' for i in range(len(slides)))
    own = [("slide", m) for m in members]
    members["ppt/presentation.xml"] = f'<p:presentation xmlns:p="{p}" xmlns:r="{_OFFICE}"><p:sldIdLst>{listed}</p:sldIdLst></p:presentation>'
    return package_bytes(members, "ppt/presentation.xml", {"ppt/presentation.xml": own})
