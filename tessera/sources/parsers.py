"""Readers of office files: zipped XML is read here, PDF needs a reader plugged in."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
BLOCKS = "source_path string, block_number int, style string, text string, table_number int, row_number int, cells array<string>"
SHEET_ROWS = "source_path string, sheet_number int, sheet_name string, row_number int, cells array<string>, formulas array<string>, bold boolean, merged boolean, hidden boolean"
PAGES = "source_path string, page_number int, text string"


def docx_blocks(content: bytes) -> Iterator[tuple]:
    """(style, text, table_number, row_number, cells) of paragraphs and table rows in document order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                if name is not None:
                    names[s.get(f"{_W}styleId")] = name.get(f"{_W}val")

    def text(node) -> str:
        return "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else "" for t in node.iter())

    tables = 0
    for item in body:
        if item.tag == f"{_W}p":
            style = item.find(f"{_W}pPr/{_W}pStyle")
            key = style.get(f"{_W}val") if style is not None else None
            yield names.get(key, key) or "Normal", text(item), None, None, None
        elif item.tag == f"{_W}tbl":
            tables += 1
            for n, row in enumerate(item.iter(f"{_W}tr"), 1):
                yield "", "", tables, n, ["\n".join(text(p) for p in c.iter(f"{_W}p")) for c in row.findall(f"{_W}tc")]


def _column(ref: str) -> int:
    out = 0
    for letter in re.match("[A-Z]+", ref)[0]:
        out = 26 * out + ord(letter) - 64
    return out


def xlsx_rows(content: bytes) -> Iterator[tuple]:
    """(sheet_number, sheet_name, row_number, cells, formulas, bold, merged, hidden) of every physical row.

    A cell with a formula gives its cached value and the formula; dates, times and date-times give ISO texts, booleans true or false.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        have = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in have else []
        fonts, styles, codes = [], [], {}
        if "xl/styles.xml" in have:
            root = ET.fromstring(z.read("xl/styles.xml"))
            fonts = [f.find(f"{_S}b") is not None and f.find(f"{_S}b").get("val", "1") not in ("0", "false") for f in root.iterfind(f"{_S}fonts/{_S}font")]
            codes = {int(n.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]', "", n.get("formatCode").lower()) for n in root.iterfind(f"{_S}numFmts/{_S}numFmt")}
            styles = [(int(x.get("fontId", 0)), int(x.get("numFmtId", 0))) for x in root.iterfind(f"{_S}cellXfs/{_S}xf")]
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for number, sheet in enumerate(ET.fromstring(z.read("xl/workbook.xml")).iterfind(f"{_S}sheets/{_S}sheet"), 1):
            target = links[sheet.get(f"{_R}id")]
            root = ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            merged = {int(a) for m in root.iterfind(f"{_S}mergeCells/{_S}mergeCell") if (r := re.match(r"[A-Z]+(\d+):[A-Z]+(\d+)$", m.get("ref"))) and (a := r[1]) == r[2]}
            found, width, last = {}, 0, 0
            for row in root.iterfind(f"{_S}sheetData/{_S}row"):
                last = int(row.get("r", last + 1))
                cells, at = {}, 0
                for c in row.iterfind(f"{_S}c"):
                    at = _column(c.get("r")) if c.get("r") else at + 1
                    cells[at] = _cell(c, shared, styles, fonts, codes)
                width = max([width, *cells])
                found[last] = (cells, row.get("hidden") in ("1", "true"))
            for n in range(1, max(found, default=0) + 1):
                cells, hidden = found.get(n, ({}, False))
                filled = [cells[c] for c in sorted(cells) if cells[c][0] is not None or cells[c][1]]
                yield number, sheet.get("name"), n, [cells.get(c, (None, None, False))[0] for c in range(1, width + 1)], [cells.get(c, (None, None, False))[1] for c in range(1, width + 1)], bool(filled) and all(x[2] for x in filled), n in merged, hidden


def _moment(days: float, form: int, code: str) -> str:
    """A stored number as date, time or both, in ISO form: as its format shows it, or both where the number has both."""
    at = datetime(1899, 12, 30) + timedelta(seconds=round(days * 86400))
    if (18 <= form <= 21 or 45 <= form <= 47 or code and not re.search("[dy]", code)) and days < 1:
        return at.time().isoformat(timespec="seconds")
    if (14 <= form <= 17 or code and not re.search("[hs]", code)) and days == int(days):
        return at.date().isoformat()
    return at.isoformat(timespec="seconds")


def _cell(c, shared: list[str], styles: list, fonts: list[bool], codes: dict[int, str]) -> tuple:
    kind, value, formula = c.get("t", "n"), c.findtext(f"{_S}v"), c.find(f"{_S}f")
    font, form = styles[int(c.get("s", 0))] if int(c.get("s", 0)) < len(styles) else (0, 0)
    if kind == "s" and value is not None:
        value = shared[int(value)]
    elif kind == "inlineStr":
        value = "".join(t.text or "" for t in c.iter(f"{_S}t"))
    elif kind == "b" and value is not None:
        value = "true" if value == "1" else "false"
    elif kind == "n" and value is not None and (14 <= form <= 22 or 45 <= form <= 47 or re.search("[dmyhs]", codes.get(form, ""))):
        value = _moment(float(value), form, codes.get(form, ""))
    return value, f"={formula.text}" if formula is not None and formula.text else None, bool(fonts) and font < len(fonts) and fonts[font]


def _parse(files: DataFrame, suffix: str, schema: str, rows: Callable[[bytes], Iterator[tuple]], most: int = 2000) -> DataFrame:
    """Rows of the files (logical_path, content) of one suffix, and one row with ``error`` for a file that can't be read, in place of all its rows.

    A file is read by itself and its rows leave in batches, so that a task holds one file's rows at most beside what Arrow brings.
    """

    def run(batches):
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                name = path.as_py()
                try:
                    out = [(name, *row, None) for row in rows(content.as_py() or b"")]
                except Exception as e:  # noqa: BLE001 - whatever is wrong with a file is told in its row
                    out = [(name, *[None] * (len(shape) - 2), f"{type(e).__name__}: {e}")]
                for at in range(0, len(out), most):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at : at + most], strict=True), shape, strict=True)], schema=shape)

    schema += ", error string"
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    shape = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])
    return files.filter(F.lower("logical_path").endswith(suffix)).select("logical_path", "content").mapInArrow(run, schema)


def good(parsed: DataFrame) -> DataFrame:
    """The rows of files that could be read."""
    return parsed.filter("error is null").drop("error")


def read_docx(files: DataFrame) -> DataFrame:
    def rows(content: bytes):
        return ((n, *block) for n, block in enumerate(docx_blocks(content), 1))

    return _parse(files, ".docx", BLOCKS, rows)


def read_xlsx(files: DataFrame) -> DataFrame:
    return _parse(files, ".xlsx", SHEET_ROWS, xlsx_rows)


def read_pdf(files: DataFrame, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """Pages with text, numbered as in the file. reader: bytes to page texts; none is built in, so one must be given."""
    if reader is None:
        raise ValueError("reading PDF files needs a reader: pass a function from bytes to page texts")

    def rows(content: bytes):
        return ((n, page) for n, page in enumerate(reader(content), 1) if page.strip())

    return _parse(files, ".pdf", PAGES, rows)
