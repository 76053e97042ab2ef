"""XLSX workbooks of text cells, by the open format itself: a zip of XML parts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from typing import BinaryIO
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MAX_ROWS, MAX_COLUMNS, MAX_CELL = 1_048_576, 16_384, 32_767
#: Where a table of many workbooks goes on with the next one: rows, and characters of their XML.
PART_ROWS, PART_XML = 100_000, 64_000_000

#: Characters that XML 1.0 cannot hold; the format writes them as _xHHHH_.
_ODD = re.compile("[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")
_CODED = re.compile("_x([0-9A-Fa-f]{4})_")


def column_name(k: int) -> str:
    """Letters of a column from 0."""
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


def column_number(place: str) -> int:
    k = 0
    for c in place.rstrip("0123456789"):
        k = k * 26 + ord(c) - 64
    return k - 1


def _row(number: int, values: Sequence[str | None]) -> str:
    cells = []
    for k, v in enumerate(values):
        if v is not None:
            if len(v) > MAX_CELL:
                raise ValueError(f"row {number}: a cell holds at most {MAX_CELL} characters")
            text = escape(_ODD.sub(lambda m: f"_x{ord(m[0]):04X}_", v))
            cells.append(f'<c r="{column_name(k)}{number}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>')
    return f'<row r="{number}">{"".join(cells)}</row>'


def write_sheet(path: str | BinaryIO, names: Sequence[str], rows: Iterable[Sequence[str | None]], sheet: str = "Sheet1") -> None:
    """A workbook of one sheet; null cells are left out. Rows are written as they come."""
    _write(path, names, (_row(number, row) for number, row in enumerate(rows, 2)), sheet)


def write_parts(names: Sequence[str], rows: Iterable[Sequence[str | None]]) -> Iterator[bytes]:
    """Workbooks of at most PART_ROWS rows, one after the other; at least one. Each ends with a line break, as the comment of its zip."""
    rows = iter(rows)
    ahead = next(rows, None)

    def part() -> Iterator[str]:
        nonlocal ahead
        number, size = 2, 0
        while ahead is not None and number < PART_ROWS + 2 and size < PART_XML:
            yield (line := _row(number, ahead))
            number, size, ahead = number + 1, size + len(line), next(rows, None)

    while True:
        made = io.BytesIO()
        _write(made, names, part(), "Sheet1", b"\n")
        yield made.getvalue()
        if ahead is None:
            return


def _write(path: str | BinaryIO, names: Sequence[str], lines: Iterable[str], sheet: str, comment: bytes = b"") -> None:
    if len(names) > MAX_COLUMNS:
        raise ValueError(f"a sheet has at most {MAX_COLUMNS} columns")
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kinds = {"/xl/workbook.xml": "sheet.main", "/xl/worksheets/sheet1.xml": "worksheet"}
    types = "".join(f'<Override PartName="{n}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{k}+xml"/>' for n, k in kinds.items())
    relation = lambda kind, target: f'{head}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/{kind}" Target="{target}"/></Relationships>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", relation("officeDocument", "xl/workbook.xml"))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", relation("worksheet", "worksheets/sheet1.xml"))
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as out:
            out.write(f'{head}<worksheet xmlns="{MAIN}"><sheetData>{_row(1, names)}'.encode())
            for number, line in enumerate(lines, 2):
                if number > MAX_ROWS:
                    raise ValueError(f"a sheet has at most {MAX_ROWS - 1} rows below its names; write_workbooks has no such limit")
                out.write(line.encode())
            out.write(b"</sheetData></worksheet>")
        z.comment = comment


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) in the workbook's order."""
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    listed = ET.fromstring(z.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet")
    paths = [(s.get("name"), targets[s.get(f"{{{RELATIONS}}}id")]) for s in listed]
    return [(name, t.lstrip("/") if t.startswith("/") else f"xl/{t}") for name, t in paths]


def sheet_names(path: str) -> list[str]:
    with zipfile.ZipFile(path) as z:
        return [name for name, _ in _sheets(z)]


def _text(node: ET.Element) -> str:
    """All text of a string item but its phonetic runs."""
    runs = [node, *node.iterfind(f"{{{MAIN}}}r")]
    plain = "".join(t.text or "" for r in runs for t in r.iterfind(f"{{{MAIN}}}t"))
    return _CODED.sub(lambda m: chr(int(m[1], 16)), plain)


def read_lines(path: str | BinaryIO, sheet: str | int = 0) -> Iterator[dict[int, str]]:
    """Cells of each row by the number of their column, one row after the other."""
    with zipfile.ZipFile(path) as z:
        part = _sheets(z)[sheet][1] if isinstance(sheet, int) else dict(_sheets(z))[sheet]
        shared = [_text(n) for n in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        with z.open(part) as stream:
            for _, row in ET.iterparse(stream):
                if row.tag != f"{{{MAIN}}}row":
                    continue
                line: dict[int, str] = {}
                for k, cell in enumerate(row.iterfind(f"{{{MAIN}}}c")):
                    kind, value = cell.get("t"), cell.findtext(f"{{{MAIN}}}v")
                    if kind == "inlineStr":
                        value = _text(cell.find(f"{{{MAIN}}}is"))
                    elif value is not None and kind == "s":
                        value = shared[int(value)]
                    elif value is not None and kind == "b":
                        value = "TRUE" if value == "1" else "FALSE"
                    if value is not None:
                        line[column_number(cell.get("r")) if cell.get("r") else k] = value
                yield line
                row.clear()


def read_sheet(path: str | BinaryIO, sheet: str | int = 0) -> tuple[list[str], list[tuple]]:
    """Column names and rows of text. Cells keep the file's own text: numbers as stored, truth values as TRUE and FALSE; dates are
    serial numbers there. Unnamed columns are called by their letters."""
    lines = list(read_lines(path, sheet))
    if not lines:
        return [], []
    names = [lines[0].get(k, column_name(k)) for k in range(max((max(x, default=-1) for x in lines), default=-1) + 1)]
    return names, [tuple(x.get(k) for k in range(len(names))) for x in lines[1:]]
