"""Workbook parsing inside a task: .xlsx bytes in, non-empty sheets out (zip and XML only)."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from .html_tables import ParsedTable

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_BUILTIN_DATE_FORMATS = {*range(14, 23), 45, 46, 47}  # fixed values of the file format


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(_MAIN + "t"))


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    targets = {
        r.get("Id"): r.get("Target")
        for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    }
    out = []
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_MAIN + "sheet"):
        target = targets[s.get(_REL)]
        out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def sheet_names(content: bytes) -> list[str]:
    """Sheet names without reading any sheet; an unreadable file has none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            return [name for name, _ in _sheets(book)]
    except Exception:
        return []


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {
        int(f.get("numFmtId"))
        for f in root.iter(_MAIN + "numFmt")
        if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")), re.I)
    }
    formats = root.find(_MAIN + "cellXfs")
    return {
        i
        for i, xf in enumerate(formats if formats is not None else [])
        if int(xf.get("numFmtId", 0)) in _BUILTIN_DATE_FORMATS | custom
    }


def _value(cell, shared: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _text(cell)
    raw = cell.findtext(_MAIN + "v")
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "True" if raw == "1" else "False"
    if kind == "n" and int(cell.get("s", -1)) in dates:
        return str(dt.datetime(1899, 12, 30) + dt.timedelta(days=float(raw)))
    return raw


def _column(reference: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(letter) - ord("A") + 1
    return n - 1


def _rows(xml: bytes, shared: list[str], dates: set[int]) -> list[list[str | None]]:
    rows: dict[int, dict[int, str | None]] = {}
    at = -1
    for row in ElementTree.fromstring(xml).iter(_MAIN + "row"):
        at = int(row.get("r")) - 1 if row.get("r") else at + 1
        cells: dict[int, str | None] = {}
        col = -1
        for cell in row.iter(_MAIN + "c"):
            col = _column(cell.get("r")) if cell.get("r") else col + 1
            value = _value(cell, shared, dates)
            if value is not None:
                cells[col] = value
        if cells:
            rows[at] = cells
    if not rows:
        return []
    width = max(max(c) for c in rows.values()) + 1
    return [[rows.get(i, {}).get(j) for j in range(width)] for i in range(max(rows) + 1)]


def parse_workbook(content: bytes, sheet: str | None = None) -> Iterator[ParsedTable]:
    """Every sheet with data (or the one asked for); the first row is its header."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = (
            [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
            if "xl/sharedStrings.xml" in names
            else []
        )
        dates = _date_styles(book)
        for name, target in _sheets(book):
            if (sheet is not None and name != sheet) or target not in names:
                continue
            try:
                rows = _rows(book.read(target), shared, dates)
            except Exception as error:
                yield ParsedTable(name, None, [], [], f"Sheet could not be read: {error}")
                continue
            if len(rows) > 1:
                yield ParsedTable(name, None, [[c or "" for c in rows[0]]], rows[1:])
