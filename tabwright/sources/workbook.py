"""Spreadsheet workbooks (.xlsx: a zip of XML parts) as a distributed source."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tabwright.session import ship_with_tasks

ship_with_tasks(__name__)

_CHUNK = 10_000
# Built-in number formats that show dates or times.
_DATE_FORMATS = set(range(14, 23)) | set(range(45, 48))


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _text(element) -> str:
    return "".join(t.text or "" for t in element.iter() if _tag(t) == "t")


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = next(e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _tag(e) == "sheet")
    wanted = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(e.attrib["Target"] for e in links if e.attrib["Id"] == wanted)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    dated = set(_DATE_FORMATS)
    for e in root.iter():
        code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", e.attrib.get("formatCode", ""))
        if _tag(e) == "numFmt" and re.search(r"[ymdhs]", code.lower()):
            dated.add(int(e.attrib["numFmtId"]))
    styles = [e for e in root.iter() if _tag(e) == "cellXfs"]
    cells = list(styles[0]) if styles else []
    return {i for i, e in enumerate(cells) if int(e.attrib.get("numFmtId", 0)) in dated}


def _cell(element, shared: list[str], dated: set[int]) -> str | None:
    kind = element.attrib.get("t", "n")
    if kind == "inlineStr":
        return _text(element)
    raw = next((e.text for e in element if _tag(e) == "v"), None)
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "true" if raw == "1" else "false"
    if kind == "n" and int(element.attrib.get("s", -1)) in dated:
        return (datetime(1899, 12, 30) + timedelta(days=float(raw))).isoformat(timespec="seconds")
    return raw


def _column_index(reference: str) -> int:
    index = 0
    for letter in reference.rstrip("0123456789"):
        index = index * 26 + ord(letter) - ord("A") + 1
    return index - 1


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Cells of the first sheet, row by row, as text."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = [_text(e) for e in root if _tag(e) == "si"]
        dated = _date_styles(book)
        with book.open(_first_sheet(book)) as part:
            for _, element in ElementTree.iterparse(part):
                if _tag(element) != "row":
                    continue
                row: list[str | None] = []
                for position, cell in enumerate(element):
                    at = _column_index(cell.attrib["r"]) if "r" in cell.attrib else position
                    row.extend([None] * (at + 1 - len(row)))
                    row[at] = _cell(cell, shared, dated)
                element.clear()
                yield row


def _explode_books(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows = sheet_rows(content)
            header = [str(h) if h is not None else f"Unnamed: {i}" for i, h in enumerate(next(rows, []))]
            header = _told_apart(header)
            chunk: list[list[str | None]] = []
            for row in rows:
                wide = max((i + 1 for i, cell in enumerate(row) if cell is not None), default=0)
                if wide > len(header):  # cells beyond the header get columns of their own from here on
                    if chunk:
                        yield pd.DataFrame({"path": path, "header": [header] * len(chunk), "cells": chunk})
                        chunk = []
                    header = _told_apart(header + [f"Unnamed: {i}" for i in range(len(header), wide)])
                chunk.append((row + [None] * len(header))[: len(header)])
                if len(chunk) == _CHUNK:
                    yield pd.DataFrame({"path": path, "header": [header] * len(chunk), "cells": chunk})
                    chunk = []
            if chunk:
                yield pd.DataFrame({"path": path, "header": [header] * len(chunk), "cells": chunk})


def _told_apart(header: list[str]) -> list[str]:
    """Repeated names get a number, so no column is lost."""
    seen: set[str] = set()
    for i, wanted in enumerate(header):
        name, n = wanted, 0
        while name in seen or (n and name in header):
            n += 1
            name = f"{wanted}.{n}"
        header[i] = name
        seen.add(name)
    return header


def read_workbooks(files: DataFrame) -> DataFrame:
    """(path, content) files to one table of text columns, matched by header name."""
    rows = files.select("path", "content").mapInPandas(
        _explode_books, "path string, header array<string>, cells array<string>"
    )
    # Only header rows travel to the driver: one short list per distinct layout.
    layouts = [r["header"] for r in rows.select("header").distinct().collect()]
    names = list(dict.fromkeys(n for layout in sorted(layouts, key=len, reverse=True) for n in layout))

    def pick(name: str):
        at = F.array_position("header", name).cast("int")
        return F.when(at > 0, F.get("cells", at - 1)).alias(name)

    return rows.select(*[pick(n) for n in names])
