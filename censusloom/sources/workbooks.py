"""Workbooks (.xlsx) as a Spark source: a scan of files, unpacked row by row in the tasks.

A workbook is unpacked once, to a table of cells with their kinds; sheets, headers, types and rows are taken from
that. A number is a date or a time of a day if the format of its cell says so.
"""

from __future__ import annotations

import io
import re
import sys
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from censusloom.runtime import written
from censusloom.sources import records

# tasks get these functions by value, wherever the package is installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELLS = "path string, sheet string, sheet_no int, row long, kinds array<string>, cells array<string>"
#: Rows handed over at a time.
BATCH = 5_000
# fixed values: names of the file format
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# fixed values: numbers of the built-in formats that show a date
_DATE_FORMATS = {*range(14, 18), 22, *range(27, 32), *range(34, 37), *range(50, 59)}
#: SQL text for the bit of a cell's kind, of a struct ``c`` of its text ``cells`` and its ``kinds``.
CELL_KIND = (
    f"case c.kinds when 'n' then if(c.cells rlike '^-?[0-9]{{1,18}}$', {records.LONG}, {records.DOUBLE}) when 'b' then {records.BOOLEAN} "
    f"when 'd' then {records.DATE} when 't' then {records.MOMENT} when 's' then {records.TEXT} else 0 end"
)


def _texts(node) -> str:
    return "".join(t.text or "" for t in node.iter(_MAIN + "t"))


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as part:
        return [_texts(n) for _, n in ElementTree.iterparse(part) if n.tag == _MAIN + "si"]


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """``(name, part)`` of the sheets in workbook order."""
    links = {
        link.get("Id"): link.get("Target")
        for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    }
    found = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_MAIN + "sheet"):
        target = links[sheet.get(_LINK)].lstrip("/")
        found.append((sheet.get("name"), target if target.startswith("xl/") else "xl/" + target))
    return found


def _column(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        number = number * 26 + ord(letter) - 64
    return number - 1


def _dated(book: zipfile.ZipFile) -> tuple[set[str], bool]:
    """Numbers of the cell styles that show a date, and whether days count from 1904."""
    old = ElementTree.fromstring(book.read("xl/workbook.xml")).find(_MAIN + "workbookPr")
    from_1904 = old is not None and old.get("date1904") in ("1", "true")
    if "xl/styles.xml" not in book.namelist():
        return set(), from_1904
    styles = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = set()
    for node in styles.iter(_MAIN + "numFmt"):
        shown = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.', "", node.get("formatCode", "")).split(";")[0].lower()
        if re.search("[yd]", shown) and not re.search("[0#?]", shown.replace(".0", "").replace(".00", "")):
            own.add(int(node.get("numFmtId")))
    formats = styles.find(_MAIN + "cellXfs")
    shows = [int(xf.get("numFmtId", 0)) for xf in (formats if formats is not None else ())]
    return {str(i) for i, number in enumerate(shows) if number in own or (number in _DATE_FORMATS and number < 164)}, from_1904


def _moment(text: str, from_1904: bool) -> tuple[str, str]:
    """A day number as ``d`` date or ``t`` date and time; one with no date stays a number."""
    days = float(text)
    # days before March 1900 are numbered as if that year had a leap day
    begin = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30) + timedelta(days < 60)
    try:
        when = begin + timedelta(milliseconds=round(days * 86_400_000))
    except OverflowError:
        return "n", text
    if days < 0 or days != days:
        return "n", text
    return ("d", when.date().isoformat()) if when.time() == datetime.min.time() else ("t", when.isoformat(" "))


def _cell(node, shared: list[str], dated: set[str], from_1904: bool) -> tuple[str, str] | None:
    """``(kind, text)`` of a cell: ``n`` number, ``b`` boolean, ``d`` date, ``t`` date and time, ``s`` text."""
    kind = node.get("t", "n")
    if kind == "inlineStr":
        return "s", _texts(node)
    value = node.find(_MAIN + "v")
    if value is None or value.text is None:
        return None
    if kind == "s":
        return "s", shared[int(value.text)]
    if kind == "b":
        return "b", "true" if value.text == "1" else "false"
    if kind == "n" and node.get("s") in dated:
        return _moment(value.text, from_1904)
    return ("n" if kind == "n" else "s"), value.text


def _rows(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared, styles = _shared(book), _dated(book)
        for sheet_no, (name, part) in enumerate(_sheets(book), 1):
            with book.open(part) as xml:
                line = 0
                for _, node in ElementTree.iterparse(xml):
                    if node.tag != _MAIN + "row":
                        continue
                    line = int(node.get("r", line + 1))
                    cells: dict[int, tuple[str, str] | None] = {}
                    for cell in node.iter(_MAIN + "c"):
                        at = _column(cell.get("r")) if cell.get("r") else len(cells)
                        cells[at] = _cell(cell, shared, *styles)
                    node.clear()
                    filled = [cells.get(i) or (None, None) for i in range(max(cells, default=-1) + 1)]
                    yield name, sheet_no, line, [k for k, _ in filled], [t for _, t in filled]


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "sheet", "sheet_no", "row", "kinds", "cells"]
    for files in batches:
        for path, content in zip(files["path"], files["content"]):
            out: list[tuple] = []
            try:
                for row in _rows(content):
                    out.append((path, *row))
                    if len(out) == BATCH:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError):
                # not a workbook: one row without a sheet says so
                out.append((path, None, None, None, None, None))
            yield pd.DataFrame(out, columns=names)


def workbook_cells(files: DataFrame) -> DataFrame:
    """Unpack ``(path, content)`` rows to one row per sheet row, with the kind of each cell.

    A file that is no workbook gives one row whose ``sheet`` is null.
    """
    return files.select("path", "content").mapInPandas(_unpack, CELLS)


def scan_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Cells of every workbook under a folder, or of one file."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.xlsx")
        .load(path)
    )
    return workbook_cells(files)


def sheet_table(cells: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Table of one sheet: its first row names the columns, the kinds of the cells type them.

    One row reaches the driver for the header and one for the kinds, both as long as the sheet is wide.
    Columns that ``schema`` names get its types.
    """
    head = cells.agg(F.min("row").alias("row"), F.min_by("cells", "row").alias("names")).first()
    if head.row is None:
        return cells.sparkSession.createDataFrame([], "_ string").drop("_")
    names = [name or f"column_{at + 1}" for at, name in enumerate(head.names)]
    given = {f.name: f.dataType.simpleString() for f in schema or []}
    body = cells.where(F.col("row") > head.row)
    bits = records.kinds(body.select(F.arrays_zip("cells", "kinds").alias("cells")), [], len(names), CELL_KIND).first().kinds
    types = [given.get(name, records.kind_type(bit)) for name, bit in zip(names, bits)]
    return body.select(*records.typed(body, names, types, "get(cells, {0})"))


def read_xlsx(
    spark: SparkSession, path: str, sheet_id: int = 1, schema: T.StructType | None = None
) -> dict[str, DataFrame] | DataFrame | None:
    """One sheet of a workbook by number, or all by name for ``sheet_id=0``; ``None`` on error.

    The workbook is unpacked once, and its cells are written to the scratch folder.
    """
    try:
        cells = written(scan_workbooks(spark, path), "workbook-cells")
        named = cells.groupBy("sheet_no", "sheet").count().orderBy("sheet_no").collect()
    except AnalysisException:
        return None
    sheets = {r.sheet_no: r.sheet for r in named if r.sheet is not None}
    if sheet_id and sheet_id not in sheets:
        return None
    if not sheets:
        return None
    tables = {
        name: sheet_table(cells.where(F.col("sheet_no") == number), schema)
        for number, name in sheets.items()
        if sheet_id in (0, number)
    }
    return tables if sheet_id == 0 else next(iter(tables.values()))
