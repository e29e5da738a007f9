"""Bytes of small workbooks and shapefiles, for queries and tests that read them back."""

from __future__ import annotations

import io
import os
import re
import struct
import sys
import uuid
import zipfile
from datetime import date, datetime
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# tasks get these functions by value, wherever the package is installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _letters(at: int) -> str:
    out = ""
    at += 1
    while at:
        at, rest = divmod(at - 1, 26)
        out = chr(65 + rest) + out
    return out


def _sheet(rows: list[list]) -> str:
    lines = []
    for number, row in enumerate(rows, 1):
        cells = []
        for at, value in enumerate(row):
            ref = f'r="{_letters(at)}{number}"'
            if value is None:
                continue
            if isinstance(value, (bool, np.bool_)):
                cells.append(f'<c {ref} t="b"><v>{int(value)}</v></c>')
            elif isinstance(value, date):
                days = (datetime(*value.timetuple()[:6]) - datetime(1899, 12, 30)).total_seconds() / 86_400
                cells.append(f'<c {ref} s="{2 if isinstance(value, datetime) else 1}"><v>{days - (days < 61):.10f}</v></c>')
            elif isinstance(value, str):
                cells.append(f'<c {ref} t="inlineStr"><is><t>{escape(value)}</t></is></c>')
            else:
                cells.append(f"<c {ref}><v>{value!r}</v></c>")
        lines.append(f'<row r="{number}">{"".join(cells)}</row>')
    return f'<worksheet xmlns="{_NS}"><sheetData>{"".join(lines)}</sheetData></worksheet>'


def xlsx_bytes(sheets: dict[str, list[list]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        names = "".join(
            f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)
        )
        links = "".join(
            f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)
        )
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_NS}" xmlns:r="{_REL}"><sheets>{names}</sheets></workbook>')
        shown = "".join(f'<xf numFmtId="{n}"/>' for n in (0, 14, 164))
        formats = '<numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm:ss"/></numFmts>'
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{_NS}">{formats}<cellXfs count="3">{shown}</cellXfs></styleSheet>')
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            book.writestr(f"xl/worksheets/sheet{i}.xml", _sheet(rows))
    return out.getvalue()


def workbook(pdf: pd.DataFrame) -> pd.DataFrame:
    """One workbook from the rows of a group; its first column names the file."""
    data = pdf.iloc[:, 1:]
    rows = [list(data.columns)] + [[v.item() if hasattr(v, "item") else v for v in r] for r in data.itertuples(index=False)]
    return pd.DataFrame({"path": [f"book{pdf.iloc[0, 0]}.xlsx"], "content": [xlsx_bytes({"data": rows})]})


def spreadsheet(pdf: pd.DataFrame) -> pd.DataFrame:
    """One file from the rows of a group; its first column is the file's path, whose extension says the format."""
    path, data = pdf.iloc[0, 0], pdf.iloc[:, 1:]
    if path.endswith(".xlsx"):
        return pd.DataFrame({"path": [path], "content": workbook(pdf)["content"]})
    text = data.to_csv(sep="|" if path.endswith(".psv") else ",", index=False, lineterminator="\n")
    return pd.DataFrame({"path": [path], "content": [text.encode()]})


def write_files(files: DataFrame, folder: str) -> None:
    """Write ``(path, content)`` rows as files under a folder that all tasks see as a local one."""
    root = re.sub("^file:/+", "/", folder)

    def write(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                target = os.path.join(root, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.{uuid.uuid4().hex}"
                with open(part, "wb") as out:
                    out.write(content)
                os.replace(part, target)  # a task that runs again leaves the same file
            yield batch[["path"]]

    files.mapInPandas(write, "path string").count()


def shp_bytes(areas: list[list[list[tuple[float, float]]]]) -> bytes:
    body = b""
    for number, rings in enumerate(areas, 1):
        points = [p for ring in rings for p in ring]
        starts, at = [], 0
        for ring in rings:
            starts.append(at)
            at += len(ring)
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        record = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(points))
        record += struct.pack(f"<{len(starts)}i", *starts)
        record += b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">2i", number, len(record) // 2) + record
    head = struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2)
    return head + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + body


def dbf_bytes(fields: list[tuple[str, str, int]], rows: list[list]) -> bytes:
    length = 1 + sum(width for _, _, width in fields)
    head = struct.pack("<4BIHH20x", 3, 121, 1, 1, len(rows), 33 + 32 * len(fields), length)
    for name, kind, width in fields:
        head += struct.pack("<11sc4xBB14x", name.encode(), kind.encode(), width, 0)
    body = b""
    for row in rows:
        body += b" " + b"".join(
            ("" if v is None else str(v)).rjust(w).encode() if k == "N" else ("" if v is None else str(v)).ljust(w).encode()
            for v, (_, k, w) in zip(row, fields)
        )
    return head + b"\r" + body + b"\x1a"


def shapefile(pdf: pd.DataFrame) -> pd.DataFrame:
    """A ``.shp``, a ``.dbf`` and a ``.prj`` from the area rows of a group, in ``index_right`` order; ``file`` names them."""
    pdf = pdf.sort_values("index_right")
    stem = f"areas{pdf['file'].iloc[0]:05d}"
    areas = [[[(p["x"], p["y"]) for p in ring] for ring in rings] for rings in pdf["rings"]]
    rows = pdf[["SA1_CODE21", "SA2_CODE21"]].values.tolist()
    fields = [("SA1_CODE21", "N", 12), ("SA2_CODE21", "C", 9)]
    return pd.DataFrame(
        {
            "path": [f"{stem}.shp", f"{stem}.dbf", f"{stem}.prj"],
            "content": [shp_bytes(areas), dbf_bytes(fields, rows), b'GEOGCS["GDA2020",DATUM["x"]]'],
        }
    )
