"""Polygon shapefiles as a Spark source: a scan of ``.shp`` and ``.dbf`` files, joined by record.

A file is cut into pieces of whole records where it is read, which looks at the lengths of records only. The
pieces are dealt over tasks and parsed there, so a large file is the work of many. ``stored_areas`` parses a set of
files once and keeps the area table for whoever asks for them next.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from censusloom.operators.areas import area_table
from censusloom.runtime import shuffle_width

# tasks get these functions by value, wherever the package is installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHAPES = "file string, record long, parts array<int>, xs array<double>, ys array<double>"
VALUES = "file string, record long, cells map<string,string>"
BATCH = 2_000
#: Bytes of the pieces that files are cut into.
PIECE = 1 << 20
# fixed values: shape type codes of polygons in the file format
_POLYGONS = (5, 15, 25)
# fixed values: reference system names as they appear in .prj files
CRS_NAMES = {
    "EPSG:7844": ("GDA2020", "GCS_GDA2020"),
    "EPSG:4283": ("GDA94", "GCS_GDA_1994", "GCS_GDA94"),
    "EPSG:4326": ("WGS 84", "WGS84", "GCS_WGS_1984"),
}


def _stem(path: str) -> str:
    return path.rsplit(".", 1)[0]


def _shape_pieces(content: bytes) -> Iterator[tuple[int, bytes]]:
    """``(number of the first record, records)``: polygons cut between records."""
    at, record, begin, first = 100, 0, 100, 0
    while at + 8 <= len(content):
        (words,) = struct.unpack(">i", content[at + 4 : at + 8])
        at += 8 + 2 * words
        record += 1
        if at - begin >= PIECE:
            yield first, content[begin:at]
            begin, first = at, record
    if begin < len(content):
        yield first, content[begin:]


def _polygons(record: int, piece: bytes) -> Iterator[tuple]:
    at = 0
    while at + 8 <= len(piece):
        (words,) = struct.unpack(">i", piece[at + 4 : at + 8])
        body = at + 8
        (kind,) = struct.unpack("<i", piece[body : body + 4])
        if kind in _POLYGONS:
            parts, points = struct.unpack("<2i", piece[body + 36 : body + 44])
            starts = np.frombuffer(piece, "<i4", parts, body + 44)
            xy = np.frombuffer(piece, "<f8", 2 * points, body + 44 + 4 * parts).reshape(-1, 2)
            yield record, starts, np.ascontiguousarray(xy[:, 0]), np.ascontiguousarray(xy[:, 1])
        else:
            none = np.zeros(0)
            yield record, none.astype("i4"), none, none
        record += 1
        at = body + 2 * words


def _value_pieces(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Attribute rows cut by their fixed length, each piece behind the head of the file."""
    count, start, length = struct.unpack("<IHH", content[4:12])
    many = max(1, PIECE // max(1, length))
    for first in range(0, count, many):
        yield first, content[:start] + content[start + first * length : start + min(count, first + many) * length]


def _records(first: int, piece: bytes) -> Iterator[tuple]:
    _, start, length = struct.unpack("<IHH", piece[4:12])
    fields, at = [], 32
    while piece[at] != 0x0D:
        name = piece[at : at + 11].split(b"\0", 1)[0].decode("latin-1")
        fields.append((name, piece[at + 16]))
        at += 32
    for record in range((len(piece) - start) // max(1, length)):
        row = piece[start + record * length : start + (record + 1) * length]
        cells, offset = {}, 1
        for name, width in fields:
            raw = row[offset : offset + width].strip(b" \0")
            try:
                cells[name] = raw.decode("utf-8") or None
            except UnicodeDecodeError:
                cells[name] = raw.decode("latin-1")
            offset += width
        yield first + record, cells


def _parsed(files: DataFrame, pieces, read, schema: str) -> DataFrame:
    """Rows of all files: cut into pieces by the task that reads a file, parsed by the task that gets a piece."""
    names = [part.split()[0] for part in schema.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for first, piece in pieces(content):
                    yield pd.DataFrame([(_stem(path), first, piece)], columns=["file", "first", "piece"])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, first, piece in zip(batch["file"], batch["first"], batch["piece"]):
                out: list[tuple] = []
                for row in read(first, piece):
                    out.append((file, *row))
                    if len(out) == BATCH:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                yield pd.DataFrame(out, columns=names)

    dealt = files.mapInPandas(cut, "file string, first long, piece binary")
    dealt = dealt.repartition(shuffle_width(files.sparkSession), "file", "first")
    return dealt.mapInPandas(parse, schema)


def _fields(header: bytes) -> list[tuple[str, str]]:
    """Column names and Spark types from the head of a ``.dbf`` file."""
    found, at = [], 32
    while at + 32 <= len(header) and header[at] != 0x0D:
        name = header[at : at + 11].split(b"\0", 1)[0].decode("latin-1")
        kind, decimals = chr(header[at + 11]), header[at + 17]
        if kind in "NI":
            found.append((name, "double" if decimals else "bigint"))
        elif kind == "F":
            found.append((name, "double"))
        elif kind == "L":
            found.append((name, "boolean"))
        else:
            found.append((name, "string"))
        at += 32
    return found


def _columns(dbf: DataFrame) -> list[tuple[str, str]]:
    """Each column name once with its type, in the order of the first file that has it."""

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                (path, i, *column)
                for path, head in zip(batch["path"], batch["head"])
                for i, column in enumerate(_fields(bytes(head)))
            ]
            yield pd.DataFrame(found, columns=["path", "place", "name", "kind"])

    # a head has at most as many bytes as its two-byte length can say
    head = dbf.select("path", F.substring("content", 1, 65535).alias("head"))
    found = head.mapInPandas(heads, "path string, place int, name string, kind string")
    first = found.groupBy("name", "kind").agg(F.min(F.struct("path", "place")).alias("at")).orderBy("at")
    columns: dict[str, str] = {}
    for row in first.select("name", "kind").collect():
        same = columns.setdefault(row["name"], row["kind"]) == row["kind"]
        columns[row["name"]] = row["kind"] if same else "string"
    return list(columns.items())


def areas_from_files(files: DataFrame, crs: str) -> DataFrame:
    """Area table from ``(path, content)`` rows of ``.shp`` and ``.dbf`` files.

    ``index_right`` counts the records through the files in path order. A column that files
    have with different types is text. Only the distinct column names and types reach the driver.
    """
    files = files.select("path", "content")
    shp, dbf = (files.where(F.lower("path").endswith(end)) for end in (".shp", ".dbf"))
    columns = _columns(dbf)

    shapes = _parsed(shp, _shape_pieces, _polygons, SHAPES).select("file", "record", F.expr(_rings()).alias("rings"))
    values = _parsed(dbf, _value_pieces, _records, VALUES)

    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = (  # one row per file
        shapes.groupBy("file")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    )
    joined = (
        shapes.join(starts, "file")
        .join(values, ["file", "record"], "left")
        .select(
            (F.col("start") + F.col("record")).alias("index_right"),
            "rings",
            *[_typed(name, kind) for name, kind in columns],
        )
        .where(F.size("rings") > 0)
    )
    return area_table(joined, crs)


def _rings() -> str:
    ends = "concat(slice(parts, 2, size(parts)), array(size(xs)))"
    ring = (
        "zip_with(slice(xs, s + 1, e - s), slice(ys, s + 1, e - s), (a, b) -> struct(a as x, b as y))"
    )
    return f"zip_with(parts, {ends}, (s, e) -> {ring})"


def _typed(name: str, kind: str):
    text = F.col("cells").getItem(name)
    if kind == "boolean":
        return F.upper(text).isin("T", "Y").alias(name)
    return text.try_cast(kind).alias(name)


def check_crs(spark: SparkSession, path: str, crs: str) -> None:
    """Compare the ``.prj`` files under a folder with the reference system asked for.

    Points are not reprojected, so a different system, or one that cannot be compared, is
    an error. Files without a ``.prj`` are taken at the caller's word.
    """
    texts = spark.read.option("recursiveFileLookup", True).option("wholetext", True).option(
        "pathGlobFilter", "*.prj"
    ).text(path)
    for (text,) in texts.distinct().toLocalIterator():
        name = re.search(r'"([^"]*)"', text or "")
        if name is None or name[1] not in CRS_NAMES.get(crs, ()):
            raise ValueError(f"areas are in {name and name[1]!r}, not in {crs}; reproject them first")


def _shape_files(spark: SparkSession, shapefile_dir: str) -> tuple[str, DataFrame]:
    folder, glob = shapefile_dir, "*"
    if shapefile_dir.lower().endswith(".shp"):
        folder, name = shapefile_dir.rsplit("/", 1)
        glob = re.sub(r"[][{}*?\\]", "?", _stem(name))
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        # by name while listing, so that nothing else in the folder is read
        .option("pathGlobFilter", glob + ".[sdSD][hbHB][pfPF]")
        .load(folder)
    )
    return folder, files


def read_shapefile(spark: SparkSession, shapefile_dir: str, crs: str) -> DataFrame:
    """Area table from the polygon shapefiles in a folder, or from one ``.shp`` with its parts."""
    folder, files = _shape_files(spark, shapefile_dir)
    check_crs(spark, folder, crs)
    return areas_from_files(files, crs)


def stored_areas(spark: SparkSession, shapefile_dir: str, crs: str, store: str) -> DataFrame:
    """``read_shapefile``, parsed once: later calls for the same files read the area table kept under ``store``.

    The table's name is a digest of the paths, lengths and times of the files and of the reference system, so files
    that changed are parsed anew. It is moved to its place when complete, so a job that was cut off leaves nothing
    that is read, and of two jobs at the same time one keeps its table. The files are opened by that one parse only.
    """
    _, files = _shape_files(spark, shapefile_dir)
    facts = files.select(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")), F.count("path")).first()
    name = hashlib.sha256(f"{crs}|{facts[0]}|{facts[1]}".encode()).hexdigest()[:32]
    target, part = f"{store.rstrip('/')}/areas-{name}", f"{store.rstrip('/')}/_areas-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path(target)):
        read_shapefile(spark, shapefile_dir, crs).write.parquet(part)
        if not system.rename(path(part), path(target)) or system.exists(path(f"{target}/{part.rsplit('/', 1)[1]}")):
            system.delete(path(f"{target}/{part.rsplit('/', 1)[1]}"), True)
            system.delete(path(part), True)
    return spark.read.parquet(target).withMetadata("rings", {"crs": crs})
