"""Writers."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from censusloom.functions.templates import plain_path
from censusloom.runtime import broadcast_if, written
from censusloom.sources import records
from censusloom.sources.folders import list_files, qualified
from censusloom.sources.workbooks import CELL_KIND, workbook_cells

log = logging.getLogger(__name__)

#: Spark's own ``lz4`` uses another framing that few Parquet readers know.
CODECS = {"gzip": "gzip", "lz4": "lz4_raw", "zstd": "zstd"}
#: Folders moved at a time; a move is one short call to the file system.
MOVES = 16


def to_parquet(
    df: DataFrame,
    path: str,
    compression: str = "lz4",
    partition_by: str | None = None,
    mode: str = "errorifexists",
) -> None:
    """Write Parquet, compressed with gzip, lz4 or zstd."""
    if compression not in CODECS:
        raise ValueError(f"compression must be one of {sorted(CODECS)}, not {compression!r}")
    writer = df.write.mode(mode).option("compression", CODECS[compression])
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def write_csv_in_chunks(
    df: DataFrame, output_path: str, chunk_size: int = 50_000, mode: str = "overwrite"
) -> None:
    """Write a folder of CSV files with headers, each of at most ``chunk_size`` rows."""
    df.write.mode(mode).options(
        header=True, maxRecordsPerFile=chunk_size, quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(output_path)


#: Text bytes of a CSV file written in order, and what a value of a type takes in it at a guess.
FILE_BYTES = 128 << 20
_WIDTHS = {"boolean": 6, "int": 8, "bigint": 12, "double": 20}


def write_csv_in_order(
    df: DataFrame, output_path: str, id_col: str, total: int, file_bytes: int = FILE_BYTES, chunk_size: int | None = None,
    mode: str = "overwrite",
) -> None:
    """Write CSV files of about ``file_bytes`` each whose rows follow ``id_col``, within a file and over file names.

    ``id_col`` numbers the rows from 0, below ``total``. Hence the ids where files begin are known beforehand: a row's
    file is found by a division, with no sample and no global sort, and only a file's rows are sorted.
    ``chunk_size`` bounds the rows of a file as well.
    """
    row_bytes = sum(_WIDTHS.get(f.dataType.simpleString(), 24) for f in df.schema)
    rows = max(1, file_bytes // row_bytes)
    files = max(1, -(-total // rows))
    rows = max(1, -(-total // files))
    place = F.least(F.col(id_col) / F.lit(rows), F.lit(files - 1)).cast("int")
    ordered = df.repartitionById(files, F.greatest(place, F.lit(0))).sortWithinPartitions(id_col)
    options = {} if chunk_size is None else {"maxRecordsPerFile": chunk_size}
    ordered.write.mode(mode).options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options
    ).csv(output_path)


def pending_conversions(spark: SparkSession, input_dir: str, output_dir: str) -> DataFrame:
    """``(path, extension, target)`` of the spreadsheets that have no finished Parquet yet.

    A target counts as finished when it holds committed files. What a cut-off conversion
    left behind lies in a temporary folder, which is not listed, so it is done again. Two
    inputs with the same target are an error.
    """
    input_dir, output_dir = qualified(spark, input_dir), qualified(spark, output_dir)
    relative = F.substring(F.col("path"), len(input_dir.rstrip("/")) + 2, 1 << 30)
    todo = (
        list_files(spark, input_dir)
        .withColumn("extension", F.lower(F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1)))
        .where(F.col("extension").isin(".xlsx", ".xls", ".csv", ".psv"))
        .select(
            "path",
            "extension",
            F.concat(
                F.lit(output_dir.rstrip("/") + "/"),
                F.regexp_replace(relative, r"\.[A-Za-z]+$", ".parquet"),
            ).alias("target"),
        )
    )
    clash = todo.groupBy("target").agg(F.min("path"), F.max("path"), F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if clash:
        raise ValueError(f"{clash[1]} and {clash[2]} would both become {clash[0]}")
    return todo.join(_finished(spark, output_dir), "target", "left_anti").select(
        "path", "extension", "target"
    )


def _finished(spark: SparkSession, output_dir: str) -> DataFrame:
    """``target`` folders under the output that hold data files."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(output_dir)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "target string")
    root = F.regexp_extract("path", r"^(.*\.parquet)/[^/]+$", 1)
    return list_files(spark, output_dir).select(root.alias("target")).where("target != ''").distinct()


class Converted(dict[str, str]):
    """Target by source of what was converted; ``columns`` has the names and types of each target."""

    def __init__(self) -> None:
        super().__init__()
        self.columns: dict[str, tuple[Sequence[str], Sequence[str]]] = {}


def read_converted(spark: SparkSession, done: Converted) -> list[DataFrame]:
    """What was converted, as one scan for all files with the same columns and types."""
    groups: dict[tuple, list[str]] = {}
    for target in done.values():
        groups.setdefault(done.columns[target], []).append(target)
    return [spark.read.schema(_no_rows(spark, *columns).schema).parquet(*targets) for columns, targets in groups.items()]


def convert_to_parquet(
    spark: SparkSession, input_dir: str, output_dir: str, schema: T.StructType | None = None
) -> Converted:
    """Convert every spreadsheet under a folder to Parquet at the mirrored path.

    Finished targets are skipped, and a file that cannot be read is logged and passed over. Columns that
    ``schema`` names get its types, the others those of their values, file by file. Line breaks in quoted
    fields are kept. Returns what was converted, target by source.

    Files of a format are read together: once for their headers and quotes, once for the kinds of their
    values, and once for each group of files with the same columns, which is one write. A group is written
    by file to a staging folder beside the targets, and a file's folder is moved to its target when the group
    is complete. Names, headers and kinds of files reach the driver, their rows do not.
    """
    rows = pending_conversions(spark, input_dir, output_dir).toLocalIterator()
    work: dict[str, dict[str, str]] = {}
    for row in rows:
        work.setdefault(row.extension, {})[row.path] = row.target
    for path in work.pop(".xls", {}):
        log.error("cannot convert %s: no reader for .xls", path)
    given = {f.name.lower(): f.dataType.simpleString() for f in schema or []}
    staging = f"{qualified(spark, output_dir)}/_converting-{uuid.uuid4().hex}"
    done = Converted()
    try:
        for extension, targets in sorted(work.items()):
            kind = _Workbooks if extension == ".xlsx" else _Texts
            _convert(kind(spark, list(targets), extension), targets, given, staging, done)
    finally:
        _delete(spark, staging)
    return done


class _Texts:
    """Delimited files to convert: headers, kinds, and the rows of a group of them."""

    def __init__(self, spark: SparkSession, paths: list[str], extension: str):
        self.spark, self.separator = spark, records.SEPARATORS[extension]
        self.quotes = records.Quotes(spark, paths)
        self.files = {plain_path(file): file for file in self.quotes.heads}
        heads = {plain_path(file): head for file, head in self.quotes.heads.items() if file not in self.quotes.unclosed}
        long = [path for path, head in heads.items() if head.count('"') % 2]
        if long:
            found = records.records(spark, long, self.quotes).where("first").select("file", "record")
            heads |= {plain_path(r.file): r.record for r in found.toLocalIterator()}
        self.names = {path: tuple(records.header_names(head, self.separator)) for path, head in heads.items()}
        self.names = {path: names for path, names in self.names.items() if names}

    def rows(self, paths: list[str], width: int) -> DataFrame:
        found = records.records(self.spark, paths, self.quotes).where("not first")
        path = F.regexp_replace(F.url_decode(F.regexp_replace("file", r"\+", "%2B")), "^file:/+", "/")
        return records.cells(found, self.separator, width).select(path.alias("path"), "cells")

    def kinds(self) -> dict[str, list[int]]:
        if not self.names:
            return {}
        width = max(map(len, self.names.values()))
        rows = records.kinds(self.rows(self.quotes.paths, width), ["path"], width)
        return {r.path: r.kinds for r in rows.toLocalIterator()}


class _Workbooks:
    """The first sheets of workbooks: unpacked once, written, and read from there."""

    def __init__(self, spark: SparkSession, paths: list[str], extension: str):
        files = spark.read.format("binaryFile").load(paths).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
        self.cells = written(workbook_cells(files).where("sheet_no = 1"), "workbook-cells")
        heads = self.cells.groupBy("path").agg(F.min("row").alias("head"), F.min_by("cells", "row").alias("names"))
        found = {r.path: r for r in heads.toLocalIterator()}
        self.names = {path: tuple(n or f"column_{i + 1}" for i, n in enumerate(r.names)) for path, r in found.items()}
        self.heads = heads.select("path", "head")

    def rows(self, paths: list[str], width: int) -> DataFrame:
        cells = self.cells.join(self.heads, "path").where("row > head")
        return cells.select("path", F.slice("cells", 1, width).alias("cells"), F.slice("kinds", 1, width).alias("kinds"))

    def kinds(self) -> dict[str, list[int]]:
        if not self.names:
            return {}
        width = max(map(len, self.names.values()))
        rows = self.rows([], width).select("path", F.arrays_zip("cells", "kinds").alias("cells"))
        return {r.path: r.kinds for r in records.kinds(rows, ["path"], width, CELL_KIND).toLocalIterator()}


def _convert(source: _Texts | _Workbooks, targets: dict[str, str], given: dict[str, str], staging: str, done: Converted) -> None:
    """Convert the files of one format, those with the same columns together, and add them to ``done``."""
    kinds, groups = source.kinds(), {}
    for path in targets:
        if path not in source.names:
            log.error("cannot convert %s: unreadable", path)
            continue
        names = source.names[path]
        bits = kinds.get(path) or [0] * len(names)
        types = tuple(given.get(n.lower(), records.kind_type(b)) for n, b in zip(names, bits))
        groups.setdefault((names, types), []).append(path)
    for (names, types), paths in groups.items():
        todo = [paths]
        while todo:
            some = todo.pop()
            try:
                _write_group(source, names, types, {p: targets[p] for p in some}, f"{staging}/{uuid.uuid4().hex}")
                done |= {p: targets[p] for p in some}
                done.columns |= {targets[p]: (names, types) for p in some}
            except (PySparkException, Py4JError) as error:
                if len(some) == 1:
                    log.error("cannot convert %s: %s", some[0], error)
                else:  # the others of the group are converted without the one that can't be
                    todo += [some[: len(some) // 2], some[len(some) // 2 :]]


def _write_group(
    source: _Texts | _Workbooks, names: Sequence[str], types: Sequence[str], targets: dict[str, str], staging: str
) -> None:
    """One scan and one write for files with the same columns; then every file's folder goes to its target."""
    spark = source.spark if isinstance(source, _Texts) else source.cells.sparkSession
    order = sorted(targets)
    numbers = spark.createDataFrame(list(zip(order, range(len(order)))), "path string, __file int")
    numbers = broadcast_if(numbers, sum(map(len, order)) + 64 * len(order))
    rows = source.rows(order, len(names)).join(numbers, "path")
    columns = records.typed(rows, names, types, "get(cells, {0})")
    # the staging folder is private to this write, so tasks may move what they wrote to it by themselves
    writer = rows.select("__file", *columns).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.partitionBy("__file").parquet(staging)
    files = _Files(spark, staging)
    with_rows = files.numbers("__file")
    if len(with_rows) < len(order):
        _no_rows(spark, names, types).write.parquet(f"{staging}/empty")
    files.make({target.rsplit("/", 1)[0] for target in targets.values()})

    def move(number: int, path: str) -> None:
        if number in with_rows:
            files.move(f"{staging}/__file={number}", targets[path])
        else:
            files.move(f"{staging}/empty", targets[path], copy=True)

    with ThreadPoolExecutor(MOVES) as pool:
        list(pool.map(move, range(len(order)), order))


def _no_rows(spark: SparkSession, names: Sequence[str], types: Sequence[str]) -> DataFrame:
    return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in zip(names, types)])


def _delete(spark: SparkSession, folder: str) -> None:
    files = _Files(spark, folder)
    files.system.delete(files.path(folder), True)


class _Files:
    """The file system of a folder. What each call needs from the JVM is looked up once, as every look-up is a round trip."""

    def __init__(self, spark: SparkSession, folder: str):
        fs = spark._jvm.org.apache.hadoop.fs
        self.path, self.util, self.conf = fs.Path, fs.FileUtil, spark._jsc.hadoopConfiguration()
        self.folder = self.path(folder)
        self.system = self.folder.getFileSystem(self.conf)

    def numbers(self, column: str) -> set[int]:
        """Values of the folders that a write by a column of numbers left."""
        names = [path.getName() for path in self.util.stat2Paths(self.system.listStatus(self.folder))]
        return {int(name.split("=")[1]) for name in names if name.startswith(f"{column}=")}

    def make(self, folders: set[str]) -> None:
        for folder in folders:
            self.system.mkdirs(self.path(folder))

    def move(self, folder: str, target: str, copy: bool = False) -> None:
        """Put a finished folder in the place of what a cut-off conversion may have left there."""
        source, path = self.path(folder), self.path(target)
        self.system.delete(path, True)
        if copy:
            self.util.copy(self.system, source, self.system, path, False, self.conf)
        elif not self.system.rename(source, path):
            raise PySparkException(f"cannot move {folder} to {target}")
