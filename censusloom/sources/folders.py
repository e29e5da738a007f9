"""Folders of files: listing, picking by name, and reading them keyed or in one scan."""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from censusloom.functions.templates import capture_placeholders, file_path
from censusloom.sources.tables import (
    DETAIL_SCHEMA,
    GEOCODE_SCHEMA,
    get_spreadsheet_reader,
    load,
    read_parquet,
)

log = logging.getLogger(__name__)

#: The states and territories of the address feeds.
STATES = ("NSW", "ACT", "VIC", "QLD", "SA", "WA", "TAS", "NT", "OT")


def qualified(spark: SparkSession, path: str) -> str:
    """A path in the form in which ``list_files`` gives it: absolute, local ones without a scheme."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return re.sub("^file:/+", "/", whole).rstrip("/") or "/"


def list_files(spark: SparkSession, path: str, list_hidden: bool = False) -> DataFrame:
    """``(path, length, modificationTime)`` of all files under a folder.

    Spark does the listing and leaves out names that start with a dot or underscore, and
    what lies in such folders. Contents are not read. ``list_hidden`` lists these too, by the file
    system's own recursive listing on the driver, which Spark's sources do not offer.
    """
    if list_hidden:
        return _list_all(spark, path)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", "modificationTime")
    )


def _list_all(spark: SparkSession, path: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found, files = [], system.listFiles(hadoop, True)
    while files.hasNext():
        status = files.next()
        when = status.getModificationTime()
        found.append((re.sub("^file:/+", "/", status.getPath().toString()), status.getLen(), when))
    rows = spark.createDataFrame(found, "path string, length long, ms long")
    return rows.select("path", "length", F.timestamp_millis("ms").alias("modificationTime"))


def list_tables(
    spark: SparkSession, path: str, extension: str, filter_regex: str | None = None
) -> DataFrame:
    """``path`` of every table under a folder: a file, or a folder of part files, named ``*.ext``."""
    root = F.regexp_extract("path", rf"^(.*?\.{re.escape(extension)})(/.*)?$", 1)
    tables = list_files(spark, path).select(root.alias("path")).where("path != ''").distinct()
    return tables.where(F.col("path").rlike(filter_regex)) if filter_regex else tables


def folder_of(pattern: str) -> str:
    """Folder a file pattern points into: what comes before the part with a placeholder or name."""
    fixed = pattern.split("{", 1)[0]
    if "{" in pattern or re.search(r"\.(psv|csv|xlsx|parquet)$", pattern):
        return fixed.rsplit("/", 1)[0] if "/" in fixed else "."
    return fixed.rstrip("/") or "/"


def _key(pattern: str, path: Column) -> Column:
    """Key of a table: the ``{key}`` part of its path, null where the pattern does not match."""
    if "{key}" not in pattern:
        return F.element_at(F.split(path, "/"), -1)
    found = F.regexp_extract(path, "^" + capture_placeholders(pattern, ["key"], ".+"), 1)
    return F.nullif(found, F.lit(""))


def keyed_paths(
    spark: SparkSession, pattern: str, extension: str, filter_regex: str | None = None
) -> dict[str, str]:
    """Table paths by key. File names are what reaches the driver; two equal keys are an error."""
    pattern = _absolute(spark, pattern)
    tables = list_tables(spark, folder_of(pattern), extension, filter_regex)
    rows = tables.select(_key(pattern, F.col("path")).alias("key"), "path").where("key is not null")
    found: dict[str, str] = {}
    for key, path in sorted(tuple(row) for row in rows.toLocalIterator()):
        if key in found:
            raise ValueError(f"{found[key]} and {path} have the same key {key!r}")
        found[key] = path
    if not found and not tables.isEmpty():
        raise ValueError(f"no {extension} table under {folder_of(pattern)} matches {pattern!r}")
    return found


def _absolute(spark: SparkSession, pattern: str) -> str:
    """The pattern with its folder in the form in which ``list_files`` gives paths."""
    folder = folder_of(pattern)
    rest = pattern[len(folder) :] if pattern.startswith(folder) else "/" + pattern
    return qualified(spark, folder).rstrip("/") + rest if rest.strip("/") else qualified(spark, folder)


def read_spreadsheets(
    spark: SparkSession,
    file_dir_pattern: str,
    extension: str,
    filter_regex: str | None = None,
    schema: T.StructType | None = None,
    multi_line: bool = False,
) -> dict[str, DataFrame]:
    """Every table under a folder, by file name or by the ``{key}`` in the pattern.

    The pattern may be relative or have a scheme. ``filter_regex`` may match anywhere in the path. A table
    that cannot be read is left out with a warning; tables none of which matches the pattern are an
    error. ``schema`` and ``multi_line`` are as in ``load``. For many tables of one schema
    ``scan_folder`` is a single scan.
    """
    get_spreadsheet_reader("." + extension)
    paths = keyed_paths(spark, file_dir_pattern, extension, filter_regex)
    frames = {key: load(spark, path, extension, schema, multi_line) for key, path in paths.items()}
    failed = [key for key, frame in frames.items() if frame is None]
    if failed:
        log.warning("could not read %s", failed)
    return {key: frame for key, frame in frames.items() if frame is not None}


def scan_folder(
    spark: SparkSession,
    file_dir_pattern: str,
    extension: str,
    schema: T.StructType,
    filter_regex: str | None = None,
) -> DataFrame:
    """All tables of one schema under a folder in one scan, with a ``key`` column.

    The pattern may be relative or have a scheme. The path filter is on file metadata, so files it
    excludes are not opened. Corrupt files are skipped. Tables none of which matches are an error.
    """
    file_dir_pattern = _absolute(spark, file_dir_pattern)
    reader = (
        spark.read.schema(schema)
        .option("recursiveFileLookup", True)
        .option("ignoreCorruptFiles", True)
    )
    folder = folder_of(file_dir_pattern)
    if extension == "parquet":
        rows = reader.parquet(folder)
    else:
        rows = reader.options(
            header=True, sep="|" if extension == "psv" else ",", quote='"', escape='"'
        ).csv(folder)
    path = F.regexp_replace(file_path(), "^file:/+", "/")
    root = F.regexp_extract(path, rf"^(.*?\.{re.escape(extension)})(/.*)?$", 1)
    rows = rows.where(F.col("_metadata.file_path").rlike(rf"\.{re.escape(extension)}(/|$)"))
    if filter_regex:
        rows = rows.where(path.rlike(filter_regex))
    tables = list_tables(spark, folder, extension, filter_regex)
    facts = tables.agg(F.count("path"), F.count(_key(file_dir_pattern, F.col("path")))).first()
    if facts[0] and not facts[1]:
        raise ValueError(f"no {extension} table under {folder} matches {file_dir_pattern!r}")
    return rows.withColumn("key", _key(file_dir_pattern, root)).where("key is not null")


def load_gnaf_files_by_states(
    spark: SparkSession, gnaf_path: str, states: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Geocodes with a ``STATE`` column and details cut to three columns, for the given states.

    Tables are named ``{STATE}_ADDRESS_DEFAULT_GEOCODE*.parquet`` and
    ``{STATE}_ADDRESS_DETAIL*.parquet``. Only those of the wanted states are opened. No
    states means all; no table found gives empty frames with the documented columns.
    """
    wanted = "|".join(re.escape(s) for s in (states or STATES))

    def tables(kind: str) -> list[str]:
        regex = rf"(^|[^A-Za-z])({wanted})_{kind}[^/]*\.parquet$"
        return sorted(r.path for r in list_tables(spark, gnaf_path, "parquet", regex).toLocalIterator())

    geocode_paths, detail_paths = tables("ADDRESS_DEFAULT_GEOCODE"), tables("ADDRESS_DETAIL")
    if geocode_paths:
        state = F.regexp_extract(
            F.col("_metadata.file_path"), rf"({wanted})_ADDRESS_DEFAULT_GEOCODE[^/]*\.parquet", 1
        )
        geocode = read_parquet(spark, geocode_paths).withColumn("STATE", state)
    else:
        geocode = spark.createDataFrame([], T.StructType([*GEOCODE_SCHEMA, T.StructField("STATE", T.StringType())]))
    if detail_paths:
        detail = read_parquet(spark, detail_paths).select(*DETAIL_SCHEMA.names)
    else:
        detail = spark.createDataFrame([], DETAIL_SCHEMA)
    return geocode, detail
