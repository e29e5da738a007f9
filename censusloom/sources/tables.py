"""Readers for delimited text and Parquet, and the choice among them by extension."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T

from censusloom.sources.records import read_broken

log = logging.getLogger(__name__)

#: Columns of the two address feeds the library relies on.
GEOCODE_SCHEMA = T.StructType(
    [
        T.StructField("ADDRESS_DETAIL_PID", T.StringType()),
        T.StructField("GEOCODE_TYPE_CODE", T.StringType()),
        T.StructField("LATITUDE", T.DoubleType()),
        T.StructField("LONGITUDE", T.DoubleType()),
    ]
)
DETAIL_SCHEMA = T.StructType(
    [
        T.StructField("ADDRESS_DETAIL_PID", T.StringType()),
        T.StructField("FLAT_TYPE_CODE", T.StringType()),
        T.StructField("POSTCODE", T.LongType()),
    ]
)


def _delimited(
    spark: SparkSession, path: str | list[str], separator: str, schema: T.StructType | None, multi_line: bool
) -> DataFrame | None:
    reader = spark.read.options(header=True, sep=separator, quote='"', escape='"', multiLine=False)
    try:
        if multi_line:
            split = read_broken(spark, path, separator, schema)
            if split is not None:
                return split
            reader = reader.option("multiLine", True)
        if schema is None:
            found = reader.option("inferSchema", True).csv(path).schema
            # dates and times stay text, as they are written
            schema = T.StructType(
                [
                    T.StructField(f.name, T.StringType())
                    if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
                    else f
                    for f in found
                ]
            )
        return reader.schema(schema).csv(path)
    except AnalysisException as error:
        log.warning("cannot read %s: %s", path, error)
        return None


def read_psv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False
) -> DataFrame | None:
    """Pipe-separated text with a header; ``None`` if it cannot be read.

    Without a schema the types are inferred, which reads the file twice. A quote inside a
    quoted field is doubled. ``multi_line`` allows line breaks in quoted fields; such files are
    split among tasks too, see ``sources.records``.
    """
    return _delimited(spark, path, "|", schema, multi_line)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False
) -> DataFrame | None:
    """Comma-separated text with a header; ``None`` if it cannot be read."""
    return _delimited(spark, path, ",", schema, multi_line)


def read_parquet(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = None
) -> DataFrame | None:
    """Parquet; ``None`` if it cannot be read."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(*([path] if isinstance(path, str) else path))
    except AnalysisException as error:
        log.warning("cannot read %s: %s", path, error)
        return None


def get_spreadsheet_reader(extension: str) -> Callable[..., DataFrame | dict | None]:
    """Reader for ``.psv``, ``.csv``, ``.xlsx`` or ``.parquet``."""
    from censusloom.sources.workbooks import read_xlsx

    readers = {".psv": read_psv, ".csv": read_csv, ".xlsx": read_xlsx, ".parquet": read_parquet}
    if extension not in readers:
        raise ValueError(f"no reader for {extension!r}, only for {sorted(readers)}")
    return readers[extension]


def load(spark: SparkSession, path: str, fmt: str, schema: T.StructType | None = None, multi_line: bool = False):
    """Read a file or folder in the named format (``"csv"``, ``"psv"``, ``"xlsx"``, ``"parquet"``).

    ``multi_line`` is for line breaks in quoted fields and means nothing for the last two formats.
    """
    fmt = fmt.lstrip(".")
    options = {} if schema is None else {"schema": schema}
    if multi_line and fmt in ("csv", "psv"):
        options["multi_line"] = True
    return get_spreadsheet_reader("." + fmt)(spark, path, **options)
