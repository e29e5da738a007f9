"""Filters and joins on address tables."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Longer lists become a semi-join, which Spark broadcasts if its estimate of the list allows.
LONGEST_IN_LIST = 1000


def _listed(value: Column, sample: object, kind: T.DataType) -> Column:
    """A listed value as the column's type, or null if it has no such value.

    Text is read as the type. A number must keep its value, so 800.0 is the whole number 800 and
    800.5 is none; other values are compared by their text where the types differ.
    """
    if isinstance(sample, str):
        return value.try_cast(kind)
    if isinstance(sample, (int, float, Decimal)) and not isinstance(sample, bool):
        if isinstance(kind, T.NumericType):
            near = value.try_cast(kind)
            return F.when(near.eqNullSafe(value), near)
        if not isinstance(kind, T.StringType):
            return F.lit(None).cast(kind)
    return value.cast("string").try_cast(kind)


def keep_in(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Keep rows whose value is listed; an empty list keeps all. Null is never listed.

    Listed values take the column's type first; one that has no such value matches nothing.
    """
    if not values:
        return df
    kind = df.schema[column].dataType
    values = [v for v in values if v is not None]
    if len(values) <= LONGEST_IN_LIST:
        return df.where(F.col(f"`{column}`").isin([_listed(F.lit(v), v, kind) for v in values]))
    by_type: dict[type, list] = {}
    for v in values:
        by_type.setdefault(type(v), []).append(v)
    parts = []
    for some in by_type.values():
        listed = df.sparkSession.createDataFrame([(v,) for v in some], ["v"])
        parts.append(listed.select(_listed(F.col("v"), some[0], kind).alias(column)))
    return df.join(reduce(DataFrame.unionByName, parts), column, "left_semi").select(*[f"`{c}`" for c in df.columns])


def rename_clashes(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rename columns of ``right`` that ``left`` also has to ``<name>_right``, except keys."""
    clashing = [c for c in right.columns if c in left.columns and c not in keys]
    return right.withColumnsRenamed({c: c + "_right" for c in clashing})


def with_flat_type(df: DataFrame) -> DataFrame:
    """``FLAT_TYPE_CODE`` in lower case, ``unknown`` where it is null."""
    return df.withColumn(
        "FLAT_TYPE_CODE", F.lower(F.coalesce(F.col("FLAT_TYPE_CODE"), F.lit("unknown")))
    )


def filter_and_join_gnaf_frames(
    default_geocode: DataFrame,
    address_detail: DataFrame,
    building_types: Sequence[str] = (),
    postcodes: Sequence[int] = (),
) -> DataFrame:
    """Join geocodes to the details left after the two optional filters, on the address id."""
    key = "ADDRESS_DETAIL_PID"
    detail = keep_in(with_flat_type(address_detail), "FLAT_TYPE_CODE", building_types)
    detail = keep_in(detail, "POSTCODE", postcodes)
    return default_geocode.join(rename_clashes(default_geocode, detail, [key]), key, "inner")


def filter_sa1_regions(
    df: DataFrame,
    region_codes: Sequence[str] = (),
    sa2_codes: Sequence[str] = (),
    sa1_column: str = "SA1_CODE21",
    sa2_column: str = "SA2_CODE21",
) -> DataFrame:
    """Keep the listed SA1 and SA2 areas."""
    return keep_in(keep_in(df, sa1_column, region_codes), sa2_column, sa2_codes)


def filter_gnaf_cache(
    df: DataFrame,
    states: Sequence[str] = (),
    region_codes: Sequence[str] = (),
    sa2_codes: Sequence[str] = (),
    flat_type_codes: Sequence[str] = (),
    postcodes: Sequence[int] = (),
) -> DataFrame:
    """Keep mapped addresses that pass every list given. Building types are matched as they are."""
    kept = keep_in(df, "STATE", states)
    kept = filter_sa1_regions(kept, region_codes, sa2_codes)
    kept = keep_in(kept, "FLAT_TYPE_CODE", flat_type_codes)
    return keep_in(kept, "POSTCODE", postcodes)
