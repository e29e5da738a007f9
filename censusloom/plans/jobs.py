"""The jobs: map addresses to areas, keep the result, and place census counts on it."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from censusloom.operators.addresses import (
    filter_and_join_gnaf_frames,
    filter_gnaf_cache,
    filter_sa1_regions,
)
from censusloom.operators.allocate import (
    draw_addresses,
    one_hot,
    randomly_assign_census_features,
)
from censusloom.operators.areas import join_coords_with_area, to_geo_dataframe
from censusloom.operators.counts import (
    _repeats_a_key,
    cast_like,
    census_long,
    join_census_frames,
    join_census_with_coords,
)
from censusloom.runtime import scratch_folder
from censusloom.sinks import Converted, FILE_BYTES, convert_to_parquet, to_parquet, write_csv_in_order
from censusloom.sources.folders import load_gnaf_files_by_states, read_spreadsheets
from censusloom.sources.shapes import stored_areas

#: File names of the census tables at the finest level.
CENSUS_PATTERN = r"2021Census_G\d+[A-Z]?_AUST_SA1"
CRS = "EPSG:7844"
CODE, LONG, LAT = "SA1_CODE_2021", "LONGITUDE", "LATITUDE"


class JobSummary(NamedTuple):
    """What a job did, gathered while its rows were written.

    ``addresses`` were read, ``unmapped`` of them lie in no area; of each feature ``wanted`` persons were counted and
    ``placed`` ones written, fewer where a code has counts but no address.
    """

    addresses: int
    unmapped: int
    wanted: dict[str, int]
    placed: dict[str, int]

    @property
    def unplaced(self) -> dict[str, int]:
        return {f: n - self.placed.get(f, 0) for f, n in self.wanted.items()}


def _mapped_facts(df: DataFrame, area: str) -> tuple[DataFrame, Observation]:
    """The rows, counted as they pass."""
    watch = Observation()
    return df.observe(watch, F.count(F.lit(1)).alias("addresses"), F.count_if(F.col(area).isNull()).alias("unmapped")), watch


def _seen(watch: Observation, *names: str) -> list[int]:
    """What was counted. A plan that Spark finds to be empty has no counts at all: no row passed."""
    try:
        found = watch.get
    except Py4JError:
        found = {}
    return [found.get(name) or 0 for name in names]


def _areas(spark: SparkSession, source: str | DataFrame, crs: str, store: str | None = None) -> DataFrame:
    """Areas of a job: a table already, or files that are parsed once and kept under ``store``.

    Without a ``store`` the parsed table is written to the scratch folder, since the job reads it several times.
    """
    if isinstance(source, DataFrame):
        return source
    return stored_areas(spark, source, crs, store or scratch_folder(spark, "areas"))


def map_addresses(
    geocode: DataFrame,
    detail: DataFrame,
    areas: DataFrame,
    crs: str = CRS,
    strategy: str | None = None,
    building_types: Sequence[str] = (),
    postcodes: Sequence[int] = (),
    region_codes: Sequence[str] = (),
    sa2_codes: Sequence[str] = (),
) -> DataFrame:
    """Addresses with their areas, filtered before and after the spatial join.

    Details are joined only if a filter needs them. Where addresses outside all areas are
    not given the nearest one, the area filters cut the area table first: the rows they
    would drop afterwards are then never matched.
    """
    addresses = geocode
    if building_types or postcodes:
        addresses = filter_and_join_gnaf_frames(geocode, detail, building_types, postcodes)
    if strategy != "join_nearest":
        areas = filter_sa1_regions(areas, region_codes, sa2_codes)
    mapped = join_coords_with_area(
        to_geo_dataframe(addresses, crs), areas, strategy
    )
    return filter_sa1_regions(mapped, region_codes, sa2_codes)


def join_gnaf_with_shapefile(
    spark: SparkSession,
    gnaf_dir: str,
    shapefile_dir: str | DataFrame,
    crs: str = CRS,
    strategy: str | None = None,
    states: Sequence[str] = (),
    area_store: str | None = None,
    **filters,
) -> DataFrame:
    """``map_addresses`` from files; ``area_store`` is a folder where parsed areas are kept."""
    geocode, detail = load_gnaf_files_by_states(spark, gnaf_dir, states)
    areas = _areas(spark, shapefile_dir, crs, area_store)
    return map_addresses(geocode, detail, areas, crs, strategy, **filters)


def build_address_cache(
    spark: SparkSession,
    gnaf_dir: str,
    shapefile_dir: str | DataFrame,
    output: str,
    crs: str = CRS,
    strategy: str | None = None,
    area_store: str | None = None,
) -> JobSummary:
    """Join all addresses, details and areas once and keep the result, partitioned by state.

    Areas come from a shapefile folder or are an area table already; ``area_store`` is a folder where
    parsed areas are kept.
    """
    geocode, detail = load_gnaf_files_by_states(spark, gnaf_dir)
    addresses = filter_and_join_gnaf_frames(geocode, detail)
    areas = _areas(spark, shapefile_dir, crs, area_store)
    mapped = join_coords_with_area(to_geo_dataframe(addresses, crs), areas, strategy)
    mapped, facts = _mapped_facts(mapped, "index_right")
    to_parquet(mapped, output, partition_by="STATE")
    return JobSummary(*_seen(facts, "addresses", "unmapped"), {}, {})


def place_census(
    mapped: DataFrame,
    census: dict[str, DataFrame],
    features: Sequence[str],
    seed: int = 0,
    code_col: str = CODE,
    area_col: str = "SA1_CODE21",
    long_col: str = LONG,
    lat_col: str = LAT,
) -> DataFrame:
    """One-hot person table from mapped addresses and census tables.

    Only the wanted features are read, in long form, and counts meet addresses through the
    drawn numbers, so the wide table of all counts on all addresses is never made. A table
    that repeats a code takes the wide way, where the joins multiply its rows.
    """
    if _repeats_a_key(census, code_col):
        wide = join_census_frames(census, code_col, unique_keys=False)
        joined = join_census_with_coords(wide, mapped, code_col, area_col)
        return randomly_assign_census_features(joined, code_col, long_col, lat_col, features, seed=seed)
    counts = census_long(census, features, code_col)
    places = mapped.select(F.col(area_col).alias(code_col), long_col, lat_col)
    counts = cast_like(counts, code_col, places, code_col)
    persons = draw_addresses(places, counts, code_col, long_col, lat_col, features, seed=seed)
    return one_hot(persons, features, ["person_id", code_col, long_col, lat_col])


def allocate(
    spark: SparkSession,
    census_dir: str,
    output_path: str,
    census_features: Sequence[str],
    cache: str | None = None,
    gnaf_dir: str | None = None,
    shapefile_dir: str | DataFrame | None = None,
    census_pattern: str = CENSUS_PATTERN,
    crs: str = CRS,
    strategy: str | None = None,
    states: Sequence[str] = (),
    building_types: Sequence[str] = (),
    postcodes: Sequence[int] = (),
    region_codes: Sequence[str] = (),
    sa2_codes: Sequence[str] = (),
    seed: int = 0,
    chunk_size: int | None = None,
    file_bytes: int = FILE_BYTES,
) -> JobSummary:
    """Place census features on addresses and write the persons as CSV.

    With a ``cache`` of mapped addresses the address and area files are not needed. Files have about
    ``file_bytes``, at most ``chunk_size`` rows if that is given, and follow the person ids.
    """
    areas = {"region_codes": region_codes, "sa2_codes": sa2_codes}
    if cache is not None:
        mapped = filter_gnaf_cache(
            spark.read.parquet(cache),
            states=states, flat_type_codes=building_types, postcodes=postcodes, **areas,
        )
    else:
        mapped = join_gnaf_with_shapefile(
            spark, gnaf_dir, shapefile_dir, crs, strategy, states,
            building_types=building_types, postcodes=postcodes, **areas,
        )
    # the draw reads places once, where they are counted too
    mapped, facts = _mapped_facts(mapped.select("SA1_CODE21", LONG, LAT), "SA1_CODE21")
    census = read_spreadsheets(spark, census_dir, "parquet", census_pattern)
    counted = census_long(census, census_features, CODE).groupBy("feature").agg(F.sum("n").alias("n")).collect()
    wanted = {f: 0 for f in census_features} | {r.feature: r.n for r in counted}
    persons, placed = place_census(mapped, census, census_features, seed), Observation()
    each = [F.count_if(F.col(f"`{f}`")).alias(f"f{i}") for i, f in enumerate(census_features)]
    persons = persons.observe(placed, F.count(F.lit(1)).alias("n"), *each)
    write_csv_in_order(persons, output_path, "person_id", sum(wanted.values()), file_bytes, chunk_size)
    found = _seen(placed, *[f"f{i}" for i in range(len(census_features))])
    return JobSummary(*_seen(facts, "addresses", "unmapped"), wanted, dict(zip(census_features, found)))


def spreadsheets_to_parquet(
    spark: SparkSession, input_dir: str, output_dir: str, schema: StructType | None = None
) -> Converted:
    """Convert a folder of spreadsheets to Parquet; ``schema`` fixes the types of the columns it names."""
    return convert_to_parquet(spark, input_dir, output_dir, schema)
