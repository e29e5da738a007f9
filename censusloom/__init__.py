"""Place census counts on addresses with Spark."""

from censusloom.functions.templates import capture_placeholders, with_placeholders
from censusloom.operators.addresses import (
    filter_and_join_gnaf_frames,
    filter_gnaf_cache,
    filter_sa1_regions,
)
from censusloom.operators.allocate import (
    draw_addresses,
    randomly_assign_census_features,
    reconcile,
    sample_census_feature,
)
from censusloom.operators.areas import area_table, join_coords_with_area, to_geo_dataframe
from censusloom.operators.counts import (
    census_long,
    join_census_frames,
    join_census_with_coords,
    standardize_names,
)
from censusloom.sinks import convert_to_parquet, to_parquet, write_csv_in_chunks
from censusloom.sources.folders import (
    list_files,
    load_gnaf_files_by_states,
    read_spreadsheets,
    scan_folder,
)
from censusloom.sources.shapes import read_shapefile
from censusloom.sources.tables import (
    get_spreadsheet_reader,
    load,
    read_csv,
    read_parquet,
    read_psv,
)
from censusloom.sources.workbooks import read_xlsx

__all__ = [name for name in dir() if not name.startswith("_")]
