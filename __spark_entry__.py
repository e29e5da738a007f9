"""

The driver's tables hold no addresses or areas, so roles are given to them: a customer is an
address, a supplier an area and its code, line items are the persons counted in an area, and
orders stand for address details. All roles grow with the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from censusloom import sinks
from censusloom.functions import templates
from censusloom.functions.geometry import point_wkt
from censusloom.operators import addresses, allocate, areas, counts, numbering
from censusloom.plans import jobs
from censusloom.runtime import scratch_folder
from censusloom.sources import folders, tables
from fixtures import filebytes

CRS = "EPSG:7844"
SEED = 42
AGES = ["Age_0_4_yr_P", "Age_5_14_yr_P", "Age_15_19_yr_P"]
STATE_OF = ["NSW", "VIC", "QLD", "WA", "SA"]

# --- roles, as SQL both engines read the same way -------------------------------------------

_AREA_OF = "cast(floor(c_custkey / 15) as bigint)"
_POINT = (
    "cast(({s} % 40) * 11 as double) + cast((c_custkey * 7) % 120 as double) / 10 - 1 as \"LONGITUDE\", "
    "cast(floor({s} / 40) * 11 as double) + cast((c_custkey * 13) % 120 as double) / 10 - 1 as \"LATITUDE\""
).format(s=_AREA_OF)
ADDRESS = f"c_custkey as pid, {_AREA_OF} as code, {_POINT}"
STATE = "case c_nationkey % 5 " + " ".join(
    f"when {i} then '{s}'" for i, s in enumerate(STATE_OF)
) + " end"
_FLAT = (
    "case when c_custkey % 7 = 0 then null else c_mktsegment end as \"FLAT_TYPE_CODE\", "
    "2000 + c_custkey % 50 as \"POSTCODE\""
)
GEOCODE = f"cast(c_custkey as {{text}}) as \"ADDRESS_DETAIL_PID\", 'FCS' as \"GEOCODE_TYPE_CODE\", {_POINT}"
DETAIL = f"cast(c_custkey as {{text}}) as \"ADDRESS_DETAIL_PID\", {_FLAT}"
AGE_COUNTS = (
    "sum(case when l_quantity <= 10 then 1 else 0 end) as \"Age_0_4_yr_P\", "
    "sum(case when l_quantity > 10 and l_quantity <= 30 then 1 else 0 end) as \"Age_5_14_yr_P\", "
    "sum(case when l_quantity > 30 then 1 else 0 end) as \"Age_15_19_yr_P\", "
    "count(*) as \"Tot_P\""
)
# corners of an L, of four sizes
_CORNERS = [(0, 0), (0, 1), (0.5, 1), (0.5, 0.5), (1, 0.5), (1, 0), (0, 0)]
_OX, _OY = "cast((s_suppkey % 40) * 11 as double)", "cast(floor(s_suppkey / 40) * 11 as double)"
_SIZE = "power(2.0, s_suppkey % 4)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sql(df: DataFrame, text: str) -> DataFrame:
    """Project by SQL text with standard quoting."""
    return df.select(*[F.expr(e) for e in _split(text.replace('"', "`").replace("{text}", "string"))])


def _split(text: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def address_table(spark: SparkSession, sf: str) -> DataFrame:
    return sql(table(spark, sf, "customer"), ADDRESS)


def geocodes(spark: SparkSession, sf: str) -> DataFrame:
    return sql(table(spark, sf, "customer"), f"{GEOCODE}, {STATE} as \"STATE\"")


def details(spark: SparkSession, sf: str) -> DataFrame:
    return sql(table(spark, sf, "customer"), DETAIL)


def points(spark: SparkSession, sf: str) -> DataFrame:
    return areas.to_geo_dataframe(address_table(spark, sf), CRS)


def area_rows(spark: SparkSession, sf: str) -> DataFrame:
    corners = ", ".join(
        f"struct({_OX} + {x}D * {_SIZE} as x, {_OY} + {y}D * {_SIZE} as y)" for x, y in _CORNERS
    )
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("index_right"),
        F.expr(f"array(array({corners}))").alias("rings"),
        F.col("s_suppkey").alias("SA1_CODE21"),
        F.expr("cast(s_suppkey % 20 as string)").alias("SA2_CODE21"),
    )


def area_polygons(spark: SparkSession, sf: str) -> DataFrame:
    return areas.area_table(area_rows(spark, sf), CRS)


def age_counts(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("code"))
        .agg(*[F.expr(e) for e in _split(AGE_COUNTS.replace('"', "`"))])
    )


def room_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").where("s_suppkey % 3 > 0").selectExpr(
        "s_suppkey + 5 as code", "s_suppkey % 4 as Rooms", "cast(1 as bigint) as Age_0_4_yr_P"
    )


def home_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sql(table(spark, sf, "customer"), ADDRESS).groupBy("code").agg(
        F.count(F.lit(1)).alias("Homes")
    )


def census_frames(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {
        "G01": age_counts(spark, sf), "G02": room_counts(spark, sf), "G03": home_counts(spark, sf)
    }


# --- SQL the queries must agree with --------------------------------------------------------

_CENSUS_SQL = f"select l_suppkey as code, {AGE_COUNTS} from lineitem group by l_suppkey"
_ROOMS_SQL = (
    "select s_suppkey + 5 as code, s_suppkey % 4 as \"Rooms\", cast(1 as bigint) as \"Age_0_4_yr_P\" "
    "from supplier where s_suppkey % 3 > 0"
)
_ADDRESS_SQL = f"select {ADDRESS} from customer"
_LONG_SQL = (
    " union all ".join(
        f"select code, '{f}' as feature, {i} as rank, cast(\"{f}\" as bigint) as n from census"
        for i, f in enumerate(AGES, 1)
    )
)


def _q(text: str) -> str:
    return text.replace("{text}", "varchar")


def _area_sql() -> str:
    corners = ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(_CORNERS))
    return f"""
      corner(k, dx, dy) as (values {corners}),
      vertex as (select s_suppkey as area, k, {_OX} + dx * {_SIZE} as x, {_OY} + dy * {_SIZE} as y
                 from supplier, corner),
      edge as (select a.area, a.x as x1, a.y as y1, b.x as x2, b.y as y2
               from vertex a join vertex b on a.area = b.area and b.k = a.k + 1),
      box as (select area, min(x) as minx, max(x) as maxx, min(y) as miny, max(y) as maxy
              from vertex group by area)"""


_WITHIN_SQL = f"""{_area_sql()},
      pt as (select *, "LONGITUDE" as px, "LATITUDE" as py from ({_ADDRESS_SQL})),
      hit as (
        select pid, e.area
        from pt join box on px between minx and maxx and py between miny and maxy
        join edge e on e.area = box.area
        group by pid, e.area
        having sum(case when (y1 > py) <> (y2 > py)
                         and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1 then 1 else 0 end) % 2 = 1
           and max(case when (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) = 0
                         and px between least(x1, x2) and greatest(x1, x2)
                         and py between least(y1, y2) and greatest(y1, y2) then 1 else 0 end) = 0),
      mapped as (select pt.*, hit.area as index_right from pt left join hit using (pid))"""

_DISTANCE_SQL = """
      measured as (
        select pid, area, min(sqrt((x1 + t * (x2 - x1) - px) * (x1 + t * (x2 - x1) - px)
                                 + (y1 + t * (y2 - y1) - py) * (y1 + t * (y2 - y1) - py))) as distance
        from (select pid, px, py, e.*, least(greatest(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1))
                     / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0), 1) as t
              from lost, edge e)
        group by pid, area),
      ranked as (select *, rank() over (partition by pid order by distance) as r,
                 row_number() over (partition by pid order by distance, area) as rn from measured)"""


def _wkt_sql(x: str, y: str) -> str:
    part = "regexp_replace(cast({} as varchar), '\\.0$', '')"
    return f"'POINT (' || {part.format(x)} || ' ' || {part.format(y)} || ')'"


def _hash_sql(*cols: str) -> str:
    text = ", ".join(f"cast({c} as varchar)" for c in cols)
    return f"cast('0x' || substr(md5(concat_ws('|', {text})), 1, 15) as bigint)"


def _permute_sql(source: str, keys: str) -> str:
    """Recursive CTE ``image``: columns of ``source`` plus ``v``, the image of ``i`` below ``s``."""
    text = ", ".join(["'|'", f"'{SEED}'", *[f"cast({k} as varchar)" for k in keys.split(",")]])
    words = []
    for number in range(4):
        for at in (1, 17):
            word = "cast('0x' || substr(md5(concat_ws({}, '{}')), {}, 8) as bigint) % 2147483647"
            words.append(
                f"{{'l': {word.format(text, number, at)}, 'r': {word.format(text, number, at + 8)}}}"
            )
    step = (
        "list_reduce(list_prepend({'l': v // side, 'r': v % side}, ks), lambda p, k: "
        "{'l': p.r, 'r': (p.l + (k.l * p.r + k.r) % 2147483647) % side})"
    )
    return f"""
      sized as (select *, cast(ceil(sqrt(s)) as bigint) as side, [{', '.join(words)}] as ks
                from {source}),
      walk as (select *, cast(i as bigint) as v, 0 as steps from sized
               union all
               select * exclude (v, steps, nxt), nxt.l * side + nxt.r as v, steps + 1 as steps
               from (select *, {step} as nxt from walk where steps = 0 or v >= s)),
      image as (select * exclude (side, ks, steps) from walk where steps > 0 and v < s)"""


def _draw_sql(census: str, address: str, long_counts: str = _LONG_SQL) -> str:
    """CTE ``person``: the draws of ``draw_addresses`` with one row per person."""
    return f"""
      census as ({census}),
      address as ({address}),
      numbered as (select *, row_number() over (partition by code order by {_hash_sql('"LONGITUDE"', '"LATITUDE"')}, "LONGITUDE", "LATITUDE") - 1
                   as number from address where code is not null),
      size as (select code, count(*) as places from numbered group by code),
      quota as (select l.*, places,
                       sum(n) over (order by rank, hash, code
                                    rows between unbounded preceding and current row) - n as base
                from (select *, {_hash_sql('code')} as hash from ({long_counts}) where n > 0) l
                join size using (code)),
      draw as (select *, unnest(range(n)) as i, places * n as s from quota),
      {_permute_sql('draw', 'code,feature')},
      person as (select cast(base + i as bigint) as person_id, d.code, "LONGITUDE", "LATITUDE", feature
                 from image d join numbered a on a.code = d.code and a.number = d.v // d.n)"""


_ONE_HOT_SQL = ", ".join(f"feature = '{f}' as \"{f}\"" for f in AGES)
_UNEVEN = "c_custkey % 4"


def _uneven_sql(n: str) -> str:
    """CTE ``drawn``: general draw where rows of a code may differ in their counts."""
    return f"""
      flat as (select code, "LONGITUDE", "LATITUDE", {n} as n from (select *, pid as c_custkey from ({_ADDRESS_SQL}))),
      run as (select *, sum(n) over (partition by code order by {_hash_sql('"LONGITUDE"', '"LATITUDE"')}, "LONGITUDE", "LATITUDE", n
                                     rows between unbounded preceding and current row) - n as start
              from flat),
      quota as (select code, 'f' as feature, cast(sum(n) as bigint) as s, max(n) as draws
                from flat group by code having max(n) > 0),
      draw as (select *, unnest(range(draws)) as i from quota),
      {_permute_sql('draw', 'code,feature')},
      drawn as (select r.code, "LONGITUDE", "LATITUDE" from image d
                join run r on r.code = d.code and d.v >= start and d.v < start + n and d.i < n)"""


# --- queries --------------------------------------------------------------------------------

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function: Query) -> Query:
        _QUERIES[name] = function
        if oracle is not None:
            _SQL[name] = _q(oracle)
        return function

    return register


def _stored(df: DataFrame, name: str, writer: Callable[[DataFrame, str], None]) -> str:
    """Write a table under a fresh scratch folder; the folder's path."""
    folder = scratch_folder(df.sparkSession, "query")
    writer(df, f"{folder}/{name}")
    return folder


def _as_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def _as_psv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("sep", "|").csv(path)


_CUSTOMER_SQL = "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer"


@query("s1_read_psv", _CUSTOMER_SQL)
def s1(spark, sf):
    source = table(spark, sf, "customer")
    folder = _stored(source, "customer.psv", _as_psv)
    return tables.read_psv(spark, f"{folder}/customer.psv", source.schema)


@query("s2_read_csv", _CUSTOMER_SQL)
def s2(spark, sf):
    source = table(spark, sf, "customer")
    folder = _stored(source, "customer.csv", _as_csv)
    return tables.read_csv(spark, f"{folder}/customer.csv", source.schema)


@query("s3_read_parquet", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'")
def s3(spark, sf):
    orders = tables.read_parquet(spark, f"{sf}/orders.parquet")
    return orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("s4_workbook_cells", "select c_custkey, c_name, c_acctbal from customer")
def s4(spark, sf):
    from censusloom.sources.workbooks import workbook_cells

    rows = table(spark, sf, "customer").selectExpr("c_custkey div 500 as book", "c_custkey", "c_name", "c_acctbal")
    books = rows.groupBy("book").applyInPandas(filebytes.workbook, "path string, content binary")
    cells = workbook_cells(books).where("row > 1")
    return cells.selectExpr(
        "cast(cells[0] as bigint) as c_custkey", "cells[1] as c_name", "cast(cells[2] as double) as c_acctbal"
    )


def _spreadsheets(rows: DataFrame, path: str) -> str:
    """Write rows as spreadsheets, each to the file that ``path`` names; the folder they are in."""
    folder = scratch_folder(rows.sparkSession, "query")
    named = rows.select(F.expr(path).alias("__path"), "*")
    files = named.groupBy("__path").applyInPandas(filebytes.spreadsheet, "path string, content binary")
    filebytes.write_files(files, f"{folder}/in")
    return folder


@query("s4_read_xlsx", "select o_orderkey, cast(o_orderdate as date) as o_orderdate, o_totalprice, o_orderpriority from orders")
def s4_files(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "to_date(o_orderdate) as o_orderdate", "o_totalprice", "o_orderpriority")
    folder = _spreadsheets(rows, "concat('book', o_orderkey div 5000, '.xlsx')")
    return tables.load(spark, f"{folder}/in", "xlsx")


@query("s5_load_by_format", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def s5(spark, sf):
    source = table(spark, sf, "supplier")
    folder = _stored(source, "supplier.psv", _as_psv)
    return tables.load(spark, f"{folder}/supplier.psv", "psv", source.schema)


@query("s6_read_spreadsheets", "select c_custkey, c_name, c_mktsegment as key from customer")
def s6(spark, sf):
    source = table(spark, sf, "customer")
    folder = scratch_folder(spark, "query")
    for segment in _segments():
        part = source.where(F.col("c_mktsegment") == segment).select("c_custkey", "c_name")
        _as_csv(part, f"{folder}/customer_{segment}.csv")
    frames = folders.read_spreadsheets(spark, folder + "/customer_{key}.csv", "csv")
    return counts.union_rows([df.withColumn("key", F.lit(key)) for key, df in frames.items()])


def _segments() -> list[str]:
    return ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("s6_scan_folder", "select c_custkey, c_name, c_mktsegment as key from customer where c_mktsegment <> 'BUILDING'")
def s6_scan(spark, sf):
    source = table(spark, sf, "customer")
    folder = scratch_folder(spark, "query")
    for segment in _segments():
        part = source.where(F.col("c_mktsegment") == segment).select("c_custkey", "c_name")
        part.write.parquet(f"{folder}/customer_{segment}.parquet")
    return folders.scan_folder(
        spark, folder + "/customer_{key}.parquet", "parquet",
        source.select("c_custkey", "c_name").schema, "customer_[AFHM]",
    )


@query(
    "s7_placeholders",
    "select doc_id, source, lang, cast(doc_id as varchar) as number from documents",
)
def s7(spark, sf):
    paths = table(spark, sf, "documents").selectExpr(
        "doc_id", "concat('/in/', source, '/', lang, '_', doc_id, '.txt') as path"
    )
    return templates.with_placeholders(
        paths, "path", "/in/{source}/{lang}_{number}.txt", ["source", "lang", "number"]
    ).drop("path")


@query("s8_list_files", "select distinct c_mktsegment as part from customer")
def s8(spark, sf):
    folder = _stored(
        table(spark, sf, "customer"), "customer",
        lambda df, path: df.write.partitionBy("c_mktsegment").parquet(path),
    )
    files = folders.list_files(spark, folder).where("length > 0")
    return files.select(F.regexp_extract("path", "c_mktsegment=([A-Z]+)/", 1).alias("part")).distinct()


def _address_folder(spark: SparkSession, sf: str) -> str:
    """Folder of address feeds by state, named as the feeds are."""
    folder = scratch_folder(spark, "query")
    geocode = geocodes(spark, sf)
    detail = sql(table(spark, sf, "customer"), f"{DETAIL}, {STATE} as \"STATE\"")
    for state in STATE_OF:
        for df, kind in ((geocode, "DEFAULT_GEOCODE"), (detail, "DETAIL")):
            part = df.where(F.col("STATE") == state).drop("STATE")
            part.write.parquet(f"{folder}/{state}_ADDRESS_{kind}_psv.parquet")
    return folder


@query(
    "s9_load_by_states",
    f"""select {GEOCODE}, {STATE} as "STATE", d."FLAT_TYPE_CODE", d."POSTCODE"
        from customer join (select c_custkey as k, {_FLAT} from customer) d on d.k = c_custkey
        where {STATE} in ('NSW', 'WA')""",
)
def s9(spark, sf):
    geocode, detail = folders.load_gnaf_files_by_states(spark, _address_folder(spark, sf), ["NSW", "WA"])
    return geocode.join(detail, "ADDRESS_DETAIL_PID")


@query(
    "s10_shapes",
    f"""with {_area_sql()} select area as index_right, k, x, y, area as "SA1_CODE21" from vertex""",
)
def s10(spark, sf):
    from censusloom.sources.shapes import areas_from_files

    rows = area_rows(spark, sf).select(F.expr("cast(index_right div 100 as int)").alias("file"), "*")
    files = rows.groupBy("file").applyInPandas(filebytes.shapefile, "path string, content binary")
    return _corners(areas_from_files(files, CRS))


def _corners(read: DataFrame) -> DataFrame:
    return read.select(
        "index_right", "SA1_CODE21", F.posexplode(F.element_at("rings", 1)).alias("k", "p")
    ).select("index_right", "k", "p.x", "p.y", "SA1_CODE21")


@query(
    "s10_read_shapefile",
    f"""with {_area_sql()} select area as index_right, k, x, y, area as "SA1_CODE21" from vertex""",
)
def s10_files(spark, sf):
    from censusloom.sources.shapes import read_shapefile

    rows = area_rows(spark, sf).select(F.expr("cast(index_right div 100 as int)").alias("file"), "*")
    folder = scratch_folder(spark, "query")
    filebytes.write_files(rows.groupBy("file").applyInPandas(filebytes.shapefile, "path string, content binary"), folder)
    return _corners(read_shapefile(spark, folder, CRS))


@query("k1_to_parquet", _CUSTOMER_SQL)
def k1(spark, sf):
    folder = _stored(table(spark, sf, "customer"), "c.parquet", sinks.to_parquet)
    return spark.read.parquet(f"{folder}/c.parquet")


@query("k2_partitioned_parquet", f"select c_custkey, {STATE} as \"STATE\" from customer where {STATE} = 'VIC'")
def k2(spark, sf):
    source = sql(table(spark, sf, "customer"), f"c_custkey, {STATE} as \"STATE\"")
    folder = _stored(source, "c", lambda df, path: sinks.to_parquet(df, path, partition_by="STATE"))
    return spark.read.parquet(f"{folder}/c").where("STATE = 'VIC'")


@query("k3_csv_in_chunks", _CUSTOMER_SQL)
def k3(spark, sf):
    source = table(spark, sf, "customer")
    folder = _stored(source, "c", lambda df, path: sinks.write_csv_in_chunks(df, path, 100))
    return spark.read.schema(source.schema).option("header", True).csv(f"{folder}/c")


#: Extension of the file a row goes to, by its number; files hold 300 rows.
_EXTENSION = "element_at(array('.csv', '.psv', '.xlsx'), cast({n} % 3 + 1 as int))"
_NOTE = "concat('line ', s_suppkey, chr(10), '\"q\", | ', s_suppkey)"


@query("k4_convert_folder", f"select s_suppkey, s_name, s_nationkey, s_acctbal, {_NOTE} as note from supplier")
def k4(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal", F.expr(_NOTE).alias("note"))
    folder = _spreadsheets(rows, f"concat('s', s_suppkey div 900, '_', s_suppkey % 3, {_EXTENSION.format(n='s_suppkey')})")
    done = sinks.convert_to_parquet(spark, f"{folder}/in", f"{folder}/out")
    return reduce(DataFrame.unionByName, [spark.read.parquet(p) for p in done.values()]).select(
        F.col("s_suppkey").cast("long"), "s_name", F.col("s_nationkey").cast("int"), F.col("s_acctbal").cast("double"), "note"
    )


@query("p1_p2_select_and_literal", "select c_custkey, c_mktsegment, 'NSW' as \"STATE\" from customer")
def p1(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment").withColumn("STATE", F.lit("NSW"))


@query("p3_p4_flat_type", f"select c_custkey, lower(coalesce(\"FLAT_TYPE_CODE\", 'unknown')) as \"FLAT_TYPE_CODE\" from (select c_custkey, {_FLAT} from customer)")
def p3(spark, sf):
    flats = sql(table(spark, sf, "customer"), f"c_custkey, {_FLAT}")
    return addresses.with_flat_type(flats).drop("POSTCODE")


@query("p5_cast_like", "select cast(c_nationkey as varchar) as code, c_custkey from customer")
def p5(spark, sf):
    source = table(spark, sf, "customer").selectExpr("c_nationkey as code", "c_custkey")
    return counts.cast_like(source, "code", table(spark, sf, "region"), "r_name")


@query("p6_drop_totals", f"select code, {', '.join(chr(34) + f + chr(34) for f in AGES)} from ({_CENSUS_SQL})")
def p6(spark, sf):
    return allocate.drop_by_prefix(age_counts(spark, sf), "Tot_")


@query(
    "p7_standardize_names",
    f"select code, \"Age_0_4_yr_P\" as \"age_0_4_years_persons\", \"Age_5_14_yr_P\", \"Age_15_19_yr_P\", \"Tot_P\" as total_persons from ({_CENSUS_SQL})",
)
def p7(spark, sf):
    names = spark.createDataFrame(
        [("G01", "Age_0_4_yr_P", "Age 0 4 years Persons"), ("G01", "Tot_P", "Total Persons"),
         ("G01", "Age_5_14_yr_P", None), ("G09", "code", "Other")],
        "DataPackfile string, Short string, Long string",
    )
    return counts.standardize_names({"G01": age_counts(spark, sf)}, names)["G01"]


@query(
    "p10_p11_repeat_rows",
    "select l_orderkey, l_linenumber, unnest(range(cast(l_quantity as bigint) % 4)) as copy from lineitem",
)
def p10(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "cast(l_quantity as bigint) % 4 as n"
    )
    return allocate.repeat_rows(rows, "n").drop("n")


@query("p12_p8_mark_feature", "select c_custkey, true as \"f\" from customer where c_acctbal > 0")
def p12(spark, sf):
    rows = table(spark, sf, "customer").where("c_acctbal > 0").select("c_acctbal", "c_custkey")
    return rows.withColumn("f", F.lit(True)).select("c_custkey", "f")


@query("p13_points", f"select pid, \"LONGITUDE\" as px, \"LATITUDE\" as py from ({_ADDRESS_SQL})")
def p13(spark, sf):
    return points(spark, sf).select("pid", "px", "py")


@query("p14_point_wkt", f"select pid, {_wkt_sql(chr(34) + 'LONGITUDE' + chr(34), chr(34) + 'LATITUDE' + chr(34))} as geometry from ({_ADDRESS_SQL})")
def p14(spark, sf):
    return points(spark, sf).select("pid", point_wkt("px", "py").alias("geometry"))


@query("p15_unmapped_flag", f"with {_WITHIN_SQL} select pid, index_right is null as unmapped from mapped")
def p15(spark, sf):
    mapped = areas.within(points(spark, sf), area_polygons(spark, sf))
    return mapped.select("pid", F.col("index_right").isNull().alias("unmapped"))


@query("p16_p9_fill_own_columns", "select c_custkey, false as a, c_acctbal > 0 as b from customer")
def p16(spark, sf):
    source = table(spark, sf, "customer").selectExpr("c_custkey", "cast(null as boolean) as a")
    other = table(spark, sf, "customer").selectExpr("c_custkey", "c_acctbal > 0 as b")
    own, shared = areas.own_columns(source, other)
    return counts.fill_false(source.join(other, shared), own)


_DETAIL_SQL = f"select {DETAIL} from customer"


@query("f1_building_types", f"select c_custkey from (select c_custkey, {_FLAT} from customer) where lower(coalesce(\"FLAT_TYPE_CODE\", 'unknown')) in ('building', 'unknown')")
def f1(spark, sf):
    flats = addresses.with_flat_type(sql(table(spark, sf, "customer"), f"c_custkey, {_FLAT}"))
    return addresses.keep_in(flats, "FLAT_TYPE_CODE", ["building", "unknown"]).select("c_custkey")


@query("f2_postcodes", f"select c_custkey, \"POSTCODE\" from (select c_custkey, {_FLAT} from customer) where \"POSTCODE\" in (2000, 2010, 2049)")
def f2(spark, sf):
    flats = sql(table(spark, sf, "customer"), f"c_custkey, {_FLAT}").drop("FLAT_TYPE_CODE")
    return addresses.keep_in(flats, "POSTCODE", [2000, 2010, 2049])


@query("f2_long_list", "select o_orderkey, o_custkey from orders where o_custkey < 3000 and o_custkey % 2 = 0")
def f2_long(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return addresses.keep_in(orders, "o_custkey", list(range(0, 3000, 2)))


@query("f3_sa1_regions", "select s_suppkey as \"SA1_CODE21\", cast(s_suppkey % 20 as varchar) as \"SA2_CODE21\" from supplier where s_suppkey in (1, 21, 41, 5) and s_suppkey % 20 = 1")
def f3(spark, sf):
    rows = area_rows(spark, sf).select("SA1_CODE21", "SA2_CODE21")
    return addresses.filter_sa1_regions(rows, [1, 21, 41, 5], ["1"])


def _cache(spark: SparkSession, sf: str) -> DataFrame:
    return sql(
        table(spark, sf, "customer"),
        f"c_custkey, {STATE} as \"STATE\", {_AREA_OF} as \"SA1_CODE21\", "
        f"cast({_AREA_OF} % 20 as string) as \"SA2_CODE21\", {_FLAT}",
    )


@query(
    "f4_filter_cache",
    f"""select * from (select c_custkey, {STATE} as "STATE", {_AREA_OF} as "SA1_CODE21",
        cast({_AREA_OF} % 20 as varchar) as "SA2_CODE21", {_FLAT} from customer)
        where "STATE" in ('NSW', 'SA') and "SA2_CODE21" in ('1', '2', '3') and "FLAT_TYPE_CODE" in ('BUILDING', 'MACHINERY')""",
)
def f4(spark, sf):
    return addresses.filter_gnaf_cache(
        _cache(spark, sf), ["NSW", "SA"], [], ["1", "2", "3"], ["BUILDING", "MACHINERY"], []
    )


@query("f6_only_mapped", f"with {_WITHIN_SQL} select pid, index_right from mapped where index_right is not null")
def f6(spark, sf):
    mapped = areas.within(points(spark, sf), area_polygons(spark, sf))
    return areas.only_mapped(mapped).select("pid", "index_right")


@query("f7_path_regex", "select distinct c_mktsegment as part from customer where c_mktsegment < 'C'")
def f7(spark, sf):
    folder = _stored(
        table(spark, sf, "customer"), "t",
        lambda df, path: [_as_csv(df.where(F.col("c_mktsegment") == s), f"{path}/{s}.csv") for s in _segments()],
    )
    found = folders.list_tables(spark, folder, "csv", r"/[AB][A-Z]+\.csv$")
    return found.select(F.regexp_extract("path", r"([A-Z]+)\.csv$", 1).alias("part"))


@query(
    "j1_join_addresses",
    f"""select {GEOCODE}, {STATE} as "STATE", lower(coalesce(d."FLAT_TYPE_CODE", 'unknown')) as "FLAT_TYPE_CODE", d."POSTCODE"
        from customer join (select c_custkey as k, {_FLAT} from customer) d on d.k = c_custkey
        where lower(coalesce(d."FLAT_TYPE_CODE", 'unknown')) in ('building', 'unknown') and d."POSTCODE" < 2030""",
)
def j1(spark, sf):
    return addresses.filter_and_join_gnaf_frames(
        geocodes(spark, sf), details(spark, sf), ["building", "unknown"], list(range(2000, 2030))
    )


@query("j1_orders", "select c_custkey, c_mktsegment, o_orderkey from customer join orders on c_custkey = o_custkey where lower(c_mktsegment) = 'building'")
def j1_orders(spark, sf):
    kept = addresses.keep_in(
        table(spark, sf, "customer").select("c_custkey", F.lower("c_mktsegment").alias("s"), "c_mktsegment"), "s", ["building"]
    )
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return kept.join(orders, "c_custkey").drop("s")


_WIDE_SQL = f"""
  select code, a."Age_0_4_yr_P", a."Age_5_14_yr_P", a."Age_15_19_yr_P", a."Tot_P", b."Rooms",
         b."Age_0_4_yr_P" as "Age_0_4_yr_P__G02", c."Homes"
  from ({_CENSUS_SQL}) a full join ({_ROOMS_SQL}) b using (code)
  full join (select code, count(*) as "Homes" from ({_ADDRESS_SQL}) group by code) c using (code)"""


@query("j2_join_census_frames", _WIDE_SQL)
def j2(spark, sf):
    return counts.join_census_frames(census_frames(spark, sf), "code")


@query("j2_repeated_keys", f"select code, \"Tot_P\", n_name from ({_CENSUS_SQL}) full join (select cast(n_regionkey as bigint) as code, n_name from nation) using (code)")
def j2_repeated(spark, sf):
    other = table(spark, sf, "nation").selectExpr("cast(n_regionkey as bigint) as code", "n_name")
    return counts.join_census_frames({"a": age_counts(spark, sf).select("code", "Tot_P"), "b": other}, "code")


@query(
    "j2_long_form",
    f"""with census as ({_CENSUS_SQL}), rooms as ({_ROOMS_SQL})
        select 'G01' as "table", code, feature, n from ({_LONG_SQL}) where n > 0
        union all select 'G02', code, 'Rooms', "Rooms" from rooms where "Rooms" > 0""",
)
def j2_long(spark, sf):
    return counts.census_long(census_frames(spark, sf), [*AGES, "Rooms"], "code")


@query("j3_census_with_coords", f"select code, \"Age_0_4_yr_P\", \"Age_5_14_yr_P\", \"Age_15_19_yr_P\", \"Tot_P\", pid, \"LONGITUDE\", \"LATITUDE\" from ({_CENSUS_SQL}) join ({_ADDRESS_SQL}) using (code)")
def j3(spark, sf):
    census = age_counts(spark, sf).withColumn("code", F.col("code").cast("string"))
    homes = address_table(spark, sf).withColumnRenamed("code", "SA1_CODE21")
    return counts.join_census_with_coords(census, homes, "code", "SA1_CODE21")


_SAMPLED_A = "select c_nationkey as code, c_custkey % 10 as place, true as a from customer"
_SAMPLED_B = "select s_nationkey as code, s_suppkey % 10 as place, true as b from supplier"


def _sampled(spark, sf):
    a = table(spark, sf, "customer").selectExpr("c_nationkey as code", "c_custkey % 10 as place", "true as a")
    b = table(spark, sf, "supplier").selectExpr("s_nationkey as code", "s_suppkey % 10 as place", "true as b")
    return a, b


@query("j4_join_sampled", f"select code, place, coalesce(a, false) as a, coalesce(b, false) as b from ({_SAMPLED_A}) full join ({_SAMPLED_B}) using (code, place)")
def j4(spark, sf):
    return counts.join_sampled_features(*_sampled(spark, sf))


_MAPPED_COLS = (
    f"pid, code, \"LONGITUDE\", \"LATITUDE\", {_wkt_sql('px', 'py')} as geometry, index_right, "
    "index_right as \"SA1_CODE21\", cast(index_right % 20 as varchar) as \"SA2_CODE21\""
)


@query("j5_join_coords_with_area", f"with {_WITHIN_SQL} select {_MAPPED_COLS} from mapped")
def j5(spark, sf):
    return areas.join_coords_with_area(points(spark, sf), area_polygons(spark, sf))


@query("j5_shuffled", f"with {_WITHIN_SQL} select pid, index_right from mapped")
def j5_shuffled(spark, sf):
    return areas.within(points(spark, sf), area_polygons(spark, sf), limit=0).select("pid", "index_right")


@query("j6_nearest", f"with {_WITHIN_SQL}, lost as (select * from mapped where index_right is null), {_DISTANCE_SQL} select {_MAPPED_COLS.replace('index_right', 'coalesce(index_right, area)').replace('coalesce(index_right, area), coalesce', 'coalesce(index_right, area) as index_right, coalesce')} from mapped left join (select pid, area from ranked where rn = 1) using (pid)")
def j6(spark, sf):
    return areas.join_coords_with_area(points(spark, sf), area_polygons(spark, sf), "join_nearest")


@query("j6_nearest_ties", f"with {_WITHIN_SQL}, lost as (select * from mapped), {_DISTANCE_SQL} select distinct px, py, area as index_right, distance from ranked join pt using (pid) where r = 1")
def j6_ties(spark, sf):
    return areas.nearest(points(spark, sf), area_polygons(spark, sf), ties="all")


@query("j7_filter_strategy", f"with {_WITHIN_SQL} select {_MAPPED_COLS} from mapped where index_right is not null")
def j7(spark, sf):
    return areas.join_coords_with_area(points(spark, sf), area_polygons(spark, sf), "filter")


@query(
    "a1_reconcile",
    f"""with census as ({_CENSUS_SQL})
        select code, feature, n as wanted,
               case when code in (select code from ({_ADDRESS_SQL})) then n else 0 end as placed
        from ({_LONG_SQL}) where n > 0""",
)
def a1(spark, sf):
    census = age_counts(spark, sf)
    long = counts.census_long({"G01": census}, AGES, "code")
    return allocate.reconcile(l3(spark, sf), long, "code", AGES)


@query("a2_group_length", "select o_orderkey, o_custkey, count(*) over (partition by o_custkey) as n from orders")
def a2(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return numbering.number_rows(orders, ["o_custkey"], ["o_orderkey"], "k", "n").drop("k")


_W1_SQL = f"""with recursive
   draw as (select o_orderkey, o_orderpriority as code,
                   row_number() over (partition by o_orderpriority order by {{order}}) - 1 as i,
                   count(*) over (partition by o_orderpriority) as s from orders),
   {_permute_sql('draw', 'code')} select o_orderkey, code, v as rank from image"""


_W1_SQL = _W1_SQL.replace("{order}", f"{_hash_sql('o_orderkey')}, o_orderkey")


@query("w1_shuffled_index", _W1_SQL)
def w1(spark, sf):
    orders = table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderpriority as code")
    return numbering.shuffled_index(orders, ["code"], ["o_orderkey"], "rank", SEED)


@query("w1_split_groups", _W1_SQL)
def w1_split(spark, sf):
    orders = table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderpriority as code")
    return numbering.shuffled_index(orders, ["code"], ["o_orderkey"], "rank", SEED, hot_rows=100)


@query(
    "w2_person_ids",
    f"select o_orderkey, o_orderstatus as feature, row_number() over (order by case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end, {_hash_sql('o_orderkey')}, o_orderkey) - 1 as id from orders",
)
def w2(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderstatus as feature")
    return allocate.with_person_ids(rows, ["F", "O", "P"], ["o_orderkey"], "id")


@query(
    "l1_sample_feature",
    f"with recursive {_uneven_sql('cast(code % 9 as bigint)')} select code, \"LONGITUDE\", \"LATITUDE\", true as f from drawn",
)
def l1(spark, sf):
    census = address_table(spark, sf).withColumn("f", F.expr("code % 9"))
    return allocate.sample_census_feature(census, "code", "LONGITUDE", "LATITUDE", "f", SEED)


@query(
    "l1_uneven_counts",
    f"with recursive {_uneven_sql(_UNEVEN)} select code, \"LONGITUDE\", \"LATITUDE\", true as f from drawn",
)
def l1_uneven(spark, sf):
    census = address_table(spark, sf).withColumn("f", F.expr("pid % 4"))
    return allocate.sample_census_feature(census, "code", "LONGITUDE", "LATITUDE", "f", SEED)


@query("l2_stack_sampled", f"select code, place, a, false as b from ({_SAMPLED_A}) union all select code, place, false, b from ({_SAMPLED_B})")
def l2(spark, sf):
    return counts.stack_sampled_features(*_sampled(spark, sf))


@query(
    "l3_assign_features",
    f"with recursive {_draw_sql(_CENSUS_SQL, _ADDRESS_SQL)} select person_id, code, \"LONGITUDE\", \"LATITUDE\", {_ONE_HOT_SQL} from person",
)
def l3(spark, sf):
    joined = counts.join_census_with_coords(age_counts(spark, sf), address_table(spark, sf), "code", "code")
    return allocate.randomly_assign_census_features(
        joined, "code", "LONGITUDE", "LATITUDE", AGES, seed=SEED, even_counts=True
    )


@query(
    "l3_draw_addresses",
    f"with recursive {_draw_sql(_CENSUS_SQL, _ADDRESS_SQL)} select person_id, code, \"LONGITUDE\", \"LATITUDE\", feature from person",
)
def l3_long(spark, sf):
    long = counts.census_long({"G01": age_counts(spark, sf)}, AGES, "code")
    return allocate.draw_addresses(
        address_table(spark, sf), long, "code", "LONGITUDE", "LATITUDE", AGES, seed=SEED
    )


@query("u1_union_rows", "select c_nationkey as k from customer union all select s_nationkey from supplier")
def u1(spark, sf):
    return counts.union_rows(
        [table(spark, sf, "customer").selectExpr("c_nationkey as k"), table(spark, sf, "supplier").selectExpr("s_nationkey as k")]
    )


@query("u2_union_columns", "select cast(c_custkey as varchar) as k, c_acctbal as a, cast(null as varchar) as b from customer union all select s_name, null, s_name from supplier")
def u2(spark, sf):
    return counts.union_columns(
        table(spark, sf, "customer").selectExpr("c_custkey as k", "c_acctbal as a"),
        table(spark, sf, "supplier").selectExpr("s_name as k", "s_name as b"),
    )


_E_SQL = f"""{_WITHIN_SQL},
  {_draw_sql(_CENSUS_SQL, 'select index_right as code, "LONGITUDE", "LATITUDE" from mapped')}"""


@query("e1_allocate", f"with recursive {_E_SQL} select person_id, code as \"SA1_CODE_2021\", \"LONGITUDE\", \"LATITUDE\", {_ONE_HOT_SQL} from person")
def e1(spark, sf):
    folder = scratch_folder(spark, "query")
    mapped = areas.join_coords_with_area(points(spark, sf), area_polygons(spark, sf))
    sinks.to_parquet(mapped, f"{folder}/cache")
    census = age_counts(spark, sf).withColumnRenamed("code", "SA1_CODE_2021")
    sinks.to_parquet(census, f"{folder}/census/2021Census_G01_AUST_SA1.parquet")
    jobs.allocate(spark, f"{folder}/census", f"{folder}/out", AGES, cache=f"{folder}/cache", seed=SEED)
    schema = "person_id long, SA1_CODE_2021 long, LONGITUDE double, LATITUDE double, " + ", ".join(
        f"{f} boolean" for f in AGES
    )
    return spark.read.schema(schema).option("header", True).csv(f"{folder}/out")


_E_GEO = f"""cast(pid as varchar) as "ADDRESS_DETAIL_PID", 'FCS' as "GEOCODE_TYPE_CODE", "LONGITUDE", "LATITUDE", "STATE" """
_E_AREA = f"""{_wkt_sql('px', 'py')} as geometry, index_right, index_right as "SA1_CODE21", cast(index_right % 20 as varchar) as "SA2_CODE21" """
_E_JOIN = f"""mapped join (select c_custkey as pid, {STATE} as "STATE", lower(coalesce("FLAT_TYPE_CODE", 'unknown')) as "FLAT_TYPE_CODE", "POSTCODE" from (select *, {_FLAT} from customer)) d using (pid)"""


@query("e2_address_cache", f"with {_WITHIN_SQL} select {_E_GEO}, \"FLAT_TYPE_CODE\", \"POSTCODE\", {_E_AREA} from {_E_JOIN}")
def e2(spark, sf):
    output = scratch_folder(spark, "query")
    jobs.build_address_cache(spark, _address_folder(spark, sf), area_polygons(spark, sf), output)
    return spark.read.parquet(output)


@query("e3_spreadsheets_to_parquet", "select r_regionkey, r_name, c_custkey from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def e3(spark, sf):
    regions = table(spark, sf, "region")
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey"))
    rows = rows.join(regions, F.expr("n_regionkey = r_regionkey")).select("r_regionkey", "r_name", "c_custkey")
    folder = _spreadsheets(rows, f"concat('r', r_regionkey, '/c', c_custkey div 900, '_', c_custkey % 3, {_EXTENSION.format(n='c_custkey')})")
    schema = rows.select("c_custkey").schema
    done = jobs.spreadsheets_to_parquet(spark, f"{folder}/in", f"{folder}/out", schema)
    read = sinks.read_converted(spark, done)
    return reduce(DataFrame.unionByName, [df.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema]) for df in read])


@query(
    "e4_map_addresses",
    f"""with {_WITHIN_SQL} select {_E_GEO}, "FLAT_TYPE_CODE", "POSTCODE", {_E_AREA} from {_E_JOIN}
        where "FLAT_TYPE_CODE" in ('building', 'machinery', 'unknown') and index_right % 20 < 10""",
)
def e4(spark, sf):
    return jobs.map_addresses(
        geocodes(spark, sf), details(spark, sf), area_polygons(spark, sf), CRS, "filter",
        ["building", "machinery", "unknown"], (), (), [str(i) for i in range(10)],
    )


def entry(spark: SparkSession) -> DataFrame:
    return l3(spark, "/root/testdata/sf0.001")


def _corpus() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries of the optional folder for training corpora, and their SQL."""
    try:
        import corpus_pipeline
        from censusloom.llm import queries as corpus
    except ModuleNotFoundError as missing:
        if missing.name not in ("corpus_pipeline", "censusloom.llm"):
            raise
        return {}, {}
    sqls = corpus.SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
    return corpus.QUERIES | {"pipeline": corpus_pipeline.run}, sqls


def queries() -> dict[str, Query]:
    return _QUERIES | _corpus()[0]


def oracle_sql() -> dict[str, str]:
    return _SQL | _corpus()[1]
