import random

import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

from censusloom import (
    capture_placeholders, convert_to_parquet, get_spreadsheet_reader, list_files, load,
    load_gnaf_files_by_states, read_csv, read_parquet, read_psv, read_shapefile, read_spreadsheets,
    read_xlsx, scan_folder, to_parquet, with_placeholders, write_csv_in_chunks,
)
from censusloom.functions.templates import captured_names, file_path
from fixtures.filebytes import dbf_bytes, shp_bytes, xlsx_bytes

BOOK = {
    "soils & rain": [["plot", "depth_mm", "kind"], [17, 240, "loam"], [18, 95, "clay"], [23, 310, None]],
    "gauges, 2019": [["gauge", "site"], ["RG-7", "upper weir"], ["RG-9", "mill"]],
}


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    if isinstance(text, bytes):
        path.write_bytes(text)
    else:
        path.write_text(text)
    return str(path)


# --- templates ---


@pytest.mark.parametrize("template,names,expected", [
    ("{year}-{site}.rain+{unit}", ["year", "unit"], r"(.*?)\-.*?\.rain\+(.*?)"),
    ("", ["year"], ""),
    ("rain (all).csv", ["year"], r"rain\ \(all\)\.csv"),
    ("{a}{b}|{c_1}", [], r".*?.*?\|.*?"),
])
def test_capture_placeholders(template, names, expected):
    assert capture_placeholders(template, names, r".*?") == expected


PATHS = ["/rain/2019/upper_daily.psv", "/rain/2020/mill_hourly.psv", "/rain/2020/weir_daily.psv", "/snow/2020/mill_daily.psv"]


@pytest.mark.parametrize("template,names,pattern,expected", [
    ("/rain/{year}/{site}_{step}.psv", ["site", "step"], ".+", [("mill", "hourly"), ("upper", "daily"), ("weir", "daily")]),
    ("/{what}/2020/{site}_{step}.psv", ["site", "what"], "[^l]+", []),
    ("/{what}/2020/{site}_{step}.psv", ["site", "what"], "[a-z]+", [("rain", "mill"), ("rain", "weir"), ("snow", "mill")]),
    ("/rain/{year}/{site}_{step}.psv", [], ".+", [(), (), ()]),
    ("2020/{site}", ["site"], ".+", []),
])
def test_with_placeholders(spark, rows, template, names, pattern, expected):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    found = with_placeholders(df, "path", template, names, pattern)
    assert rows(found.select(*captured_names(template, names))) == expected


# --- folders ---


def test_list_files(spark, tmp_path):
    seen = ["a.psv", "b c.psv", "x+y/z%20.psv", "x+y/deep/q.txt"]
    hidden = [".lock", "_tmp/part.psv", "x+y/.old/r.psv"]
    for name in seen + hidden:
        put(tmp_path / name, "12345")
    found = list_files(spark, str(tmp_path))
    assert found.columns == ["path", "length", "modificationTime"] and {r.length for r in found.collect()} == {5}
    assert sorted(r.path for r in found.collect()) == sorted(str(tmp_path / n) for n in seen)
    every = list_files(spark, str(tmp_path), list_hidden=True)
    assert every.dtypes == found.dtypes and sorted(r.path for r in every.collect()) == sorted(str(tmp_path / n) for n in seen + hidden)


def test_read_spreadsheets_keys(spark, tmp_path):
    put(tmp_path / "gauge7.psv", "day|mm\n3|0.5\n")
    put(tmp_path / "gauge12.psv", "day|mm\n4|7\n")
    put(tmp_path / "sites.csv", "a\n1\n")
    folder = str(tmp_path)
    for given in (folder, folder + "/"):
        assert sorted(read_spreadsheets(spark, given, "psv")) == ["gauge12.psv", "gauge7.psv"]
    frames = read_spreadsheets(spark, folder + "/gauge{key}.psv", "psv")
    assert {k: tuple(df.first()) for k, df in frames.items()} == {"7": (3, 0.5), "12": (4, 7)}
    assert sorted(read_spreadsheets(spark, folder + "/ga{key}1{rest}.psv", "psv")) == ["uge"]
    assert read_spreadsheets(spark, folder, "xlsx") == {}


def test_folders_by_relative_path_and_scheme(spark, tmp_path, rows, monkeypatch):
    """The folder a template points into may be given in any form that Spark reads."""
    import os

    schema = spark.createDataFrame([], "n long").schema
    for i in (1, 2):
        put(tmp_path / f"t_{i}.csv", f"n\n{i}\n")
    relative = os.path.relpath(tmp_path, spark._jvm.java.lang.System.getProperty("user.dir"))
    for folder in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}", relative):
        frames = read_spreadsheets(spark, folder + "/t_{key}.csv", "csv")
        assert {k: df.first().n for k, df in frames.items()} == {"1": 1, "2": 2}
        assert rows(scan_folder(spark, folder + "/t_{key}.csv", "csv", schema)) == [(1, "1"), (2, "2")]
        with pytest.raises(ValueError, match="matches"):
            read_spreadsheets(spark, folder + "/u_{key}.csv", "csv")
        with pytest.raises(ValueError, match="matches"):
            scan_folder(spark, folder + "/u_{key}.csv", "csv", schema)


def test_regex_keeps_the_right_keys(spark, tmp_path):
    for i, name in enumerate(["rain.csv", "rain_04.csv", "rain_11.csv", "snow_11.csv", "rain_x.csv"]):
        put(tmp_path / name, f"n\n{i}\n")
    put(tmp_path / "rain_12.txt", "n\n9\n")
    frames = read_spreadsheets(spark, str(tmp_path) + "/", "csv", r"rain_\d+")
    assert {k: df.first().n for k, df in frames.items()} == {"rain_04.csv": 1, "rain_11.csv": 2}


def test_equal_keys_are_an_error(spark, tmp_path):
    put(tmp_path / "a" / "t.csv", "n\n1\n")
    put(tmp_path / "b" / "t.csv", "n\n2\n")
    with pytest.raises(ValueError, match="same key"):
        read_spreadsheets(spark, str(tmp_path), "csv")


def test_scan_folder_in_one_scan(spark, tmp_path, rows):
    folder = tmp_path / "my dir+x"
    for key in ("one", "two", "three"):
        put(folder / f"t_{key}.csv", f"n\n{len(key)}\n")
    scan = scan_folder(spark, f"{folder}/t_{{key}}.csv", "csv", spark.range(0).withColumnRenamed("id", "n").schema, "t_t")
    assert rows(scan) == [(3, "two"), (5, "three")]
    path = spark.read.schema("n long").csv(str(folder)).select(file_path()).first()[0]
    assert "/my dir+x/" in path


# --- delimited text and parquet ---


def test_readers(spark, tmp_path, rows):
    path = put(tmp_path / "t.csv", "code,day,x,ok\n0800,2010-04-15,1.5,true\n0801,2011-01-01,2,false\n")
    inferred = read_csv(spark, path)
    assert [f.dataType.simpleString() for f in inferred.schema] == ["int", "string", "double", "boolean"]
    declared = read_csv(spark, path, spark.createDataFrame([], "code string, day string, x double, ok boolean").schema)
    assert rows(declared)[0] == ("0800", "2010-04-15", 1.5, True)
    assert read_csv(spark, str(tmp_path / "none.csv")) is None
    assert read_psv(spark, str(tmp_path / "none.psv")) is None
    assert read_parquet(spark, str(tmp_path / "none.parquet")) is None
    with pytest.raises(ValueError, match=".docx"):
        get_spreadsheet_reader(".docx")
    assert rows(load(spark, path, "csv")) == rows(inferred)


@pytest.mark.parametrize("codec,stored", [("lz4", "LZ4"), ("gzip", "GZIP"), ("zstd", "ZSTD")])
def test_to_parquet_codecs(spark, tmp_path, codec, stored):
    path = tmp_path / "t"
    to_parquet(spark.range(10), str(path), codec)
    part = next(p for p in path.glob("part-*"))
    assert pyarrow.parquet.ParquetFile(part).metadata.row_group(0).column(0).compression == stored
    with pytest.raises(ValueError, match="compression"):
        to_parquet(spark.range(1), str(path), "snappy")


def test_csv_in_chunks(spark, tmp_path, rows):
    write_csv_in_chunks(spark.range(25).coalesce(1), str(tmp_path / "out"), 10)
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert len(parts) == 3 and all(p.read_text().startswith("id\n") for p in parts)
    back = spark.read.csv(str(tmp_path / "out"), header=True, schema="id long")
    assert sorted(r.id for r in back.collect()) == list(range(25))


# --- workbooks ---


def test_workbook_sheets(spark, tmp_path, rows):
    path = put(tmp_path / "book.xlsx", xlsx_bytes(BOOK))
    first, second = [(17, 240, "loam"), (18, 95, "clay"), (23, 310, None)], [("RG-7", "upper weir"), ("RG-9", "mill")]
    assert rows(read_xlsx(spark, path)) == first
    sheets = read_xlsx(spark, path, 0)
    assert {name: rows(df) for name, df in sheets.items()} == dict(zip(BOOK, (first, second)))
    assert rows(read_xlsx(spark, path, 2)) == second
    assert read_xlsx(spark, path, 3) is None
    wide = read_xlsx(spark, path, 1, spark.createDataFrame([], "plot string, other int").schema)
    assert rows(wide.select("plot", "depth_mm")) == [("17", 240), ("18", 95), ("23", 310)]


def test_workbook_dates(spark, tmp_path):
    from datetime import date, datetime

    data = [["d", "t", "both", "n"], [date(2021, 8, 10), datetime(2021, 8, 10, 6, 30), date(1999, 12, 31), 44418], [date(1900, 1, 1), None, datetime(2000, 2, 29, 23, 59, 59), 2.5]]
    df = read_xlsx(spark, put(tmp_path / "t.xlsx", xlsx_bytes({"s": data})))
    assert [f.dataType.simpleString() for f in df.schema] == ["date", "timestamp_ntz", "timestamp_ntz", "double"]
    assert sorted(tuple(r) for r in df.collect()) == [
        (date(1900, 1, 1), None, datetime(2000, 2, 29, 23, 59, 59), 2.5),
        (date(2021, 8, 10), datetime(2021, 8, 10, 6, 30), datetime(1999, 12, 31), 44418.0),
    ]


def test_workbook_is_parsed_once(spark, tmp_path):
    """Sheets, headers, kinds and rows all come from the written cells, not from the file."""
    df = read_xlsx(spark, put(tmp_path / "book.xlsx", xlsx_bytes(BOOK)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "binaryFile" not in plan and "parquet" in plan.lower()


def test_workbook_types(spark, tmp_path):
    data = [["n", "x", "ok", "mixed", "gap"], [1, 1.5, True, "a", None], [2, 2, False, 3, None]]
    df = read_xlsx(spark, put(tmp_path / "t.xlsx", xlsx_bytes({"s": data})))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "boolean", "string", "string"]
    assert [tuple(r) for r in df.orderBy("n").collect()] == [(1, 1.5, True, "a", None), (2, 2.0, False, "3", None)]


def test_missing_or_broken_workbook(spark, tmp_path):
    assert read_xlsx(spark, str(tmp_path / "none.xlsx")) is None
    assert read_xlsx(spark, str(tmp_path / "none.xlsx"), 0) is None
    assert read_xlsx(spark, put(tmp_path / "bad.xlsx", "no workbook")) is None


# --- address feeds ---


def feeds(spark, folder, state, ids, extra=""):
    lat = spark.createDataFrame([(i, 34.5, 150.3) for i in ids], "ADDRESS_DETAIL_PID string, LATITUDE double, LONGITUDE double")
    more = spark.createDataFrame([(i, "flat", 2000, "x") for i in ids], "ADDRESS_DETAIL_PID string, FLAT_TYPE_CODE string, POSTCODE long, EXTRA string")
    lat.toPandas().to_parquet(folder / f"{state}_ADDRESS_DEFAULT_GEOCODE_psv.parquet")
    more.toPandas().to_parquet(folder / f"{state}_ADDRESS_DETAIL_psv.parquet")


def test_load_by_states(spark, tmp_path, rows):
    feeds(spark, tmp_path, "NSW", ["1001", "1002"])
    feeds(spark, tmp_path, "ACT", ["1234"])
    geocode, detail = load_gnaf_files_by_states(spark, str(tmp_path), ["NSW"])
    assert geocode.columns == ["ADDRESS_DETAIL_PID", "LATITUDE", "LONGITUDE", "STATE"]
    assert rows(geocode.select("ADDRESS_DETAIL_PID", "STATE")) == [("1001", "NSW"), ("1002", "NSW")]
    assert rows(detail) == [("1001", "flat", 2000), ("1002", "flat", 2000)]
    geocode, detail = load_gnaf_files_by_states(spark, str(tmp_path))
    assert rows(geocode.select("ADDRESS_DETAIL_PID", "STATE")) == [("1001", "NSW"), ("1002", "NSW"), ("1234", "ACT")]
    assert detail.count() == 3
    geocode, detail = load_gnaf_files_by_states(spark, str(tmp_path), ["VIC"])
    assert geocode.count() == detail.count() == 0
    assert detail.columns == ["ADDRESS_DETAIL_PID", "FLAT_TYPE_CODE", "POSTCODE"] and "STATE" in geocode.columns


def test_only_wanted_columns_are_scanned(spark, tmp_path):
    feeds(spark, tmp_path, "NSW", ["1001"])
    _, detail = load_gnaf_files_by_states(spark, str(tmp_path), ["NSW"])
    assert "EXTRA" not in detail._jdf.queryExecution().executedPlan().toString()


# --- shapefiles ---

RINGS = [
    [[(0, 0), (0, 3), (3, 3), (3, 0), (0, 0)]],
    [[(5, 5), (5, 9), (9, 9), (9, 5), (5, 5)], [(6, 6), (7, 6), (7, 7), (6, 7), (6, 6)]],
]


def shapefile(folder, name, rings, rows, prj=None):
    put(folder / f"{name}.shp", shp_bytes(rings))
    fields = [("SA1_CODE21", "N", 12), ("SA2_NAME21", "C", 20)]
    put(folder / f"{name}.dbf", dbf_bytes(fields, rows))
    if prj:
        put(folder / f"{name}.prj", f'GEOGCS["{prj}",DATUM["x"]]')


def test_read_shapefile(spark, tmp_path):
    shapefile(tmp_path, "a", RINGS, [[101, "Here"], [102, None]], "GDA2020")
    shapefile(tmp_path, "b", RINGS[:1], [[103, "There"]])
    areas = read_shapefile(spark, str(tmp_path), "EPSG:7844").orderBy("index_right").collect()
    assert [(r.index_right, r.SA1_CODE21, r.SA2_NAME21) for r in areas] == [
        (0, 101, "Here"), (1, 102, None), (2, 103, "There"),
    ]
    assert [[[(p.x, p.y) for p in ring] for ring in r.rings] for r in areas] == [*RINGS, RINGS[0]]
    assert (areas[1].minx, areas[1].maxy) == (5.0, 9.0)
    one = read_shapefile(spark, str(tmp_path / "b.shp"), "EPSG:7844")
    assert [r.SA1_CODE21 for r in one.collect()] == [103]


def test_attribute_columns_once_by_name(spark, tmp_path):
    put(tmp_path / "a.shp", shp_bytes(RINGS[:1]))
    put(tmp_path / "a.dbf", dbf_bytes([("SA1", "N", 5), ("ONLY", "C", 3)], [[7, "x"]]))
    put(tmp_path / "b.shp", shp_bytes(RINGS[:1]))
    put(tmp_path / "b.dbf", dbf_bytes([("SA1", "C", 5)], [["8A"]]))
    areas = read_shapefile(spark, str(tmp_path), "EPSG:7844").orderBy("index_right")
    assert [(r.SA1, r.ONLY) for r in areas.select("SA1", "ONLY").collect()] == [("7", "x"), ("8A", None)]


def test_one_large_shapefile_is_parsed_by_many_tasks(spark, tmp_path, monkeypatch):
    from censusloom.sources import shapes

    monkeypatch.setattr(shapes, "PIECE", 400)
    count = 120
    rings = [[[(i, 0), (i, 1), (i + 1, 1), (i, 0)]] for i in range(count)]
    shapefile(tmp_path, "a", rings, [[i, f"n{i}"] for i in range(count)])
    files = spark.read.format("binaryFile").load(str(tmp_path / "a.shp"))
    parsed = shapes._parsed(files, shapes._shape_pieces, shapes._polygons, shapes.SHAPES)
    assert parsed.groupBy(F.spark_partition_id()).count().count() > 4
    areas = read_shapefile(spark, str(tmp_path), "EPSG:7844").orderBy("index_right").collect()
    assert [(r.index_right, r.SA1_CODE21, r.SA2_NAME21, r.minx) for r in areas] == [(i, i, f"n{i}", float(i)) for i in range(count)]


def test_stored_areas_are_parsed_once(spark, tmp_path):
    from censusloom.sources.shapes import stored_areas

    shapefile(tmp_path / "in", "a", RINGS, [[101, "Here"], [102, None]], "GDA2020")
    store = str(tmp_path / "store")
    first = stored_areas(spark, str(tmp_path / "in"), "EPSG:7844", store)
    assert "MapInPandas" not in first._jdf.queryExecution().executedPlan().toString()
    kept = sorted(p.name for p in (tmp_path / "store").iterdir())
    again = stored_areas(spark, str(tmp_path / "in"), "EPSG:7844", store)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect())) and again.schema["rings"].metadata["crs"] == "EPSG:7844"
    assert sorted(p.name for p in (tmp_path / "store").iterdir()) == kept and len(kept) == 1
    shapefile(tmp_path / "in", "b", RINGS[:1], [[103, "There"]])
    assert stored_areas(spark, str(tmp_path / "in"), "EPSG:7844", store).count() == 3


def test_shapefile_in_another_crs(spark, tmp_path):
    shapefile(tmp_path, "a", RINGS[:1], [[101, "Here"]], "GDA94")
    with pytest.raises(ValueError, match="GDA94"):
        read_shapefile(spark, str(tmp_path), "EPSG:7844")


# --- conversion ---


def test_convert_folder(spark, tmp_path, rows):
    source, target = tmp_path / "in", tmp_path / "out"
    put(source / "a.csv", "n,t\n1,x\n")
    put(source / "deep" / "b.psv", "n|t\n2|y\n")
    put(source / "c.xlsx", xlsx_bytes({"s": [["n"], [3]]}))
    put(source / "old.xls", b"\xd0\xcf")
    put(source / "notes.txt", "no")
    done = convert_to_parquet(spark, str(source), str(target))
    assert sorted(p.removeprefix(str(target)) for p in done.values()) == ["/a.parquet", "/c.parquet", "/deep/b.parquet"]
    assert rows(spark.read.parquet(str(target / "deep" / "b.parquet"))) == [(2, "y")]
    assert rows(spark.read.parquet(str(target / "c.parquet"))) == [(3,)]
    put(source / "d.csv", "n\n4\n")
    again = convert_to_parquet(spark, str(source), str(target))
    assert [p.removeprefix(str(source)) for p in again] == ["/d.csv"]
    assert sorted(read_spreadsheets(spark, str(target), "parquet")) == ["a.parquet", "b.parquet", "c.parquet", "d.parquet"]


def test_delimited_text_round_trip(spark, tmp_path, rows):
    from censusloom import sinks
    from censusloom.sources import tables

    made = spark.createDataFrame(
        [(1, 'say "hi", x'), (2, "  pad  "), (3, "a|b"), (4, None), (5, "two\nlines")], "id long, note string"
    )
    sinks.write_csv_in_chunks(made, f"{tmp_path}/out", 2)
    back = tables.read_csv(spark, f"{tmp_path}/out", made.schema, multi_line=True)
    assert rows(back) == rows(made)


def _broken(path, separator, end, seed, count=600):
    """A file with breaks, quotes and separators inside quotes, and some records longer than a split."""
    rnd = random.Random(seed)

    def field():
        inner = rnd.choice(["a\nb", 'x\n\n""y"" \n', f"{separator}\n{separator}", '""', "\n" * rnd.randrange(60), "w" * rnd.randrange(40) + "\n", "é\n😀"])
        return f'"{inner}"' if rnd.random() < 0.3 else rnd.choice(["", "12", "-3.5", "true", "x y"])

    lines = [separator.join(["id", '"no\nte"', "val"])]
    lines += [separator.join([str(i), field(), field()]) for i in range(count)]
    text = end.join(line.replace("\n", end) for line in lines) + end
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())


@pytest.fixture
def small_splits(spark):
    """Ranges of 2,000 bytes, so that small files have many."""
    settings = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "100"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name in settings:
        spark.conf.unset(name)


@pytest.mark.parametrize("separator,end", [(",", "\n"), ("|", "\r\n")])
def test_breaks_inside_quotes_are_split_over_tasks(spark, tmp_path, small_splits, separator, end):
    """Equal to the unsplit read of the same files, by many tasks; one break is as long as several ranges."""
    folder = tmp_path / "in"
    for i in range(3):
        _broken(folder / f"t{i}.txt", separator, end, i)
    (folder / "t1.txt").write_bytes((folder / "t1.txt").read_bytes() + f'9999{separator}"{("long" + end) * 2000}"{separator}end{end}'.encode())
    schema = spark.createDataFrame([], "id int, note string, val string").schema
    reader = read_psv if separator == "|" else read_csv
    split = reader(spark, str(folder), schema, multi_line=True)
    whole = spark.read.schema(schema).csv(str(folder), header=True, sep=separator, multiLine=True, quote='"', escape='"')
    assert split.count() == whole.count() == 1801
    assert split.exceptAll(whole).count() == whole.exceptAll(split).count() == 0
    assert split.rdd.getNumPartitions() > 10 > whole.rdd.getNumPartitions()
    inferred = reader(spark, str(folder), multi_line=True)
    assert inferred.dtypes == [("id", "int"), ("no\nte".replace("\n", "\n"), "string"), ("val", "string")]
    assert inferred.where("id = 9999 and val = 'end'").count() == 1


def test_text_without_breaks_or_with_open_quotes(spark, tmp_path, rows):
    """No break: Spark's own reader. A quote never closed: the unsplit reader."""
    plain = read_csv(spark, put(tmp_path / "a.csv", 'k,v\n1,"x ""y"""\n2,z\n'), multi_line=True)
    assert rows(plain) == [(1, 'x "y"'), (2, "z")]
    assert "MapInArrow" not in plain._jdf.queryExecution().executedPlan().toString()
    odd = put(tmp_path / "b.csv", 'k,v\n1,"a\nb"\n2,5" pipe\n')
    schema = spark.createDataFrame([], "k int, v string").schema
    whole = spark.read.schema(schema).csv(odd, header=True, multiLine=True, quote='"', escape='"')
    assert rows(read_csv(spark, odd, schema, multi_line=True)) == rows(whole)
    assert read_csv(spark, str(tmp_path / "none.csv"), multi_line=True) is None


def test_conversion_keeps_breaks_and_declared_types(spark, tmp_path, rows, small_splits):
    source, target = tmp_path / "in", tmp_path / "out"
    _broken(source / "wide.csv", ",", "\n", 4)
    _broken(source / "dos.psv", "|", "\r\n", 5)
    put(source / "codes.csv", "code,Big,day,e,flag\n0800,12345678901234567890,2010-04-15,1e3,TRUE\n0822,3,x,2,false\n")
    put(source / "head.csv", "code,Big,day,e,flag\n")
    put(source / "nothing.csv", "")
    put(source / "same names.psv", "k|K||k\n1|2|3|4\n5|6\n")
    schema = spark.createDataFrame([], "CODE string").schema
    done = convert_to_parquet(spark, str(source), str(target), schema)
    assert sorted(p.removeprefix(f"{target}/") for p in done.values()) == ["codes.parquet", "dos.parquet", "head.parquet", "same names.parquet", "wide.parquet"]
    codes = spark.read.parquet(f"{target}/codes.parquet")
    assert [t for _, t in codes.dtypes] == ["string", "decimal(38,0)", "string", "double", "boolean"]
    assert [str(v) for v in rows(codes)[0]] == ["0800", "12345678901234567890", "2010-04-15", "1000.0", "True"]
    assert spark.read.parquet(f"{target}/head.parquet").columns == codes.columns
    assert rows(spark.read.parquet(f"{target}/same names.parquet")) == [(1, 2, 3, 4), (5, 6, None, None)]
    for name, separator in (("wide.csv", ","), ("dos.psv", "|")):
        whole = spark.read.csv(str(source / name), header=True, sep=separator, multiLine=True, quote='"', escape='"')
        back = spark.read.parquet(f"{target}/{name[:-4]}.parquet").select(*[F.col(f"`{c}`").cast("string") for c in whole.columns])
        assert back.exceptAll(whole).count() == whole.exceptAll(back).count() == 0 and back.count() == 600


def test_many_small_files_in_a_handful_of_jobs(spark, tmp_path):
    """Files with the same columns share a scan and a write; nothing is left beside the targets."""
    source, target = tmp_path / "in", tmp_path / "out"
    for i in range(150):
        put(source / f"d{i % 7}" / f"a{i}.csv", f"k,v\n{i},x{i}\n{i},\"y\nz\"\n")
        put(source / f"b{i}.psv", f"k|w\n{i}|{i}.5\n")
    for i in range(10):
        put(source / f"c{i}.xlsx", xlsx_bytes({"s": [["k"], [i]]}))
    put(source / "bad.xlsx", "no workbook")
    spark.sparkContext.setJobGroup("convert", "")
    try:
        done = convert_to_parquet(spark, str(source), str(target))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("convert"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(done) == 310 and jobs < 60
    assert sorted(p.name for p in target.iterdir() if not p.name.endswith(".parquet")) == [f"d{i}" for i in range(7)]
    back = spark.read.option("recursiveFileLookup", True).parquet(str(target / "d3"))
    assert sorted(map(tuple, back.collect())) == sorted(r for i in range(3, 150, 7) for r in ((i, f"x{i}"), (i, "y\nz")))
    assert convert_to_parquet(spark, str(source), str(target)) == {}


def test_conversion_of_a_relative_folder_and_equal_targets(spark, tmp_path, monkeypatch):
    import os

    from censusloom import sinks

    monkeypatch.chdir(tmp_path)
    os.makedirs("in/sub")
    for name in ("in/sub/a.csv", "in/b.csv"):
        with open(name, "w") as file:
            file.write('id,note\n1,"x ""y"""\n')
    here = os.path.relpath(str(tmp_path), os.getcwd())
    base = str(tmp_path) if here == "." else here
    done = sinks.convert_to_parquet(spark, f"file://{tmp_path}/in", f"{base}/out")
    assert sorted(done.values()) == [f"{tmp_path}/out/b.parquet", f"{tmp_path}/out/sub/a.parquet"]
    assert spark.read.parquet(f"{tmp_path}/out/sub/a.parquet").collect()[0].note == 'x "y"'
    assert sinks.convert_to_parquet(spark, f"{tmp_path}/in", f"{tmp_path}/out") == {}
    with open("in/b.psv", "w") as file:
        file.write("id|note\n1|x\n")
    with pytest.raises(ValueError, match="both become"):
        sinks.convert_to_parquet(spark, f"{tmp_path}/in", f"{tmp_path}/other")


def test_converted_spreadsheets_are_read_by_their_columns(spark, tmp_path, rows):
    """The conversion query reads files of the same columns as one scan, however many there are."""
    import __spark_entry__ as entry

    customers = [(i * 450, f"n{i}", i % 3) for i in range(40)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(3)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "AFRICA"), (1, "ASIA")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    found = entry.queries()["e3_spreadsheets_to_parquet"](spark, str(tmp_path))
    regions = {0: (0, "AFRICA"), 1: (1, "ASIA"), 2: (0, "AFRICA")}
    assert rows(found) == sorted(((*regions[n], k) for k, _, n in customers), key=lambda r: [(False, str(v)) for v in r])
    assert found._jdf.queryExecution().analyzed().collectLeaves().size() <= 2


def test_converted_files_of_other_columns_are_apart(spark, tmp_path, rows):
    from censusloom.sinks import read_converted

    source = tmp_path / "in"
    for name, text in (("a", "k,v\n1,x\n"), ("b", "k,v\n2,y\n"), ("c", "k,v\n2.5,z\n"), ("d", "k,v\n")):
        put(source / f"{name}.csv", text)
    done = convert_to_parquet(spark, str(source), str(tmp_path / "out"))
    frames = {tuple(t for _, t in df.dtypes): rows(df) for df in read_converted(spark, done)}
    assert frames == {("int", "string"): [(1, "x"), (2, "y")], ("double", "string"): [(2.5, "z")], ("string", "string"): []}
