import csv


from pyspark.sql import functions as F

from censusloom.plans import jobs
from tests.test_sources import put, shapefile

AGES = ["Age_0_4_yr_M", "Age_0_4_yr_F"]


def inputs(spark, tmp_path):
    homes, shapes, census = tmp_path / "gnaf", tmp_path / "shapes", tmp_path / "census data"
    for folder in (homes, shapes, census):
        folder.mkdir()
    make = spark.createDataFrame
    for state, at in (("NSW", [("1", 1.0, 1.0), ("2", 2.0, 1.5), ("3", 40.0, 40.0)]), ("WA", [("4", 11.0, 11.0)])):
        make(at, "ADDRESS_DETAIL_PID string, LATITUDE double, LONGITUDE double").toPandas().to_parquet(
            homes / f"{state}_ADDRESS_DEFAULT_GEOCODE_psv.parquet"
        )
        make([(p, "FLAT", 2000 + int(p)) for p, _, _ in at], "ADDRESS_DETAIL_PID string, FLAT_TYPE_CODE string, POSTCODE long").toPandas().to_parquet(
            homes / f"{state}_ADDRESS_DETAIL_psv.parquet"
        )
    square = lambda a, b: [[(a, a), (a, b), (b, b), (b, a), (a, a)]]
    shapefile(shapes, "areas", [square(0, 3), square(10, 12)], [[101, "A"], [102, "B"]])
    make([("101", 5, 9), ("102", 2, 9), ("999", 3, 9)], "SA1_CODE_2021 string, Age_0_4_yr_M long, Tot_M long").toPandas().to_parquet(
        census / "2021Census_G01_AUST_SA1.parquet"
    )
    make([("101", 1)], "SA1_CODE_2021 string, Age_0_4_yr_F long").toPandas().to_parquet(
        census / "2021Census_G02A_AUST_SA1.parquet"
    )
    make([("101", 77)], "SA1_CODE_2021 string, Age_0_4_yr_F long").toPandas().to_parquet(
        census / "2021Census_G01_AUST_SA2.parquet"
    )
    return str(homes), str(shapes), str(census)


def placed(folder):
    found = []
    for part in folder.glob("part-*"):
        with open(part) as f:
            found += list(csv.DictReader(f))
    return found


def sums(persons):
    return {
        (code, f): n
        for code in {p["SA1_CODE_2021"] for p in persons}
        for f in AGES
        if (n := sum(p["SA1_CODE_2021"] == code and p[f] == "true" for p in persons))
    }


def test_allocate_from_files_and_from_cache(spark, tmp_path):
    homes, shapes, census = inputs(spark, tmp_path)
    jobs.allocate(spark, census, str(tmp_path / "out"), AGES, gnaf_dir=homes, shapefile_dir=shapes, seed=3)
    persons = placed(tmp_path / "out")
    assert sums(persons) == {("101", AGES[0]): 5, ("101", AGES[1]): 1, ("102", AGES[0]): 2}
    assert sorted(int(p["person_id"]) for p in persons) == list(range(8))
    assert list(persons[0]) == ["person_id", "SA1_CODE_2021", "LONGITUDE", "LATITUDE", *AGES]

    jobs.build_address_cache(spark, homes, shapes, str(tmp_path / "cache"))
    cache = spark.read.parquet(str(tmp_path / "cache"))
    assert {(r.ADDRESS_DETAIL_PID, r.SA1_CODE21, r.geometry, r.FLAT_TYPE_CODE) for r in cache.collect()} == {
        ("1", 101, "POINT (1 1)", "flat"), ("2", 101, "POINT (1.5 2)", "flat"),
        ("3", None, "POINT (40 40)", "flat"), ("4", 102, "POINT (11 11)", "flat"),
    }
    jobs.allocate(spark, census, str(tmp_path / "again"), AGES, cache=str(tmp_path / "cache"), seed=3)
    key = lambda p: int(p["person_id"])
    assert sorted(placed(tmp_path / "again"), key=key) == sorted(persons, key=key)

    jobs.allocate(
        spark, census, str(tmp_path / "wa"), AGES, cache=str(tmp_path / "cache"), states=["WA"], postcodes=[2004]
    )
    assert sums(placed(tmp_path / "wa")) == {("102", AGES[0]): 2}


def test_job_summaries(spark, tmp_path):
    """Counted while writing; equal to what the tables say afterwards."""
    from censusloom import reconcile
    from censusloom.operators.areas import unmapped_count

    homes, shapes, census = inputs(spark, tmp_path)
    told = jobs.build_address_cache(spark, homes, shapes, str(tmp_path / "cache"))
    cache = spark.read.parquet(str(tmp_path / "cache"))
    assert (told.addresses, told.unmapped) == (cache.count(), unmapped_count(cache)) == (4, 1)
    told = jobs.allocate(spark, census, str(tmp_path / "out"), AGES, cache=str(tmp_path / "cache"), seed=3)
    assert (told.addresses, told.unmapped) == (4, 1)
    persons = spark.read.csv(str(tmp_path / "out"), header=True, inferSchema=True)
    tables = jobs.read_spreadsheets(spark, census, "parquet", jobs.CENSUS_PATTERN)
    counts = jobs.census_long(tables, AGES, jobs.CODE).select(F.col(jobs.CODE).cast("int").alias(jobs.CODE), "feature", "n")
    both = reconcile(persons, counts, jobs.CODE, AGES).groupBy("feature").agg(F.sum("wanted"), F.sum("placed")).collect()
    assert {r[0]: (r[1], r[2]) for r in both} == {f: (told.wanted[f], told.placed[f]) for f in AGES if told.wanted[f]}
    none = jobs.allocate(spark, census, str(tmp_path / "none"), AGES, cache=str(tmp_path / "cache"), states=["TAS"])
    assert none.addresses == 0 and none.placed == dict.fromkeys(AGES, 0) and none.unplaced == told.wanted


def test_files_follow_ids_and_bytes(spark, tmp_path):
    from censusloom.sinks import write_csv_in_order

    df = spark.range(5000).repartition(7).selectExpr("id as person_id", "id % 2 = 0 as f")
    for size, chunk in ((18 * 600, None), (18 * 600, 100), (1 << 20, None)):
        out = tmp_path / f"{size}-{chunk}"
        write_csv_in_order(df, str(out), "person_id", 5000, size, chunk)
        files = sorted(out.glob("part-*.csv"))
        ids = [[int(line.split(",")[0]) for line in f.read_text().splitlines()[1:]] for f in files]
        assert sum(ids, []) == list(range(5000))
        assert len(files) == {None: -(-5000 // (size // 18)), 100: 54}[chunk] or chunk == 100 and max(map(len, ids)) == 100


def test_nearest_gives_every_address_an_area(spark, tmp_path):
    homes, shapes, _ = inputs(spark, tmp_path)
    mapped = jobs.join_gnaf_with_shapefile(
        spark, homes, shapes, strategy="join_nearest", states=["NSW"], building_types=["flat"], region_codes=[102]
    )
    assert [(r.ADDRESS_DETAIL_PID, r.SA1_CODE21) for r in mapped.collect()] == [("3", 102)]
    plain = jobs.join_gnaf_with_shapefile(spark, homes, shapes, states=["NSW"])
    assert "FLAT_TYPE_CODE" not in plain.columns and plain.count() == 3


def test_repeated_codes_multiply(spark, tmp_path):
    make = spark.createDataFrame
    mapped = make([(101, 1.0, 1.0)], "SA1_CODE21 long, LONGITUDE double, LATITUDE double")
    census = {"G01": make([("101", 2), ("101", 2)], "SA1_CODE_2021 string, f long")}
    persons = jobs.place_census(mapped, census, ["f"])
    # two joined rows with a count of two: the code has two places to draw from, and draws two
    assert persons.where("f").count() == 2


def test_spreadsheets_to_parquet(spark, tmp_path):
    put(tmp_path / "in" / "a.csv", "n\n1\n")
    jobs.spreadsheets_to_parquet(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "a.parquet")).count() == 1
