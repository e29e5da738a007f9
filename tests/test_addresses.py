from datetime import date
from decimal import Decimal

import pytest

from censusloom import filter_and_join_gnaf_frames, filter_gnaf_cache, filter_sa1_regions
from censusloom.operators.addresses import keep_in


@pytest.fixture(scope="module")
def geocode(spark):
    return spark.createDataFrame(
        [(f"GA{i}", -12.0 - i / 4, 130.5 + i / 8) for i in range(7)],
        "ADDRESS_DETAIL_PID string, LATITUDE double, LONGITUDE double",
    )


@pytest.fixture(scope="module")
def detail(spark):
    kinds = ["SHED", None, "Duplex", "shed", None, "KIOSK"]
    return spark.createDataFrame(
        [(f"GA{i + 1}", kind, 810 + 10 * (i % 3)) for i, kind in enumerate(kinds)],
        "ADDRESS_DETAIL_PID string, FLAT_TYPE_CODE string, POSTCODE long",
    )


@pytest.mark.parametrize(
    "types,postcodes,expected",
    [
        ([], [], [1, 2, 3, 4, 5, 6]),
        (["shed"], [], [1, 4]),
        (["unknown", "kiosk"], [], [2, 5, 6]),
        ([], [820], [2, 5]),
        (["shed", "duplex"], [830, 810], [1, 3, 4]),
        (["KIOSK"], [], []),
        (["shed"], [999], []),
    ],
)
def test_filter_and_join(geocode, detail, types, postcodes, expected):
    joined = filter_and_join_gnaf_frames(geocode, detail, types, postcodes)
    assert sorted(r.ADDRESS_DETAIL_PID for r in joined.collect()) == [f"GA{i}" for i in expected]


def test_clashing_columns_get_a_suffix(spark, geocode, detail):
    both = detail.selectExpr("*", "1 as LATITUDE")
    assert filter_and_join_gnaf_frames(geocode, both).columns == [
        "ADDRESS_DETAIL_PID", "LATITUDE", "LONGITUDE", "FLAT_TYPE_CODE", "POSTCODE", "LATITUDE_right",
    ]


@pytest.mark.parametrize(
    "sa1,sa2,expected",
    [
        ([], [], list(range(12))),
        (["7003", "7011"], [], [3, 11]),
        ([], ["S1"], [1, 5, 9]),
        (["7001", "7002", "7005"], ["S1"], [1, 5]),
        (["7001"], ["S2"], []),
        (["1"], [], []),
    ],
)
def test_regions(spark, sa1, sa2, expected):
    df = spark.range(12).selectExpr("cast(7000 + id as string) as SA1_CODE_2021", "concat('S', id % 4) as SA2_CODE_2021", "id")
    kept = filter_sa1_regions(df, sa1, sa2, "SA1_CODE_2021", "SA2_CODE_2021")
    assert sorted(r.id for r in kept.collect()) == expected


def cache(spark):
    """Forty mapped addresses; every filter column has its own period."""
    return spark.range(40).selectExpr(
        "element_at(array('TAS', 'NT', 'WA'), cast(id % 3 + 1 as int)) as STATE", "cast(7000 + id as string) as SA1_CODE21",
        "concat('S', id % 5) as SA2_CODE21", "if(id % 2 = 0, 'shed', 'kiosk') as FLAT_TYPE_CODE", "800 + id % 7 as POSTCODE", "id",
    )


@pytest.mark.parametrize(
    "filters,expected",
    [
        ({}, lambda i: True),
        ({"states": ["TAS", "WA"]}, lambda i: i % 3 != 1),
        ({"region_codes": ["7004", "7039", "8000"]}, lambda i: i in (4, 39)),
        ({"sa2_codes": ["S0"]}, lambda i: i % 5 == 0),
        ({"flat_type_codes": ["kiosk"]}, lambda i: i % 2 == 1),
        ({"postcodes": [803, 806]}, lambda i: i % 7 in (3, 6)),
        (
            {"states": ["NT"], "sa2_codes": ["S1", "S2"], "flat_type_codes": ["shed"], "postcodes": [801, 802]},
            lambda i: i % 3 == 1 and i % 5 in (1, 2) and i % 2 == 0 and i % 7 in (1, 2),
        ),
    ],
)
def test_cache_filter(spark, filters, expected):
    assert sorted(r.id for r in filter_gnaf_cache(cache(spark), **filters).collect()) == [i for i in range(40) if expected(i)]


def test_cache_filter_reaches_the_scan(spark, tmp_path):
    cache(spark).write.partitionBy("STATE").parquet(str(tmp_path / "cache"))
    kept = filter_gnaf_cache(spark.read.parquet(str(tmp_path / "cache")), ["NT"], postcodes=[804])
    plan = kept.select("SA1_CODE21")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualTo(POSTCODE,804)]" in plan.replace("IsNotNull(POSTCODE), ", "")
    assert "PartitionFilters: [isnotnull(STATE" in plan
    assert "SA2_CODE21" not in plan.split("ReadSchema")[1]


def test_long_list_equals_short_list(spark, rows):
    df = spark.range(5000).selectExpr("id as k", "id % 7 as v")
    some = list(range(0, 5000, 3))
    assert rows(keep_in(df, "k", some)) == rows(df.where("k % 3 = 0"))


@pytest.mark.parametrize("many", [1000, 1001])
def test_text_list_on_a_number_column(spark, many):
    from censusloom.operators.addresses import keep_in

    codes = spark.range(5).selectExpr("id as code")
    assert keep_in(codes, "code", [str(i) for i in range(2, many + 1)] + ["none"]).count() == 3


@pytest.mark.parametrize("more", [0, 1001])
@pytest.mark.parametrize("kind,values,expected", [
    ("bigint", [800.0, 801.5, 802], [800, 802]),
    ("bigint", [Decimal("803.0"), Decimal("804.2"), "805", "x", None, True], [803, 805]),
    ("int", [800, 2**40, 1e300], [800]),
    ("double", [800, 801.0, "802", Decimal("803")], [800, 801, 802, 803]),
    ("decimal(10,2)", [800, 801.0, "802.00", Decimal("803.001")], [800, 801, 802]),
    ("string", [800, "801"], [800, 801]),
    ("float", [800.0, 800.1], [800]),
])
def test_values_of_any_type(spark, kind, values, expected, more):
    """Short and long lists agree: a value counts if the column's type has it exactly."""
    df = spark.range(800, 810).selectExpr("id", f"cast(id as {kind}) as p")
    kept = keep_in(df, "p", values + [f"none{i}" for i in range(more)])
    assert kept.columns == ["id", "p"] and sorted(r.id for r in kept.collect()) == expected


@pytest.mark.parametrize("more", [0, 1001])
def test_dates_and_booleans(spark, more):
    df = spark.range(5).selectExpr("id", "date_add(date'2021-08-10', cast(id as int)) as d", "id = 3 as b")
    filler = [f"none{i}" for i in range(more)]
    assert sorted(r.id for r in keep_in(df, "d", [date(2021, 8, 11), "2021-08-13", 2021, *filler]).collect()) == [1, 3]
    assert [r.id for r in keep_in(df, "b", [True, *filler]).collect()] == [3]
    assert keep_in(df, "b", [1, *filler]).count() == 0
