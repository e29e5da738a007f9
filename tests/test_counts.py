import pytest
from pyspark.sql import functions as F

from censusloom import census_long, join_census_frames, standardize_names
from censusloom.operators.counts import (
    cast_like, join_sampled_features, stack_sampled_features, union_columns,
)

KEY = "SA1_CODE_2021"


@pytest.fixture(scope="module")
def frames(spark):
    make = spark.createDataFrame
    return {
        "G01": make([(1, 10, 5), (2, None, 7)], f"{KEY} long, a long, Tot long"),
        "G02": make([(2, 20), (3, 30)], f"{KEY} long, b long"),
        "G03": make([(3, 1), (4, 0), (None, 9)], f"{KEY} long, a long"),
    }


def as_dicts(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda d: (d[KEY] is None, d[KEY] or 0))


@pytest.mark.parametrize("unique", [None, True, False])
def test_wide_join(frames, unique):
    none = dict.fromkeys(["a", "Tot", "b", "a__G03"])
    assert as_dicts(join_census_frames(frames, unique_keys=unique)) == [
        none | {KEY: 1, "a": 10, "Tot": 5},
        none | {KEY: 2, "Tot": 7, "b": 20},
        none | {KEY: 3, "b": 30, "a__G03": 1},
        none | {KEY: 4, "a__G03": 0},
        none | {KEY: None, "a__G03": 9},
    ]


def test_wide_join_multiplies_repeated_keys(spark, frames):
    twice = spark.createDataFrame([(1, 1), (1, 2)], f"{KEY} long, c long")
    joined = join_census_frames({"x": frames["G01"], "y": twice})
    assert sorted((r[KEY], r.c) for r in joined.collect() if r.c) == [(1, 1), (1, 2)]


def test_wide_join_is_one_shuffle(frames):
    plan = join_census_frames(frames, unique_keys=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_long_form(frames, rows):
    assert rows(census_long(frames, ["a", "b", "a__G03"])) == [
        ("G01", 1, "a", 10), ("G02", 2, "b", 20), ("G02", 3, "b", 30), ("G03", 3, "a__G03", 1),
        ("G03", None, "a__G03", 9),
    ]
    plan = census_long(frames, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Tot" not in plan.split("ExistingRDD")[0]
    with pytest.raises(ValueError, match="zzz"):
        census_long(frames, ["a", "zzz"])


def test_standardize_names(spark):
    make = spark.createDataFrame
    tables = {"G01": make([(1, 2)], "short_col int, other int"), "G02": make([(4,)], "short_col int"),
              "G03": make([(4,)], "short_col int")}
    names = make(
        [("G01", "short_col", "Long Col Name"), ("G01", "other", None), ("G02", "short_col", "long_col")],
        "identification string, abbreviation string, long string",
    )
    got = standardize_names(tables, names, "identification", "abbreviation", "long")
    assert {k: v.columns for k, v in got.items()} == {
        "G01": ["long_col_name", "other"], "G02": ["long_col"], "G03": ["short_col"],
    }


def test_cast_like_rejects_bad_text(spark):
    codes = spark.createDataFrame([("x",)], "code string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cast_like(codes, "code", spark.range(1), "id").collect()


def test_union_columns(spark, rows):
    make = spark.createDataFrame
    a, b = make([(1, 1)], "k int, n int"), make([("x", 1.5, True)], "k string, n double, f boolean")
    assert rows(union_columns(a, b)) == [("1", 1.0, None), ("x", 1.5, True)]


def test_stack_and_join_sampled(spark, rows):
    make = spark.createDataFrame
    a = make([("A", True), ("A", True), ("B", True)], "code string, f boolean")
    b = make([("A", True), ("A", True), ("C", True)], "code string, g boolean")
    assert rows(stack_sampled_features(a, b)) == rows(
        a.withColumn("g", F.lit(False)).unionByName(b.withColumn("f", F.lit(False)))
    )
    assert rows(join_sampled_features(a, b)) == [
        *[("A", True, True)] * 4, ("B", True, False), ("C", False, True),
    ]


def test_features_of_tables_named_like_files(spark, frames, rows):
    from censusloom.operators.allocate import randomly_assign_census_features, reconcile

    tables = {f"{name}.parquet": df for name, df in frames.items()}
    again = "a__G03.parquet"
    assert rows(census_long(tables, [again])) == [("G03.parquet", 3, again, 1), ("G03.parquet", None, again, 9)]
    homes = spark.createDataFrame([(3, 1.0, 2.0, 2), (3, 3.0, 4.0, 2)], f"{KEY} long, x double, y double, `{again}` long")
    persons = randomly_assign_census_features(homes, KEY, "x", "y", [again])
    assert persons.count() == 2 and persons.columns[-1] == again
    wanted = spark.createDataFrame([(3, again, 2)], f"{KEY} long, feature string, n long")
    assert rows(reconcile(persons, wanted, KEY, [again])) == [(3, again, 2, 2)]


def _five(spark, many):
    """Five tables that repeat codes; one code has ``many`` rows in three of them."""
    sizes = {"a": (many, 2, 0, 1), "b": (many // 4, 3, 2, 0), "c": (1, 1, 1, 1), "d": (3, 0, 5, 0), "e": (0, 2, 2, 1)}
    frames = {}
    for name, counts in sizes.items():
        rows = [(code, 100 * code + i // 2) for code, n in enumerate(counts) for i in range(n)] + [(None, 7)]
        frames[name] = spark.createDataFrame(rows, f"code long, {name} long")
    return frames


@pytest.mark.parametrize("many", [12, 400])
def test_repeated_keys_in_five_tables(spark, monkeypatch, many):
    from functools import reduce

    from censusloom.operators import counts

    monkeypatch.setattr(counts, "PRODUCT", 60)
    frames = _five(spark, many)
    joined = counts.join_census_frames(frames, "code")
    chain = reduce(lambda a, b: a.join(b, "code", "full"), frames.values())
    assert joined.columns == chain.columns
    assert joined.exceptAll(chain).count() == chain.exceptAll(joined).count() == 0
    assert joined.where("code = 0").count() == many * (many // 4) * 3


def test_repeated_keys_meet_in_one_shuffle(spark, monkeypatch):
    from censusloom.operators import counts

    plan = counts.join_census_frames(_five(spark, 12), "code")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    monkeypatch.setattr(counts, "PRODUCT", 2000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = counts.join_census_frames(_five(spark, 400), "code").where("code = 0")
        tasks = [r["count"] for r in hot.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == 8 and max(tasks) < 2 * min(tasks) and sum(tasks) == 120_000
