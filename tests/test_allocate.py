import pytest
from pyspark.sql import functions as F

from censusloom import join_census_with_coords, randomly_assign_census_features, reconcile, sample_census_feature
from censusloom.functions.hashing import round_keys, with_permuted
from censusloom.operators.allocate import draw_addresses, repeat_rows
from censusloom.operators.numbering import number_rows, ordered_totals, running_totals, shuffled_index

COLS = "code_col string, long_col double, lat_col double"


FEATURES = ["babies", "school", "retired"]
#: Persons of each code: more than homes, fewer, and none.
WANTED = {"P1": (9, 2, 1), "P2": (0, 6, 0), "P3": (1, 1, 13)}
HOMES = {"P1": 3, "P2": 5, "P3": 1}


def homes(spark):
    """Joined census rows, as many as a code has homes."""
    data = [
        (code, 140.0 + at / 8, -30.0 - n / 4, *WANTED[code]) for n, code in enumerate(WANTED) for at in range(HOMES[code])
    ]
    return spark.createDataFrame(data, COLS + "".join(f", {f} long" for f in FEATURES))


def counted(persons):
    sums = persons.groupBy("code_col").agg(*[F.count_if(F.col(f)).alias(f) for f in FEATURES])
    return {r.code_col: tuple(r)[1:] for r in sums.collect()}


PERSONS = sum(map(sum, WANTED.values()))


def assign(census, **kwargs):
    return randomly_assign_census_features(census, "code_col", "long_col", "lat_col", FEATURES, **kwargs)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 10, 17, 99, 1000, 12345])
def test_permutation_is_one(spark, size):
    df = spark.range(size).withColumn("n", F.lit(size).cast("long")).withColumn("code", F.lit("x"))
    df = df.withColumn("keys", round_keys(3, "code"))
    images = with_permuted(df, "id", "n", "keys", "p").agg(
        F.countDistinct("p"), F.min("p"), F.max("p")
    ).first()
    assert tuple(images) == (size, 0, size - 1)


def test_draws_are_uniform(spark):
    df = spark.range(30000).withColumn("n", F.lit(6).cast("long"))
    df = df.withColumn("keys", round_keys(1, "id")).withColumn("i", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    pairs = with_permuted(df, "i", "n", "keys", "p").groupBy("id").agg(F.sort_array(F.collect_list("p")).alias("s"))
    seen = [r["count"] for r in pairs.groupBy("s").count().collect()]
    assert len(seen) == 15 and all(1800 < n < 2200 for n in seen)


def test_filter_on_a_permutation_plans_quickly(spark):
    df = spark.range(1000).withColumn("n", F.lit(1000).cast("long")).withColumn("keys", round_keys(3, "n"))
    assert with_permuted(df, "id", "n", "keys", "p").where("p < 10").count() == 10


@pytest.mark.parametrize("wanted", [{"P1": (5, 2), "P2": (1, 9)}, {"P1": (40, 1), "P2": (3, 3), "P3": (2, 30)}])
def test_sample_has_the_counts(spark, wanted):
    data = [(code, 140.0 + at, float(at), n) for code, (n, places) in wanted.items() for at in range(places)]
    census = spark.createDataFrame(data, COLS + ", tenants long")
    drawn = sample_census_feature(census, "code_col", "long_col", "lat_col", "tenants")
    assert drawn.columns == ["code_col", "long_col", "lat_col", "tenants"]
    counts = {r.code_col: r["count"] for r in drawn.groupBy("code_col").count().collect()}
    assert counts == {code: n for code, (n, _) in wanted.items()}
    assert drawn.where("tenants").count() == sum(counts.values())
    most = drawn.groupBy("code_col", "long_col").count().groupBy("code_col").agg(F.max("count").alias("n")).collect()
    assert all(r.n <= wanted[r.code_col][0] for r in most)


def test_sample_with_null_zero_negative_and_uneven_counts(spark):
    census = spark.createDataFrame(
        [("A", 1.0, 1.0, 3), ("A", 2.0, 2.0, 0), ("A", 3.0, 3.0, None), ("B", 1.0, 1.0, -4), (None, 5.0, 5.0, 2),
         ("C", 1.0, 1.0, 1), ("C", 2.0, 2.0, 5), ("C", 3.0, 3.0, 50)],
        COLS + ", f long",
    )
    drawn = sample_census_feature(census, "code_col", "long_col", "lat_col", "f", seed=1).collect()
    per_code = {}
    for r in drawn:
        per_code.setdefault(r.code_col, []).append(r.long_col)
    assert per_code["A"] == [1.0] * 3
    assert per_code[None] == [5.0] * 2
    assert "B" not in per_code
    assert len(per_code["C"]) <= 50 and per_code["C"].count(3.0) >= 44


def test_assign(spark):
    persons = assign(homes(spark))
    assert persons.columns == ["person_id", "code_col", "long_col", "lat_col", *FEATURES]
    assert counted(persons) == WANTED
    got = persons.orderBy("person_id").collect()
    assert [r.person_id for r in got] == list(range(PERSONS))
    assert all(sum(r[f] for f in FEATURES) == 1 for r in got)
    order = [next(i for i, f in enumerate(FEATURES) if r[f]) for r in got]
    assert order == sorted(order)
    for r in persons.groupBy("code_col", "long_col", *FEATURES).count().collect():
        assert r["count"] <= next(n for f, n in zip(FEATURES, WANTED[r.code_col]) if r[f])


def test_assign_is_repeatable(spark, rows):
    census = homes(spark)
    first = rows(assign(census, seed=5))
    assert rows(assign(census.repartition(5), seed=5)) == first
    assert rows(assign(census, seed=6)) != first
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows(assign(census, seed=5)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_general_draw_equals_even_draw(spark, rows):
    census = homes(spark)
    even, general = assign(census, even_counts=True), assign(census, even_counts=False)
    assert rows(even.drop("person_id")) == rows(general.drop("person_id"))
    assert sorted(r.person_id for r in general.collect()) == list(range(PERSONS))


def test_split_groups_keep_the_counts(spark):
    census = homes(spark)
    for even in (True, False):
        persons = assign(census, hot_rows=1, even_counts=even)
        assert counted(persons) == WANTED
        assert sorted(r.person_id for r in persons.collect()) == list(range(PERSONS))


def test_totals_cannot_be_asked_for(spark):
    census = homes(spark).withColumnRenamed("retired", "Tot_old")
    with pytest.raises(ValueError, match="Tot_old"):
        randomly_assign_census_features(census, "code_col", "long_col", "lat_col", ["Tot_old"])
    kept = randomly_assign_census_features(census, "code_col", "long_col", "lat_col", ["Tot_old"], ignore_total=False)
    assert kept.count() == 14


def test_codes_without_addresses_place_nobody(spark, rows):
    homes = spark.createDataFrame([("A", 1.0, 1.0), (None, 2.0, 2.0)], COLS)
    counts = spark.createDataFrame([("A", "f", 2), ("Z", "f", 3), ("A", "g", 0)], "code_col string, feature string, n long")
    persons = draw_addresses(homes, counts, "code_col", "long_col", "lat_col", ["f", "g"])
    assert rows(persons) == [(0, "A", 1.0, 1.0, "f"), (1, "A", 1.0, 1.0, "f")]
    wide = persons.selectExpr("person_id", "code_col", "feature = 'f' as f", "feature = 'g' as g")
    assert rows(reconcile(wide, counts, "code_col", ["f", "g"])) == [
        ("A", "f", 2, 2), ("A", "g", 0, 0), ("Z", "f", 3, 0),
    ]


def test_one_large_count_is_spread_over_tasks(spark):
    df = spark.createDataFrame([("A", 1000), ("B", 0), ("C", None), ("D", -1)], "k string, n long")
    copies = repeat_rows(df, "n", chunk=10)
    assert sorted(r.copy for r in copies.collect()) == list(range(1000))
    parts = copies.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1


def test_numbering_and_totals_with_split_groups(spark):
    df = spark.range(1000).selectExpr("if(id < 900, 'hot', cast(id % 3 as string)) as k", "id", "id % 5 as v")
    df = df.withColumn("k", F.when(F.col("id") != 999, F.col("k")))
    for hot in (10, 10**6):
        numbered = number_rows(df, ["k"], ["id"], "i", "n", hot_rows=hot).collect()
        groups = {}
        for r in numbered:
            groups.setdefault(r.k, []).append(r)
        for members in groups.values():
            assert sorted(r.i for r in members) == list(range(len(members)))
            assert {r.n for r in members} == {len(members)}
        sums = running_totals(df, ["k"], ["id"], {"v": F.col("v")}, hot_rows=hot).collect()
        for key in groups:
            mine = sorted((r.v_before, r.v) for r in sums if r.k == key)
            at = 0
            for before, value in sorted(mine):
                assert before == at or value == 0 or before <= at
                at = max(at, before + value)
            assert at == sum(r.v for r in groups[key]) == next(r.v_total for r in sums if r.k == key)


def crowded(spark):
    """A code with most rows on one place, some of these equal in all columns, and null codes and places."""
    return spark.range(20_000).selectExpr(
        "if(id < 17000, 'hot', if(id % 50 = 0, null, cast(id % 3 as string))) as code",
        "if(id < 15000, 1.5D, if(id % 70 = 0, null, id % 90 / 8D)) as x", "if(id < 15000, 2.5D, 0D) as y",
        "if(id < 4000, 7, id) as pid", "'s' as state",
    )


def test_run_of_equal_places_is_split(spark):
    """More rows on one place than a task may number: several tasks, all numbers once, places where they were."""
    df = crowded(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for columns in (df.columns, ["code", "x", "y"]):
            one = df.select(*columns)
            whole = number_rows(one, ["code"], ["x", "y"], "i", "n").groupBy("code", "x", "y", "n").agg(F.sort_array(F.collect_list("i")))
            split = number_rows(one, ["code"], ["x", "y"], "i", "n", hot_rows=1000)
            assert split.columns == [*columns, "i", "n"]
            tasks = split.where("x = 1.5").groupBy(F.spark_partition_id()).count().collect()
            again = split.groupBy("code", "x", "y", "n").agg(F.sort_array(F.collect_list("i")))
            assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
            assert len(tasks) > 4 and max(r["count"] for r in tasks) < 5000
            assert split.drop("i", "n").exceptAll(one).count() == 0 and split.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_draws_on_equal_places(spark):
    """Equal places are one run with a multiplicity, and get the draws that their rows would get."""
    homes = crowded(spark).where("x is not null").withColumnsRenamed({"code": "code_col", "x": "long_col", "y": "lat_col"})
    counts = spark.createDataFrame([("hot", "f", 9000), ("hot", "g", 3), ("1", "f", 40)], "code_col string, feature string, n long")
    found = []
    for order, hot in ((None, 10**6), (None, 2), (["long_col", "lat_col", "pid"], 10**6)):
        persons = draw_addresses(homes, counts, "code_col", "long_col", "lat_col", ["f", "g"], order=order, hot_rows=hot)
        found.append(sorted(tuple(r)[1:] for r in persons.collect()))
    assert found[0] == found[1] and [len(f) for f in found] == [9043] * 3
    on_one = [sum(r[1] == 1.5 for r in f) for f in found]
    assert all(abs(n - 9003 * 15 / 17) < 200 for n in on_one)
    wide = homes.withColumn("f", F.when(F.col("code_col") == "hot", 5).otherwise(F.col("pid") % 4))
    drawn = [
        sorted(map(tuple, sample_census_feature(wide, "code_col", "long_col", "lat_col", "f", hot_rows=hot).collect()), key=str)
        for hot in (10**6, 3)
    ]
    assert drawn[0] == drawn[1] and sum(r[0] == "hot" for r in drawn[0]) == 5


def test_census_is_read_once(spark):
    """Counts, sizes and numbers all come from the written places."""
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    census = homes(spark)
    watched = census.mapInArrow(seen, census.schema)
    assert assign(watched).count() == PERSONS and reads.value == sum(HOMES.values())


def test_shuffled_index_is_a_permutation_per_group(spark):
    df = spark.range(500).selectExpr("id % 3 as k", "id")
    for hot in (20, 10**6):
        ranks = {}
        for r in shuffled_index(df, ["k"], ["id"], "rank", seed=9, hot_rows=hot).collect():
            ranks.setdefault(r.k, []).append(r.rank)
        assert all(sorted(v) == list(range(len(v))) and v != sorted(v) for v in ranks.values())


def test_ordered_totals(spark):
    df = spark.range(100).selectExpr("id % 4 as b", "id", "id % 3 as v")
    got = {r.id: r.start for r in ordered_totals(df, ["b"], ["id"], "v", "start").collect()}
    at = 0
    for i in sorted(range(100), key=lambda i: (i % 4, i)):
        assert got[i] == at
        at += i % 3


@pytest.mark.parametrize("codes,found", [(["7001", "7005", "7009"], [7001, 7005]), (["07005", "7002"], [7005]), ([], [])])
def test_join_census_with_coords(spark, codes, found):
    """Codes of the census take the type of the addresses' codes as text; several homes of a code all get its counts."""
    census = spark.createDataFrame([(c, 10 * i) for i, c in enumerate(codes)], "CODE_2021 string, tenants long")
    coords = spark.range(7001, 7008, 2).selectExpr("id as CODE21", "140D + id / 8D as longitude", "explode(array(-30D, -31D)) as latitude")
    joined = join_census_with_coords(census, coords, "CODE_2021", "CODE21")
    assert joined.columns == ["CODE_2021", "tenants", "longitude", "latitude"]
    expected = [(c, 10 * [int(k) for k in codes].index(c), 140 + c / 8, lat) for c in found for lat in (-31.0, -30.0)]
    assert sorted((int(r[0]), *tuple(r)[1:]) for r in joined.collect()) == expected


def test_ids_do_not_depend_on_the_number_of_ranges(spark):
    from censusloom.operators.allocate import with_person_ids

    people = spark.range(200).selectExpr("id as row", "if(id % 3 = 0, 'a', 'b') as feature")
    found = [sorted(with_person_ids(people, ["a", "b"], ["row"], "id", buckets=n).collect()) for n in (1, 3, 8)]
    assert found[0] == found[1] == found[2]


def test_numbers_do_not_depend_on_splitting(spark):
    from censusloom.operators.numbering import number_rows

    df = spark.range(300).selectExpr("id", "id % 2 as k")
    found = [sorted(number_rows(df, ["k"], ["id"], "i", "n", hot_rows=hot).collect()) for hot in (7, 40, 1000)]
    assert found[0] == found[1] == found[2]
