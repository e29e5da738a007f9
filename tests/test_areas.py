import numpy as np
import pytest
from pyspark.sql import functions as F

from censusloom import area_table, join_coords_with_area, to_geo_dataframe
from censusloom.functions.geometry import point_wkt
from censusloom.operators.areas import nearest, within
from censusloom.operators.cells import Grid, area_index, area_stats

CRS = "EPSG:4326"


def square(a, b):
    return [(a, a), (a, b), (b, b), (b, a)]


def areas(spark, *polygons, crs=CRS):
    """Area table; a polygon is a list of corners, or a list of such rings."""
    rings = [p if isinstance(p[0], list) else [p] for p in polygons]
    data = [
        (i, [[(float(x), float(y)) for x, y in ring] for ring in p], f"a{i}") for i, p in enumerate(rings)
    ]
    schema = "index_right long, rings array<array<struct<x:double,y:double>>>, name string"
    return area_table(spark.createDataFrame(data, schema), crs)


def points(spark, *at, crs=CRS):
    df = spark.createDataFrame([(float(x), float(y)) for x, y in at], "LONGITUDE double, LATITUDE double")
    return to_geo_dataframe(df, crs)


def found(df):
    return sorted((r.LONGITUDE, r.LATITUDE, r.index_right) for r in df.collect())


#: Two overlapping diamonds and one far away, by centre and reach.
DIAMONDS = [[(x - r, y), (x, y + r), (x + r, y), (x, y - r)] for x, y, r in ((10, 20, 4), (13, 20, 2.5), (-40, 7, 1))]


def test_points_within(spark):
    got = join_coords_with_area(points(spark, (8, 21), (12.5, 20.5), (-40, 7.5), (6, 23)), areas(spark, *DIAMONDS))
    assert got.columns == ["LONGITUDE", "LATITUDE", "geometry", "index_right", "name"]
    assert sorted((r.geometry, r.name) for r in got.collect() if r.name) == [
        ("POINT (-40 7.5)", "a2"), ("POINT (12.5 20.5)", "a0"), ("POINT (12.5 20.5)", "a1"), ("POINT (8 21)", "a0"),
    ]
    assert [(r.geometry, r.index_right) for r in got.collect() if r.name is None] == [("POINT (6 23)", None)]


def test_no_point_within(spark):
    got = join_coords_with_area(points(spark, (0, 0), (10, 24.5)), areas(spark, *DIAMONDS))
    assert [(r.index_right, r.name) for r in got.collect()] == [(None, None)] * 2


@pytest.mark.parametrize("cut", [True, False])
def test_nearest_strategy(spark, cut):
    at = points(spark, (-30, 7), (30, 20), (10, 17), (9, 30))
    got = join_coords_with_area(at, areas(spark, *DIAMONDS), "join_nearest", cut_lineage=cut)
    assert found(got) == [(-30, 7, 2), (9, 30, 0), (10, 17, 0), (30, 20, 1)]


def test_mapped_points_pass_by_the_search(spark):
    """Only points outside all areas are shuffled to be given the nearest one."""
    at = points(spark, (30, 30), (1, 1), (30, 30), (2, 1)).withColumn("id", F.monotonically_increasing_id())
    got = join_coords_with_area(at, areas(spark, square(0, 3)), "join_nearest")
    plan = got._jdf.queryExecution().sparkPlan().toString()
    union = plan[plan.index("Union") :].splitlines()
    depth = union[1].index(":-")
    passed = [union[1]] + [line for line in union[2:] if line[depth : depth + 1] == ":"]
    assert any("isnotnull(index_right" in line for line in passed)
    assert not any("Exchange" in line or "Join" in line for line in passed)
    assert found(got) == [(1, 1, 0), (2, 1, 0), (30, 30, 0), (30, 30, 0)]


def ring(centre, reach, corners, wave=0.0):
    turn = np.linspace(0, 2 * np.pi, corners, endpoint=False)
    out = reach * (1 + wave * np.sin(9 * turn))
    return np.stack([centre[0] + out * np.cos(turn), centre[1] + out * np.sin(turn)], 1)


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_large_area_among_small_ones(spark, limit):
    """Corners on the lines of the grid, long edges, and an area with most of all edges."""
    shapes = [np.array(square(i % 16, i % 16 + 1), float) + [0, i // 16] for i in range(256)]
    shapes += [ring((8.0, 8.0), 7.5, 3000, 0.2), ring((4.0, 11.0), 9.0, 5), np.array([(-1, 5), (18, 5), (18, 5.25), (-1, 5.25)])]
    rng = np.random.default_rng(3)
    at = np.concatenate([rng.uniform(-2, 19, (400, 2)), rng.integers(-4, 76, (300, 2)) / 4, shapes[256][::100], shapes[257]])
    table, asked = areas(spark, *[[tuple(c) for c in s.tolist()] for s in shapes]), points(spark, *at.tolist())
    expected = []
    for px, py in at:
        expected += [(px, py, i) for i in [i for i, s in enumerate(shapes) if contains(s, px, py)] or [None]]
    key = lambda r: (r[0], r[1], r[2] is None, r[2] or 0)
    got = [(r.LONGITUDE, r.LATITUDE, r.index_right) for r in within(asked, table, limit).collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_index_of_a_large_area_is_made_by_many_tasks(spark):
    shapes = [ring((8.0, 8.0), 7.5, 4000, 0.2)] + [np.array(square(0.0, 0.5)) + [i % 16, i // 16] for i in range(256)]
    table = areas(spark, *[[tuple(c) for c in s.tolist()] for s in shapes])
    index, _ = area_index(table, Grid(area_stats(table)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = index.where("index_right = 0").groupBy(F.spark_partition_id()).agg(F.count("cell"), F.max(F.size("edges"))).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    counts = sorted(r[1] for r in tasks)
    assert len(counts) == 8 and counts[-1] < 3 * counts[0] and max(r[2] for r in tasks) < 400


def test_areas_of_odd_shapes(spark):
    """Repeated corners, closed and open rings, no rings, rings of one or two corners, two parts, one extent of zero."""
    parts = [
        [[(0, 0), (0, 0), (0, 2), (2, 2), (2, 2), (2, 0), (0, 0)]], [[(5, 5)]], [[(6, 6), (7, 7)]],
        [[(10, 0), (10, 1), (11, 1), (11, 0)], [(12, 0), (12, 1), (13, 1), (13, 0)]], [],
    ]
    table = areas(spark, *[[*p] if p else [[]] for p in parts])
    at = [(1, 1), (0, 0), (2, 1), (5, 5), (6.5, 6.5), (10.5, 0.5), (11.5, 0.5), (12.5, 0.5)]
    want = [(1, 1, 0), (10.5, 0.5, 3), (12.5, 0.5, 3)]
    for limit in (1 << 26, 0):
        assert [r for r in found(within(points(spark, *at), table, limit).where("index_right is not null"))] == want


def test_filter_strategy(spark):
    got = join_coords_with_area(
        points(spark, (-40.25, 7.5), (30, 20), (9, 30)), areas(spark, *DIAMONDS), "filter"
    ).collect()
    assert [(r.geometry, r.index_right) for r in got] == [("POINT (-40.25 7.5)", 2)]


def test_unknown_strategy_and_other_crs(spark):
    with pytest.raises(ValueError, match="strategy"):
        join_coords_with_area(points(spark, (1, 1)), areas(spark, square(0, 3)), "guess")
    with pytest.raises(ValueError, match="EPSG:7844"):
        join_coords_with_area(points(spark, (1, 1)), areas(spark, square(0, 3), crs="EPSG:7844"))


def test_holes_overlaps_and_null_points(spark):
    donut = [square(0, 10), square(4, 6)]
    shapes = areas(spark, donut, square(0, 5))
    at = [(1, 1), (5, 5), (4, 4.5), (4.5, 4.5), (7, 7), (0, 5)]
    assert found(within(points(spark, *at), shapes)) == sorted(
        [(1, 1, 0), (1, 1, 1), (5, 5, None), (4, 4.5, 1), (4.5, 4.5, 1), (7, 7, 0), (0, 5, None)],
        key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0),
    )
    unknown = to_geo_dataframe(
        spark.createDataFrame([(None, 1.0)], "LONGITUDE double, LATITUDE double"), CRS
    )
    assert [r.index_right for r in join_coords_with_area(unknown, shapes, "join_nearest").collect()] == [None]


def test_no_areas(spark):
    none = areas(spark, square(0, 1)).where("false")
    got = join_coords_with_area(points(spark, (1, 1)), none, "join_nearest").collect()
    assert [r.index_right for r in got] == [None]


def test_equal_names_get_suffixes(spark):
    at = points(spark, (1, 1)).withColumn("name", F.lit("here"))
    got = join_coords_with_area(at, areas(spark, square(0, 3)))
    assert got.columns == ["LONGITUDE", "LATITUDE", "name_left", "geometry", "index_right", "name_right"]


def scattered(seed, count):
    """Star-shaped areas of very different sizes, a third of them crowded into one spot."""
    rng = np.random.default_rng(seed)
    shapes = []
    for i in range(count):
        centre = rng.uniform(0, 100, 2) if i % 3 else rng.uniform(10, 12, 2)
        corners = int(rng.integers(3, 12))
        reach = rng.uniform(0.3, 1, corners) * 2 ** rng.uniform(-3, 4)
        turn = np.sort(rng.uniform(0, 2 * np.pi, corners))
        shapes.append(np.stack([centre[0] + reach * np.cos(turn), centre[1] + reach * np.sin(turn)], 1))
    at = np.concatenate([rng.uniform(-5, 110, (150, 2)), rng.uniform(9, 13, (100, 2)), shapes[5][:3]])
    return shapes, at


def edges(shape):
    return shape[:, 0], shape[:, 1], np.roll(shape[:, 0], -1), np.roll(shape[:, 1], -1)


def contains(shape, px, py):
    x1, y1, x2, y2 = edges(shape)
    with np.errstate(all="ignore"):
        odd = (((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)).sum() % 2
    on = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) == 0
    on &= (px >= np.minimum(x1, x2)) & (px <= np.maximum(x1, x2))
    on &= (py >= np.minimum(y1, y2)) & (py <= np.maximum(y1, y2))
    return bool(odd) and not on.any()


def distance(shape, px, py):
    x1, y1, x2, y2 = edges(shape)
    dx, dy = x2 - x1, y2 - y1
    t = np.clip(((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy), 0, 1)
    return np.sqrt((x1 + t * dx - px) ** 2 + (y1 + t * dy - py) ** 2).min()


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_against_brute_force(spark, limit):
    shapes, at = scattered(1, 300)
    table, asked = areas(spark, *[[tuple(c) for c in s.tolist()] for s in shapes]), points(spark, *at.tolist())
    expected = []
    for px, py in at:
        inside = [i for i, s in enumerate(shapes) if contains(s, px, py)]
        expected += [(px, py, i) for i in inside or [None]]
    key = lambda r: (r[0], r[1], r[2] is None, r[2] or 0)
    got = [(r.LONGITUDE, r.LATITUDE, r.index_right) for r in within(asked, table, limit).collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)

    near = {(r.px, r.py): r for r in nearest(asked, table, limit=limit).collect()}
    for px, py in at[:120]:
        far = np.array([distance(s, px, py) for s in shapes])
        assert near[px, py].distance == pytest.approx(far.min(), abs=1e-9)
        assert far[near[px, py].index_right] == pytest.approx(far.min(), abs=1e-9)


def test_nearest_ties(spark):
    shapes = areas(spark, square(4, 5), square(0, 1), square(4, 5))
    at = points(spark, (2.5, 2.5))
    assert [r.index_right for r in nearest(at, shapes).collect()] == [0]
    assert sorted(r.index_right for r in nearest(at, shapes, ties="all").collect()) == [0, 1, 2]


def test_no_cross_join_in_plans(spark):
    shapes, at = scattered(2, 40)
    table, asked = areas(spark, *[[tuple(c) for c in s.tolist()] for s in shapes]), points(spark, *at.tolist())
    for df in (within(asked, table), within(asked, table, 0), nearest(asked, table), nearest(asked, table, limit=0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("value,text", [
    (1.0, "1"), (0.1, "0.1"), (-33.8688, "-33.8688"), (0.0005, "0.0005"), (12345678.0, "12345678"),
    (123456789.25, "123456789.25"), (0.0, "0"), (150.0, "150"), (1e-5, "0.00001"), (-1.25e-7, "-0.000000125"), (-0.0, "-0"),
    (1e300, "1" + "0" * 300), (1.7976931348623157e308, "17976931348623157" + "0" * 292), (1.5e7, "15000000"), (-98765432.125, "-98765432.125"),
])
def test_wkt_numbers(spark, value, text):
    df = spark.createDataFrame([(value, value)], "x double, y double")
    assert df.select(point_wkt("x", "y")).first()[0] == f"POINT ({text} {text})"


def test_wkt_keeps_every_double(spark):
    """The text reads back as the same double, and has no exponent."""
    rng = np.random.default_rng(8)
    values = [5e-324, 2.2250738585072014e-308, *(rng.uniform(-1, 1, 300) * 10.0 ** rng.integers(-320, 308, 300)).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", F.split(point_wkt("x", "x"), "[ ()]")[2].alias("t"))
    for r in df.collect():
        assert float(r.t) == r.x and "E" not in r.t and not (("." in r.t) and r.t.endswith("0"))


def test_wkt_of_a_null(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert df.select(point_wkt("x", "y")).first()[0] is None
