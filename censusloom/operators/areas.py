"""Attach points to the areas that contain them, or to the nearest ones.

Points are two doubles ``px, py``; an area table has ``rings``, its bounding box, the row
number ``index_right`` and any attributes. The coordinate reference system is kept as column
metadata and must agree on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from censusloom.functions import geometry as geo
from censusloom.operators.cells import BOX, BYTES_PER_CELL, BYTES_PER_EDGE, AreaStats, Grid, area_index, area_stats, holds
from censusloom.operators.numbering import ordered_totals
from censusloom.runtime import BROADCAST_LIMIT, broadcast_if, shuffle_width, written

AREA_COLUMNS = ("rings", *BOX, "index_right")
#: Children of a node of the search tree.
FANOUT = 16
#: Guards bounds on distances against rounding.
SLACK = 1e-12


def to_geo_dataframe(
    df: DataFrame, crs: str, longitude_col: str = "LONGITUDE", latitude_col: str = "LATITUDE"
) -> DataFrame:
    """Add the point columns ``px, py``, marked with their reference system."""
    return df.withColumns(
        {"px": F.col(longitude_col).cast("double"), "py": F.col(latitude_col).cast("double")}
    ).withMetadata("px", {"crs": crs})


def area_table(df: DataFrame, crs: str, rings: str = "rings", index: str = "index_right") -> DataFrame:
    """Area table from a column of rings and one of row numbers; other columns are attributes."""
    corners = "transform(flatten(rings), p -> p.{})"
    return (
        df.withColumnsRenamed({rings: "rings", index: "index_right"})
        .withColumns(
            {"index_right": F.col("index_right").cast("long")}
            | {
                side + axis: F.expr(f"array_{side}({corners.format(axis)})")
                for side in ("min", "max")
                for axis in "xy"
            }
        )
        .withMetadata("rings", {"crs": crs})
    )


def attributes(areas: DataFrame) -> list[str]:
    return [c for c in areas.columns if c not in AREA_COLUMNS]


def _crs(df: DataFrame, column: str) -> str | None:
    return df.schema[column].metadata.get("crs")


def within(
    points: DataFrame,
    areas: DataFrame,
    limit: int = BROADCAST_LIMIT,
    stats: AreaStats | None = None,
) -> DataFrame:
    """Left join of points to the areas they lie in, adding ``index_right`` and the attributes.

    Every point has one cell, so this is one equi-join on the cell with the exact test in
    its condition. A small index is broadcast and the points are not moved. Otherwise both
    sides are shuffled by cell, and a crowded cell is split by Spark's skew join. Attributes
    travel in the index, so that no second join of the points is needed for them.
    """
    stats = stats or area_stats(areas)
    named = attributes(areas)
    if not stats.areas:
        nothing = [F.lit(None).cast(areas.schema[c].dataType).alias(c) for c in named]
        return points.select("*", F.lit(None).cast("long").alias("index_right"), *nothing)
    grid = Grid(stats)
    index, fineness = area_index(areas, grid)
    size = stats.most_bytes()
    if size > limit:
        index = written(index, "area-cells")  # built once, to be measured and to be used
        rows, edges = index.agg(F.count(F.lit(1)), F.expr("sum(size(edges))")).first()
        size = BYTES_PER_CELL * rows + BYTES_PER_EDGE * (edges or 0)
    if named:
        row_bytes = BYTES_PER_CELL * len(named)
        index = index.join(broadcast_if(areas.select("index_right", *named), row_bytes * stats.areas, limit), "index_right")
        size += size / BYTES_PER_CELL * row_bytes

    covered = (
        f"px between {stats.minx!r}D and {stats.maxx!r}D "
        f"and py between {stats.miny!r}D and {stats.maxy!r}D"
    )
    coarse = grid.coarse_key(grid.coarse("px", "x"), grid.coarse("py", "y"))
    cell = grid.fine_key("coarse", grid.cell("px", "x", "per_side"), grid.cell("py", "y", "per_side"))
    # points with no cell get keys nothing has, so that they do not meet in one partition
    spread = f"-1L - pmod(xxhash64(px, py), {1 << 40}L)"
    located = (
        points.withColumn("__coarse", F.expr(f"if({covered}, {coarse}, null)"))
        .join(F.broadcast(fineness), F.col("__coarse") == F.col("coarse"), "left")
        .select(*points.columns, F.expr(f"coalesce({cell}, {spread})").alias("__cell"))
    )
    gained = ["index_right", *named]
    hits = index.select("cell", F.struct(*gained).alias("__area"), "full", "edges", "turns", "base")
    on = (F.col("__cell") == F.col("cell")) & F.expr(holds("px", "py"))
    joined = located.join(broadcast_if(hits, size, limit), on, "left")
    return joined.select(*points.columns, *[F.col("__area")[c].alias(c) for c in gained])


def _morton(x: str, y: str) -> str:
    """SQL text that interleaves the low 16 bits of two bigint columns."""

    def spread(v: str) -> str:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = f"(({v} | shiftleft({v}, {shift})) & {mask}L)"
        return v

    return f"{spread(x)} | shiftleft({spread(y)}, 1)"


def _ranked(areas: DataFrame, stats: AreaStats) -> DataFrame:
    """Area boxes numbered along a Z-order curve: ``rank`` puts neighbours close together."""
    scale = 65535 / stats.reach
    boxes = areas.select(
        "index_right",
        *BOX,
        F.expr(f"floor(((minx + maxx) / 2 - {stats.minx!r}D) * {scale!r}D)").alias("__x"),
        F.expr(f"floor(((miny + maxy) / 2 - {stats.miny!r}D) * {scale!r}D)").alias("__y"),
    ).withColumn("__z", F.expr(_morton("__x", "__y")))
    # 2**16 buckets at most
    boxes = boxes.withColumns({"__bucket": F.shiftright("__z", 16), "__one": F.lit(1).cast("long")})
    return ordered_totals(boxes, ["__bucket"], ["__z", "index_right"], "__one", "rank").select(
        "index_right", *BOX, "rank"
    )


def nearest(
    points: DataFrame,
    areas: DataFrame,
    ties: str = "lowest",
    limit: int = BROADCAST_LIMIT,
    stats: AreaStats | None = None,
) -> DataFrame:
    """Nearest area of each distinct ``(px, py)``: ``(px, py, index_right, distance)``.

    The areas are packed into a tree of boxes, ``FANOUT`` to a node, and all points go down
    it together: each step joins the nodes kept so far with their children and drops those
    farther than the best upper bound of the point. What is left at the bottom is measured
    exactly. Distances are planar. ``ties`` is ``"lowest"`` (smallest ``index_right``) or
    ``"all"``.
    """
    if ties not in ("lowest", "all"):
        raise ValueError(f"ties must be 'lowest' or 'all', not {ties!r}")
    where = ["px", "py"]
    # spread by number of partitions: the search costs far more than the size of its input says
    width = shuffle_width(points.sparkSession)
    asked = points.select(*where).where("px is not null and py is not null").distinct()
    asked = asked.repartition(width, *where)
    stats = stats or area_stats(areas)
    if not stats.areas:
        return asked.where("false").selectExpr(*where, "0L as index_right", "0D as distance")
    leaves = _ranked(areas, stats)
    levels = 0
    while stats.areas > FANOUT ** (levels + 1):
        levels += 1

    def boxes_at(level: int) -> DataFrame:
        """``(parent, node, box)`` of a level; on level 0 the nodes are the areas themselves."""
        if level == 0:
            return leaves.selectExpr(f"rank div {FANOUT}L as parent", "index_right as node", *BOX)
        grouped = leaves.groupBy(F.expr(f"rank div {FANOUT**level}L").alias("node")).agg(
            *[F.expr(f"{c[:3]}({c})").alias(c) for c in BOX]
        )
        return grouped.selectExpr(f"node div {FANOUT}L as parent", "node", *BOX)

    low, high = geo.box_distances("px", "py")
    near_enough = f"low <= bound * {1 + SLACK!r}D + {SLACK!r}D"

    def kept(frontier: DataFrame) -> DataFrame:
        """Drop nodes beyond the bound known so far, then tighten it and drop again."""
        measured = frontier.selectExpr(*where, "node", "bound", f"{low} as low", f"{high} as high")
        tightest = F.least("bound", F.min("high").over(Window.partitionBy(*where)))
        return (
            measured.where(near_enough)
            .withColumn("bound", tightest)
            .where(near_enough)
            .select(*where, "bound", F.col("node").alias("at"))
        )

    # the top of the tree has at most FANOUT nodes and becomes a literal
    top = [
        f"struct({row.node}L as node, " + ", ".join(f"{row[c]!r}D as {c}" for c in BOX) + ")"
        for row in boxes_at(levels).collect()
    ]
    unbounded = "double('infinity') as bound"
    frontier = kept(asked.selectExpr(*where, unbounded, f"inline(array({', '.join(top)}))"))
    for level in reversed(range(levels)):
        children = broadcast_if(boxes_at(level), 64 * stats.areas / FANOUT**level, limit)
        frontier = kept(frontier.join(children, F.col("at") == F.col("parent")))

    shapes = areas.select(
        F.col("index_right").alias("area"), F.expr(geo.area_edges("rings")).alias("edges")
    )
    measured = frontier.join(
        broadcast_if(shapes, 40 * stats.edges, limit), F.col("at") == F.col("area")
    ).select(*where, F.col("area").alias("index_right"), F.explode("edges").alias("e"))
    measured = measured.select(
        *where, "index_right", F.expr(geo.edge_distance("e", "px", "py")).alias("distance")
    )
    if ties == "lowest":
        best = F.min(F.struct("distance", "index_right")).alias("best")
        return measured.groupBy(*where).agg(best).select(
            *where, "best.index_right", "best.distance"
        )
    closest = F.min("distance").over(Window.partitionBy(*where))
    measured = measured.groupBy(*where, "index_right").agg(F.min("distance").alias("distance"))
    return measured.withColumn("least", closest).where("distance = least").drop("least")


def _suffixed(coords: DataFrame, areas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tell apart equal names of both sides by ``_left`` and ``_right``."""
    both = set(coords.columns) & set(attributes(areas))
    return (
        coords.withColumnsRenamed({c: c + "_left" for c in both}),
        areas.withColumnsRenamed({c: c + "_right" for c in both}),
    )


def join_coords_with_area(
    coords: DataFrame,
    area_polygons: DataFrame,
    failed_join_strategy: str | None = None,
    ties: str = "lowest",
    limit: int = BROADCAST_LIMIT,
    cut_lineage: bool = True,
) -> DataFrame:
    """Points with the columns of the area they lie in, ``index_right`` and WKT ``geometry``.

    A point on a boundary is outside, a point in several areas is repeated, and one in none
    keeps nulls. ``failed_join_strategy`` then says what happens to it: ``None`` leaves it,
    ``"filter"`` drops it, ``"join_nearest"`` gives it the nearest area. The last one reads the
    result of the containment join three times, so it is written to the scratch folder first,
    unless ``cut_lineage`` is false.
    """
    if failed_join_strategy not in (None, "filter", "join_nearest"):
        raise ValueError(f"unknown strategy {failed_join_strategy!r}")
    left, right = _crs(coords, "px"), _crs(area_polygons, "rings")
    if left and right and left != right:
        raise ValueError(f"points are in {left} but areas in {right}")
    coords, areas = _suffixed(coords, area_polygons)
    stats = area_stats(areas)
    mapped = within(coords, areas, limit, stats)
    if failed_join_strategy == "filter":
        mapped = only_mapped(mapped)
    elif failed_join_strategy == "join_nearest":
        if cut_lineage:
            mapped = written(mapped, "contained-points")
        mapped = _with_nearest(mapped, areas, ties, limit, stats)
    return mapped.select(
        *[c for c in coords.columns if c not in ("px", "py")],
        geo.point_wkt("px", "py").alias("geometry"),
        "index_right",
        *attributes(areas),
    )


def _with_nearest(
    mapped: DataFrame, areas: DataFrame, ties: str, limit: int, stats: AreaStats
) -> DataFrame:
    """Give the rows without an area the nearest one.

    Rows that have an area pass by. Only the distinct places of the others go down the tree, and
    only these rows are joined with what it found.
    """
    gained = ["index_right", *attributes(areas)]
    kept = [c for c in mapped.columns if c not in gained]
    lost = mapped.where(F.col("index_right").isNull()).select(*kept)
    found = (
        nearest(lost.select("px", "py"), areas, ties, limit, stats)
        .join(areas.select(*gained), "index_right")
        .select(F.col("px").alias("__px"), F.col("py").alias("__py"), F.struct(*gained).alias("__near"))
    )
    given = lost.join(found, (F.col("px") == F.col("__px")) & (F.col("py") == F.col("__py")), "left")
    given = given.select(*kept, *[F.col("__near")[c].alias(c) for c in gained])
    return only_mapped(mapped).select(*kept, *gained).unionByName(given)


def only_mapped(mapped: DataFrame) -> DataFrame:
    """Drop the points that lie in no area."""
    return mapped.where(F.col("index_right").isNotNull())


def unmapped_count(mapped: DataFrame) -> int:
    """How many rows have no area."""
    return mapped.where(F.col("index_right").isNull()).count()


def own_columns(left: DataFrame, right: DataFrame) -> tuple[list[str], list[str]]:
    """Columns only one of two frames has, and columns both have, in frame order."""
    shared = [c for c in left.columns if c in right.columns]
    single: Sequence[str] = [
        c for c in [*left.columns, *right.columns] if c not in shared
    ]
    return list(single), shared
