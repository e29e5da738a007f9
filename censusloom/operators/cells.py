"""Cell index of an area table, built from single edges.

The extent is cut into coarse cells, and each of these into its own number of fine cells. Edges are rows
from the start: they are dealt over tasks, clipped to the rows of cells they run through, and meet again
only as the few edges of one cell, so no task handles all of a large area. Along a row of cells the edges
that cross its middle line are counted from the right; the parity so far says whether a cell without edges is
inside, and is what a cell with edges starts from.

Why a cell needs no edges but its own. A ray from a point of a cell to larger x crosses every edge to the
right of the cell that has the point's y between its ends, which depends on y alone. Moved from the point to
the middle line of the row, this count changes at each end of such an edge that lies between both heights.
Two edges meet in every corner, so the changes of edges to the right cancel, save at corners where one of them
goes on into the cell. Hence it suffices to know the parity on the middle line and, for edges near the cell, the
heights of those ends that lie in the row and to the right of the cell. All of this only compares coordinates, so
the outcome equals that of testing all edges of the area, to the last bit.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from censusloom.functions import geometry as geo
from censusloom.runtime import shuffle_width

BOX = ("minx", "miny", "maxx", "maxy")
#: The index may hold this many times as many cells as there are areas, at each of its levels ...
CELLS_PER_AREA = 4
#: ... where so many edges count as one area more.
EDGES_PER_AREA = 16
#: The coarse grid has at most 2**9 cells a side, a coarse cell at most 2**8 fine cells a side.
COARSE_DEPTH, FINE_DEPTH = 9, 8
#: How near an edge has to come to a cell to be kept with it, in coarse cells. Guards against rounding.
NEAR = 1 / 2**FINE_DEPTH
BYTES_PER_EDGE, BYTES_PER_CELL = 48, 64


class AreaStats(NamedTuple):
    """One row of facts about an area table."""

    areas: int
    edges: int
    minx: float
    miny: float
    maxx: float
    maxy: float
    width: float
    height: float
    surface: float

    @property
    def reach(self) -> float:
        """Side of the square laid over the extent, never zero."""
        return max(self.maxx - self.minx, self.maxy - self.miny, 1e-9) * (1 + 1e-9)

    @property
    def weight(self) -> float:
        """Areas, with edges counted in."""
        return self.areas + self.edges / EDGES_PER_AREA

    def depth(self) -> int:
        """Depth of the finest coarse grid that keeps to the budget of cells."""
        best = 0
        for depth in range(COARSE_DEPTH + 1):
            scale = 2**depth / self.reach
            cells = self.surface * scale**2 + (self.width + self.height) * scale + self.areas
            if cells <= CELLS_PER_AREA * self.weight:
                best = depth
        return best

    def most_bytes(self) -> float:
        """What the index can take at most: both budgets multiplied, and every edge in the cells around it."""
        cells = CELLS_PER_AREA**2 * self.weight
        return (BYTES_PER_CELL + BYTES_PER_EDGE) * cells + 4 * BYTES_PER_EDGE * self.edges


def area_stats(areas: DataFrame) -> AreaStats:
    """Facts that size the index: one aggregation over the area table, one row back."""
    facts = [
        "count(1)",
        "sum(aggregate(rings, 0, (n, r) -> n + size(r)))",
        *["min(minx)", "min(miny)", "max(maxx)", "max(maxy)"],
        *["sum(maxx - minx)", "sum(maxy - miny)", "sum((maxx - minx) * (maxy - miny))"],
    ]
    row = areas.agg(*[F.expr(fact) for fact in facts]).first()
    return AreaStats(*[0.0 if value is None else value for value in row])


class Grid:
    """Coarse square cells over the extent, each cut into its own number of fine cells.

    Its methods give SQL text. A cell number never falls as the coordinate grows, and
    scaling by a power of two is exact, so coarse and fine numbers always agree.
    """

    def __init__(self, stats: AreaStats):
        self.side = 2 ** stats.depth()
        self.scale = self.side / stats.reach
        self.origin = {"x": stats.minx, "y": stats.miny}

    def unit(self, value: str, axis: str) -> str:
        """Coordinate in units of coarse cells."""
        return f"(({value}) - {self.origin[axis]!r}D) * {self.scale!r}D"

    def cell(self, value: str, axis: str, per_side: str = "1L", shift: float = 0.0) -> str:
        """Cell of a coordinate, moved by ``shift`` coarse cells, among ``per_side`` to a coarse one."""
        moved = f"({self.unit(value, axis)} + {shift!r}D)" if shift else f"({self.unit(value, axis)})"
        return f"floor({moved} * {per_side})"

    def at(self, cell: str, axis: str, per_side: str, part: float) -> str:
        """Coordinate of a place in a cell: 0 for its begin, 1 for its end."""
        return f"({self.origin[axis]!r}D + ({cell} + {part!r}D) / {per_side} / {self.scale!r}D)"

    def coarse(self, value: str, axis: str) -> str:
        return f"least({self.cell(value, axis)}, {self.side - 1}L)"

    def coarse_key(self, gx: str, gy: str) -> str:
        return f"({gy}) * {self.side}L + {gx}"

    def fine_key(self, coarse: str, fx: str, fy: str) -> str:
        """One bigint for a fine cell, from its coarse cell and its place in there."""
        span = 2**FINE_DEPTH
        return f"(({coarse}) * {span}L + ({fy}) % per_side) * {span}L + ({fx}) % per_side"


def _clip(grid: Grid, row: str, per_side: str) -> list[str]:
    """Select list: first and last cell ``c_from, c_to`` that an edge comes near in one row of cells, and whether it
    ``crosses`` the middle line of the row. An end in the row is taken as it is, so that corners are exact."""

    def end(x: str, y: str, side: float) -> str:
        line = grid.at(row, "y", per_side, side)
        along = f"xa + (xb - xa) * coalesce(try_divide({line} - ya, yb - ya), 0D)"
        return f"if({grid.cell(y, 'y', per_side)} = {row}, {x}, least(greatest({along}, least(xa, xb)), greatest(xa, xb)))"

    middle = grid.at(row, "y", per_side, 0.5)
    return [
        f"{end('xa', 'ya', 0.0)} as x0", f"{end('xb', 'yb', 1.0)} as x1",
        f"{grid.cell('least(x0, x1)', 'x', per_side, -NEAR)} as c_from", f"{grid.cell('greatest(x0, x1)', 'x', per_side, NEAR)} as c_to",
        f"(ya > {middle}) != (yb > {middle}) as crosses",
    ]


def _marks(first: str, last: str) -> str:
    """Cells an edge comes near in a row from ``first`` to ``last``, and the cell up to which it counts, as one list."""
    begin, end = f"greatest(c_from, {first})", f"least(c_to, {last})"
    near = f"transform(sequence({begin}, {end}), c -> named_struct('x', c, 'near', true, 'odd', 0L))"
    odd = f"array(named_struct('x', least(c_from - 1, {last}), 'near', false, 'odd', 1L))"
    return f"concat(if({begin} <= {end}, {near}, array()), if(crosses and c_from > {first}, {odd}, array()))"


def _swept(marks: DataFrame, row: list[str]) -> DataFrame:
    """Walk along each row of cells from the right: ``base``, the parity at every marked cell, and ``below``, the
    next marked cell to the left. ``marks`` has one row a cell."""
    from_right = Window.partitionBy(*row).orderBy(F.desc("x"))
    so_far = from_right.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marks.withColumns({"base": F.sum("odd").over(so_far) % 2, "below": F.lead("x").over(from_right)})


#: Cells without edges that lie inside, from a marked cell to the next one to its left.
_FILLED = "if(base = 1 and below + 1 <= if(near, x - 1, x), sequence(below + 1, if(near, x - 1, x)), array())"


def area_index(areas: DataFrame, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """Cell index ``(cell, index_right, full, edges, turns, base)`` of an area table, and ``per_side``, the number of
    fine cells a side of each coarse cell.

    A point in the cell is in the area if ``holds`` says so. Fineness is chosen from sums per coarse cell so that each
    has at most ``CELLS_PER_AREA`` times as many entries as areas, edges counted in; the coarse grid is bounded by
    constants. ``index_right`` must be unique.
    """
    # spread by number of partitions: an edge makes far more rows than its size says
    dealt = areas.select("index_right", F.struct(*BOX).alias("box"), F.expr(f"inline({geo.area_edges('rings')})"))
    edges = dealt.repartition(shuffle_width(areas.sparkSession), "index_right", "x1", "y1").selectExpr(
        "index_right", "box", "struct(x1, y1, x2, y2) as e",
        *[f"if(y1 <= y2, {c}1, {c}2) as {c}a" for c in "xy"], *[f"if(y1 <= y2, {c}2, {c}1) as {c}b" for c in "xy"],
    ).selectExpr("*", f"explode(sequence({grid.coarse('ya', 'y')}, {grid.coarse('yb', 'y')})) as gy")
    edges = edges.selectExpr("*", *_clip(grid, "gy", "1L"))
    last_coarse = f"{grid.side - 1}L"

    # coarse cells: which have edges, and how areas go on to the right of them
    marks = edges.selectExpr("index_right", "box", "gy", f"inline({_marks('0L', last_coarse)})")
    marks = marks.groupBy("index_right", "gy", "x").agg(
        F.max("near").alias("near"), (F.sum("odd") % 2).alias("odd"), F.count_if("near").alias("edges"), F.any_value("box").alias("box")
    )
    filled = f"transform({_FILLED}, c -> struct(c as gx, 0L as edges))"
    coarse = _swept(marks, ["index_right", "gy"]).selectExpr(
        "index_right", "gy", "box", "base", f"inline(concat(if(near, array(struct(x as gx, edges)), array()), {filled}))",
    ).selectExpr("*", f"{grid.coarse_key('gx', 'gy')} as coarse")

    def part(axis: str) -> str:
        low, high = grid.unit(f"box.min{axis}", axis), grid.unit(f"box.max{axis}", axis)
        return f"greatest(least({high}, g{axis} + 1D) - greatest({low}, g{axis} + 0D), 0D)"

    sums = coarse.groupBy("coarse").agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"count(1) + sum(edges) / {EDGES_PER_AREA}").alias("weight"),
        F.expr(f"sum({part('x')} + {part('y')})").alias("sides"), F.expr(f"sum({part('x')} * {part('y')})").alias("surface"),
    )
    sizes = ", ".join(f"{2 ** depth}L" for depth in range(FINE_DEPTH + 1))
    fits = f"c -> surface * c * c + sides * c + n <= {CELLS_PER_AREA} * weight"
    fineness = sums.select("coarse", F.expr(f"coalesce(array_max(filter(array({sizes}), {fits})), 1L)").alias("per_side"))
    fine = F.broadcast(fineness)  # at most 4**COARSE_DEPTH rows of two numbers

    # fine cells: the same again inside every coarse cell
    def rows(low: str, high: str) -> str:
        """Rows of fine cells of the coarse cell that a range of y meets."""
        first = f"greatest({grid.cell(low, 'y', 'per_side')}, gy * per_side)"
        final = f"least({grid.cell(high, 'y', 'per_side')}, (gy + 1) * per_side - 1)"
        return f"if({first} <= {final}, sequence({first}, {final}), array())"

    ends = "array(struct(xa as x, ya as y), struct(xb as x, yb as y))"
    # an end that lies to the right of the coarse cell moves what counts there, from its height on
    beyond = f"{grid.coarse('v.y', 'y')} = gy and {grid.cell('v.x', 'x', '1L', -NEAR)} > gx"
    moved = f"(v.y > {grid.at('f', 'y', 'per_side', 0.5)}) != (v.y > {grid.at('gy', 'y', '1L', 0.5)})"
    turned = (
        f"flatten(transform(filter({ends}, v -> {beyond}), "
        f"v -> transform(filter({rows('box.miny', 'box.maxy')}, f -> {moved}), f -> struct(f as fy, false as own))))"
    )
    first, last = "gx * per_side", "((gx + 1) * per_side - 1)"
    held = f"explode(sequence(greatest(c_from, 0L), least(c_to, {last_coarse}))) as gx"
    local = (
        edges.where(f"greatest(c_from, 0L) <= least(c_to, {last_coarse})")
        .selectExpr("index_right", "box", "e", "xa", "ya", "xb", "yb", "gy", held)
        .withColumn("coarse", F.expr(grid.coarse_key("gx", "gy")))
        .join(fine, "coarse")
        .selectExpr("*", f"inline(concat(transform({rows('ya', 'yb')}, f -> struct(f as fy, true as own)), {turned}))")
        .selectExpr("*", *_clip(grid, "fy", "per_side"))
    )
    keys = ["index_right", "coarse", "fy", "x"]
    one = f"array(named_struct('x', {last}, 'near', false, 'odd', 1L))"
    # ends that lie in the row and to the right of the cell
    right = f"{grid.cell('v.y', 'y', 'per_side')} = fy and {grid.cell('v.x', 'x', 'per_side', -NEAR)} > x"
    edge_marks = local.selectExpr("*", f"inline(if(own, {_marks(first, last)}, {one}))").selectExpr(
        *keys, "near", "odd", "if(near, e, null) as e", f"if(near, transform(filter({ends}, v -> {right}), v -> v.y), null) as turns",
    )
    going_on = (
        coarse.where("base = 1").join(fine, "coarse").selectExpr("*", f"explode({rows('box.miny', 'box.maxy')}) as fy")
        .selectExpr(
            "index_right", "coarse", "fy", f"{last} as x", "false as near", "1L as odd",
            "cast(null as struct<x1:double,y1:double,x2:double,y2:double>) as e", "cast(null as array<double>) as turns",
        )
    )
    cells = (
        edge_marks.unionByName(going_on)
        .repartition("index_right", "coarse", "fy")  # one shuffle for the cells and for the walk along their row
        .groupBy(*keys)
        .agg(
            F.max("near").alias("near"), (F.sum("odd") % 2).alias("odd"), F.collect_list("e").alias("edges"),
            F.flatten(F.collect_list("turns")).alias("turns"),
        )
    )
    # an area that goes on to the left of the coarse cell fills the row up to there
    swept = _swept(cells, ["index_right", "coarse", "fy"]).join(fine, "coarse")
    swept = swept.withColumn("below", F.expr(f"coalesce(below, coarse % {grid.side}L * per_side - 1)"))
    parity = f"(base + size(filter(turns, t -> t > {grid.at('fy', 'y', 'per_side', 0.5)}))) % 2"
    empty = "cast(array() as array<struct<x1:double,y1:double,x2:double,y2:double>>) as edges, cast(array() as array<double>) as turns"
    index = swept.selectExpr(
        "index_right", "coarse", "per_side", "fy",
        f"inline(concat(if(near, array(struct(x as fx, false as full, edges, turns, {parity} as base)), array()), "
        f"transform({_FILLED}, c -> struct(c as fx, true as full, {empty}, 0L as base))))",
    ).selectExpr(f"{grid.fine_key('coarse', 'fx', 'fy')} as cell", "index_right", "full", "edges", "turns", "base")
    return index, fineness


def holds(px: str, py: str) -> str:
    """Whether a cell's entry has the point inside; the boundary is outside."""
    crossed = f"size(filter(edges, e -> {geo.crosses('e', px, py)})) + size(filter(turns, t -> t > {py}))"
    return f"(full or ((base + {crossed}) % 2 = 1 and not exists(edges, e -> {geo.touches('e', px, py)})))"
