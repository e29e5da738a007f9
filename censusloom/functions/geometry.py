"""Planar geometry on nested arrays and doubles, as Spark SQL expressions.

A ring is ``array<struct<x:double,y:double>>``, an area an array of rings (outer rings and
holes alike), an edge ``struct<x1,y1,x2,y2>``. The functions take and return SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def area_edges(rings: str) -> str:
    """All edges of an area. A ring whose ends differ is closed; an empty one has no edges."""
    ends = (
        "concat(slice(r, 2, size(r)), "
        "if(element_at(r, -1) = r[0], slice(r, 1, 0), slice(r, 1, 1)))"
    )
    edge = "struct(a.x as x1, a.y as y1, b.x as x2, b.y as y2)"
    edges = f"zip_with(slice(r, 1, size({ends})), {ends}, (a, b) -> {edge})"
    return f"flatten(transform(filter({rings}, r -> size(r) > 0), r -> {edges}))"


def crosses(e: str, px: str, py: str) -> str:
    """Whether the ray from the point towards larger x crosses the edge."""
    at = f"({e}.x2 - {e}.x1) * ({py} - {e}.y1) / ({e}.y2 - {e}.y1) + {e}.x1"
    return f"if(({e}.y1 > {py}) != ({e}.y2 > {py}), {px} < {at}, false)"


def touches(e: str, px: str, py: str) -> str:
    """Whether the point lies on the edge."""
    cross = f"({e}.x2 - {e}.x1) * ({py} - {e}.y1) - ({e}.y2 - {e}.y1) * ({px} - {e}.x1)"
    return (
        f"({py} between least({e}.y1, {e}.y2) and greatest({e}.y1, {e}.y2) "
        f"and {px} between least({e}.x1, {e}.x2) and greatest({e}.x1, {e}.x2) and {cross} = 0)"
    )


def inside(edges: str, px: str, py: str) -> str:
    """Even-odd test with the boundary outside."""
    odd = f"size(filter({edges}, e -> {crosses('e', px, py)})) % 2 = 1"
    return f"({odd} and not exists({edges}, e -> {touches('e', px, py)}))"


def edge_distance(e: str, px: str, py: str) -> str:
    """Distance from the point to the edge."""
    dx, dy = f"({e}.x2 - {e}.x1)", f"({e}.y2 - {e}.y1)"
    length = f"({dx} * {dx} + {dy} * {dy})"
    along = f"(({px} - {e}.x1) * {dx} + ({py} - {e}.y1) * {dy}) / {length}"
    t = f"if({length} > 0, least(greatest({along}, 0D), 1D), 0D)"
    ex, ey = f"({e}.x1 + {t} * {dx} - {px})", f"({e}.y1 + {t} * {dy} - {py})"
    return f"sqrt({ex} * {ex} + {ey} * {ey})"


def box_distances(px: str, py: str) -> tuple[str, str]:
    """Bounds on the distance from the point to what the box ``minx, miny, maxx, maxy`` fits.

    The lower bound is the distance to the box. For the upper one: something touches each
    side of a tight box, so it is as near as the far end of the nearest side.
    """
    gap_x = f"greatest(minx - {px}, {px} - maxx, 0D)"
    gap_y = f"greatest(miny - {py}, {py} - maxy, 0D)"
    near_x = f"least(abs({px} - minx), abs({px} - maxx))"
    near_y = f"least(abs({py} - miny), abs({py} - maxy))"
    far_x = f"greatest(abs({px} - minx), abs({px} - maxx))"
    far_y = f"greatest(abs({py} - miny), abs({py} - maxy))"
    low = f"sqrt({gap_x} * {gap_x} + {gap_y} * {gap_y})"
    high = (
        f"sqrt(least({near_x} * {near_x} + {far_y} * {far_y}, "
        f"{near_y} * {near_y} + {far_x} * {far_x}))"
    )
    return low, high


def _plain_number(value: str) -> str:
    """Decimal text without exponent or trailing zeros, with all digits of the double's own text.

    Where that has an exponent its digits are moved instead; nothing is rounded.
    """
    text = f"cast({value} as string)"
    part = lambda k: f"regexp_extract({text}, '^(-?)([0-9])[.]([0-9]+)E(-?[0-9]+)$', {k})"
    digits = f"concat({part(2)}, if({part(3)} = '0', '', {part(3)}))"
    power = f"cast({part(4)} as int)"
    left = f"if(length({digits}) > {power} + 1, concat(left({digits}, {power} + 1), '.', substring({digits}, {power} + 2)), rpad({digits}, {power} + 1, '0'))"
    right = f"concat('0.', repeat('0', -{power} - 1), {digits})"
    moved = f"concat({part(1)}, if({power} < 0, {right}, {left}))"
    return f"if({text} like '%E%', {moved}, regexp_replace({text}, '[.]0$', ''))"


def point_wkt(px: str, py: str) -> Column:
    """Well-known text of a point; null if a coordinate is null."""
    return F.expr(f"concat('POINT (', {_plain_number(px)}, ' ', {_plain_number(py)}, ')')")
