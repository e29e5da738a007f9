"""Near-duplicates of vectors by collision-counting projections.

Vectors with equal labels are compared by cosine. Every vector is projected on many random lines. Two
vectors collide on a line if one lies in the window around the other; for a pair at the threshold the
number of collisions follows a known binomial law, which gives the count that all but a stated share
of such pairs pass. Pairs that pass are verified in double precision.

Counting every pair would grow with the square of a label, so pairs are first brought together by
lines of their own: in each of several views a few lines, cut into cells, put near vectors into one
cell. The number of lines in a view grows with the logarithm of the label's size, and the number of
views follows from the share of pairs at the threshold that may be missed. Inside a cell vectors are
sorted along a line and counted in windows around each. A pair is worked on only in the first view
that brings it together, and a task gives sums of links and a spanning forest, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from censusloom.llm.common import Forest, components, cut, in_blocks, mapped, runs, small, table

#: Cells above this many vectors are worked on in pairs of blocks.
BLOCK = 2048
#: Windows and cells as multiples of the spread that a pair at the threshold has on a line.
REACH, CELL = 2.0, 4.0
#: Vectors a cell should hold if the label's vectors lie about evenly, and the share of those on one line's cell.
CROWD, SHARE = 64, 0.4


def near_in_cell(cell: float) -> float:
    """Chance that a pair whose difference is normal with spread 1 falls into one randomly shifted cell."""
    normal = NormalDist()
    return 2 * normal.cdf(cell) - 1 - 2 / cell * (normal.pdf(0) - normal.pdf(cell))


@dataclass(frozen=True)
class Views:
    """The random lines for vectors of one length, and how many of them a label of some size uses."""

    cosine: float = 0.93
    lines: int = 64
    missed: float = 1e-3
    seed: int = 5

    @property
    def spread(self) -> float:
        """Distance of unit vectors at the threshold, which is their spread on a line of normal entries."""
        return math.sqrt(2 - 2 * self.cosine)

    @property
    def passing(self) -> int:
        """Collisions that all but a share of the pairs at the threshold have."""
        chance = 2 * NormalDist().cdf(REACH) - 1
        below = 0.0
        for count in range(self.lines + 1):
            below += math.comb(self.lines, count) * chance**count * (1 - chance) ** (self.lines - count)
            if below > self.missed / 10:
                return count
        return self.lines

    def shape(self, size: int) -> tuple[int, int]:
        """Lines in a view and number of views for a label of ``size`` vectors."""
        depth = max(1, math.ceil(math.log(max(1.0, size / CROWD)) / -math.log(SHARE)))
        return depth, math.ceil(math.log(self.missed) / math.log1p(-near_in_cell(CELL) ** depth))

    def counting(self, dim: int) -> np.ndarray:
        return np.random.default_rng([self.seed, dim]).standard_normal((dim, self.lines))

    def cells(self, unit: np.ndarray, size: int) -> np.ndarray:
        """Key of each vector's cell in every view, one column a view."""
        depth, views = self.shape(size)
        rng = np.random.default_rng([self.seed, unit.shape[1], depth, 1])
        lines, width = rng.standard_normal((unit.shape[1], views * depth)), CELL * self.spread
        place = np.floor((unit @ lines) / width + rng.random(views * depth)).astype(np.int64).reshape(len(unit), views, depth)
        key = np.zeros(place.shape[:2], np.uint64)
        for i in range(depth):
            key = (key ^ place[:, :, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key.view(np.int64)


def _usable(vector) -> np.ndarray | None:
    """The vector in double precision, or None if it can't be compared."""
    if vector is None or not len(vector) or None in vector:
        return None
    values = np.array(vector, float)
    return values if np.isfinite(values).all() and values.any() else None


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def features(rows: DataFrame) -> DataFrame:
    """``(vec_id, label, dim, vec_key, data)``; the last two are null for vectors that link with nothing."""

    def make():
        def step(part):
            vectors = [None if k is None or i is None else _usable(v) for i, k, v in zip(part["vec_id"], part["label"], part["embedding"])]
            data = [None if v is None else v.tobytes() for v in vectors]
            keys = [None if d is None else hashlib.blake2b(f"{k}:".encode() + d, digest_size=16).digest() for k, d in zip(part["label"], data)]
            return {
                "vec_id": part["vec_id"], "label": part["label"], "dim": [0 if v is None else len(v) for v in vectors],
                "vec_key": keys, "data": data,
            }

        return step

    own = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    return mapped(own, make, {"vec_id": "long", "label": "string", "dim": "long", "vec_key": "binary", "data": "binary"})


def _celled(distinct: DataFrame, views: Views) -> DataFrame:
    """A row for each vector and view: ``(cell, view, node, copies, size, group, data)``."""

    def make():
        def step(part):
            out = {name: [] for name in fields}
            vectors = [np.frombuffer(d) for d in part["data"]]
            for dim, size in sorted({*zip(part["dim"], part["size"])}):
                own = [i for i, pair in enumerate(zip(part["dim"], part["size"])) if pair == (dim, size)]
                keys = views.cells(_unit(np.array([vectors[i] for i in own])), size)
                for i, cells in zip(own, keys.tolist()):
                    out["cell"] += cells
                    out["view"] += range(len(cells))
                    for name in ("label", "dim", "node", "copies", "size", "data"):
                        out[name] += [part[name][i]] * len(cells)
            return out

        return step

    fields = {"label": "string", "dim": "long", "view": "int", "cell": "long", "node": "long", "copies": "long", "size": "long", "data": "binary"}
    return mapped(distinct, make, fields)


def _links(views: Views):
    def make():
        def step(key, group: pa.Table):
            view, lo, hi = key[2], key[4], key[5]
            size = group["size"][0].as_py()
            raw = np.array([np.frombuffer(d) for d in group["data"].to_pylist()])
            unit = _unit(raw)
            place = unit @ views.counting(unit.shape[1])
            order = np.argsort(place[:, 0], kind="stable")
            raw, unit, place = raw[order], unit[order], place[order]
            node, copies, block = (group[c].to_numpy()[order] for c in ("node", "copies", "block"))
            before = views.cells(unit, size)[:, :view]
            reach, scaled = REACH * views.spread, _unit(raw)
            n, links, forest = len(node), np.zeros(len(node), np.int64), Forest(len(node))
            step_rows = max(1, (1 << 20) // (n * views.lines) or 1)
            end = np.searchsorted(place[:, 0], place[:, 0] + views.spread * CELL, "right")
            for at in range(0, n, step_rows):
                to, last = min(n, at + step_rows), int(end[min(n, at + step_rows) - 1])
                hits = (np.abs(place[at:to, None, :] - place[None, at:last, :]) <= reach).sum(axis=2)
                passed = (hits >= views.passing) & (np.arange(at, last)[None, :] > np.arange(at, to)[:, None])
                if lo != hi:
                    passed &= block[at:to, None] != block[None, at:last]
                i, j = np.nonzero(passed)
                i, j = i + at, j + at
                if view and len(i):
                    new = ~(before[i] == before[j]).any(axis=1)
                    i, j = i[new], j[new]
                linked = (scaled[i] * scaled[j]).sum(axis=1) >= views.cosine
                i, j = i[linked], j[linked]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                for a, b in zip(i.tolist(), j.tolist()):
                    forest.join(a, b)
            hit = np.flatnonzero(links)
            return {"node": node[hit], "links": links[hit], "peer": node[forest.roots()[hit]]}

        return step

    return make


def near_vectors(rows: DataFrame, views: Views = Views()) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every vector.

    Linked are vectors with equal labels and a cosine of at least the threshold. Vectors that are null,
    zero or hold null or non-finite entries, and rows with a null label, link with nothing, as do rows
    with a null ``vec_id``, whose component is null and which are kept; vectors of different lengths
    don't link. Equal vectors are linked and worked on once. Rows are kept one for one; rows with equal
    ``vec_id`` and different vectors are linked on their own; other columns are left out; an empty table
    gives an empty table.
    """
    found = cut(features(rows), "vectors")
    own = found.where("vec_key is not null").groupBy("vec_key").agg(F.min(F.struct("vec_id", "label", "dim", "data")).alias("v"), F.count(F.lit(1)).alias("copies"))
    # numbers of vectors are fixed by being written
    distinct = cut(own.select("vec_key", "v.*", "copies", F.monotonically_increasing_id().alias("node")), "distinct")
    sizes = cut(distinct.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size")), "labels")
    celled = _celled(distinct.join(small(sizes, 64), ["label", "dim"]).select("label", "dim", "node", "copies", "size", "data"), views)
    cells = ["label", "dim", "view", "cell"]
    crowded = celled.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).where("blocks > 1")
    celled = celled.join(small(cut(crowded, "crowded"), 64), cells, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    dealt = in_blocks(celled, "blocks", F.xxhash64("node"))
    fields = {"node": "long", "links": "long", "peer": "long"}
    part = cut(runs(dealt, [*cells, "lo", "hi"], _links(views), fields, least=2), "links")
    linked = components(part.select(F.col("node").alias("a"), F.col("peer").alias("b")), "clusters")
    links = part.groupBy("node").agg(F.sum("links").alias("links"))
    facts = distinct.select("vec_key", "vec_id", "node", "copies").join(links, "node", "left").join(linked, "node", "left")
    facts = cut(facts.withColumn("component", F.coalesce("component", "node")), "facts")
    lowest = facts.groupBy("component").agg(F.min("vec_id").alias("lowest"))
    facts = facts.join(lowest, "component").select(
        "vec_key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("lowest").alias("component")
    )
    out = found.select("vec_id", "vec_key").join(facts, "vec_key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def op1_collision_counting(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
