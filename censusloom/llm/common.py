"""Shared steps of the operators: Arrow slices, sorted runs of groups, cut lineage, components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from censusloom.runtime import BROADCAST_LIMIT, broadcast_if, written

#: Rows handed to Python code at a time, so that its memory follows the longest texts only.
SLICE = 256
#: Edges of a part while components are found.
EDGES = 100_000

ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
    "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()),
}


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key as a long and the text, whatever other columns there are."""
    return docs.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").cast("string").alias(text))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _batch(columns: dict, fields: dict[str, str]) -> pa.RecordBatch:
    arrays = [pa.array(columns[name], type=ARROW[kind]) for name, kind in fields.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(fields))


def byte_cuts(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """First rows and ends of slices of at most ``size`` bytes of text, or of one text."""
    before = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(before, before[at] + size, "right")) - 1)
        yield at, end
        at = end


def mapped(
    df: DataFrame, make: Callable[[], Callable[[dict], dict]], fields: dict[str, str], size: int = SLICE, by: tuple[str, int] | None = None,
) -> DataFrame:
    """Apply a function of column lists to slices of rows, of ``size`` rows or ``by`` the bytes of a text column.

    ``make`` runs once a task and returns the function, so what it loads is loaded once a task.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            cuts = byte_cuts(batch.column(by[0]), by[1]) if by else ((at, at + size) for at in range(0, batch.num_rows, size))
            for at, end in cuts:
                part = batch.slice(at, end - at)
                yield _batch(step({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}), fields)

    return df.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in fields.items()))


def runs(
    df: DataFrame, keys: list[str], make: Callable[[], Callable[[tuple, pa.Table], dict]], fields: dict[str, str],
    order: tuple[str, ...] = (), least: int = 1, flush: int = 20_000,
) -> DataFrame:
    """Apply a function to every group of rows with equal keys; a task holds one group at a time.

    Groups must be small by construction: callers split large ones into blocks first. Groups of fewer
    than ``least`` rows are passed over.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, held, last, out, count = make(), [], None, [], 0

        def done(key):
            return _batch(step(key, pa.Table.from_batches(held)), fields)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            begin, here = 0, list(zip(*columns))
            cuts = [i for i in range(1, len(here)) if here[i] != here[i - 1]]
            for end in [*cuts, len(here)]:
                if held and here[begin] != last:
                    if sum(part.num_rows for part in held) >= least:
                        out.append(done(last))
                        count += out[-1].num_rows
                    held.clear()
                    if count >= flush:
                        yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                        out, count = [], 0
                held.append(batch.slice(begin, end - begin))
                last, begin = here[begin], end
        if sum(part.num_rows for part in held) >= least:
            out.append(done(last))
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in fields.items()))


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back; finished shuffles are then free to be removed.

    Spark removes the shuffle files of plans that are no longer referenced, so both collectors
    are asked to run.
    """
    out = written(df, label)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast if the counted rows are within the limit; else Spark shuffles both sides."""
    return broadcast_if(df, df.count() * row_bytes, limit)


def in_blocks(df: DataFrame, blocks: str, key: Column) -> DataFrame:
    """Deal the rows of large groups to pairs of blocks, so that any two rows meet in one of them.

    ``blocks`` is the column with the number of blocks of a row's group. Rows get ``block`` and the pair
    ``lo <= hi``; a group of one block is the pair (0, 0).
    """
    placed = df.withColumn("block", F.pmod(key, F.col(blocks)).cast("long"))
    other = placed.withColumn("_other", F.explode(F.expr(f"sequence(0L, cast({blocks} as bigint) - 1L)")))
    return other.withColumn("lo", F.least("block", "_other")).withColumn("hi", F.greatest("block", "_other")).drop("_other", blocks)


class Forest:
    """Union by smallest index over ``0 .. n-1``."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))], dtype=np.int64)


def _contracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each slice of edges becomes stars that connect the same nodes."""
    for batch in batches:
        ends = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
        nodes, index = np.unique(np.concatenate(ends), return_inverse=True)
        forest, n = Forest(len(nodes)), len(ends[0])
        for i, j in zip(index[:n].tolist(), index[n:].tolist()):
            forest.join(i, j)
        roots = forest.roots()
        moved = np.flatnonzero(roots != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[roots[moved]])], names=["a", "b"])


def _smaller_first(edges: DataFrame) -> DataFrame:
    pair = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    return edges.where("a <> b").select(*pair).mapInArrow(_contracted, "a long, b long").distinct()


def _few_files(edges: DataFrame, rows: int) -> DataFrame:
    """At most a file for each ``EDGES`` rows, and eight, as every file written has a cost of its own."""
    return edges.coalesce(max(8, -(-rows // EDGES)))


def _stars(edges: DataFrame) -> bool:
    """Whether every edge ``(a, b)`` leads from a node without other edges to one that leads nowhere."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.coalesce(F.max(F.col("up") + F.least("up", "down")), F.lit(0)).alias("most")).first()["most"] <= 1


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Smallest node reachable from each node of ``edges (a, b)``: ``(node, component)``.

    Alternates two steps until all edges lead to such a node: every node hands its larger neighbours to the
    smallest node it sees, then its smaller ones. Minima are aggregated before the shuffle and
    joined back, by a broadcast if there are few, so no neighbour list is ever held; edges are contracted
    inside each task. Nodes without an edge are not in the result.
    """
    edges = cut(_smaller_first(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))), label)
    while not _stars(edges):
        rows = edges.count()
        size = rows * 64  # of the minima in a task's memory, at most
        lowest = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("low"))
        large = edges.join(broadcast_if(lowest, size), "b", "left").select("a", F.coalesce("low", "b").alias("b"))
        # every node a now has only smaller neighbours b
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        both = F.explode(F.array("a", "b")).alias("a")
        pairs = large.join(broadcast_if(lowest, size), "a").select(both, F.col("low").alias("b"))
        edges = cut(_few_files(_smaller_first(pairs), rows), label)
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def numbered(df: DataFrame, group: list[str], order: list[str], bucket: Column, name: str = "rank") -> DataFrame:
    """Number rows ``0 ..`` within each group; a hot group is numbered in ``bucket`` parts."""
    from pyspark.sql import Window

    parted = df.withColumn("_part", bucket)
    sizes = parted.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    ranked = parted.withColumn(name, F.row_number().over(inside) - 1).join(bases, [*group, "_part"])
    return ranked.withColumn(name, F.col(name) + F.col("_base")).drop("_part", "_base")
