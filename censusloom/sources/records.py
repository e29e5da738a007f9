"""Delimited text with line breaks inside quotes, split over tasks.

A line break ends a record only if an even number of quotes of the file comes before it. Quotes are first
counted for each range of bytes that Spark reads as one split, and added up over the ranges of a file; from
this every range knows whether it begins inside quotes, and finds the records in it by itself. What is left of
a record at the end of a range meets the rest of it by a shuffle of these pieces alone.

A quote stands only around a field, and is doubled inside one, as Spark and most programs write it.
"""

from __future__ import annotations

import csv
import logging
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from censusloom.runtime import BROADCAST_LIMIT

# tasks get these functions by value, wherever the package is installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

log = logging.getLogger(__name__)

SEPARATORS = {".csv": ",", ".psv": "|"}
#: Bits that say what the values of a column are, and what a column of just these becomes.
INT, LONG, BIG, DOUBLE, BOOLEAN, DATE, MOMENT, TEXT = (1 << i for i in range(8))


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(file, block, line)``; a file's lines come in their order within a block."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


class Quotes:
    """Which ranges of which files begin inside quotes: one aggregation, a few numbers a range back.

    Spark cuts files at multiples of a length that depends on all files read together, so these facts hold for
    the same paths only; tasks check that they got ranges that begin at such a multiple.
    """

    def __init__(self, spark: SparkSession, paths: list[str]):
        self.paths, self.step = sorted(paths), 0
        self.lines = _lines(spark, paths)  # files are listed once
        lines = self.lines.withColumn("id", F.monotonically_increasing_id())
        quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit('"')))
        facts = lines.groupBy("file", "block").agg(
            F.sum(quotes).alias("quotes"), F.max(quotes % 2).alias("odd"),
            F.min_by(F.when(F.col("block") == 0, F.col("line")), "id").alias("head"), F.octet_length(F.first("file")).alias("width"),
        )
        so_far = Window.partitionBy("file").orderBy("block")
        facts = facts.withColumn("before", F.sum("quotes").over(so_far) - F.col("quotes"))
        facts = facts.select("file", "block", "head", "odd", (F.col("before") % 2).alias("inside"), ((F.col("before") + F.col("quotes")) % 2).alias("open"))
        last = F.max(F.struct("block", "open")).over(Window.partitionBy("file"))
        rows = facts.withColumn("unclosed", F.when(F.struct("block", "open") == last, F.col("open")).otherwise(0))
        rows = rows.withColumn("step", F.min(F.when(F.col("block") > 0, F.col("block"))).over(Window.partitionBy("file")))
        wanted = rows.where("block = 0 or odd = 1 or inside = 1 or unclosed = 1").toLocalIterator()
        self.heads: dict[str, str] = {}
        self.inside: set[tuple[str, int]] = set()
        self.unclosed: set[str] = set()
        self.broken = False
        for row in wanted:
            if row.block == 0:
                self.heads[row.file] = row.head
                self.step = min(self.step or row.step or 0, row.step or self.step)
            if row.inside:
                self.inside.add((row.file, row.block))
            if row.unclosed:
                self.unclosed.add(row.file)
            self.broken |= bool(row.odd)

    @property
    def size(self) -> int:
        """Bytes of the list that tasks get."""
        return sum(len(file) + 16 for file, _ in self.inside)


def _cut(batches: Iterable[pa.RecordBatch], inside: set[tuple[str, int]], step: int) -> Iterator[pa.RecordBatch]:
    """Records of the ranges of a task: ``(file, first, record, block, opens, closes)``.

    ``opens`` and ``closes`` are null for a whole record; a piece has one or the other, or neither if all of
    the range lies in one record.
    """
    here, open_, lines, begun, first = None, False, [], False, False

    def out(file, block, rows):
        columns = list(zip(*rows)) if rows else [()] * 4
        n = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * n, pa.string()), pa.array(columns[1], pa.bool_()), pa.array(columns[0], pa.string()),
             pa.array([block] * n, pa.int64()), pa.array(columns[2], pa.bool_()), pa.array(columns[3], pa.bool_())],
            names=["file", "first", "record", "block", "opens", "closes"],
        )

    def rest():
        """The piece at the end of a range."""
        if here is not None and open_:
            yield out(*here, [("\n".join(lines), first and begun, begun, False)])

    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column(0), batch.column(1).to_numpy()
        codes = files.dictionary_encode()
        marks = codes.indices.to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero((np.diff(marks) != 0) | (np.diff(blocks) != 0)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(edges, edges[1:]):
            key = (files[begin].as_py(), int(blocks[begin]))
            fresh = key != here
            if fresh:
                yield from rest()
                if key[1] and (not step or key[1] % step):
                    raise ValueError(f"{key[0]} is not cut into ranges as it was when its quotes were counted")
                here, open_, lines, begun = key, key in inside, [], False
                first = key[1] == 0
            text = batch.column(2).slice(begin, end - begin)
            quotes = pc.count_substring(text, '"').to_numpy(zero_copy_only=False)
            after = (np.cumsum(quotes) + open_) & 1
            before = np.concatenate([[int(open_)], after[:-1]])
            whole = (before == 0) & (after == 0)
            at = np.flatnonzero(whole)
            if len(at):
                n = len(at)
                heads = np.zeros(n, bool)
                heads[0] = first and at[0] == 0
                no = pa.nulls(n, pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0]] * n, pa.string()), pa.array(heads), text.take(pa.array(at)), pa.array(np.full(n, key[1], np.int64)), no, no],
                    names=["file", "first", "record", "block", "opens", "closes"],
                )
                if heads[0]:
                    first = False
            rows = []
            for i in np.flatnonzero(~whole).tolist():
                if not before[i]:
                    lines, begun = [], True
                lines.append(text[i].as_py())
                if not after[i]:
                    rows.append(("\n".join(lines), first and begun, None if begun else False, None if begun else True))
                    first = first and not begun
                    lines = []
            if rows:
                yield out(*key, rows)
            open_ = bool(after[-1])
    yield from rest()


def records(spark: SparkSession, paths: list[str], quotes: Quotes) -> DataFrame:
    """``(file, first, record)`` of all files: every record as text, ``first`` for the header of a file.

    Empty lines are no records. ``file`` is the path as Spark's file metadata has it. Each range is read by
    a task of its own; files are read once more if records go on from one range to the next.
    """
    if sorted(paths) != quotes.paths:
        quotes = Quotes(spark, paths)
    inside, step = quotes.inside, quotes.step
    cut = quotes.lines.mapInArrow(
        lambda batches: _cut(batches, inside, step), "file string, first boolean, record string, block long, opens boolean, closes boolean"
    )
    found = cut.where("opens is null").select("file", "first", "record")
    if inside:
        pieces = cut.where("opens is not null")
        in_order = Window.partitionBy("file").orderBy("block", "opens")
        pieces = pieces.withColumn("chain", F.sum(F.col("opens").cast("long")).over(in_order))
        joined = pieces.groupBy("file", "chain").agg(
            F.max("first").alias("first"),
            F.array_join(F.expr("transform(array_sort(collect_list(struct(block, opens, record))), p -> p.record)"), "\n").alias("record"),
        )
        found = found.unionByName(joined.select("file", "first", "record"))
    # lines that end in a carriage return have it between them too
    ended = F.when(F.col("record").endswith("\r"), F.expr("replace(substring(record, 1, length(record) - 1), '\r\n', '\n')"))
    return found.withColumn("record", F.coalesce(ended, F.col("record"))).where("record != ''")


def header_names(head: str, separator: str) -> list[str]:
    """Column names of a header record: empty ones by place, repeated ones with their place."""
    names = next(csv.reader([head.rstrip("\r")], delimiter=separator), [])
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def cells(found: DataFrame, separator: str, width: int) -> DataFrame:
    """``found`` with ``cells``, the fields of each record as text; missing fields are null."""
    fields = ", ".join(f"c{i} string" for i in range(width))
    parsed = F.from_csv("record", fields, {"sep": separator, "quote": '"', "escape": '"', "maxColumns": str(max(20480, width + 1))})
    return found.withColumn("cells", F.array(*[parsed[f"c{i}"] for i in range(width)]))


def text_kind(value: str) -> str:
    """SQL text for the bit of a value's kind; null and empty have none."""
    whole = f"case when try_cast({value} as int) is not null then {INT} when try_cast({value} as bigint) is not null then {LONG} when length({value}) <= 38 then {BIG} else {TEXT} end"
    number = "'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"
    return (
        f"case when coalesce({value}, '') = '' then 0 when {value} rlike '^[+-]?[0-9]+$' then {whole} when {value} rlike {number} then {DOUBLE} "
        f"when {value} in ('NaN', 'Inf', '+Inf', '-Inf', 'Infinity', '-Infinity') then {DOUBLE} when lower({value}) in ('true', 'false') then {BOOLEAN} else {TEXT} end"
    )


def kind_type(bits: int) -> str:
    """The narrowest type for all kinds found in a column; text if there are none, or kinds that don't go together."""
    if bits in (BOOLEAN, DATE):
        return {BOOLEAN: "boolean", DATE: "date"}[bits]
    if bits and not bits & ~(DATE | MOMENT):
        return "timestamp_ntz"
    if not bits or bits & ~(INT | LONG | BIG | DOUBLE):
        return "string"
    return "double" if bits & DOUBLE else "decimal(38,0)" if bits & BIG else "bigint" if bits & LONG else "int"


def kinds(rows: DataFrame, keys: list[str], width: int, kind: str | None = None) -> DataFrame:
    """Per group the kinds of each column as an array of bits; ``kind`` is SQL text over ``c``, a cell."""
    bit = kind or text_kind("c")
    each = rows.withColumn("__kinds", F.expr(f"transform(cells, c -> {bit})"))
    return each.groupBy(*keys).agg(F.array(*[F.coalesce(F.bit_or(F.get("__kinds", F.lit(i))), F.lit(0)) for i in range(width)]).alias("kinds"))


def typed(rows: DataFrame, names: list[str], types: list[str], cell: str = "cells[{0}]") -> list[Column]:
    """Columns of ``cells`` under their names; a value its column's type does not have becomes null."""
    return [F.expr(f"try_cast({cell.format(i)} as {kind})").alias(name) for i, (name, kind) in enumerate(zip(names, types))]


def read_broken(spark: SparkSession, path: str | list[str], separator: str, schema: T.StructType | None) -> DataFrame | None:
    """Files with line breaks inside quotes as one table; None if the plain reader or the unsplit one has to do it.

    Without a schema the names come from a header, which all files must share, and types from all values.
    """
    paths = [path] if isinstance(path, str) else list(path)
    quotes = Quotes(spark, paths)
    if not quotes.broken:
        return None
    if quotes.unclosed or quotes.size > BROADCAST_LIMIT:
        log.warning("%s: quotes that are not closed, or too many ranges; not split", paths)
        return None
    found = records(spark, paths, quotes)
    if schema is not None:
        row = F.from_csv("record", schema.toDDL(), {"sep": separator, "quote": '"', "escape": '"'})
        return found.where("not first").select(row.alias("row")).select("row.*")
    heads = {h.rstrip("\r") for h in quotes.heads.values()}
    if any(h.count('"') % 2 for h in heads):
        heads = {r.record for r in found.where("first").select("record").distinct().toLocalIterator()}
    if len(heads) != 1:
        log.warning("%s: files with different headers are not split", paths)
        return None
    names = header_names(heads.pop(), separator)
    rows = cells(found.where("not first"), separator, len(names))
    bits = kinds(rows, [], len(names)).first().kinds
    return rows.select(*typed(rows, names, [kind_type(b) for b in bits]))
