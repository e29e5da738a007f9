"""Token ids as Parquet list columns that can be read in part.

Ids are one list column in plain order of ``doc_id``. Row groups and pages are kept small, the id
column is dictionary encoded, the number columns are delta encoded (format version 2), and the
writer adds page indexes, so a reader that wants few documents or only their lengths skips the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from censusloom.llm.bpe import BYTES, encoder
from censusloom.llm.common import byte_cuts, small, texts
from censusloom.runtime import scratch_folder

#: Rows handed on at a time.
ROWS = 1024
#: What the files hold. ``part`` and ``place`` give a row's place in the order of all, ``before`` the ids of its part before it.
SCHEMA = "doc_id long, n_tokens long, part int, place long, before long, ids array<int>"


def encoded_parts(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """Whole texts as ids, each with ``end_id`` behind it, in the order and the parts they come in."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, place, before = encoder(path), TaskContext.get().partitionId(), 0, 0
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at, stop in byte_cuts(batch.column(1), BYTES):
                ids = coder(batch.column(1).slice(at, stop - at))
                for first in range(0, stop - at, ROWS):
                    found = ids[first : first + ROWS]
                    lengths = np.fromiter((len(one) + len(end) for one in found), np.int64, len(found)) // 4
                    ends = np.cumsum(lengths)
                    values = np.frombuffer(b"".join(found) if not end else end.join(found) + end, "<i4")
                    offsets = np.concatenate([[0], ends]).astype(np.int32)
                    columns = [
                        batch.column(0).slice(at + first, len(found)), pa.array(lengths), pa.array(np.full(len(found), part, np.int32)),
                        pa.array(np.arange(place, place + len(found))), pa.array(before + ends - lengths),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "part", "place", "before", "ids"])
                    place, before = place + len(found), before + int(ends[-1])

    return texts(docs).mapInArrow(run, SCHEMA)


def write_tokens(
    docs: DataFrame, folder: str, path: str, end_id: int | None = 2, row_group_bytes: int = 16 << 20, page_rows: int = 1000,
) -> None:
    """Write the ids of all documents in ascending order of ``doc_id`` (nulls first).

    Texts are dealt by ranges of ``doc_id`` and encoded after that; the task that writes a part counts its ids.
    Rows with equal ``doc_id`` follow each other. A null text has only the end id; other columns are left out; an
    empty table gives a folder that reads as empty.
    """
    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        encoded_parts(ordered, path, end_id)
        .write.option("compression", "zstd")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .parquet(folder)
    )


def read_tokens(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """Rows of the files, with ``start``, the number of ids of all documents before.

    Without ``ids`` only the number columns are read. Parts are added up from one row a part, and a row's place in
    its part was stored with it, so no row is shuffled.
    """
    rows = spark.read.schema(SCHEMA).parquet(folder)
    return _with_start(rows if ids else rows.drop("ids"), rows)


def _with_start(rows: DataFrame, stored: DataFrame) -> DataFrame:
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    totals = stored.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("_sum"))
    bases = small(totals.select("part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base")), 16)
    return rows.join(bases, "part").withColumn("start", F.col("_base") + F.col("before")).drop("_base", "before")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of the files in a folder; ids are read where they lie."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4").view(np.uint8)
            edges = (lists.offsets.to_numpy().astype(np.int64) * 4).tolist()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(edges, edges[1:])]
            n = (np.diff(edges) // 4).astype(np.int64)
            columns = [*(batch.column(i) for i in range(3)), pa.array(n), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "before", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(SCHEMA).parquet(folder)
    found = rows.select("doc_id", "part", "before", "ids").mapInArrow(run, "doc_id long, part int, before long, n_tokens long, ids_crc32 long")
    return _with_start(found, rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_token_files(spark, sf_dir):
    folder = scratch_folder(spark, "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return digests(spark, folder)
