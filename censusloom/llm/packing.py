"""Packing into fixed windows by minimum bin slack.

Documents longer than a window are cut into full windows and a remainder. Only the number of
remainders of each length matters for how they are combined, and there are at most ``window - 1``
lengths whatever the input, so the combinations are found once from that histogram. For each window
the longest remaining length is taken, and dynamic programming over a bitset of reachable sums finds
the multiset of remaining lengths that fills the rest closest to capacity; going back through the
bitsets gives how often each length is used. A combination is repeated for as long as its counts last.
Spark numbers the pieces of each length, and a piece's number tells its window and its offset.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from censusloom.llm.bpe import BYTES, encoder
from censusloom.llm.common import cut, mapped, numbered, texts

WINDOW = 2048
#: An encoder takes and remembers this many times fewer bytes here, as its worker goes on to other stages of a pipeline with them.
LESS = 2


def best_fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """A multiset of the given lengths whose sum is as near to ``room`` as can be: length to times."""
    reachable, steps, limit = 1, [], (1 << (room + 1)) - 1
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left = min(counts[length], room // length)
        times = 1
        while left:  # 1, 2, 4 ... and the rest make every number of uses
            times = min(times, left)
            after = (reachable | reachable << (length * times)) & limit
            if after != reachable:
                steps.append((length, times, reachable))
                reachable = after
            left -= times
            times *= 2
        if reachable >> room & 1:
            break
    total, chosen = reachable.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + times
            total -= length * times
    return chosen


def combinations(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """``(repeats, {length: times})`` that use up all counts."""
    left, found = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = best_fill(window - longest, {n: c for n, c in left.items() if c})
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        repeats = min(left[n] // times for n, times in chosen.items())
        found.append((repeats, chosen))
        left = {n: c for n, c in ((n, c - repeats * chosen.get(n, 0)) for n, c in left.items()) if c}
    return found


def slots(counts: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, ...]], int]:
    """Rows ``(length, first, last, sequence, times, offset)`` and the number of sequences.

    Pieces ``first .. last - 1`` of a length go to sequences from ``sequence`` on, ``times`` to each, the
    first of them at ``offset``.
    """
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for repeats, chosen in combinations(counts, window):
        offset = 0
        for length, times in sorted(chosen.items(), reverse=True):
            first = used[length]
            used[length] += repeats * times
            rows.append((length, first, used[length], sequence, times, offset))
            offset += length * times
        sequence += repeats
    return rows, sequence


def pieces(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Documents as ids with ``end_id`` behind them, cut into windows and a remainder.

    ``(doc_id, start, length, ids_crc32, doc_tokens)`` and ``ids`` if asked for.
    """

    def make():
        coder = encoder(path, less=LESS)
        end = np.array([end_id], "<u4").tobytes()

        def step(rows):
            out = {name: [] for name in fields}
            for key, data in zip(rows["doc_id"], coder(rows["text"])):
                data += end
                for at in range(0, len(data), 4 * window):
                    part = data[at : at + 4 * window]
                    values = (key, at // 4, len(part) // 4, zlib.crc32(part), len(data) // 4)
                    for name, value in zip(fields, values):
                        out[name].append(value)
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
            return out

        return step

    fields = {"doc_id": "long", "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long"}
    fields |= {"ids": "array<int>"} if with_ids else {}
    return mapped(texts(docs), make, fields, by=("text", BYTES // LESS))


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces with their places: ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, and ``ids`` if asked for.

    A null or empty text is the end id alone. Rows of the input are packed one by one, also with null or
    repeated ``doc_id``; equal pieces may change places with each other. Other columns are left out; an
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    cut_up = cut(pieces(docs, path, end_id, window, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``window`` rows
    full = counts.pop(window, 0)
    rows, sequences = slots(counts, window)
    if full:
        rows.append((window, 0, full, sequences, 1, 0))
    places = spark.createDataFrame(rows, "length long, first long, last long, sequence long, times long, base long")
    parts = max(8, (full + sum(counts.values())) // 200_000)
    # at most about ``window`` combinations of some lengths each, so the places may be sent to all tasks
    ranked = numbered(cut_up, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"], F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)))
    placed = ranked.join(F.broadcast(places), "length").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    step = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(step / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.pmod(step, F.col("times")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )


def op3_pack(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
