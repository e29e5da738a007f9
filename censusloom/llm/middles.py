"""Fill-in-the-middle: a text is cut in three and its middle moved to the end, inside one buffer.

Two cuts are drawn between the tokens of a text. Sentinels go in at the cuts, in a bytearray, and the
pieces change places by rotations, each made of three reversals. A text is restored by the same
rotations run backwards. All of it is done on bytes: white space is ASCII, so tokens, cuts and
sentinels never split a character.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from censusloom.llm.common import mapped, table
from censusloom.llm.words import bounds


class Sentinels(NamedTuple):
    """What stands before the prefix, the suffix and the middle; each begins and ends with another character."""

    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"


FIELDS = {"doc_id": "long", "n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "binary"}


def token_ends(data: bytes) -> np.ndarray:
    """End of every token: a word with the white space before it, or what white space is left at the end."""
    _, ends = bounds(data)
    if len(data) > (ends[-1] if len(ends) else 0):
        ends = np.append(ends, len(data))
    return ends


def reverse(buffer: bytearray, begin: int, end: int) -> None:
    """Reverse a stretch of the buffer where it lies, half of it changing places with the other half."""
    stretch = np.frombuffer(buffer, np.uint8)[begin:end]
    half = len(stretch) // 2
    first = stretch[:half].copy()
    stretch[:half] = stretch[::-1][:half]
    stretch[len(stretch) - half :] = first[::-1]


def rotate(buffer: bytearray, begin: int, middle: int, end: int) -> None:
    """Exchange the neighbours ``begin .. middle`` and ``middle .. end`` by three reversals."""
    reverse(buffer, begin, middle)
    reverse(buffer, middle, end)
    reverse(buffer, begin, end)


def arranged(data: bytes, first: int, second: int, form: str, marks: Sentinels = Sentinels()) -> bytes:
    """The text cut at two bytes, with sentinels, in the order of ``form`` (``psm`` or ``spm``)."""
    buffer = bytearray(data)
    buffer[second:second] = marks.suffix
    buffer[first:first] = marks.middle
    buffer[0:0] = marks.prefix
    one = len(marks.prefix) + first
    two = one + len(marks.middle) + second - first
    end = len(buffer)
    rotate(buffer, one, two, end)  # the middle goes behind the suffix
    if form == "spm":
        rotate(buffer, 0, one, one + end - two)  # and the suffix before the prefix
    return bytes(buffer)


def restored(output: bytes, form: str, marks: Sentinels = Sentinels()) -> bytes:
    """The text that ``arranged`` was given, from its output and form alone."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    if form == "spm":
        rotate(buffer, 0, buffer.index(marks.prefix), buffer.index(marks.middle))
    one, two, end = buffer.index(marks.suffix), buffer.index(marks.middle), len(buffer)
    rotate(buffer, one, two, end)
    back = one + end - two  # the suffix begins here again
    del buffer[back : back + len(marks.suffix)]
    del buffer[one : one + len(marks.middle)]
    del buffer[: len(marks.prefix)]
    return bytes(buffer)


def _chars(data: bytes) -> int:
    """Code points: bytes that do not continue a character."""
    codes = np.frombuffer(data, np.uint8)
    return int(((codes & 0xC0) != 0x80).sum())


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, marks: Sentinels = Sentinels()) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` of every whole text.

    ``n`` counts tokens. ``rate`` per cent of the texts are rearranged, ``spm_rate`` per cent of these with
    the suffix first; draws come from a hash of ``seed`` and ``doc_id``. Texts that are null, empty or hold
    a sentinel are ``plain``: their output is the text, empty for null, and the counts of characters are
    null. A null ``doc_id`` hashes as no digits. Rows are kept one for one, also with repeated ``doc_id``;
    other columns are left out; an empty table gives an empty table.
    """

    def make():
        def one(key, data):
            digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
            h = [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]
            ends = token_ends(data)
            n = len(ends)
            if not data or any(mark in data for mark in marks) or h[2] % 100 >= rate:
                return n, "plain", None, None, data
            low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
            first, second = (int(ends[c - 1]) if c else 0 for c in (low, high))
            form = "spm" if h[3] % 100 < spm_rate else "psm"
            return n, form, _chars(data[:first]), _chars(data[first:second]), arranged(data, first, second, form, marks)

        def step(rows):
            done = [one(key, data or b"") for key, data in zip(rows["doc_id"], rows["text"])]
            return {"doc_id": rows["doc_id"]} | {name: [d[i] for d in done] for i, name in enumerate(list(FIELDS)[1:])}

        return step

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return mapped(own, make, FIELDS).withColumn("output", F.col("output").cast("string"))


def restore(transformed: DataFrame, marks: Sentinels = Sentinels()) -> DataFrame:
    """``transformed`` with ``restored``, the text rebuilt from ``output`` and ``form``; other columns are kept.

    A null output or form gives null.
    """
    kinds = {f.name: "string" if f.name == "form" else f.dataType.simpleString().replace("bigint", "long") for f in transformed.schema.fields}
    kinds["output"] = "binary"

    def make():
        def step(rows):
            back = [None if o is None or f is None else restored(o, f, marks) for o, f in zip(rows["output"], rows["form"])]
            return rows | {"restored": back}

        return step

    moved = mapped(transformed.withColumn("output", F.col("output").cast("binary")), make, kinds | {"restored": "binary"})
    return moved.withColumns({c: F.col(c).cast("string") for c in ("output", "restored")})


def op12_fill_in_middle(spark, sf_dir):
    done = restore(transform(table(spark, sf_dir, "documents")))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
