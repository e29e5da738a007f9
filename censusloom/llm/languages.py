"""Language identification by prediction by partial matching over bytes.

Every language has a tree of contexts of up to ``ORDER`` bytes with the counts of the byte that comes next,
taken from all its documents. A byte is coded in the longest context the tree has; a byte new there escapes
to the next shorter one at the price of method C (as many parts as there are different bytes in the context),
and bytes of the longer context no longer count in the shorter. The counts are frozen, so the code length of a
text is a sum over its strings of ``ORDER + 1`` bytes, and each different string is priced once a slice.
The language with the shortest code is the one predicted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from censusloom.llm.common import table, written

#: Bytes of the longest context.
ORDER = 4
#: Bound on the strings of ``ORDER + 1`` bytes in the tree of one language, and on the languages.
NODES, LANGUAGES = 400_000, 200
#: Bytes of text priced or counted at a time.
SLICE_BYTES = 4 << 20
UNKNOWN = "und"


def strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of each text together with the ``ORDER`` bytes before it, and where each text begins.

    Bytes before a text count as 0.
    """
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    pad = bytes(ORDER)
    codes = np.frombuffer(b"".join(part for t in texts for part in (pad, t)), np.uint8).astype(np.int64)
    if not len(codes):
        return np.empty(0, np.int64), np.zeros(0, np.int64)
    found = codes[ORDER:].copy()
    for i in range(1, ORDER + 1):
        found += codes[ORDER - i : len(codes) - i] << (8 * i)
    starts = np.cumsum(lengths) - lengths
    # the strings that end in the padding of a later text are left out
    keep = np.ones(len(found), bool)
    gaps = starts[1:] + ORDER * np.arange(len(texts) - 1)
    keep[(gaps[:, None] + np.arange(ORDER)).ravel()] = False
    return found[keep], starts


def _slices(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a part has few bytes of text, or a single row."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // SLICE_BYTES
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(edges, edges[1:]):
            if end > begin:
                yield batch.slice(begin, end - begin)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, string, n)`` of batches ``(lang, text)``, added up inside the task as far as memory allows."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def told(lang):
        grams, n = held.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "string", "n"])

    for part in _slices(batches, 1):
        langs, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
        for lang in sorted(set(langs)):
            found, _ = strings([t or b"" for own, t in zip(langs, texts) if own == lang])
            grams, n = np.unique(found, return_counts=True)
            if lang in held:
                grams, index = np.unique(np.concatenate([held[lang][0], grams]), return_inverse=True)
                n = np.bincount(index, np.concatenate([held[lang][1], n]), len(grams)).astype(np.int64)
            held[lang] = grams, n
            if len(grams) > NODES:
                yield told(lang)
    for lang in sorted(held):
        yield told(lang)


@dataclass
class Level:
    """Contexts of one length: counts of the bytes after each, and what escaping from it leaves of the next shorter."""

    strings: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    covered: np.ndarray

    @staticmethod
    def of(strings: np.ndarray, counts: np.ndarray, shorter: "Level | None", order: int) -> "Level":
        contexts, first = np.unique(strings >> 8, return_index=True)
        total = np.add.reduceat(counts, first) if len(first) else np.empty(0, np.int64)
        distinct = np.diff(np.append(first, len(strings)))
        covered = np.zeros(len(contexts), np.int64)
        if shorter is not None and len(first):
            at = np.searchsorted(shorter.strings, strings & ((1 << 8 * order) - 1))
            covered = np.add.reduceat(shorter.counts[at], first)
        return Level(strings, counts, contexts, total, distinct, covered)


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


class Tree:
    """Context tree of one language."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.levels: list[Level] = []
        for order, (grams, counts) in enumerate(levels):
            by = np.argsort(grams)
            self.levels.append(Level.of(grams[by], counts[by], self.levels[-1] if order else None, order))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each string after the bytes before it."""
        out = np.zeros(len(grams))
        left = np.arange(len(grams))
        # what the context escaped from covers of this one: counts, and different bytes
        covered, seen = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
        for order in range(len(self.levels) - 1, -1, -1):
            level, own = self.levels[order], grams[left] & ((1 << 8 * (order + 1)) - 1)
            at, there = _lookup(level.contexts, own >> 8)
            if not there.any():
                continue
            place, coded = _lookup(level.strings, own)
            total = np.where(there, level.total[at] - covered[left], 0)
            fresh = np.where(there, level.distinct[at] - seen[left], 0)
            room = np.maximum(total + fresh, 1)
            coded &= there
            share = np.where(coded, level.counts[place], np.where(total + fresh > 0, fresh, 1))
            out[left] -= np.log2(share / room)
            covered[left] = np.where(there, level.covered[at], covered[left])
            seen[left] = np.where(there, level.distinct[at], seen[left])
            left = left[~coded]
            if not len(left):
                return out
        out[left] += np.log2(np.maximum(256 - seen[left], 1))
        return out


def _train(docs: DataFrame, lang: str, text: str) -> DataFrame:
    own = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    parts = own.where("lang is not null and text is not null").mapInArrow(_counted, "lang string, string long, n long")
    return parts.groupBy("lang", "string").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", nodes: int = NODES, languages: int = LANGUAGES) -> dict[str, Tree]:
    """Context trees of the languages of ``docs``, counted over all rows whose language and text are not null.

    Counts are added up in tasks before they are shuffled, so a language with most rows is no hot group. A
    tree of more than ``nodes`` strings keeps those found at least 2**k times, with the smallest k that keeps
    to the bound; what comes to the driver is at most ``nodes * (ORDER + 1) * languages`` counts, and more languages
    are an error. No rows give no tree.
    """
    counts = written(_train(docs, lang, text), "strings")
    sizes = counts.groupBy("lang", F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("rows"))
    by_lang: dict[str, list] = {}
    for row in sizes.collect():  # at most 64 rows a language
        by_lang.setdefault(row.lang, []).append((row.power, row.rows))
    if len(by_lang) > languages:
        raise ValueError(f"{len(by_lang)} languages, more than {languages}")
    least = {}
    for name, rows in by_lang.items():
        power = 0
        while sum(n for p, n in rows if p >= power) > nodes:
            power += 1
        least[name] = 1 << power
    if not least:
        return {}
    bound = F.element_at(F.create_map(*[F.lit(v) for pair in least.items() for v in pair]), F.col("lang"))
    levels = [None] * (ORDER + 1)
    for order in range(ORDER, -1, -1):
        if order < ORDER:
            mask = (1 << 8 * (order + 1)) - 1
            counts = counts.groupBy("lang", F.col("string").bitwiseAND(F.lit(mask).cast("long")).alias("string")).agg(F.sum("n").alias("n"))
        levels[order] = counts.where(F.col("n") >= bound).select("lang", F.lit(order).alias("level"), "string", "n")
    rows = levels[0]
    for more in levels[1:]:
        rows = rows.unionByName(more)
    found = rows.toArrow()
    names, level = np.array(found["lang"].to_pylist(), object), found["level"].to_numpy()
    grams, n = found["string"].to_numpy(), found["n"].to_numpy()
    trees = {}
    for name in sorted(least):
        own = names == name
        trees[name] = Tree([(grams[own & (level == o)], n[own & (level == o)]) for o in range(ORDER + 1)])
    return trees


def code_lengths(texts: list[bytes], trees: list[Tree]) -> np.ndarray:
    """Bits each text takes in each language: an array of languages by texts."""
    found, starts = strings(texts)
    out = np.zeros((len(trees), len(texts)))
    if not len(found):
        return out
    grams, index = np.unique(found, return_inverse=True)
    full = np.flatnonzero(np.array([len(t) > 0 for t in texts]))
    for i, tree in enumerate(trees):
        out[i, full] = np.add.reduceat(tree.bits(grams)[index], starts[full])
    return out


def predict(docs: DataFrame, trees: dict[str, Tree], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from the text alone.

    ``score`` is the share of the language's probability among all, each language being as likely at first.
    Of equal code lengths the first language by name wins. A text that is null or has no letter, and any text
    without a tree to judge it, is ``und`` with score 0. Columns ``lang_pred`` and ``score`` of ``docs`` are
    replaced, all others kept; an empty table gives an empty table. Texts are priced whole.
    """
    names = sorted(trees)
    held = docs.sparkSession.sparkContext.broadcast([trees[n] for n in names])  # bounded, see fit

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            part = pa.RecordBatch.from_arrays([batch], names=["text"])
            labels, scores = [], []
            for rows in _slices([part], 0):
                data = [t or b"" for t in rows.column(0).to_pylist()]
                bits = code_lengths(data, held.value)
                best = bits.argmin(0)
                scores += (1 / np.exp2(np.maximum(bits.min(0) - bits, -1000)).sum(0)).tolist()
                labels += [names[b] for b in best]
            yield pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    known = F.col(f"`{text}`").rlike(r"\p{L}")
    judged = F.arrow_udf(run, "lang_pred string, score double")(F.col(f"`{text}`").cast("string").cast("binary")) if names else None
    if judged is None:
        return docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    told = docs.select(*[F.col(f"`{c}`") for c in kept], judged.alias("__told"), F.coalesce(known, F.lit(False)).alias("__known"))
    return told.select(
        *[F.col(f"`{c}`") for c in kept],
        F.when(F.col("__known"), F.col("__told.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("__known"), F.col("__told.score")).otherwise(0.0).alias("score"),
    )


def held_out(key: Column, parts: int = 5) -> Column:
    """One row in ``parts`` by the crc32 of the key as text; a null key counts as no text and is held out."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts == 0


def op13_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id").cast("long")))
    trees = fit(docs.where("not held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), trees).select("doc_id", "held_out", "lang_pred", "score")
