"""Quality rules on text statistics, judged by isolation forests calibrated on labelled rows.

Statistics are taken from every whole text. Each rule has a forest over its statistics: trees split a
bounded sample of labelled documents at random, and how soon a document is alone tells how odd it is.
A rule's cut between odd and usual is the one that rejects most documents labelled bad while it keeps
nearly all labelled good. One forest over all statistics would hide what is odd in a single one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from censusloom.llm.common import SLICE, cut, mapped, table, texts
from censusloom.llm.words import bounds, hashes, sequences, utf8

SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest splits on, each a ratio so that long documents are no odder than short ones.
RATIOS = ("symbols", "word_length", "dup_lines", "repeats", "upper", "cries", "digits")
#: The statistics each rule's forest looks at.
RULES = {"symbols": ("symbols",), "words": ("word_length",), "repeats": ("dup_lines", "repeats"), "shouting": ("upper", "cries"), "digits": ("digits",)}
FIELDS = {"doc_id": "long"} | dict.fromkeys(BASE, "long") | dict.fromkeys(RATIOS, "double")
FEWEST_WORDS, MOST_REPEATS = 50, 50
#: Bound of the sample of labelled rows.
LABELLED = 20_000

_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LOWER = np.isin(np.arange(256), np.arange(97, 123))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """Base counts and ratios of one whole text."""
    text = text or ""
    data = utf8(text)
    starts, ends = bounds(data)
    n = len(starts)
    if not n:
        return (0,) * len(BASE), (0.0,) * len(RATIOS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = len(text) - int(counts[[0x20, *range(0x09, 0x0E)]].sum())
    symbols = int(counts[_IS_SYMBOL].sum())
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    dup = len(lines) - len(set(lines))
    windows = sequences(hashes(data, starts, ends), 3)
    repeats = 0
    if len(windows):
        _, inverse, times = np.unique(windows, return_inverse=True, return_counts=True)
        hit = np.flatnonzero(times[inverse] > 1)
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + 3, -1)
        repeats = int((np.cumsum(cover)[:n] > 0).sum())
    upper, lower = int(counts[_UPPER].sum()), int(counts[_LOWER].sum())
    ratios = (
        symbols / n, chars / n, dup / len(lines), repeats / n, upper / max(1, upper + lower),
        int(counts[33]) / n, int(counts[_DIGIT].sum()) / chars,
    )
    return (n, chars, symbols, dup, repeats), ratios


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < FEWEST_WORDS or 100 * n_repeat_words > MOST_REPEATS * n_words


def measure(docs: DataFrame) -> DataFrame:
    """``(doc_id, base counts, ratios)`` of every whole text.

    A null or blank text has zeros. Rows are kept one for one, also with null or repeated ``doc_id``;
    other columns are left out; an empty table gives an empty table.
    """

    def make():
        def step(rows):
            both = [statistics(t) for t in rows["text"]]
            out = {"doc_id": rows["doc_id"]} | {k: [b[0][i] for b in both] for i, k in enumerate(BASE)}
            return out | {k: [b[1][i] for b in both] for i, k in enumerate(RATIOS)}

        return step

    return mapped(texts(docs), make, FIELDS)


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a random tree of ``n`` leaves."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Isolation trees as arrays, one row a tree; a leaf points to itself and carries its path length."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    depth: int
    usual: float
    cut: float = 2.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Oddness in 0 .. 1 of each row of ``x``."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, left, right, path in zip(self.feature, self.split, self.left, self.right, self.path):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = np.where(x[rows, feature[at]] < split[at], left[at], right[at])
            total += path[at]
        return np.exp2(-total / len(self.path) / self.usual)


def grow(x: np.ndarray, trees: int, sample: int, seed: int) -> Forest:
    """Trees over random samples of rows, split on a random ratio at a random place between its extremes."""
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    depth = max(1, math.ceil(math.log2(max(2, sample))))
    size = 2 ** (depth + 1)
    arrays = [np.zeros((trees, size), t) for t in (np.int64, float, np.int64, np.int64, float)]
    feature, split, left, right, path = arrays
    for t in range(trees):
        left[t] = right[t] = np.arange(size)
        todo, used = [(0, x[rng.choice(len(x), sample, replace=False)], 0)], 1
        while todo:
            at, rows, level = todo.pop()
            low, high = rows.min(0), rows.max(0)
            open_ = np.flatnonzero(high > low)
            if level == depth or len(rows) < 2 or not len(open_):
                path[t, at] = level + expected_path(len(rows))
                continue
            f = int(rng.choice(open_))
            s = float(rng.uniform(low[f], high[f]))
            s = s if s > low[f] else float(high[f])
            feature[t, at], split[t, at], left[t, at], right[t, at] = f, s, used, used + 1
            side = rows[:, f] < s
            todo += [(used, rows[side], level + 1), (used + 1, rows[~side], level + 1)]
            used += 2
    return Forest(feature, split, left, right, path, depth, max(expected_path(sample), 1e-9))


def calibrated(forest: Forest, x: np.ndarray, good: np.ndarray, loss: float) -> Forest:
    """Set the cut: reject the most bad rows while at most ``loss`` of the good ones are rejected.

    The cut lies half-way between the last score kept and the next one, so that rows like the kept
    ones are kept. Without good or bad rows nothing is rejected.
    """
    scores = forest.scores(x)
    best, forest.cut = 0, 2.0
    if not good.any() or good.all():
        return forest
    order = np.unique(scores)
    lost = 1 - np.searchsorted(np.sort(scores[good]), order) / good.sum()
    caught = (~good).sum() - np.searchsorted(np.sort(scores[~good]), order)
    for i in range(len(order)):
        gain = caught[i] - lost[i] * good.sum()
        if lost[i] <= loss and gain > best:
            best, forest.cut = gain, (order[i] + (order[i - 1] if i else order[i])) / 2
    return forest


@dataclass
class Rules:
    """A calibrated forest for each rule."""

    forests: dict[str, Forest]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """How far the oddest rule of each row lies above its cut; below 0 if all rules pass."""
        each = [f.scores(x[:, [RATIOS.index(c) for c in RULES[name]]]) - f.cut for name, f in self.forests.items()]
        return np.max(each, axis=0)


def fit(
    measured: DataFrame, labels: DataFrame, rows: int = LABELLED, trees: int = 100, sample: int = 256, loss: float = 0.001, seed: int = 7,
) -> Rules | None:
    """Calibrated forests from at most ``rows`` labelled documents, picked by a hash of their ids.

    Documents that fail the base rules are left out. A document with several labels has the lowest.
    Documents like those kept are kept: a cut lies between two scores. None if no labelled row is left.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    own = own.dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    passing = measured.where((F.col("n_words") >= FEWEST_WORDS) & (100 * F.col("n_repeat_words") <= MOST_REPEATS * F.col("n_words")))
    found = passing.join(F.broadcast(picked), "doc_id").select("doc_id", "quality", *RATIOS)
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id", *RATIOS).limit(rows).toPandas()
    if not len(found):
        return None
    x = found[list(RATIOS)].to_numpy(float)
    good = found["quality"].to_numpy() > 0
    forests, left = {}, np.ones(len(x), bool)
    for name, columns in RULES.items():
        own = x[:, [RATIOS.index(c) for c in columns]]
        forests[name] = calibrated(grow(own, trees, sample, seed), own[left], good[left], loss)
        left &= good | (forests[name].scores(own) < forests[name].cut)  # a later rule need not catch these again
    return Rules(forests)


def judge(measured: DataFrame, rules: Rules | None) -> DataFrame:
    """``(doc_id, base counts, base_failed, kept, margin)``; without forests the base rules decide alone."""

    def make():
        def step(rows):
            failed = [base_failed(n, r) for n, r in zip(rows["n_words"], rows["n_repeat_words"])]
            x = np.array([rows[k] for k in RATIOS], float).T
            margin = rules.margin(x) if rules and len(x) else np.full(len(failed), -1.0)
            kept = [not f and m < 0 for f, m in zip(failed, margin)]
            return {k: rows[k] for k in ("doc_id", *BASE)} | {"base_failed": failed, "kept": kept, "margin": margin}

        return step

    fields = {"doc_id": "long"} | dict.fromkeys(BASE, "long") | {"base_failed": "boolean", "kept": "boolean", "margin": "double"}
    return mapped(measured, make, fields, size=4096)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns; rows are judged where they lie.

    A null text has no words and goes.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct()
    picked = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    rules = fit(measure(texts(docs).join(F.broadcast(picked), "doc_id", "left_semi")), labels)

    @F.pandas_udf("boolean")
    def passes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for at in range(0, len(batch), SLICE):
                both = [statistics(t) for t in batch.iloc[at : at + SLICE]]
                margin = rules.margin(np.array([b[1] for b in both], float)) if rules else np.full(len(both), -1.0)
                out += [not base_failed(b[0][0], b[0][4]) and bool(m < 0) for b, m in zip(both, margin)]
            yield pd.Series(out, dtype=bool)

    return docs.where(passes(F.col("text")))


def op4_quality_rules(spark, sf_dir):
    measured = cut(measure(table(spark, sf_dir, "documents")), "quality")
    return judge(measured, fit(measured, table(spark, sf_dir, "labels")))
