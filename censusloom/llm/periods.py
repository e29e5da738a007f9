"""Runs of words that repeat with a period, found by longest common extensions in suffix trees.

A text is first narrowed to the stretches every word of which lies in a window that comes again in the
text; a run of the asked length has no other words, and nor has a word beside one that would extend it.
Each stretch gets a suffix tree, and so does its reversal (Ukkonen's algorithm). The Euler tour of a
tree gives the order of its leaves and the lowest node between neighbours, and a table of minima over it
the longest common extension of any two places in constant time. The longest Lyndon word at each place,
for both orders of the alphabet, is the root of every run there can be; extended to both sides by
the two trees it becomes the run.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from censusloom.llm.common import mapped, table
from censusloom.llm.words import bounds, hashes, sequences

FIELDS = {
    "doc_id": "long", "n_words": "long", "starts": "array<long>", "lengths": "array<long>", "periods": "array<long>", "collapsed": "binary",
}


def suffix_tree(symbols: list[int]) -> tuple[dict[int, int], list[int], list[int], int]:
    """Ukkonen's tree of a sequence that ends in a symbol found nowhere else.

    Returns the edges, ``parent * width + first symbol -> child``, begin and end of every node's label,
    and ``width``.
    """
    n, width = len(symbols), max(symbols) + 1
    begin, end, link, edges = [0], [0], [0], {}
    node, edge, length, left = 0, 0, 0, 0
    for i, symbol in enumerate(symbols):
        waiting = 0
        left += 1
        while left:
            if not length:
                edge = i
            key = node * width + symbols[edge]
            child = edges.get(key)
            if child is None:
                edges[key] = len(begin)
                begin.append(i)
                end.append(n)
                link.append(0)
                if waiting:
                    link[waiting] = node
                    waiting = 0
            else:
                at = begin[child]
                span = (end[child] if end[child] <= i else i + 1) - at
                if length >= span:
                    edge += span
                    length -= span
                    node = child
                    continue
                if symbols[at + length] == symbol:
                    length += 1
                    if waiting:
                        link[waiting] = node
                    break
                fork = len(begin)
                begin += (at, i)
                end += (at + length, n)
                link += (0, 0)
                edges[key] = fork
                edges[fork * width + symbol] = fork + 1
                begin[child] = at + length
                edges[fork * width + symbols[at + length]] = child
                if waiting:
                    link[waiting] = fork
                waiting = fork
            left -= 1
            if node == 0 and length:
                length -= 1
                edge = i - left + 1
            elif node:
                node = link[node]
    return edges, begin, end, width


class Extensions:
    """Longest common extensions to the right of any two places of a sequence of numbers ``1 ..``.

    ``ranks`` has the place of every suffix in the order of the alphabet, with the empty suffix first;
    ``ranks_reversed()`` that for the alphabet the other way round.
    """

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        edges, begin, end, self.width = suffix_tree([*symbols.tolist(), 0])
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        self.children = np.fromiter(edges.values(), np.int64, len(edges))
        self.parents, self.firsts = keys // self.width, keys % self.width
        self.labels = (np.array(end) - np.array(begin)).tolist()
        order, lowest = self._tour(self.firsts, True)
        self.ranks = np.empty(self.n + 1, np.int64)
        self.ranks[order] = np.arange(self.n + 1)
        self.minima = [np.array(lowest, np.int32)]
        while 2 << (len(self.minima) - 1) <= self.n + 1:
            last, step = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-step], last[step:]))

    def _tour(self, firsts: np.ndarray, with_depths: bool) -> tuple[list[int], list[int]]:
        """Euler tour: suffixes in the order of their leaves, and the depth where the tour turned before each."""
        # children that come first are pushed last
        by_node = np.lexsort((-firsts, self.parents))
        kids = self.children[by_node].tolist()
        nodes = len(self.labels)
        ends = np.cumsum(np.bincount(self.parents, minlength=nodes)).tolist()
        depth, labels = [0] * nodes, self.labels
        above = [0] * nodes
        stack, order, lowest, low, total = kids[: ends[0]], [], [], 0, self.n + 1
        while stack:
            node = stack.pop()
            top = above[node]
            if top < low:
                low = top
            here = top + labels[node]
            first, last = ends[node - 1], ends[node]
            if first == last:
                order.append(total - here)
                lowest.append(low)
                low = total
                continue
            below = kids[first:last]
            for kid in below:
                above[kid] = here
            stack += below
        return order, lowest

    def ranks_reversed(self) -> np.ndarray:
        turned = np.where(self.firsts == 0, 0, self.width - self.firsts)
        ranks = np.empty(self.n + 1, np.int64)
        ranks[self._tour(turned, False)[0]] = np.arange(self.n + 1)
        return ranks

    def __call__(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Length of what both suffixes begin with; the suffix ``n`` is empty. Places must differ."""
        a, b = self.ranks[one], self.ranks[other]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.minima)):
            at = np.flatnonzero(level == k)
            if len(at):
                out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << k)])
        return out


def _lyndon_ends(ranks: np.ndarray) -> np.ndarray:
    """End of the longest Lyndon word at each place: where the next smaller suffix begins."""
    rank = ranks.tolist()
    n = len(rank) - 1
    ends = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        j, own = i + 1, rank[i]
        while rank[j] > own:
            j = ends[j]
        ends[i] = j
    return np.array(ends[:n], np.int64)


def all_runs(symbols: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows ``start, length, period`` of the runs of a sequence of numbers ``1 ..``, by start, then period."""
    n = len(symbols)
    ahead, back = Extensions(symbols), Extensions(symbols[::-1])
    found = []
    for ranks in (ahead.ranks, ahead.ranks_reversed()):
        begin, end = np.arange(n), _lyndon_ends(ranks)
        start = begin - back(n - begin, n - end)
        stop = end + ahead(begin, end)
        period = end - begin
        good = stop - start >= np.maximum(least, times * period)
        found.append(np.stack([start, stop - start, period], 1)[good])
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def candidates(words: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Stretches ``begin .. end`` that hold every run.

    In a run of length L >= max(least, times * q) every window of at most least * (times - 2) / times + 1 words
    comes again one period before or after, as L > 2 * q + window - 2.
    """
    window = math.ceil(least * (times - 2) / times) + 1
    spans = sequences(words, window)
    if len(words) < least:
        return []
    order = np.argsort(spans, kind="stable")
    same = spans[order[1:]] == spans[order[:-1]]
    again = np.zeros(len(spans), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    hit = np.flatnonzero(again)
    cover[hit] += 1
    cover[hit + window] -= 1
    edges = np.flatnonzero(np.diff(np.cumsum(cover[:-1]) > 0, prepend=False, append=False))
    return [(int(a), int(b)) for a, b in zip(edges[0::2], edges[1::2]) if b - a >= least]


def runs_of(words: list[bytes], codes: np.ndarray, least: int, times: int) -> np.ndarray:
    """Runs of a list of words, given their hashes; words are told apart by their bytes, not by these."""
    found = [np.empty((0, 3), np.int64)]
    for begin, end in candidates(codes, least, times):
        numbers: dict[bytes, int] = {}
        symbols = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words[begin:end]], np.int64)
        found.append(all_runs(symbols, least, times) + np.array([begin, 0, 0]))
    return np.concatenate(found)


def find_runs(
    docs: DataFrame, least: int = 24, times: int = 3, rewrite: Callable[[int | None, int], np.ndarray | None] | None = None,
) -> DataFrame:
    """``(doc_id, n_words, starts, lengths, periods, collapsed)`` of every whole text.

    A run has smallest period ``q``, at least ``max(least, times * q)`` words (``times`` at least 2) and no
    neighbour that would extend it. The lists have one entry a run, by start, then period. ``collapsed``
    has the words outside of all runs and the first ``q`` of each run, one space between them. ``rewrite``
    gets ``doc_id`` and the number of words of a text and may return, for each place, the number of the word to
    read there. A null or blank text has no words. Rows are kept one for one, also with null or repeated
    ``doc_id``; other columns are left out; an empty table gives an empty table. Memory follows the
    longest repetitive stretch of a single text.
    """
    if times < 2:
        raise ValueError("a run repeats at least twice")

    def make():
        def one(key, data):
            words = data.split()  # the same white space: space and U+0009 to U+000D
            codes = hashes(data, *bounds(data))
            index = rewrite(key, len(words)) if rewrite and words else None
            if index is not None:
                words, codes = [words[i] for i in index.tolist()], codes[index]
            runs = runs_of(words, codes, least, times)
            if len(runs):
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
                np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
                kept = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
            else:
                kept = words
            return len(words), runs, b" ".join(kept)

        def step(rows):
            done = [one(key, data or b"") for key, data in zip(rows["doc_id"], rows["text"])]
            parts = {name: [d[1][:, i] for d in done] for i, name in enumerate(("starts", "lengths", "periods"))}
            return {"doc_id": rows["doc_id"], "n_words": [d[0] for d in done], **parts, "collapsed": [d[2] for d in done]}

        return step

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return mapped(own, make, FIELDS).withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(key: int | None, n: int) -> np.ndarray | None:
    """One text in ten, by a hash of its key, repeats a stretch of its words from some word on."""
    if key is None:
        return None
    h = zlib.crc32(str(key).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    index = np.arange(n)
    index[a:] = a + (index[a:] - a) % p
    return index


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the run with the greatest exponent, and digests of all runs and of the collapsed text."""
    runs = "transform(starts, (s, i) -> named_struct('start', s, 'length', lengths[i], 'period', periods[i]))"
    ahead = "r.length * b.period > b.length * r.period"  # exact; of equal ones the first, by start and period, stays
    best = f"aggregate(runs, runs[0], (b, r) -> if({ahead}, r, b))"
    lines = "transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n'))"
    told = found.withColumn("runs", F.expr(runs)).withColumn("best", F.expr(f"if(size(runs) > 0, {best}, null)"))
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.expr(f"array_join({lines}, '')"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark, sf_dir):
    return digest(find_runs(table(spark, sf_dir, "documents"), rewrite=planted))
