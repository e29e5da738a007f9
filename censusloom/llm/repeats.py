"""Removal of passages that repeat across documents, by repeated-phrase automata.

A window is a number of consecutive words. Each window is represented by the least hash of the short
word runs inside it, which equal windows share; consecutive windows with the same least hash are a
segment. Segments whose hash comes only once can't hold a repeated window. Equal segments are put
together: all but the first repeat it whole. The different ones are cut out of the texts. Where very many
of them share a least hash, as around a common saying, they are cut again into single windows, and those
that come only once are let go. Windows are counted, and those that come again are confirmed phrases, each
with its first place. Phrases and segments are dealt to shards by the least hash, or by the window's own;
each shard compiles its phrases into an Aho-Corasick automaton over words and streams its segments through
it, which gives every place of every phrase, word for word. All places but the first are removed.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from censusloom.llm.common import cut, mapped, runs, small, table, texts
from censusloom.llm.words import bounds, hashes, inside, sequences, stretches, utf8

WINDOW, RUN = 20, 6
#: Segments in a shard, and the most that one task streams through a shard's automaton.
SHARD, STREAM = 2000, 4000
#: Stands for a missing doc_id, which comes after all others.
LAST = (1 << 63) - 1


def least_hashes(words: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs, and the least of them in every window."""
    own = sequences(words, run)
    least, width, reach = own, 1, window - run + 1
    while width < reach:
        step = min(width, reach - width)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        width += step
    return own, least


def segments(words: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least hash, first window, number of windows and number of equal runs in the document, of each segment."""
    own, least = least_hashes(words, window, run)
    if not len(least):
        none = np.empty(0, np.int64)
        return none, none, none, none
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    many = np.diff(np.append(first, len(least)))
    ordered = np.sort(own)
    key = least[first]
    times = np.searchsorted(ordered, key, "right") - np.searchsorted(ordered, key, "left")
    return key.view(np.int64), first, many, times


def _keyed(docs: DataFrame) -> DataFrame:
    """``(id, version, text)``: a missing id comes last; rows with equal ids are told apart by their texts."""
    plain = texts(docs).where("text is not null")
    return plain.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64("text").alias("version"), "text")


def _document_words(text: str | None) -> np.ndarray:
    data = utf8(text)
    return hashes(data, *bounds(data))


def repeated_segments(keyed: DataFrame, window: int, run: int) -> DataFrame:
    """``(id, version, first, many, key, own)`` of the segments that may hold a repeated window.

    ``own`` is a hash of all words of the segment; together with ``key`` it tells segments apart.
    """

    def count():
        def step(rows):
            keys, times = [], []
            for text in rows["text"]:
                key, _, _, n = segments(_document_words(text), window, run)
                own, at = np.unique(key, return_index=True)
                keys.append(own)
                times.append(n[at])
            return {"key": np.concatenate(keys).astype(np.int64), "n": np.concatenate(times).astype(np.int64)}

        return step

    def place():
        def step(rows):
            found, owns = [], []
            for text in rows["text"]:
                words = _document_words(text)
                found.append(segments(words, window, run))
                _, first, many, _ = found[-1]
                owns.append(stretches(words, first, first + many + window - 1).view(np.int64))
            count = [len(f[0]) for f in found]
            return {k: np.repeat(np.array(rows[k], np.int64), count) for k in ("id", "version")} | {
                k: np.concatenate([f[i] for f in found]).astype(np.int64) for k, i in (("first", 1), ("many", 2), ("key", 0))
            } | {"own": np.concatenate(owns).astype(np.int64)}

        return step

    counted = mapped(keyed.select("text"), count, {"key": "long", "n": "long"})
    again = cut(counted.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "runs")
    placed = mapped(keyed, place, dict.fromkeys(("id", "version", "first", "many", "key", "own"), "long"))
    return placed.join(again, "key").select("id", "version", "first", "many", "key", "own")


def with_words(keyed: DataFrame, chosen: DataFrame, window: int) -> DataFrame:
    """``(id, version, first, key, words)``: the words of chosen segments ``(id, version, first, many, key)``."""
    wanted = chosen.groupBy("id", "version").agg(F.collect_set(F.struct("first", "many", "key")).alias("s"))
    wanted = cut(wanted.select("id", "version", F.col("s.first").alias("firsts"), F.col("s.many").alias("many"), F.col("s.key").alias("keys")), "wanted")

    def make():
        def step(rows):
            out = {name: [] for name in fields}
            for id_, version, text, *chosen in zip(*(rows[k] for k in ("id", "version", "text", "firsts", "many", "keys"))):
                data = utf8(text)
                starts, ends = bounds(data)
                for first, many, key in zip(*chosen):
                    own = b" ".join(data[starts[w] : ends[w]] for w in range(first, first + many + window - 1))
                    for name, value in zip(fields, (id_, version, first, key, own.decode("utf-8", "surrogatepass"))):
                        out[name].append(value)
            return out

        return step

    fields = {"id": "long", "version": "long", "first": "long", "key": "long", "words": "string"}
    return mapped(keyed.join(wanted, ["id", "version"]), make, fields)


def split_common(found: DataFrame, window: int) -> DataFrame:
    """The segments, but those of a hash that more than ``STREAM`` of them share are cut into single windows.

    A window goes by its own hash from there on, and windows whose hash comes only once are left out.
    So a shard holds few phrases of a common hash, however many segments there are.
    """
    common = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > STREAM).select("key")
    common = cut(common, "common")
    if common.isEmpty():
        return found

    def make():
        def step(rows):
            out = {name: [] for name in fields}
            for id_, version, first, words in zip(*(rows[k] for k in ("id", "version", "first", "words"))):
                data = utf8(words)
                starts, ends = bounds(data)
                for at, key in enumerate(sequences(hashes(data, starts, ends), window).view(np.int64).tolist()):
                    own = data[starts[at] : ends[at + window - 1]].decode("utf-8", "surrogatepass")
                    for name, value in zip(fields, (id_, version, first + at, key, own)):
                        out[name].append(value)
            return out

        return step

    fields = {"id": "long", "version": "long", "first": "long", "key": "long", "words": "string"}
    common = small(common, 16)
    single = cut(mapped(found.join(common, "key").select("id", "version", "first", "words"), make, fields), "single")
    again = single.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return cut(found.join(common, "key", "left_anti").unionByName(single.join(again, "key")), "split")


def confirmed_phrases(found: DataFrame, window: int) -> DataFrame:
    """``(id, version, first, starts)``: the windows that come again, at their first place, by segment."""

    def make():
        def step(rows):
            if not rows["id"]:
                return {name: [] for name in fields}
            words = np.array([t.count(" ") + 1 for t in rows["words"]])
            data = utf8(" ".join(rows["words"]))
            hashed, many = sequences(hashes(data, *bounds(data)), window), words - window + 1
            step_in, place = inside(many), np.repeat(np.cumsum(words) - words, many)
            out = {k: np.repeat(np.array(rows[k], np.int64), many) for k in ("id", "version", "first")}
            return out | {"hash": hashed[place + step_in].view(np.int64), "start": out["first"] + step_in}

        return step

    fields = dict.fromkeys(("id", "version", "first", "hash", "start"), "long")
    windows = mapped(found.select("id", "version", "first", "words"), make, fields, size=2048)
    place = F.struct("id", "start", "first", "version").alias("place")
    counted = windows.select("hash", place).groupBy("hash").agg(F.min("place").alias("p"), F.count(F.lit(1)).alias("n"))
    again = counted.where("n > 1").select("p.id", "p.version", "p.start", "p.first")
    return again.groupBy("id", "version", "first").agg(F.collect_list("start").alias("starts"))


def _locate(window: int):
    def make():
        def step(key, group: pa.Table):
            rows = group.to_pydict()
            number: dict[str, int] = {}
            automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            split = [w.split(" ") for w in rows["words"]]
            for words, id_, first, starts in zip(split, rows["id"], rows["first"], rows["starts"]):
                if starts is not None:
                    own = [number.setdefault(w, len(number) + 1) for w in words]
                    for start in starts:
                        automaton.add_word(tuple(own[start - first : start - first + window]), (id_, start))
            out = {name: [] for name in ("id", "version", "begin", "end")}
            if not len(automaton):
                return out
            automaton.make_automaton()
            for words, id_, version, first, starts in zip(split, rows["id"], rows["version"], rows["first"], rows["starts"]):
                if starts is not None:
                    continue
                begin = end = -1
                for last, place in automaton.iter(tuple(number.get(w, 0) for w in words)):
                    at = first + last - window + 1
                    if (id_, at) == place:
                        continue
                    if at > end:
                        if end > 0:
                            for name, value in zip(out, (id_, version, begin, end)):
                                out[name].append(value)
                        begin = at
                    end = at + window
                if end > 0:
                    for name, value in zip(out, (id_, version, begin, end)):
                        out[name].append(value)
            return out

        return step

    return make


def _sharded(found: DataFrame, phrases: DataFrame) -> DataFrame:
    """Segments, and phrases with their ``starts``, dealt to shards; a shard of many segments has several streams.

    The phrases of a shard go to each of its streams.
    """
    shards = max(1, -(-found.count() // SHARD))
    shard = F.pmod("key", F.lit(shards)).alias("shard")
    busy = found.groupBy(shard).agg(F.ceil(F.count(F.lit(1)) / STREAM).alias("streams")).where("streams > 1")
    busy = small(cut(busy, "streams"), 24)
    several = F.coalesce("streams", F.lit(1).cast("long"))
    stream = found.withColumn("shard", shard).join(busy, "shard", "left").select(
        "shard", F.pmod(F.xxhash64("id", "version", "first"), several).alias("stream"), "id", "version", "first", "words",
        F.lit(None).cast("array<long>").alias("starts"),
    )
    spoken = found.join(phrases, ["id", "version", "first"]).withColumn("shard", shard)
    spoken = spoken.join(busy, "shard", "left").select(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), several - 1)).alias("stream"), "id", "version", "first", "words", "starts",
    )
    return stream.unionByName(spoken)


def removed_words(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """``(id, version, begins, ends)``: word ranges to remove, of the documents that have any.

    A range is covered by windows whose words also start earlier: in a smaller ``doc_id``, or in the
    same document before. A missing ``doc_id`` comes last; rows with equal ``doc_id`` and start are the
    same place.
    """
    keyed = _keyed(docs)
    places = cut(repeated_segments(keyed, window, run), "places")
    place = F.struct("id", "first", "version", "many").alias("p")
    different = places.select("key", "own", place).groupBy("key", "own").agg(F.min("p").alias("p"), F.count(F.lit(1)).alias("n"))
    different = cut(different.select("key", "own", "p.*", "n"), "different")
    found = split_common(cut(with_words(keyed, different, window), "segments"), window)
    phrases = cut(confirmed_phrases(found, window), "phrases")
    fields = {"id": "long", "version": "long", "begin": "long", "end": "long"}
    ranges = runs(_sharded(found, phrases), ["shard", "stream"], _locate(window), fields, least=2)
    first = different.where("n > 1").select("key", "own", F.col("id").alias("_id"), F.col("first").alias("_first"))
    again = places.join(first, ["key", "own"]).where("id <> _id or first <> _first")
    again = again.select("id", "version", F.col("first").alias("begin"), (F.col("first") + F.col("many") + window - 1).alias("end"))
    ranges = ranges.unionByName(again).distinct()
    return ranges.groupBy("id", "version").agg(F.collect_list(F.struct("begin", "end")).alias("r")).select(
        "id", "version", F.col("r.begin").alias("begins"), F.col("r.end").alias("ends")
    )


def _kept(n: int, begins, ends) -> np.ndarray:
    gone = np.zeros(n + 1, np.int64)
    np.add.at(gone, np.array(begins or (), np.int64), 1)
    np.add.at(gone, np.array(ends or (), np.int64), -1)
    return np.cumsum(gone)[:n] == 0


def _with_ranges(docs: DataFrame, window: int, run: int) -> DataFrame:
    """All rows and columns, with the ranges of each as ``_begins`` and ``_ends``."""
    ranges = cut(removed_words(docs, window, run), "ranges")
    ranges = ranges.select(F.col("id").alias("_id"), F.col("version").alias("_version"), F.col("begins").alias("_begins"), F.col("ends").alias("_ends"))
    own = (F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)) == F.col("_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_version"))
    return docs.join(ranges, own, "left").drop("_id", "_version")


def without_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text)`` of every document, kept words joined by one space.

    A null text has no words and an empty ``kept_text``. Rows are kept one for one; other columns are
    left out; an empty table gives an empty table. See ``removed_words`` for ties.
    """

    def make():
        def step(rows):
            out = {"doc_id": rows["doc_id"], "n_words": [], "n_removed": [], "kept_text": []}
            for text, begins, ends in zip(rows["text"], rows["_begins"], rows["_ends"]):
                data = utf8(text)
                first, last = bounds(data)
                keep = np.flatnonzero(_kept(len(first), begins, ends))
                out["n_words"].append(len(first))
                out["n_removed"].append(len(first) - len(keep))
                out["kept_text"].append(b" ".join(data[first[i] : last[i]] for i in keep.tolist()).decode("utf-8", "surrogatepass"))
            return out

        return step

    ranged = _with_ranges(texts(docs), window, run).select("doc_id", "text", "_begins", "_ends")
    return mapped(ranged, make, {"doc_id": "long", "n_words": "long", "n_removed": "long", "kept_text": "string"})


def cut_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """The documents with repeated passages cut out of ``text``; all rows and columns are kept.

    What lies between kept words stays as it is, and a cut leaves one space. Texts without a repeated
    passage, null ones among them, are not changed.
    """
    @F.pandas_udf("string")
    def shortened(text: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for t, b, e in zip(text, begins, ends):
            if t is None or b is None or not len(b):
                out.append(t)
                continue
            data = utf8(t)
            first, last = bounds(data)
            keep = np.concatenate(([False], _kept(len(first), list(b), list(e)), [False])).astype(np.int8)
            turns = np.flatnonzero(np.diff(keep))
            parts = [data[first[i] : last[j - 1]] for i, j in zip(turns[0::2], turns[1::2])]
            out.append(b" ".join(parts).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    # other columns travel as one, so that their names meet no other
    others = [c for c in docs.columns if c != "text"]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_others"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = _with_ranges(own, window, run).select("_others", shortened("text", "_begins", "_ends").alias("text"))
    return ranged.select(*[F.col("text") if c == "text" else F.col("_others")[c].alias(c) for c in docs.columns])


def op8_repeated_passages(spark, sf_dir):
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
