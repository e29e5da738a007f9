"""Near-duplicates of documents by b-bit MinHash.

A document is its set of distinct word shingles. Documents with equal sets are one from the start. Of
each set the minima under many keyed permutations are taken: bands of whole minima find candidates,
and the low bits of all minima, packed, estimate the similarity of two sets from the count of equal
ones, corrected for those that are equal by chance. Sets that share a band key, directly or through
others, are a family. Sets whose estimate could reach the threshold and that are not linked already are
compared as full sets, in blocks, so no group is ever held whole. A family of several blocks is dealt to
random blocks twice and linked inside them, which grows with its size and joins what has many copies;
after that only the sets outside its largest component meet the rest, in pairs of blocks. A pair of
blocks gives a spanning forest of its new links, not the pairs.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from censusloom.llm.common import Forest, components, cut, mapped, runs, small, table, texts
from censusloom.llm.words import bounds, hashes, mixed, sequences, utf8

#: Documents of a family in a block.
BLOCK = 256
#: Low bits kept of each minimum, packed into 64-bit words.
BITS = 4
_ONES = np.uint64(0x1111111111111111)


@dataclass(frozen=True)
class Likeness:
    """What is alike: ``100 * shared >= percent * united`` for sets of ``width``-word shingles.

    The number of bands follows from the share of pairs at the threshold that may be missed.
    """

    width: int = 3
    percent: int = 85
    rows: int = 6
    missed: float = 1e-5
    seed: int = 11
    bands: int = field(init=False)

    def __post_init__(self):
        hit = (self.percent / 100) ** self.rows
        object.__setattr__(self, "bands", math.ceil(math.log(self.missed) / math.log1p(-hit)))

    @property
    def minima(self) -> int:
        return self.rows * self.bands

    @property
    def estimate(self) -> float:
        """Estimates below this don't come from pairs at the threshold, but for one in a hundred thousand."""
        t = self.percent / 100
        return t - 4.5 * math.sqrt(t * (1 - t) / self.minima)


class Signer:
    """Shingle sets and signatures of texts."""

    def __init__(self, like: Likeness):
        rng = np.random.default_rng(like.seed)
        self.like = like
        self.flip = rng.integers(0, 1 << 32, like.minima, dtype=np.uint32)[:, None]
        self.times = (rng.integers(0, 1 << 32, like.minima, dtype=np.uint32) | np.uint32(1))[:, None]
        self.place = mixed(np.arange(1, like.minima + 1, dtype=np.uint64)).reshape(like.bands, like.rows) | np.uint64(1)

    def shingles(self, text: str | None) -> np.ndarray:
        """Distinct shingle hashes, sorted; with too few words, the whole sequence as one."""
        data = utf8(text, lower=True)
        own = hashes(data, *bounds(data))
        return np.unique(sequences(own, min(self.like.width, len(own)))) if len(own) else own

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        values = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.like.minima, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(values), 2048):
            least = np.minimum(least, ((values[None, at : at + 2048] ^ self.flip) * self.times).min(axis=1))
        return least

    def bands(self, minima: np.ndarray) -> np.ndarray:
        """A key for each band; keys of different bands differ."""
        rows = minima.astype(np.uint64).reshape(self.place.shape)
        return mixed((mixed(rows + np.uint64(1)) * self.place).sum(axis=1, dtype=np.uint64)).view(np.int64)

    def low_bits(self, minima: np.ndarray) -> np.ndarray:
        """The low bits of all minima, 16 to a word; what is left of the last word is 0 in every signature."""
        low = np.zeros(-(-len(minima) // 16) * 16, np.uint64)
        low[: len(minima)] = minima & np.uint32((1 << BITS) - 1)
        return (low.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)


def estimates(one: np.ndarray, many: np.ndarray, minima: int) -> np.ndarray:
    """Similarity of a packed signature to others: the share of equal entries, without those equal by chance."""
    differ = one ^ many
    differ |= differ >> np.uint64(1)
    differ |= differ >> np.uint64(2)
    equal = 1 - np.bitwise_count(differ & _ONES).sum(axis=1, dtype=np.int64) / minima
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def features(docs: DataFrame, like: Likeness) -> DataFrame:
    """``(doc_id, version, n_shingles, set_key, bands, signature)`` of whole texts; without words the last three are null.

    ``version`` is a hash of the text, and ``signature`` the low bits of all minima, packed.
    """

    def make():
        signer = Signer(like)

        def step(rows):
            sets = [signer.shingles(t) for t in rows["text"]]
            minima = [signer.minima(s) if len(s) else None for s in sets]
            return {
                "doc_id": rows["doc_id"], "version": rows["version"], "n_shingles": [len(s) for s in sets],
                "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "bands": [None if m is None else signer.bands(m) for m in minima],
                "signature": [None if m is None else signer.low_bits(m).tobytes() for m in minima],
            }

        return step

    fields = {"doc_id": "long", "version": "long", "n_shingles": "long", "set_key": "binary", "bands": "array<long>", "signature": "binary"}
    return mapped(texts(docs).withColumn("version", F.xxhash64("text")), make, fields)


def families(sets: DataFrame) -> DataFrame:
    """``(node, family, blocks)`` of all sets that share a band key with another."""
    keyed = sets.select("node", F.explode("bands").alias("band"))
    lowest = keyed.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    edges = keyed.join(lowest, "band").where("node > low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    found = components(edges, "families").withColumnRenamed("component", "family")
    sizes = found.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    return found.join(sizes, "family")


def _links(like: Likeness):
    def make():
        def step(key, group: pa.Table):
            _, lo, hi = key
            node = group["node"].to_numpy()
            order = np.argsort(node, kind="stable")
            block = group["block"].to_numpy()[order]
            data = group["shingles"].to_pylist()
            sets = [np.frombuffer(data[i], np.uint64) for i in order]
            node = node[order]
            size = np.array([len(s) for s in sets])
            signs = np.frombuffer(b"".join(group["signature"].to_pylist()), np.uint64).reshape(len(sets), -1)[order]
            forest, a, b = Forest(len(sets)), [], []
            first: dict[int, int] = {}
            for i, known in enumerate(group["known"].to_numpy()[order].tolist()):
                forest.join(first.setdefault(known, i), i)
            for i in range(len(sets)):
                rest = np.arange(i + 1, len(sets))
                if lo != hi:
                    rest = rest[block[i + 1 :] != block[i]]
                rest = rest[100 * np.minimum(size[rest], size[i]) >= like.percent * np.maximum(size[rest], size[i])]
                if not len(rest):
                    continue
                near = estimates(signs[i], signs[rest], like.minima)
                best = np.argsort(-near, kind="stable")
                for j in rest[best[near[best] >= like.estimate]].tolist():
                    if forest.find(i) == forest.find(j):
                        continue
                    shared = len(np.intersect1d(sets[i], sets[j], True))
                    if 100 * shared >= like.percent * (size[i] + size[j] - shared):
                        forest.join(i, j)
                        a.append(node[i])
                        b.append(node[j])
            return {"a": a, "b": b}

        return step

    return make


def _dealt(members: DataFrame, linked: DataFrame) -> DataFrame:
    """Members in pairs of blocks ``lo <= hi`` in which all pairs meet, but those inside a family's largest component.

    ``linked (node, component)`` are the links found so far; families it does not name are one block.
    """
    nodes = members.select("node", "family", "blocks").join(linked, "node", "left")
    nodes = cut(nodes.select("node", "family", F.coalesce("component", "node").alias("known"), (F.col("blocks") > 1).alias("several")), "known")
    parts = nodes.where("several").groupBy("family", "known").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("family").agg(F.max_by("known", F.struct("n", "known")).alias("main"), F.max("n").alias("in_main"), F.sum("n").alias("n"))
    ceil = lambda n: F.ceil(n / BLOCK).cast("long")
    largest = largest.select("family", "main", ceil(F.col("in_main")).alias("mains"), ceil(F.col("n") - F.col("in_main")).alias("others"))
    placed = nodes.join(largest, "family", "left").select(
        "node", "known", F.coalesce(F.col("known") == F.col("main"), F.lit(False)).alias("inner"),
        F.coalesce("mains", F.lit(0).cast("long")).alias("mains"), F.coalesce("others", F.lit(1).cast("long")).alias("others"),
    ).where("not inner or others > 0")
    block = F.expr("if(inner, pmod(xxhash64(node), mains), mains + pmod(xxhash64(node), others))").alias("block")
    placed = placed.select("node", "known", block, F.expr("if(inner, mains, 0L)").alias("from"), (F.col("mains") + F.col("others") - 1).alias("to"))
    dealt = members.select("node", "family", "signature", "shingles").join(placed, "node")
    dealt = dealt.withColumn("_other", F.explode(F.sequence("from", "to"))).drop("from", "to")
    return dealt.withColumn("lo", F.least("block", "_other")).withColumn("hi", F.greatest("block", "_other")).drop("_other")


def near_duplicates(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every document.

    Linked are documents whose full sets of shingles are alike; ``component_id`` is the smallest
    ``doc_id`` reachable by links. Words are runs of characters other than space and U+0009 to U+000D,
    with A to Z in lower case. A null text or one without words has no shingles and links with nothing.
    Rows are kept one for one: rows with equal ``doc_id`` and different sets are linked on their own, and
    rows with a null ``doc_id`` link with nothing, have a null component and are kept. Other columns are
    left out; an empty table gives an empty table.
    """
    found = cut(features(docs, like), "minhash")
    known = found.where("doc_id is not null and set_key is not null")
    sets = known.groupBy("set_key").agg(F.min(F.struct("doc_id", "version", "bands", "signature")).alias("s"))
    # numbers of sets are fixed by being written
    sets = cut(sets.select("set_key", "s.*", F.monotonically_increasing_id().alias("node")), "sets")
    family = cut(families(sets), "families")
    chosen = sets.select("node", "doc_id", "version", "signature").join(small(family, 40), "node")
    own = texts(docs).withColumn("version", F.xxhash64("text"))
    members = own.join(chosen, ["doc_id", "version"]).select("node", "text", "family", "blocks", "signature")

    def make():
        signer = Signer(like)
        return lambda rows: {k: rows[k] for k in ("node", "family", "blocks", "signature")} | {
            "shingles": [signer.shingles(t).tobytes() for t in rows["text"]]
        }

    members = mapped(members, make, {"node": "long", "family": "long", "blocks": "long", "signature": "binary", "shingles": "binary"})
    members = cut(members, "members")
    fields = {"a": "long", "b": "long"}
    inside = []
    for turn in (1, 2):
        own = F.pmod(F.xxhash64("node", F.lit(turn)), "blocks")
        dealt = members.where("blocks > 1").withColumns({"known": F.col("node"), "block": own, "lo": own, "hi": own}).drop("blocks")
        inside.append(cut(runs(dealt, ["family", "lo", "hi"], _links(like), fields, least=2), "inside"))
    inside = inside[0].unionByName(inside[1])
    dealt = _dealt(members, components(inside, "inside"))
    edges = cut(runs(dealt, ["family", "lo", "hi"], _links(like), fields, least=2), "edges").unionByName(inside)
    linked = cut(sets.select("node", "set_key", "doc_id").join(components(edges, "links"), "node"), "linked")
    lowest = linked.groupBy("component").agg(F.min("doc_id").alias("lowest"))
    lone = sets.select("set_key", F.col("doc_id").alias("component")).join(linked, "set_key", "left_anti")
    labels = lone.unionByName(linked.join(lowest, "component").select("set_key", F.col("lowest").alias("component")))
    out = found.select("doc_id", "n_shingles", "set_key").join(labels, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def keep_one(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """The documents without those linked to a smaller ``doc_id``, directly or not; all columns are kept.

    Rows that share a ``doc_id`` stay or go together; rows with a null ``doc_id`` stay.
    """
    gone = cut(near_duplicates(docs, like).where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(small(gone, 16), docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")


def op2_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
