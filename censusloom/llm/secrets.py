"""Secret scan by a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived that every match must satisfy. The
index of a slice of documents maps each trigram that any query uses to the documents that have it;
queries intersect and unite these postings, and only documents that satisfy a query are scanned with
the rule. Rules without mandatory trigrams scan every document. An index never leaves its task, so
nothing is shuffled and a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import product
from re import _constants as node
from re import _parser as regexes

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from censusloom.llm.common import SLICE, mapped, texts
from censusloom.llm.words import utf8

#: Base rules: kind, regex, and the test a match must pass. Fixed values.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]{24,}", lambda m: True),
}
#: Further rules, found in the same way.
ADDED = {
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", lambda m: True),
    "code_host": (r"gh[pousr]_[A-Za-z0-9]{36,}", lambda m: True),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]{10,}", lambda m: True),
    "signed": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", lambda m: True),
    "login_url": (r"[a-z]{2,10}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@[A-Za-z0-9.-]+", lambda m: True),
}
#: Most literal strings a part of a regex is expanded to before it is cut off.
EXPANDED = 64


def _literals(item, many: int = EXPANDED) -> list[str] | None:
    """All strings an element of a parsed regex can match, if they are few."""
    op, value = item
    if op is node.LITERAL:
        return [chr(value)]
    if op is node.IN and all(k is node.LITERAL for k, _ in value) and len(value) <= 4:
        return [chr(c) for _, c in value]
    if op is node.SUBPATTERN:
        return _strings(value[3], many)
    if op is node.BRANCH:
        found = [_strings(branch, many) for branch in value[1]]
        return None if None in found or sum(map(len, found)) > many else sum(found, [])
    if op in (node.MAX_REPEAT, node.MIN_REPEAT) and value[1] <= 2:
        inner = _strings(value[2], many)
        if inner is None:
            return None
        times = range(value[0], value[1] + 1)
        found = ["".join(p) for n in times for p in product(inner, repeat=n)]
        return found if len(found) <= many else None
    return None


def _strings(items, many: int) -> list[str] | None:
    found = [""]
    for item in items:
        more = _literals(item, many)
        if more is None or len(found) * len(more) > many:
            return None
        found = [a + b for a in found for b in more]
    return found


def trigram_query(pattern: str) -> list[list[frozenset[bytes]]]:
    """A conjunction of disjunctions of trigram sets (lower case, of UTF-8) that any match satisfies.

    Each disjunct is a set of trigrams that must all be there. Runs of elements with few literal
    strings are joined; what can't be expanded ends a run. A run with a string under three bytes
    says nothing. An empty query means that every document must be scanned.
    """
    clauses, held = [], [""]

    def close():
        nonlocal held
        strings = [utf8(s, lower=True) for s in held]
        if min(map(len, strings)) >= 3:
            clauses.append([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])
        held = [""]

    def walk(items):
        nonlocal held
        for item in items:
            more = _literals(item)
            if more is not None and len(held) * len(more) <= EXPANDED:
                held = [a + b for a in held for b in more]
            elif item[0] is node.SUBPATTERN:
                walk(item[1][3])
            else:
                close()
                if more is not None:
                    held = more
                elif item[0] in (node.MAX_REPEAT, node.MIN_REPEAT) and item[1][0] > 0:
                    walk(item[1][2])
                    close()

    walk(regexes.parse(pattern))
    close()
    return clauses


class TrigramIndex:
    """Postings of the trigrams that the rules use, over a slice of documents."""

    def __init__(self, queries: dict[str, list]):
        self.queries = queries
        wanted = {t for q in queries.values() for clause in q for group in clause for t in group}
        self.needed = np.zeros(1 << 24, bool)
        self.needed[[int.from_bytes(t, "big") for t in wanted]] = True

    def postings(self, batch: list[bytes]) -> dict[int, np.ndarray]:
        """Documents of each needed trigram, ascending; no trigram spans two documents."""
        found: dict[int, list[int]] = {}
        for i, data in enumerate(batch):
            raw = np.frombuffer(data, np.uint8)
            for at in range(0, max(0, len(raw) - 2), 1 << 20):
                part = raw[at : at + (1 << 20) + 2].astype(np.uint32)
                codes = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
                for code in np.unique(codes[self.needed[codes]]).tolist():
                    if (had := found.setdefault(code, []))[-1:] != [i]:
                        had.append(i)
        return {code: np.array(docs) for code, docs in found.items()}

    def candidates(self, batch: list[str]) -> dict[str, list[int]]:
        """For every rule the documents its query leaves."""
        index, none = self.postings([utf8(t, lower=True) for t in batch]), np.empty(0, np.int64)
        out = {}
        for name, clauses in self.queries.items():
            docs = np.arange(len(batch))
            for clause in clauses:
                met = [none]
                for group in clause:
                    both = None
                    for trigram in sorted(group):
                        own = index.get(int.from_bytes(trigram, "big"), none)
                        both = own if both is None else np.intersect1d(both, own, True)
                    met.append(both)
                docs = np.intersect1d(docs, np.concatenate(met))
            out[name] = docs.tolist()
        return out


def finder(rules: dict):
    """A function that gives the spans ``(start, order of the rule, end, kind)`` of each text, sorted."""
    compiled = [(k, i, re.compile(p, re.ASCII), test) for i, (k, (p, test)) in enumerate(rules.items())]
    index = TrigramIndex({k: trigram_query(p) for k, (p, _) in rules.items()})

    def find(batch: list[str]) -> list[list[tuple]]:
        spans = [[] for _ in batch]
        left = index.candidates(batch)
        for kind, i, rule, test in compiled:
            for d in left[kind]:
                spans[d] += [(m.start(), i, m.end(), kind) for m in rule.finditer(batch[d]) if test(m)]
        return [sorted(s) for s in spans]

    return find


def scan(docs: DataFrame, rules: dict | None = None) -> DataFrame:
    """Secrets in every whole text: ``(doc_id, kinds, starts, ends)``, spans in code points.

    Spans are leftmost and do not overlap within a kind, sorted by start, then by the order of the
    rules. A null text is empty; rows are kept one for one, also with null or repeated ``doc_id``;
    other columns are left out; an empty table gives an empty table.
    """
    chosen = BASE | ADDED if rules is None else rules

    def make():
        find = finder(chosen)

        def step(rows):
            found = find([t or "" for t in rows["text"]])
            return {
                "doc_id": rows["doc_id"], "kinds": [[x[3] for x in s] for s in found],
                "starts": [[x[0] for x in s] for s in found], "ends": [[x[2] for x in s] for s in found],
            }

        return step

    fields = {"doc_id": "long", "kinds": "array<string>", "starts": "array<int>", "ends": "array<int>"}
    return mapped(texts(docs), make, fields)


def digest(found: DataFrame, base: tuple[str, ...] = tuple(BASE)) -> DataFrame:
    """``(doc_id, n_<kind> ..., base_sha256, spans)`` of found spans, in their order."""

    def make():
        def step(rows):
            out = {"doc_id": rows["doc_id"]} | {f"n_{k}": [kinds.count(k) for kinds in rows["kinds"]] for k in base}
            named = [
                [(k, f"{k}:{a}:{b}") for k, a, b in zip(*spans)] for spans in zip(rows["kinds"], rows["starts"], rows["ends"])
            ]
            own = [",".join(s for k, s in spans if k in base) for spans in named]
            out["base_sha256"] = [hashlib.sha256(s.encode()).hexdigest() for s in own]
            return out | {"spans": [",".join(s for _, s in spans) for spans in named]}

        return step

    fields = {"doc_id": "long"} | {f"n_{k}": "long" for k in base} | {"base_sha256": "string", "spans": "string"}
    return mapped(found.select("doc_id", "kinds", "starts", "ends"), make, fields)


def mask(docs: DataFrame, rules: dict | None = None, sign: str = "*") -> DataFrame:
    """The documents with every character of a secret replaced by ``sign``; all columns and rows are kept.

    The column ``text`` is replaced in place, so rows are neither joined nor moved. A null text stays null.
    """
    chosen = BASE | ADDED if rules is None else rules

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = finder(chosen)
        for batch in batches:
            out = [None if t is None else str(t) for t in batch]
            for at in range(0, len(out), SLICE):
                for i, spans in enumerate(find([t or "" for t in out[at : at + SLICE]]), at):
                    if spans:
                        text = list(out[i])
                        for start, _, end, _ in spans:
                            text[start:end] = sign * (end - start)
                        out[i] = "".join(text)
            yield pd.Series(out, dtype=object)

    return docs.withColumn("text", masked(F.col("text")))


def op5_secret_scan(spark, sf_dir):
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
