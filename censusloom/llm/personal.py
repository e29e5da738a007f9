"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, schemes and cues of account
numbers. From each anchor a local parser expands to the boundaries of an address or number and
checks it. A parser starts behind what its kind has already consumed, so the spans of a kind are the
leftmost ones that do not overlap.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from censusloom.llm.common import mapped, texts
from censusloom.llm.secrets import digest

#: Characters and shapes of the kinds. Fixed values.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
DIGITS = re.compile(r"[0-9]+")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
CALL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"[^\s/@:]{1,64}:[^\s/@]{1,64}@[A-Za-z0-9.-]+")
ACCOUNT = re.compile(r"[:\s#]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", re.ASCII)
SOCIAL = re.compile(r"[:\s#]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])", re.ASCII)
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "ssn")
ANCHORS = {"@": "email", "+": "phone", "://": "login", "IBAN": "iban", "SSN": "ssn"} | {d: "digit" for d in "0123456789"}


def luhn(digits: str) -> bool:
    """Check sum of card numbers."""
    values = [int(d) for d in reversed(digits)]
    return (sum(values[0::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def mod97(account: str) -> bool:
    """Check digits of international account numbers."""
    plain = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for anchor, kind in ANCHORS.items():
        made.add_word(anchor, kind)
    made.make_automaton()
    return made


def expand(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All valid spans of a text, by kind, then start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys(KINDS, 0)
    for at, anchor in anchors.iter(text):
        if anchor == "digit":
            if at >= free["ip"]:
                if match := NUMBERS.match(text, at):
                    free["ip"] = match.end()
                    if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match.groups()):
                        found["ip"].append(match.span())
                else:
                    free["ip"] = DIGITS.match(text, at).end()
            if at >= free["card"] and (match := CHAIN.match(text, at)):
                free["card"] = match.end()
                digits = match[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(match.span())
        elif anchor == "email":
            start = at
            while start > free["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (match := DOMAIN.match(text, at + 1)):
                found["email"].append((start, match.end()))
                free["email"] = match.end()
        elif anchor == "phone":
            if match := CALL.match(text, at):
                if 9 <= sum(c.isdigit() for c in match[0]) <= 15:
                    found["phone"].append(match.span())
        elif anchor == "login":
            start = at - 2
            while start > free["login"] and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            if start < at - 2 and (match := LOGIN.match(text, at + 1)):
                found["login"].append((start, match.end()))
                free["login"] = match.end()
        elif match := (ACCOUNT if anchor == "iban" else SOCIAL).match(text, at + 1):
            if anchor == "ssn" or mod97(match[1]):
                found[anchor].append(match.span(1))
    return [(kind, a, b) for kind in KINDS for a, b in found[kind]]


def scan(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text: ``(doc_id, kinds, starts, ends)``, spans in code points.

    Spans are sorted by kind, then start. A null text is empty; rows are kept one for one, also with
    null or repeated ``doc_id``; other columns are left out; an empty table gives an empty table.
    """

    def make():
        anchors = automaton()

        def step(rows):
            found = [expand(t or "", anchors) for t in rows["text"]]
            return {
                "doc_id": rows["doc_id"], "kinds": [[x[0] for x in s] for s in found],
                "starts": [[x[1] for x in s] for s in found], "ends": [[x[2] for x in s] for s in found],
            }

        return step

    fields = {"doc_id": "long", "kinds": "array<string>", "starts": "array<int>", "ends": "array<int>"}
    return mapped(texts(docs), make, fields)


def op6_personal_data(spark, sf_dir):
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")), BASE)
