"""Words of whole texts as numpy arrays, without a Python loop over the words.

A word is a run of characters other than space and U+0009 to U+000D. In UTF-8 these are single
bytes that occur in no other character, so texts are cut as bytes. Every word gets a 64-bit hash
from prefix sums of a polynomial over its bytes; sequences of words are hashed from the hashes of
their words. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the polynomial over bytes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Odd multipliers of the mixing steps.
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE_VALUE = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least ``n`` of them."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 16, 1 << n.bit_length())
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX[0]
    x ^= x >> np.uint64(33)
    x *= MIX[1]
    x ^= x >> np.uint64(33)
    return x


def utf8(text: str | None, lower: bool = False) -> bytes:
    """Bytes of a text; lone surrogates, which UTF-8 lacks, are kept as they are."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.translate(LOWER) if lower else data


def bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word."""
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edges[0::2], edges[1::2]


def hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[np.frombuffer(data, np.uint8)] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def sequences(words: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """64-bit hash of each run of ``length`` consecutive words, at the place of its first word."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, length + 2 * salt, np.uint64)
    factor = BASE * (2 * salt + 1) % (1 << 64)
    for i in range(length):
        total = (total + words[i : i + n]) * np.uint64(factor)
    return mixed(total)


def whole(words: np.ndarray) -> int:
    """Hash of a whole sequence of words."""
    if not len(words):
        return 0
    up, _ = _power_table(len(words))
    total = (mixed(words) * up[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))
    return int(mixed(np.array([total]))[0])


def stretches(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the words ``first .. end - 1`` for each pair of places."""
    up, down = _power_table(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mixed(words) * up[: len(words)], out=sums[1:])
    return mixed((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))


def inside(many: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... for each count, one after another."""
    total = np.cumsum(many)
    return np.arange(total[-1] if len(many) else 0) - np.repeat(total - many, many)
