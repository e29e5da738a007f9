"""Byte-level BPE encoding with the tokenizers library, and decoding.

Texts are cut before every space, and every line break, that a visible character follows. The pattern of
byte-level BPE always starts a new piece there, and one behind such a line break, so the ids of a text are the
ids of its parts, one after another; ids of parts that come again are looked up. A part seen for the first time is cut further, where letters end and
where they begin after something other than a space or an apostrophe; the pattern starts a new piece there
too. A run of letters is a single piece, so it goes to the library's BPE model itself; runs with a space or a line
break before them go there many at a time, as no token of the model reaches from one into the next.

A slice of texts with many different parts looks nothing up: its parts stay Arrow arrays, those that are letters and marks are
told apart there, and every different run of letters goes to the model once a slice. That takes less time than a table of words
that grows with the texts, and less memory; the larger the slice, the fewer the runs.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
import re
import string
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

from censusloom.llm.common import byte_cuts, mapped, texts

CUT = re.compile(r" (?=\S)")
LETTERS = re.compile(r"[^\W\d_]+|[\W\d_]+")
#: Characters that may be one piece with letters behind them: the apostrophe, and what only here counts as white space.
UNCLEAR = "'\x1c\x1d\x1e\x1f"
#: Marks that are pieces of their own right behind letters, at the end of a part.
MARKS = frozenset(",.;:!?")
#: What may follow letters up to the end of a part, and is cut off there; other marks only take longer.
TAIL = string.punctuation + string.digits
#: Bytes of text and ids remembered by a worker, of parts and of units, and the longest part that is; memory only, never results.
REMEMBERED, REMEMBERED_UNITS, LONGEST = 12 << 20, 6 << 20, 40
#: Runs of letters that go to the model together, at most; fewer than ``FEW`` go alone.
TOGETHER, FEW = 64, 16
#: Bytes of text, from one text on, whose different parts are encoded together, and the number of parts from which none is looked up.
BYTES, MANY = 1 << 24, 1 << 12
#: Little-endian unsigned 32-bit integers, by how many.
PACKED = [struct.Struct(f"<{n}I") for n in range(16)]


@functools.lru_cache(maxsize=4)
def json_tokenizer(path: str) -> Tokenizer:
    """A tokenizer of the tokenizers library from its file; special strings in a text are ordinary text."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: visible Latin-1 bytes for themselves, the rest from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(hidden)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _parents(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes ``token``: what is left when only lower ranks are merged."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [(ranks.get(parts[i] + parts[i + 1], ranks[token]), i) for i in range(len(parts) - 1)]
        rank, i = min(found)
        if rank >= ranks[token]:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    if len(parts) != 2:
        raise ValueError(f"token {token!r} can't be made by merging two tokens of lower rank")
    return parts[0], parts[1]


@functools.lru_cache(maxsize=4)
def rank_tokenizer(path: str, pattern: str) -> Tokenizer:
    """A tokenizer of the tokenizers library from a file of ranks and the pattern that cuts texts."""
    ranks, shown = read_ranks(path), byte_characters()
    text = lambda token: "".join(shown[b] for b in token)
    merges = [tuple(map(text, _parents(t, ranks))) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    tokenizer = Tokenizer(models.BPE({text(t): r for t, r in ranks.items()}, merges))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    tokenizer.decoder = decoders.ByteLevel()
    return tokenizer


class Remembered(dict):
    """Ids by text. When they take half of ``limit`` bytes they become the older ones, and what was older is forgotten.

    A text found among the older ones is taken over, so one that comes again and again is never forgotten.
    """

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.limit, self.size = limit, 0

    def __missing__(self, text: str) -> bytes | None:
        ids = self.older.get(text)
        if ids is not None:
            self.add(text, ids)
        return ids

    def add(self, text: str, ids: bytes) -> None:
        self[text] = ids
        self.size += len(text) + len(ids)

    def take(self, found: dict[str, bytes]) -> None:
        found = {text: ids for text, ids in found.items() if len(text) <= LONGEST}
        self.update(found)
        self.size += sum(map(len, found)) + sum(map(len, found.values()))

    def trim(self) -> None:
        if self.size > self.limit // 2:
            self.older, self.size = dict(self), 0
            self.clear()


def _piecewise(tokenizer: Tokenizer) -> bool:
    """Whether a run of letters, with a space before it or not, is one piece for this tokenizer."""
    if tokenizer.normalizer is not None or tokenizer.pre_tokenizer is None:
        return False
    pieces = ["a", " bc", ".", " \u00e9", "12", "e", "'", "\n", "F", "_", "g", ".", "\n", "h", "\t", "\n", "3", "\n", "!"]
    return [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str("".join(pieces))] == [_shown(p) for p in pieces]


def _crossing(model: models.Model) -> tuple[str, ...] | None:
    """What must not stand where a run ends and the space or line break before the next begins; None if the model needs every run alone.

    Merges only make tokens of the vocabulary. So runs can't affect each other where no token holds the end of one and the next space,
    or a line break and anything else.
    """
    if not isinstance(model, models.BPE) or model.dropout or model.ignore_merges or model.unk_token is not None:
        return None
    if model.continuing_subword_prefix or model.end_of_word_suffix or model.byte_fallback:
        return None
    tokens = Tokenizer(model).get_vocab()
    if not tokens.keys() >= set(byte_characters()):
        return None
    spaces = {before + "\u0120" for token in tokens for before in token.split("\u0120")[:-1] if before}
    return tuple(spaces | {token for token in tokens if "\u010a" in token and token.strip("\u010a")})


_SHOWN: dict[int, str] = {}


def _shown(text: str) -> str:
    """The text as the characters that stand for its bytes."""
    if not _SHOWN:
        _SHOWN.update(enumerate(byte_characters()))
    return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(_SHOWN)


def _lists(ids: list[bytes]) -> pa.ListArray:
    """Little-endian 32-bit integers as one list for each."""
    ends = np.cumsum([0, *map(len, ids)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def _ends(texts: pa.StringArray, sizes: np.ndarray) -> pa.StringArray:
    """The last bytes of texts, by how many."""
    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    stops = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset + 1 : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[np.repeat(stops - ends[1:], sizes) + np.arange(ends[-1])]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


class Encoder:
    """Ids of texts as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer: Tokenizer, less: int = 1):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.known, self.units = Remembered(REMEMBERED // less), Remembered(REMEMBERED_UNITS // less)
        self.piecewise = _piecewise(tokenizer)
        self.crossing = _crossing(self.model) if self.piecewise else None
        #: Whether a token begins with a space or a line break, by id.
        self.spaced = np.zeros(max(tokenizer.get_vocab().values(), default=-1) + 1, bool)
        self.spaced[[i for token, i in tokenizer.get_vocab().items() if token.startswith(("\u0120", "\u010a"))]] = True

    def _letters(self, word: str, space: str) -> bytes:
        """Ids of a run of letters, with a space before it or not."""
        table = self.known if space else self.units
        ids = table[word]
        if ids is None:
            found = [token.id for token in self.model.tokenize(space + word if word.isascii() else space + _shown(word))]
            ids = PACKED[len(found)].pack(*found) if len(found) < len(PACKED) else struct.pack(f"<{len(found)}I", *found)
            if len(word) <= LONGEST:
                table.add(word, ids)
        return ids

    def _unit(self, text: str) -> bytes:
        """Ids of any other stretch between two places where pieces begin."""
        ids = self.units[text]
        if ids is None:
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
            if len(text) <= LONGEST:
                self.units.add(text, ids)
        return ids

    def _part(self, text: str) -> bytes:
        """Ids of a part, unit by unit."""
        if not self.piecewise:
            return self._unit(text)
        out, held = [], ""
        for run in LETTERS.findall(text):
            if not run.isalpha():
                held += run
                continue
            last = held[-1:]
            if last and last in UNCLEAR:
                held += run  # may be one piece with what is before it
                continue
            if last.isspace():
                # the last of several spaces is a piece of its own, or goes with the letters if it is U+0020
                held = held[:-1]
                if held:
                    out.append(self._unit(held))
                if last != " ":
                    out.append(self._unit(last))
            elif held:
                out.append(self._unit(held))
            out.append(self._letters(run, "\u0120" if last == " " else ""))
            held = ""
        if held:
            out.append(self._unit(held))
        return b"".join(out)

    def _new(self, part: str) -> bytes:
        """Ids of a part that is not known: of one that begins with a line break, or else of the part with a space before it."""
        if not self.piecewise:
            found = self._part(" " + part)
        else:
            space, word = ("", part[1:]) if part[0] == "\n" else ("\u0120", part)
            if word.isalpha():
                found = self._letters(word, space)
                if space:
                    return found
            elif word[-1] in MARKS and word[:-1].isalpha():
                found = self._letters(word[:-1], space) + self._unit(word[-1])
            else:
                found = self._part(" " + word if space else word)
            if not space:
                found = self._unit("\n") + found
        if len(part) <= LONGEST:
            self.known.add(part, found)
        return found

    def _together(self, words: list[str]) -> Iterator[bytes]:
        """Ids of runs of letters, each with a space before it."""
        for at in range(0, len(words), TOGETHER):
            own = words[at : at + TOGETHER]
            shown = [_shown(" " + " ".join(own))]
            if len(words) < FEW or any(end in shown[0] for end in self.crossing):
                shown = [_shown(" " + word) for word in own]
            ids = np.array([token.id for text in shown for token in self.model.tokenize(text)], "<u4")
            data, edges = ids.tobytes(), (4 * np.flatnonzero(self.spaced[ids])).tolist()
            yield from (data[a:b] for a, b in zip(edges, [*edges[1:], len(data)]))

    def _unknown(self, parts: Iterable[str]) -> dict[str, bytes]:
        """Ids of parts that are not among the newer ones known; runs of letters that begin them go to the model together."""
        if self.crossing is None:
            return {part: self.known[part] or self._new(part) for part in parts}
        known, older, found, new, marked = self.known, self.known.older, {}, {}, []
        for part in parts:
            ids = older.get(part)
            if ids is not None:
                found[part] = ids
            elif part.isalpha():
                new[part] = None
            elif (word := part.rstrip(TAIL)).isalpha():
                marked.append((part, word))
                if word not in known and word not in older:
                    new[word] = None
            else:
                found[part] = self._new(part)
        if new:
            found.update(zip(new, self._together(list(new))))
        for part, word in marked:
            found[part] = (found.get(word) or known[word]) + self._unit(part[len(word) :])
        known.take(found)
        return found

    def _text(self, text: str) -> bytes:
        """Ids of a whole text, cut at spaces only."""
        head, *rest = CUT.split(text)  # white space in a row is cut before its last space
        ids = [self.known[part] or self._new(part) for part in rest]
        return (self._part(head) if head else b"") + b"".join(ids)

    @staticmethod
    def _blank(part: str) -> bool:
        """Whether a part comes from white space in a row, which is cut before its last space only."""
        first = part[1:2] if part[:1] == "\n" else part[:1]
        return not first or first.isspace()

    def _looked_up(self, parts: pa.StringArray, used: np.ndarray) -> tuple[pa.ListArray, np.ndarray]:
        """Ids of the parts that are used, and which of them are blank."""
        names = parts.to_pylist()
        ids = list(map(self.known.get, names))
        missing = [at for at, (found, here) in enumerate(zip(ids, used.tolist())) if found is None and here]
        blank = [at for at in missing if self._blank(names[at])]
        unknown = {names[at]: at for at in (missing if not blank else sorted(set(missing).difference(blank)))}
        for part, own in self._unknown(unknown).items():
            if part in unknown:
                ids[unknown[part]] = own
        return _lists([own or b"" for own in ids]), np.array(blank, np.int64)

    def _runs(self, runs: pa.StringArray) -> pa.ListArray:
        """Ids of runs of letters, each with a space or a line break before it."""
        cuts = np.append(np.arange(0, len(runs), TOGETHER), len(runs)).astype(np.int32)
        found = [np.zeros(0, np.int32)]
        for at, text in enumerate(pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), runs), "").to_pylist()):
            shown = _shown(text)
            if any(end in shown for end in self.crossing):
                own = [run[1:] if run[0] == " " else run for run in runs.slice(at * TOGETHER, TOGETHER).to_pylist()]
                found.append(np.frombuffer(b"".join([self.known[run] or self._new(run) for run in own]), "<i4"))
            else:
                found.append(np.array([token.id for token in self.model.tokenize(shown)], np.int32))
        ids = np.concatenate(found)
        edges = np.append(np.flatnonzero(self.spaced[ids]), len(ids)).astype(np.int32)  # a run has one space or line break
        return pa.ListArray.from_arrays(pa.array(edges), pa.array(ids))

    def _many(self, parts: pa.StringArray, used: np.ndarray) -> tuple[pa.ListArray, np.ndarray]:
        """The same for many parts: letters with marks behind them or not are cut up as arrays, and each run of letters is encoded once."""
        body = pc.utf8_ltrim(parts, "\n")
        word = pc.utf8_rtrim(body, TAIL)
        plain = pc.utf8_is_alpha(word).to_numpy(zero_copy_only=False) & used
        # letters newer than the library's are not letters to it
        wide = np.flatnonzero(plain & ~pc.string_is_ascii(word).to_numpy(zero_copy_only=False))
        plain[wide] = [own.isalpha() for own in word.take(pa.array(wide)).to_pylist()]
        before = pc.if_else(pc.starts_with(parts, "\n"), "\n", " ")
        runs = pc.binary_join_element_wise(before, word, "").filter(pa.array(plain)).dictionary_encode()
        tails = _ends(body, pc.binary_length(body).to_numpy() - pc.binary_length(word).to_numpy()).filter(pa.array(plain)).dictionary_encode()
        other = np.flatnonzero(used & ~plain)
        names = parts.take(pa.array(other)).to_pylist()
        blank = [self._blank(name) for name in names]
        rest = [self._unit(tail) if tail else b"" for tail in tails.dictionary.to_pylist()]
        rest += [b"" if no else self.known[name] or self._new(name) for name, no in zip(names, blank)]
        # a part is a run and a tail, or something else and nothing
        units = pa.concat_arrays([_lists([b""]), self._runs(runs.dictionary), _lists(rest)])
        two = np.zeros((len(parts), 2), np.int32)
        two[plain, 0] = 1 + runs.indices.to_numpy()
        two[plain, 1] = 1 + len(runs.dictionary) + tails.indices.to_numpy()
        two[other, 0] = 1 + len(runs.dictionary) + len(tails.dictionary) + np.arange(len(other))
        found = units.take(pa.array(two.ravel()))
        return pa.ListArray.from_arrays(found.offsets[::2], found.values), other[np.array(blank, bool)]

    def _texts(self, batch: pa.StringArray) -> list[bytes]:
        """Ids of texts; each different part is encoded once, and ids are put in their places as arrays."""
        cuts = pc.split_pattern(pc.replace_substring(batch, "\n", " \n"), " ")  # a line break is a piece of its own
        edges = cuts.offsets.to_numpy().astype(np.int64) - cuts.offsets[0].as_py()
        coded, heads = cuts.flatten().dictionary_encode(), pc.list_element(cuts, 0).to_pylist()
        del cuts
        parts, which = coded.dictionary, coded.indices.to_numpy().copy()
        which[edges[:-1]] = len(parts) + np.arange(len(heads))  # no space is before them
        used = np.zeros(len(parts) + len(heads), bool)
        used[which] = True  # some parts only are heads
        ids, blank = (self._looked_up if len(parts) < MANY or self.crossing is None else self._many)(parts, used[: len(parts)])
        found = pa.concat_arrays([ids, _lists([self._part(head) if head else b"" for head in heads])]).take(pa.array(which))
        ends, data = found.offsets.to_numpy()[edges].tolist(), found.values.to_numpy()
        out = [data[a:b].tobytes() for a, b in zip(ends, ends[1:])]
        if len(blank):  # white space in a row, which is not cut like this
            used[:] = False
            used[blank] = True
            for i in np.unique(np.searchsorted(edges, np.flatnonzero(used[which]), "right") - 1).tolist():
                out[i] = self._text(batch[i].as_py())
        return out

    def __call__(self, batch: list[str | None] | pa.StringArray) -> list[bytes]:
        collecting = gc.isenabled()
        gc.disable()  # nothing made here refers back to itself; looking through the tables costs a fifth of the time
        texts, out = pc.fill_null(pa.array(batch, pa.string()) if isinstance(batch, list) else batch, ""), []
        if not self.piecewise:
            out = [self._text(text) for text in texts.to_pylist()]
        for at, end in byte_cuts(texts, BYTES) if self.piecewise else ():
            out += self._texts(texts.slice(at, end - at))
            self.known.trim()
            self.units.trim()
        pa.default_memory_pool().release_unused()  # else the worker keeps it while other work goes on there
        if collecting:
            gc.enable()
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str | None = None, less: int = 1) -> Encoder:
    """The encoder of a worker process: tasks that follow each other there find what was remembered.

    It remembers a part, one by ``less``, of the usual bytes; what is remembered stays in the worker when other work follows.
    """
    return Encoder(rank_tokenizer(path, pattern) if pattern else json_tokenizer(path), less)


def encode(
    docs: DataFrame, path: str, pattern: str | None = None, offsets: bool = False, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Ids of every whole text: ``(doc_id, ids array<int>)``, with ``starts`` and ``ends`` if ``offsets``.

    ``path`` is a file of the tokenizers library, or a file of ranks if a ``pattern`` is given. ``starts``
    and ``ends`` are the places, in code points, of the characters a token is of; tokens that share the
    bytes of one character get the same place. A null text is empty; rows are kept one for one, with
    repeated and null keys and without other columns; an empty table gives an empty table.
    """

    def make():
        tokenizer = rank_tokenizer(path, pattern) if pattern else json_tokenizer(path)
        coder = encoder(path, pattern)

        def step(rows):
            if not offsets:
                return {key: rows[key], "ids": [np.frombuffer(b, "<u4").astype(np.int32) for b in coder(rows[text])]}
            found = tokenizer.encode_batch([t or "" for t in rows[text]], add_special_tokens=False)
            return {
                key: rows[key], "ids": [e.ids for e in found], "starts": [[a for a, _ in e.offsets] for e in found],
                "ends": [[b for _, b in e.offsets] for e in found],
            }

        return step

    fields = {key: "long", "ids": "array<int>"} | ({"starts": "array<int>", "ends": "array<int>"} if offsets else {})
    return mapped(texts(docs, key, text), make, fields, by=None if offsets else (text, BYTES))


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Bytes of every list of ids by a file of ranks: ``(doc_id, data binary, text string)``.

    Ids are turned into bytes one by one, so a list may begin or end inside a character; ``text`` has
    U+FFFD in place of such a part. Null ids are empty; an unknown id is an error.
    """

    def make():
        ranks = read_ranks(path)
        pieces = {rank: token for token, rank in ranks.items()}

        def step(rows):
            data = [b"".join(map(pieces.__getitem__, ids or ())) for ids in rows["ids"]]
            return {key: rows[key], "data": data, "text": [d.decode("utf-8", "replace") for d in data]}

        return step

    return mapped(encoded.select(key, "ids"), make, {key: "long", "data": "binary", "text": "string"})


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of ids and of the decoded bytes: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``."""

    def make():
        coder = encoder(path, pattern)
        pieces = {rank: token for token, rank in read_ranks(path).items()}

        def step(rows):
            ids = coder(rows["text"])
            back = [b"".join(map(pieces.__getitem__, np.frombuffer(i, "<u4").tolist())) for i in ids]
            return {
                "doc_id": rows["doc_id"], "n_tokens": [len(i) // 4 for i in ids],
                "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(b).hexdigest() for b in back],
            }

        return step

    fields = {"doc_id": "long", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return mapped(texts(docs), make, fields, by=("text", BYTES))


def op10_byte_bpe(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
