"""Runs of words, fill-in-the-middle and language identification against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from censusloom.llm import common, languages, middles, periods, queries

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i * 7919 % 99991}" for i in range(4000))
EDGES = [
    (5, "one two three"), (5, "one two three"), (2, None), (3, ""), (None, "one two three"), (4, " \n\t "), (6, LONG), (9, "a\tb\n" * 20_000),
    (7, "x" * 3000), (8, "é ß 😀 ü" * 30), (10, "the " * 80), (11, "p <P> q <S> r <M> s"), (12, " lead and trail \r\n"), (-3, "1 2 3 !!"),
]
CLASHES = "doc_id long, text string, n long, form string, runs string, best int, held_out string, score string, lang_pred string, starts int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "a", "b", 2, "c", "d", "e", 3) for r in EDGES], CLASHES)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASHES)


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# --- runs of words ---------------------------------------------------------------------------


def plain_runs(words, least, times):
    """Every period is tried, smallest first; a stretch found with a smaller one has that as its period."""
    numbers = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    n, found = len(ids), {}
    for q in range(1, n // times + 1):
        edges = np.flatnonzero(np.diff(ids[q:] == ids[:-q], prepend=False, append=False))
        for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist()):
            if b - a + q >= max(least, times * q):
                found.setdefault((a, b - a + q), q)
    return sorted((a, length, q) for (a, length), q in found.items())


def plain_row(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = sorted(plain_runs(words, 24, 3), key=lambda r: (r[0], r[2]))
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join(f"{a},{length},{q}\n" for a, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(kept))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 40)), max_size=8), st.integers(1, 12), st.integers(2, 4), st.randoms(use_true_random=False))
def test_runs_of_random_words(blocks, least, times, rnd):
    """Stretches that repeat, with some words changed, over few words."""
    words = []
    for size, length in blocks:
        root = [b"%d" % rnd.randrange(3) for _ in range(size + 1)]
        words += [root[i % len(root)] for i in range(length)]
    for _ in range(rnd.randrange(3)):
        if words:
            words[rnd.randrange(len(words))] = b"9"
    codes = np.array([hash(w) & (2**63 - 1) for w in words], np.uint64)
    found = periods.runs_of(words, codes, least, times).tolist()
    assert [tuple(r) for r in found] == sorted(plain_runs(words, least, times), key=lambda r: (r[0], r[2]))


def test_extensions_of_random_sequences():
    rnd = random.Random(5)
    for n in (1, 2, 3, 40, 200):
        s = [rnd.randrange(1, 3) for _ in range(n)]
        tree = periods.Extensions(np.array(s))
        pairs = [(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]
        got = tree(*np.array(pairs).T).tolist()
        for (i, j), g in zip(pairs, got):
            assert s[i : i + g] == s[j : j + g] and (i + g == n or j + g == n or s[i + g] != s[j + g])
        assert tree.ranks.tolist() == [sorted(s[k:] for k in range(n + 1)).index(s[i:]) for i in range(n + 1)]
        turned = [-x for x in s]
        assert tree.ranks_reversed().tolist() == [sorted(turned[k:] for k in range(n + 1)).index(turned[i:]) for i in range(n + 1)]


def test_runs_query(spark):
    found = sorted(map(tuple, queries.QUERIES["op11_periodic_runs"](spark, SF).collect()))
    want = sorted(plain_row(*d) for d in documents(spark))
    assert found == want and sum(r[1] for r in want) > 10


def test_runs_of_odd_rows(spark, docs, none):
    found = sorted(map(tuple, periods.digest(periods.find_runs(docs, rewrite=periods.planted)).collect()), key=str)
    assert found == sorted((plain_row(i, t) for i, t in EDGES), key=str)
    assert periods.find_runs(none).count() == 0
    whole = {r.doc_id: r.collapsed for r in periods.find_runs(docs).collect()}
    assert whole[9] == "a b" and whole[10] == "the" and whole[2] == "" and whole[6] == LONG
    with pytest.raises(ValueError):
        periods.find_runs(docs, times=1)


# --- fill in the middle ------------------------------------------------------------------------


def plain_middle(doc_id, text, seed=42):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(tokens[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_middles(spark, docs, none):
    many = [(i, t) for i in range(40) for _, t in EDGES if t != LONG]
    table = spark.createDataFrame(many + EDGES, "doc_id long, text string")
    done = middles.restore(middles.transform(table))
    rows = done.collect()
    got = sorted((tuple(r)[:6] for r in rows), key=str)
    assert got == sorted((plain_middle(i, t) for i, t in many + EDGES), key=str)
    assert {r.form for r in rows} == {"plain", "spm", "psm"}
    assert sorted(r.restored for r in rows) == sorted(t or "" for _, t in many + EDGES)
    odd = middles.transform(docs).collect()
    assert sorted(map(tuple, odd), key=str) == sorted((plain_middle(i, t) for i, t in EDGES), key=str)
    assert middles.restore(middles.transform(none)).count() == 0
    blank = spark.createDataFrame([(1, None, "spm"), (2, "x", None)], "k int, output string, form string")
    assert [r.restored for r in middles.restore(blank).collect()] == [None, None]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aé<PSM> \n😀>", max_size=40), st.integers(0, 99), st.integers(0, 99), st.sampled_from(["psm", "spm"]))
def test_rotations_are_undone(text, a, b, form):
    if any(s in text for s in ("<P>", "<S>", "<M>")):
        return
    data = text.encode()
    cuts = [0, *middles.token_ends(data).tolist()]
    first, second = sorted((cuts[a % len(cuts)], cuts[b % len(cuts)]))
    assert middles.restored(middles.arranged(data, first, second, form), form) == data


def test_other_sentinels(spark):
    marks = middles.Sentinels(b"[pre]", b"[suffix]", b"[m]")
    table = spark.createDataFrame([(i, f"alpha <P> beta gamma {i}") for i in range(50)], "doc_id long, text string")
    done = middles.restore(middles.transform(table, seed=3, rate=100, spm_rate=50, marks=marks), marks).collect()
    assert {r.form for r in done} == {"psm", "spm"} and all(r.restored == f"alpha <P> beta gamma {r.doc_id}" for r in done)


# --- language ----------------------------------------------------------------------------------


def plain_bits(train, text):
    """Code length by dictionaries: longest context first, escapes by method C, exclusion of what longer ones hold."""
    tree = {}
    for t in train:
        padded = bytes(languages.ORDER) + t
        for i, x in enumerate(t):
            for k in range(languages.ORDER + 1):
                context = tree.setdefault(padded[i + languages.ORDER - k : i + languages.ORDER], {})
                context[x] = context.get(x, 0) + 1
    total, padded = 0.0, bytes(languages.ORDER) + text
    for i, x in enumerate(text):
        out = set()
        for k in range(languages.ORDER, -2, -1):
            if k < 0:
                total += np.log2(256 - len(out))
                break
            seen = tree.get(padded[i + languages.ORDER - k : i + languages.ORDER])
            if seen is None:
                continue
            left = {y: n for y, n in seen.items() if y not in out}
            room = sum(left.values()) + len(left)
            if x in left:
                total -= np.log2(left[x] / room)
                break
            if room:
                total -= np.log2(len(left) / room)
            out |= set(seen)
    return total


def test_code_lengths(spark):
    train = {"x": ["abracadabra", "abba cab", ""], "y": ["über öl für", "zzz", "bar\x00bar"]}
    rows = [(lang, t) for lang, texts in train.items() for t in texts] + [("x", None), (None, "lost")]
    trees = languages.fit(spark.createDataFrame(rows * 3, "lang string, text string"))
    assert sorted(trees) == ["x", "y"]
    texts = [t.encode() for t in ("", "abra", "cab über", "q", "zzzz zz", "\x00\x00", "Ω")]
    found = languages.code_lengths(texts, [trees["x"], trees["y"]])
    for row, lang in zip(found, "xy"):
        assert np.allclose(row, [plain_bits([t.encode() for t in train[lang]] * 3, t) for t in texts])


def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.QUERIES["op13_language_id"](spark, sf).withColumnRenamed("lang_pred", "told")
    rows = found.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r.told == r.lang for r in rows) >= 0.98 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_rows(spark, docs, none):
    train = spark.createDataFrame([("en", "the one two and three"), ("de", "über ß ü é")], "lang string, text string")
    told = languages.predict(docs, languages.fit(train))
    assert sorted(told.columns) == sorted(docs.columns) and told.schema["score"].dataType.typeName() == "double"
    rows = told.collect()
    assert len(rows) == len(EDGES)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {2, 3, 4, -3} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (8, 10)} == {8: "de", 10: "en"}
    assert all(r.lang_pred == "und" for r in languages.predict(docs, languages.fit(train.where("false"))).collect())
    assert languages.predict(none, languages.fit(train)).count() == 0
    with pytest.raises(ValueError):
        languages.fit(train, languages=1)


def test_pruned_tree_keeps_its_parents(spark):
    """A bounded tree drops rare strings; what is left still prices every text."""
    words = spark.createDataFrame([("x", "the then them " * 9 + f"rare{i}") for i in range(20)], "lang string, text string")
    whole, small = languages.fit(words)["x"], languages.fit(words, nodes=40)["x"]
    assert len(small.levels[-1].strings) <= 40 < len(whole.levels[-1].strings)
    assert np.isfinite(languages.code_lengths([b"the rarest \xff"], [small])).all()


# --- byte-level BPE, part by part ----------------------------------------------------------------


def _tiktoken():
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


POOLS = ["ab É", "ab'sdre ll", "a1 ,.\n", " \t\n\r a", "a²bⅧ1_", "'tT' re ve ", "日本 áb", "\x1c\x1d a　b' \xa0", "<|endoftext|> x", "́a ́"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(POOLS), st.lists(st.integers(0, 40), max_size=12)), max_size=5))
def test_units_have_the_ids_of_the_whole_text(parts):
    """Texts of letters, digits, apostrophes and all kinds of spaces, against the library on the whole text."""
    import public_tokenizers

    from censusloom.llm import bpe

    text = "".join(pool[i % len(pool)] for pool, picks in parts for i in picks)
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = bpe.json_tokenizer(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(bpe.encoder(path)([text])[0], "<u4").tolist() == want


def test_forgetting_changes_no_ids(monkeypatch):
    import public_tokenizers

    from censusloom.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [f"word{i} Wörter, {i * 7919} the\nend's " * 3 for i in range(400)]
    want = bpe.Encoder(bpe.json_tokenizer(path))(texts)
    monkeypatch.setattr(bpe, "REMEMBERED", 500)
    small = bpe.Encoder(bpe.json_tokenizer(path))
    assert [small([t])[0] for t in texts] == want and small.known.size < 2000


def test_round_trip_of_all_documents(spark):
    """The query against tiktoken on every text, and the decoded bytes against the texts."""
    coder = _tiktoken()
    found = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op10_byte_bpe"](spark, SF).collect()}
    for doc_id, text in documents(spark):
        ids = np.array(coder.encode_ordinary(text or ""), "<u4")
        sha = hashlib.sha256((text or "").encode()).hexdigest()
        assert found.pop(doc_id) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), sha)
    assert not found


def test_token_files_of_all_documents(spark):
    import tokenizers

    import public_tokenizers

    plain = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    found, at = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op9_token_files"](spark, SF).collect()}, 0
    for doc_id, text in sorted(documents(spark)):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert found.pop(doc_id) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert not found


# --- pages and passages: odd input -----------------------------------------------------------------


@pytest.mark.parametrize("html,text", [
    ("<![ x]><p>a</p>", "a"), ("<![CDATA[x]]><p>b", "b"), ("<![if IE]><p>c</p><![endif]>", "c"),
    ('<div class="content-with-sidebar"><p>main text</p></div>', "main text"),
    ('<div class="search-page"><p>whole page</p></div>', "whole page"),
    ('<div><h1 class="header-title">T</h1><p id="x">long enough text</p></div>', "T\nlong enough text"),
    ("<svg/><p>rest</p>", "rest"), ("<object/><p>rest</p>", "rest"), ("<template><p>t</template><p>u</p>", "u"),
    ('<div style="Display: none">x</div><p>shown</p>', "shown"), ("<!DOCTYPE html><!-><?php x ?><p>g", "g"),
    ('<div class="sidebar"><p>few</p></div><p>much more than that</p>', "much more than that"), (None, ""), ("", ""),
])
def test_odd_pages(html, text):
    from censusloom.llm import pages

    assert pages.main_text(html, set()) == text


MARKUP = ["<", ">", "!", "[", "]", "--", "/", "?", "p", "div", "svg", " class='ad'", "<!", "<![", "<!--", "</", "<p>", "</div>", "&amp;", "&#x;", "é", " ", "\n", "<script>", "<li>", "<td", "CDATA["]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(MARKUP), max_size=40))
def test_no_markup_ends_the_job(parts):
    from censusloom.llm import pages

    text = pages.main_text("".join(parts), set())
    assert text == "\n".join(line.strip() for line in text.split("\n") if line.strip()) and pages.subtrees("".join(parts))


def test_cutting_passages_with_clashing_names(spark):
    from censusloom.llm import repeats

    passage = " ".join(f"w{i}" for i in range(30))
    names = ["doc_id", "_id", "_version", "_begins", "_ends", "text", "_others", "id", "key"]
    rows = [(i, 10 + i, "v", 1, 2, text, "o", 5, 6) for i, text in enumerate([f"one {passage}", f"two {passage} end", None])]
    found = repeats.cut_repeats(spark.createDataFrame(rows, names))
    assert found.columns == names
    assert {r.doc_id: (r["_id"], r.text, r["_others"]) for r in found.collect()} == {
        0: (10, f"one {passage}", "o"), 1: (11, "two end", "o"), 2: (12, None, "o"),
    }


def test_words_that_come_again_are_not_forgotten(monkeypatch):
    """A word of every text is encoded once, however many others come between."""
    import public_tokenizers

    from censusloom.llm import bpe

    monkeypatch.setattr(bpe, "REMEMBERED", 2000)
    tokenizer = bpe.json_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    coder, asked = bpe.Encoder(tokenizer), []

    class Model:
        def tokenize(self, text):
            asked.append(text)
            return tokenizer.model.tokenize(text)

    coder.model = Model()
    letters = "abcdefghij"
    batches = [[f"x again {letters[i % 10]}q{letters[i // 10]}{letters[k]}z again, ends." for k in range(10)] for i in range(40)]
    plain = [[bytes(np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4")) for t in batch] for batch in batches]
    assert [coder(batch) for batch in batches] == plain
    assert asked.count("Ġagain") == 1 and len(asked) > 400


def test_new_words_go_to_the_model_together(monkeypatch):
    """Ids are those of the whole text, and a text of new words asks the model far less often than once a word."""
    import public_tokenizers

    from censusloom.llm import bpe

    tokenizer = bpe.json_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    coder, asked = bpe.Encoder(tokenizer), []

    class Model:
        def tokenize(self, text):
            asked.append(text)
            return tokenizer.model.tokenize(text)

    coder.model = Model()
    letters = "abcdefghij"
    words = [f"é{letters[i % 10]}o{letters[i // 10 % 10]}à{letters[i // 100]}" + (",", "", "$$", " x")[i % 4] for i in range(1000)]
    batch = [" ".join(words[i : i + 50]) + end for i, end in zip(range(0, 1000, 50), ("", "\n", "\nend of it", "  two", "    ", "\n\n") * 4)]
    batch += ["", None, " ", "\n", "a", " a", "\na", "a\n a"]
    plain = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in batch]
    assert coder(batch) == plain and coder(batch) == plain
    assert len(asked) < 500
    monkeypatch.setattr(bpe, "BYTES", 100)
    assert bpe.Encoder(tokenizer)(batch) == plain


def test_packing_remembers_less():
    import public_tokenizers

    from censusloom.llm import bpe, packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert bpe.encoder(path, less=packing.LESS).known.limit * packing.LESS == bpe.encoder(path).known.limit


def test_a_slice_of_many_words_is_encoded_without_a_table_of_words(monkeypatch):
    """Every different run of letters goes to the model once, whatever marks are behind it, and none is remembered."""
    import public_tokenizers

    from censusloom.llm import bpe

    tokenizer = bpe.json_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    coder, asked = bpe.Encoder(tokenizer), []

    class Model:
        def tokenize(self, text):
            asked.append(text)
            return tokenizer.model.tokenize(text)

    coder.model = Model()
    letters = "abcdefghij"
    words = ["z" + "".join(letters[i // 10**k % 10] for k in range(4)) for i in range(5000)]
    batch = ["x " + " ".join(word + mark for word in words[at : at + 100]) for mark in ("", ",", "!!") for at in range(0, 5000, 100)]
    plain = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in batch]
    assert coder(batch) == plain
    assert "".join(asked).count("Ġz") == len(words) and len(asked) < 200
    assert not coder.known and not coder.known.older


@pytest.mark.parametrize("size", [60, 1 << 20])
def test_slices_of_many_parts_have_the_ids_of_whole_texts(monkeypatch, size):
    import public_tokenizers

    from censusloom.llm import bpe

    monkeypatch.setattr(bpe, "MANY", 0)
    monkeypatch.setattr(bpe, "BYTES", size)
    draw = random.Random(6)
    stuff = ["word", "Line", ".", ",", "'s", "'", "!!", "$$", "12", "_", "\r\n", "\t", "\x1c", "\u0085", "Â", " ", "　"]
    stuff += ["ª", "漢字", "\U0001f600", "\U00010d4a", "́", "\x00", *[" ", "\n", "é"] * 4]
    batch = [None, "", " ", "\n", "a", " a", "\na", "a\n a", *("".join(draw.choices(stuff, k=draw.randrange(20))) for _ in range(2000))]
    paths = public_tokenizers.path
    for tokenizer in (bpe.json_tokenizer(paths("byte_bpe_50k.json")), bpe.rank_tokenizer(paths("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)):
        plain = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in batch]
        assert bpe.Encoder(tokenizer)(batch) == plain


def test_slices_by_bytes(spark):
    from censusloom.llm.common import byte_cuts, mapped

    assert list(byte_cuts(pa.array(["ab", None, "c", "dddddd", "", "e"]), 3)) == [(0, 3), (3, 4), (4, 6)]
    assert list(byte_cuts(pa.array([], pa.string()), 3)) == []
    docs = spark.createDataFrame([(i, "x" * i) for i in range(10)], "doc_id long, text string").coalesce(1)
    count = lambda: lambda rows: {"doc_id": rows["doc_id"], "n": [len(rows["text"])] * len(rows["text"])}
    found = {r.doc_id: r.n for r in mapped(docs, count, {"doc_id": "long", "n": "long"}, by=("text", 9)).collect()}
    assert found == {0: 4, 1: 4, 2: 4, 3: 4, 4: 2, 5: 2, 6: 1, 7: 1, 8: 1, 9: 1}


def test_packing_encodes_many_rows_at_a_time(spark, monkeypatch):
    """Slices go by the bytes of their texts, as many short texts together have fewer different words than a few at a time."""
    import public_tokenizers

    from censusloom.llm import bpe, packing

    asked = []
    monkeypatch.setattr(packing, "mapped", lambda df, make, fields, **by: asked.append(by) or common.mapped(df, make, fields, **by))
    docs = spark.createDataFrame([(i, f"word{i} is one") for i in range(600)], "doc_id long, text string")
    found = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(found) == 600 and asked == [{"by": ("text", bpe.BYTES // packing.LESS)}]
