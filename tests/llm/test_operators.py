import random
import hashlib
import math
import sys

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from censusloom.llm import bpe, common, minhash, packing, pages, personal, quality, queries, repeats, secrets, tokenfiles, vectors
from censusloom.llm.common import components, cut
from tests.compare import compare, duck
from tests.llm import plain

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i * 7919 % 99991}" for i in range(4000))
EDGES = [
    (5, "one two three"), (5, "one two three"), (2, None), (3, ""), (None, "one two three"), (4, " \n\t "), (6, LONG), (9, LONG + " end"),
    (7, "x" * 3000), (8, 'é ß password = "hunter22", a@b.c@d.example +1 (017) 555-7713 10.0.0.255.9 4111 1111 1111 1111'),
    (10, "the " * 80), (11, "token: 0123456789abcdef01234567  double\n\n double"), (12, "😀 <|endoftext|>\r\n 3  4"),
]
CLASHES = "doc_id long, text string, id long, n_words string, key string, first int, component_id string, node string, label string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "a", "b", 2, "c", "d", "e") for r in EDGES], CLASHES)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASHES)


def by_text(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, duck(SF), queries.QUERIES[name], queries.SQL[name], SF)[0] == "ok"


def test_text_rules(spark, docs, none):
    want = [(i, *plain.quality(t)) for i, t in EDGES]
    measured = quality.measure(docs)
    assert by_text(measured.select("doc_id", *quality.BASE)) == sorted(want, key=str)
    judged = quality.judge(measured, None).collect()
    assert all(r.kept != r.base_failed for r in judged) and {r.doc_id for r in judged if r.kept} == {6, 9}
    labels = spark.createDataFrame([(6, 1), (9, 1), (6, None), (None, 0)], "doc_id long, quality int")
    assert sorted(r.doc_id for r in quality.keep_good(docs, labels).collect()) == [6, 9]
    assert quality.fit(measured, labels.where("false")) is None
    assert quality.keep_good(none, labels).count() == 0 and quality.measure(none).count() == 0


def test_forests_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    measured = quality.measure(docs)
    rules = quality.fit(measured, labels.where("doc_id % 2 = 0"))
    held = quality.judge(measured, rules).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    good, bad = ([r for r in held if r.quality == q] for q in (1, 0))
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_secrets(docs, none):
    digest = {}
    for i, text in EDGES:
        spans = ",".join(f"{k}:{a}:{b}" for a, _, b, k in plain.secrets(text or ""))
        digest.setdefault(i, hashlib.sha256(spans.encode()).hexdigest())
    found = secrets.digest(secrets.scan(docs)).collect()
    assert len(found) == len(EDGES) and all(r.base_sha256 == digest[r.doc_id] for r in found)
    masked = secrets.mask(docs)
    assert masked.columns == docs.columns
    text = {r.doc_id: r.text for r in masked.collect()}
    assert text[2] is None and text[6] == LONG and "hunter22" not in text[8] and len(text[8]) == len(EDGES[9][1])
    assert secrets.scan(none).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query(r"[0-9a-f]{24,}") == []
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == [[frozenset({b"aki", b"kia"})]]
    assert secrets.trigram_query(r"(?:ab|abcd)x?") == []
    query = secrets.trigram_query(secrets.BASE["assign"][0])
    assert len(query) == 1 and frozenset({b"tok", b"oke", b"ken"}) in query[0]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab@.-+1 23()%:/é4", max_size=60))
def test_personal_data_like_the_patterns(text):
    found = [s for s in personal.expand(text, personal.automaton()) if s[0] in personal.BASE]
    assert found == plain.personal(text)


def test_personal_data(docs, none):
    want = {i: plain.personal(t or "") for i, t in EDGES}
    for r in personal.scan(docs).collect():
        assert [s for s in zip(r.kinds, r.starts, r.ends) if s[0] in personal.BASE] == want[r.doc_id]
    assert personal.scan(none).count() == 0
    found = personal.expand("IBAN DE89 3704 0044 0532 0130 00, http://u:pw@h.example SSN 123-45-6789", personal.automaton())
    assert [k for k, *_ in found] == ["email", "login", "iban", "ssn"]


PAGE = (
    "<html><body><nav><ul><li>Menu<li>Two</ul></nav><div class='cookie-notice'>Ok?</div>{promo}<article><h1>T &amp; {n}</h1>"
    "<p>First <b>bold</b><br> part{n}<p>Always the same.<div class=share>Share</div><script>var a='</p>';</script>"
    "<ul><li>x{n}</ul><div id='comments'><p>Nice</p></div></article><footer>Foot</footer></body></html>"
)


def test_pages(spark):
    promo = "<section><p>Buy now</p></section>"
    rows = [(i, f"http://h.example/{i}", PAGE.format(n=i, promo=promo), "x") for i in range(8)]
    rows += [(None, None, None, "x"), (20, "http://h.example/", "", "x"), (21, "nonsense", "plain <i>text</i> &lt;p&gt;", "x"), rows[0]]
    inner = "<p>Own text {n}</p>" + promo
    rows += [(30 + i, f"http://g.example/{i}", inner.format(n=i), "x") for i in range(8)]
    rows += [(50 + i, f"http://copy.example/{i}", "<div><p>Copied page</p></div>", "x") for i in range(8)]
    found = {r.page_id: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert found[3].text == "T & 3\nFirst bold part3\nAlways the same.\nx3" and found[3].n_chars == len(found[3].text)
    assert found[None].text == "" and found[20].text == "" and found[21].text == "plain text <p>"
    assert found[33].text == "Own text 3"  # the section stands in every article of the site
    assert found[53].text == "Copied page"  # copies of one page are no template
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tokens(spark, docs, none, tmp_path):
    coder, path = plain.encoding(), public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = {i: coder.encode_ordinary(t or "") for i, t in EDGES}
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN, offsets=True)
    for r in encoded.collect():
        assert r.ids == ids[r.doc_id] and len(r.starts) == len(r.ends) == len(r.ids)
    assert {r.doc_id: r.ids for r in bpe.encode(docs, path, public_tokenizers.PATTERN).collect()} == ids
    assert {r.doc_id: r.text for r in bpe.decode(encoded, path).collect()} == {i: t or "" for i, t in EDGES}
    split = spark.createDataFrame([(1, coder.encode_ordinary("😀")[:1]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(split, path).collect()} == {1: "�", 2: ""}
    tokenfiles.write_tokens(docs, f"{tmp_path}/t", public_tokenizers.path("byte_bpe_50k.json"))
    at = 0
    for r in tokenfiles.digests(spark, f"{tmp_path}/t").orderBy("start").collect():
        own = ids[r.doc_id] + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), plain.crc(own))
        at += len(own)
    assert tokenfiles.read_tokens(spark, f"{tmp_path}/t", ids=False).agg({"n_tokens": "sum"}).first()[0] == at
    tokenfiles.write_tokens(none, f"{tmp_path}/e", public_tokenizers.path("byte_bpe_50k.json"))
    assert tokenfiles.digests(spark, f"{tmp_path}/e").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=6))
def test_best_fill_is_best(room, counts):
    sums = {0}
    for n, c in counts.items():
        sums = {s + k * n for s in sums for k in range(c + 1)}
    chosen = packing.best_fill(room, counts)
    assert all(times <= counts[n] for n, times in chosen.items())
    assert sum(n * k for n, k in chosen.items()) == max(s for s in sums if s <= room)


def test_packing(docs, none):
    path, coder = public_tokenizers.path("byte_bpe_50k.json"), plain.encoding()
    found = packing.pack(docs, path, with_ids=True).collect()
    filled, own = {}, {}
    for r in found:
        assert len(r.ids) == r.length and plain.crc(r.ids) == r.ids_crc32
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
        own.setdefault(r.doc_id, []).append((r.start, r.ids))
    for spans in filled.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0 and sum(spans[-1]) <= 2048
    assert sorted(filled) == list(range(len(filled)))
    for i, text in EDGES:
        if i != 5:
            assert sum((ids for _, ids in sorted(own[i])), []) == coder.encode_ordinary(text or "") + [1]
    assert sum(len(x) for x in own.values()) == len(found) and packing.pack(none, path).count() == 0


def test_near_duplicates(docs, none):
    found = sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str)
    component = plain.alike([e for e in EDGES if e[0] is not None], 3, 85)
    assert len(found) == len(EDGES)
    for i, n, c, kept in found:
        assert (c, kept) == ((None, True) if i is None else (component[i], component[i] == i))
    assert sorted(str(r.doc_id) for r in minhash.keep_one(docs).collect()) == sorted(str(i) for i, _ in EDGES if i != 9)
    assert minhash.near_duplicates(none).count() == 0


def test_signatures_estimate_similarity():
    like = minhash.Likeness()
    signer = minhash.Signer(like)
    a, b = np.arange(2000, dtype=np.uint64), np.arange(200, 2200, dtype=np.uint64)
    signs = [signer.low_bits(signer.minima(minhash.mixed(x))) for x in (a, b)]
    assert abs(minhash.estimates(signs[0], signs[1][None], like.minima)[0] - 1800 / 2200) < 0.15


def test_components_stop_at_stars_and_write_few_files(spark, monkeypatch):
    sizes = []

    def counted(df, label):
        out = cut(df, label)
        sizes.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(common, "cut", counted)
    star = spark.createDataFrame([(0, n) for n in range(1, 200)], "a long, b long")
    assert {r.component for r in components(star).collect()} == {0}
    assert len(sizes) == 1  # written once, without a round that changes nothing
    path = spark.createDataFrame([(n, n + 1) for n in range(0, 400)], "a long, b long").repartition(40)
    assert {r.component for r in components(path).collect()} == {0}
    assert max(sizes[2:]) <= 8


@pytest.mark.parametrize("sent", [True, False])
def test_components_of_random_links(spark, monkeypatch, sent):
    if not sent:
        monkeypatch.setattr(common, "broadcast_if", lambda df, size: df)
    draw = random.Random(3)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(7, 7), (299, 0), (299, 0)]
    nodes = sorted({n for a, b in links if a != b for n in (a, b)})
    edges = spark.createDataFrame(links, "a long, b long").repartition(9)
    assert {r.node: r.component for r in components(edges).collect()} == plain.components(nodes, [x for x in links if x[0] != x[1]])


def test_words_behind_line_breaks_are_remembered():
    tokenizer = bpe.json_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    coder = bpe.Encoder(tokenizer)
    draw = random.Random(4)
    stuff = ["word", "Line", ".", ",", "'s", " ", "\n", "\r\n", "\t", "\x1c", "\u0085", "1", "\u00e9", "\u3000", "\U0001f600", "_"]
    batch = ["some words.\nLine two,\nLine three", *("".join(draw.choices(stuff, k=draw.randrange(16))) for _ in range(3000))]
    assert coder(batch) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in batch]
    assert {"\nLine", "two,"} <= coder.known.keys()


def test_memory_of_remembered_words_is_bounded():
    coder = bpe.Encoder(bpe.json_tokenizer(public_tokenizers.path("byte_bpe_50k.json")))
    letters = "abcdefghijklmnopqrst"
    names = ["".join(letters[n // 20**i % 20] for i in range(5)) for n in range(600_000)]
    for at in range(0, len(names), 10_000):
        coder([" " + " ".join(names[at : at + 10_000])])
    tables = (coder.known, coder.known.older, coder.units, coder.units.older)
    assert sum(sys.getsizeof(t) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in t.items()) for t in tables) < 100 << 20


def test_components_of_long_paths(spark):
    path = spark.range(60).selectExpr("id + 1 as a", "id as b").unionByName(spark.sql("select 100L a, 101L b"))
    found = {r.node: r.component for r in components(path).collect()}
    assert all(found[i] == 0 for i in range(61)) and found[101] == found[100] == 100


def test_repeats(docs, none):
    once = [e for k, e in enumerate(EDGES) if k != 1 and e[0] is not None]
    want = plain.kept_words(sorted(once, key=lambda e: e[0]))
    found = repeats.without_repeats(docs).collect()
    assert len(found) == len(EDGES)
    for r in found:
        if r.doc_id is not None:
            own, keep = want[r.doc_id]
            assert (r.n_words, r.n_removed) == (len(own), keep.count(False))
            assert r.kept_text == " ".join(w for w, k in zip(own, keep) if k)
    shorter = repeats.cut_repeats(docs)
    assert shorter.columns == docs.columns
    text = {r.doc_id: r.text for r in shorter.collect()}
    assert text[2] is None and text[11] == EDGES[11][1] and text[9] == "end" and text[6].split()[0] == "w0"
    assert repeats.without_repeats(none).count() == 0


def test_passages_around_a_common_run(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD", 50)
    monkeypatch.setattr(repeats, "STREAM", 100)
    rng, dealt, plain_dealt = random.Random(4), [], repeats._sharded

    def counted(*args):
        out = plain_dealt(*args).cache()
        sizes = [r["count"] for r in out.groupBy("shard", "stream").count().collect()]
        dealt.append((sum(sizes), max(sizes)))
        return out

    def run_hash(run):
        data = run.encode()
        return int(repeats.sequences(repeats.hashes(data, *repeats.bounds(data)), 6)[0])

    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    # the least of many hashes, so that it is the least in each window that has it
    common = min((" ".join(fresh(6)) for _ in range(3000)), key=run_hash).split()
    monkeypatch.setattr(repeats, "_sharded", counted)
    for contexts in (150, 600):
        inner = [[*fresh(10), *common, *fresh(10)] for _ in range(contexts)]
        docs = [(i, " ".join([*fresh(8), *inner[i % contexts], *fresh(8)])) for i in range(2 * contexts)]
        docs += [(5000 + i, " ".join([*fresh(9), *common, *inner[0][:10], *fresh(9)])) for i in range(5)]
        want = plain.kept_words(docs)
        found = repeats.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert {r.doc_id: r.kept_text for r in found} == {i: " ".join(w for w, k in zip(*want[i]) if k) for i in want}
        assert sum(r.n_removed for r in found) >= 26 * contexts
    (rows, _), (many, largest) = dealt
    assert many < 6 * rows and largest < 8 * 100


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    rows = [(i, base[i % 40] + rng.normal(size=16) * (0.02 if i >= 40 else 0), i % 2) for i in range(120)]
    rows = [(i, v.tolist(), k) for i, v, k in rows]
    odd = [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [1.0, None], 1), (204, [1.0] * 16, None), (205, [], 0)]
    odd += [(None, rows[0][1], 0), (206, rows[0][1], 0), (207, rows[0][1], 0), (208, [1.0, 2.0], 0), (209, [2.0, 4.0], 0), (210, [1e300, 2e300], 0)]
    found = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(
        [(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<double>, label int, data string, node int")).collect()}
    usable = rows + [r for r in odd if r[0] in (206, 207, 208, 209, 210)]
    links = [
        (a, b) for a, u, k in usable for b, v, m in usable
        if a != b and k == m and len(u) == len(v) and math.fsum(x / max(map(abs, u)) * y / max(map(abs, v)) for x, y in zip(u, v))
        >= 0.93 * math.sqrt(math.fsum((x / max(map(abs, u))) ** 2 for x in u) * math.fsum((y / max(map(abs, v))) ** 2 for y in v))
    ]
    root = plain.components([r[0] for r in rows + odd if r[0] is not None], links)
    for i, r in found.items():
        assert r.n_links == sum(a == i for a, _ in links) and r.component_id == root.get(i) and r.kept == (i is None or root[i] == i)
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_equal_ids_are_linked_on_their_own(spark):
    one, two = ([f"{side}{i}" for i in range(60)] for side in "ab")
    rows = [(1, " ".join(one)), (5, " ".join(one + ["end"])), (5, " ".join(two)), (7, " ".join(two + ["end"])), (7, "alone here now")]
    found = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(1, 1, True), (5, 1, False), (5, 5, True), (7, 5, False), (7, 7, True)]
    rows = [(1, [1.0, 0.0]), (5, [1.0, 0.1]), (5, [0.0, 1.0]), (7, [0.1, 1.0])]
    rows = [(i, v, 1) for i, v in rows]
    found = sorted(tuple(r) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert found == [(1, 1, 1, True), (5, 1, 1, False), (5, 1, 5, True), (7, 1, 5, False)]


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(3)
    first = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    made = []
    for i in range(120):
        words = list(first)
        for _ in range(i % 9):
            words[rng.randrange(120)] = f"x{rng.randrange(10_000)}"
        made.append((i, " ".join(words)))
    docs = spark.createDataFrame(made, "doc_id long, text string")
    root = plain.alike(made, 3, 85)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: root[i] for i, _ in made} and len(set(got.values())) > 1
