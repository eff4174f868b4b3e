"""Each operator against a brute-force version or SQL, and its defined edge cases, on small tables."""

import gc
import hashlib
import html
import pickle
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from compare import connect, difference
from promptscore import new_work_dir
from promptscore.llm import (
    byte_bpe,
    components,
    contamination,
    line_frequency,
    main_text,
    prefixes,
    pu_quality,
    queries,
    repeats,
    simhash,
    token_records,
    transcripts,
    unit_dedup,
)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string"
LONG = " ".join(f"w{i % 97}x{i}" for i in range(60_000))
LINE = "one line of more than twenty words that is the same in all of these texts so that it has to go away again at last"
EDGE = [
    (1, None, "en", "s", None, None),
    (2, "", "en", None, 0, "x"),
    (3, " \n\t ", None, "s", 4, "x"),
    (4, f"{LINE}\nown words here", "en", "s", 1, "x"),
    (5, f"{LINE.upper()}\nother words there\n{LINE}", "en", "s", 1, "x"),
    (5, f"{LINE.upper()}\nother words there\n{LINE}", "en", "s", 1, "x"),
    (5, "the same id with another text", "en", "s", 1, "x"),
    (None, f"no id\n{LINE}", "en", "s", 1, "x"),
    (None, None, None, None, None, None),
    (7, LONG, "en", "s", len(LONG), "x"),
    (8, "é日本 \U0001f600 x" * 30, "fr", "t", 1, "x"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


@pytest.mark.parametrize("name", sorted(queries.all_oracles()))
def test_query_equals_sql(spark, folder, name):
    assert difference(queries.all_queries()[name](spark, folder), connect(folder), queries.all_oracles()[name]) is None


# ---- 1 ----------------------------------------------------------------------------------------


def test_quality_rules_edge_cases(edge, empty):
    rows = line_frequency.quality_rules(edge).collect()
    assert len(rows) == len(EDGE) and line_frequency.quality_rules(empty).count() == 0
    by_id = {r.doc_id: r for r in rows if r.doc_id in (1, 2, 3, 7)}
    assert all(by_id[i].n_words == 0 and by_id[i].base_failed and not by_id[i].kept for i in (1, 2, 3))
    assert by_id[7].kept and by_id[7].n_repeat_words == 0


def test_common_lines_deplete_and_copies_do_not(spark):
    shared = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"{shared}\nown{i} end{i}", "h") for i in range(10)] + [(100 + i, " ".join(f"c{k}" for k in range(50)), "h") for i in range(30)]
    got = line_frequency.quality_rules(spark.createDataFrame(rows, "doc_id int, text string, source string"), share_of=4).collect()
    assert {r.doc_id for r in got if not r.kept} == set(range(10))


def test_repeat_words_by_hand(spark):
    text = " ".join([f"w{i}" for i in range(8)] * 3 + [f"z{i}" for i in range(9)])
    row = line_frequency.base_rules(spark.createDataFrame([(text,)], "text string")).first()
    assert (row.n_words, row.n_repeat_words) == (33, 24)


# ---- 2 ----------------------------------------------------------------------------------------


def groups_by_hand(prints, near):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if near(prints[i], prints[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates_against_all_pairs(spark, edge, block):
    rng = random.Random(1)
    base = [" ".join(rng.choices(["aa", "bb", "cc", "dd", "ee", "ff"], k=200)) for _ in range(3)]
    rows = [(i, base[i % 3][: 500 + rng.randint(0, 6)]) for i in range(40)] + [(r[0], r[1]) for r in EDGE]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = simhash.near_duplicates(spark, docs, new_work_dir(spark, "t"), block=block).collect()
    prints = [simhash.fingerprint(t)[0] for _, t in rows]
    groups = groups_by_hand(prints, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    least = {}
    for (i, _), g in zip(rows, groups):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = Counter((i, p, least.get(g)) for (i, _), p, g in zip(rows, prints, groups))
    assert Counter((r.doc_id, r.fp, r.component) for r in got) == want


def test_fingerprint_of_few_words_is_one_shingle():
    import xxhash

    want = xxhash.xxh64_intdigest(b"two words", 42)
    assert simhash.fingerprint("Two\n WORDS")[0] & (2**64 - 1) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == [0]


def test_keep_one_keeps_the_least_id_of_similar_texts(spark, empty):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    close = words[:]
    for at in (50, 150, 250, 350):
        close[at] = "new"
    other = [rng.choice(words) for _ in range(400)]
    rows = [(9, " ".join(words)), (4, " ".join(close)), (7, " ".join(other)), (7, " ".join(other)), (None, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = simhash.keep_one(spark, docs, new_work_dir(spark, "t")).collect()
    assert sorted(r.doc_id for r in got) == [4, 7]
    assert simhash.keep_one(spark, empty, new_work_dir(spark, "t")).count() == 0


@pytest.mark.parametrize("slot", [1 << 20, 600])
def test_keep_one_against_all_pairs(spark, monkeypatch, slot):
    rng, texts = random.Random(6), []
    for base in range(30):
        words = [f"b{base}w{i}" for i in range(rng.choice([8, 9, 60, 200, 400]))]
        texts.append(words)
        for share in (0.02, 0.04, 0.06, 0.08, 0.1):  # similarities from above 0.8 to below 0.5
            for _ in range(3):
                close = words[:]
                for at in rng.sample(range(len(words)), int(len(words) * share / 2) or rng.randint(0, 1)):
                    close[at] = f"n{rng.random()}"
                texts.append(close)
    texts += [["p"] * 5 + ["q", "r", "s", "t"], ["p"] * 500 + ["q", "r", "s", "t"], [], [], ["one"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set() for t in texts]
    alike = lambda a, b: a == b or len(a & b) * 100 >= 80 * len(a | b)
    pairs = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a & b]
    assert sum(0.6 <= p < 0.8 for p in pairs) > 100 and sum(0.8 <= p < 1 for p in pairs) > 100
    links = simhash.exact_links
    monkeypatch.setattr(simhash, "exact_links", lambda *given: links(*given, slot))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = simhash.keep_one(spark, docs, new_work_dir(spark, "t")).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(groups_by_hand(sets, alike)))


def test_keep_one_finds_a_pair_without_a_common_file(spark):
    minima, base = simhash.Minima(40, 5), [f"w{i}" for i in range(1672, 1680)]
    texts = [" ".join([*base, *more]) for more in ([], ["x24576"], ["x52687"])]
    sets = [simhash.shingle_set(t, 5) for t in texts]
    assert [len(s) for s in sets] == [4, 5, 5] and set(sets[0]) < set(sets[1])  # 4 of 5 in common
    first, second, third = minima.of(sets)
    assert not (first == second).any() and not (first == third).any()
    rows = [(3, texts[0]), (5, texts[1]), (4, "other words " * 3), (6, "w1672 w1673 w1674 w1675 w1676 w1677")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = simhash.keep_one(spark, docs, new_work_dir(spark, "t")).collect()
    assert sorted(r.doc_id for r in got) == [3, 4, 6]
    far = spark.createDataFrame([(9, texts[0]), (8, texts[1]), (7, texts[1])], "doc_id bigint, text string").repartition(3)
    assert [r.doc_id for r in simhash.keep_one(spark, far, new_work_dir(spark, "t")).collect()] == [7]


def by_prefixes(spark, sets, percent, block=4096, hot=()):
    """Pairs that ``prefixes.pairs`` finds between sets of hashes that are each a part of their own."""
    classes = np.zeros(prefixes.CELLS, np.uint8)
    classes[np.array(hot, np.int64) % prefixes.CELLS] = 9
    rows = [
        (i, i, len(s), bytearray(prefixes.bitmap(s)), prefixes.prefix(s, classes, percent).view(np.int64).tolist())
        for i, s in enumerate(sets)
    ]
    put = spark.createDataFrame(rows, "set long, part long, n long, bits binary, prefix array<long>").repartition(4)
    found = prefixes.pairs(spark, put.select("set", "prefix"), put.drop("prefix"), new_work_dir(spark, "t"), percent, block)
    return {tuple(r) for r in found.collect()}


@pytest.mark.parametrize("block", [4096, 7])
@pytest.mark.parametrize("percent", [60, 80])
def test_prefixes_leave_out_no_pair(spark, percent, block):
    rng = np.random.default_rng(8)
    stock = rng.integers(0, 1 << 64, 30, np.uint64)
    sets = [np.zeros(0, np.uint64)]
    for size in [1, 2, 4, 5, 9, 10, 40, 41, 300] * 3:
        own = np.unique(np.concatenate([rng.integers(0, 1 << 64, size, np.uint64), stock[: size // 3]]))
        for gone, new in [(0, 0), (1, 0), (0, 1), (1, 1), (len(own) // 9, len(own) // 9), (len(own) // 5, 0), (len(own) // 3, 3)]:
            sets.append(np.unique(np.append(rng.permutation(own)[gone:], rng.integers(0, 1 << 64, new, np.uint64))))
    sets = [np.frombuffer(b, np.uint64) for b in {s.tobytes() for s in sets}]
    alike = {
        (j, i) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])
        if (n := len(np.intersect1d(a, b))) and n * 100 >= (len(a) + len(b) - n) * percent
    }
    got = by_prefixes(spark, sets, percent, block, stock.view(np.int64))
    assert len(alike) > 100 and alike <= got and len(got) < len(sets) * 20
    n = np.arange(1, 300)
    least = prefixes._least(n[:, None], n, percent)
    assert (least[np.minimum(n[:, None], n) * 100 >= np.maximum(n[:, None], n) * percent] > 0).all()


def test_frequency_classes_count_every_row(spark):
    docs = spark.createDataFrame([("a a b",)] * 7 + [("b c",), (None,), ("",)], "text string").repartition(3)
    own = lambda t: np.unique(np.array([ord(w) for w in (t or "").split()], np.uint64))
    classes = prefixes.frequency_classes(docs, "text", own)
    assert {int(c): int(classes[c]) for c in np.flatnonzero(classes)} == {97: 24, 98: 25, 99: 8}
    assert not prefixes.frequency_classes(docs.where("false"), "text", own).any()


def test_texts_are_shuffled_packed(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, None), (4, ""), (None, "é 日 x"), (None, "é 日 x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = simhash.keep_one(spark, docs, new_work_dir(spark, "t"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("MapInArrow pack")  # below the shuffles, so before them
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, "a b c d e f"), (3, None), (None, "é 日 x")]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (201, 200)], "a long, b long")
    got = {r.node: r.root for r in components.components(spark, links, new_work_dir(spark, "t")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {201: 200}


def test_columns_with_an_operators_own_names(spark):
    rows = [(1, LINE, "a", 1, 2, 3), (2, LINE, "b", 4, 5, 6), (3, "other text here", "c", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, gone string, row_hi int, _doc int, c0 int")
    cut = unit_dedup.dedup_units(docs)
    assert cut.columns == [*docs.columns, "removed_spans"]
    assert sorted(tuple(r)[:-1] for r in cut.collect()) == [rows[0], (2, "", *rows[1][2:]), rows[2]]
    assert sorted(tuple(r) for r in simhash.keep_one(spark, docs, new_work_dir(spark, "t")).collect()) == [rows[0], rows[2]]
    named = docs.select("doc_id", "text", F.lit("x").alias("words"), F.lit("h").alias("source"), F.lit(1).alias("n_words"))
    assert line_frequency.quality_rules(named).count() == 3
    assert repeats.without_repeats(spark, docs, new_work_dir(spark, "t")).count() == 3


# ---- 3 ----------------------------------------------------------------------------------------


def repeats_by_hand(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        starts = [(i, i) for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1]
        kept = bytearray(len(t))
        for i, _ in starts:
            kept[i : i + length] = b"\1" * length
        out.append(bytes(c for c, gone in zip(t, kept) if not gone))
    return out


@pytest.mark.parametrize("block", [512, 1])
def test_repeats_against_all_windows(spark, block):
    rng = random.Random(3)
    base = "".join(rng.choices("abcdef ", k=400))
    texts = ["".join(rng.choices("ab", k=rng.randint(0, 80))) for _ in range(12)] + ["a" * 70, "é日" * 30, None, ""]
    texts += [base[:k] + "X" + base[k:] for k in (100, 200, 300)] + [base[50:250], base[50:250]]
    rows = [(i // 2 if i % 5 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = repeats.without_repeats(spark, docs, new_work_dir(spark, "t"), length=20, gram=6, block=block).collect()
    raw = [(t or "").encode() for t in texts]
    want = Counter((i, len(b), k) for (i, _), b, k in zip(rows, raw, repeats_by_hand(raw, 20)))
    assert Counter((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got) == want


def test_pieces_of_long_texts_meet(monkeypatch):
    rng = random.Random(5)
    texts = [bytes(rng.choices(b"ab", k=300)), b"ab" * 200, bytes(rng.choices(b"abcd", k=100))]
    for piece in (40, 1 << 20):
        windows = Counter()
        for data, valid, _, _ in repeats._buffers(texts, 20, piece):
            runs = repeats.Runs(data, valid, 20, 6)
            assert (runs.last - runs.first < 15).all()
            for a, b in zip(runs.first, runs.last):
                windows.update(bytes(data[i : i + 20]) for i in range(a, b + 1))
        assert windows == Counter(t[i : i + 20] for t in texts for i in range(len(t) - 19))


def test_repeats_of_nothing(spark, empty, edge):
    assert repeats.without_repeats(spark, empty, new_work_dir(spark, "t")).count() == 0
    rows = repeats.without_repeats(spark, edge, new_work_dir(spark, "t")).collect()
    assert len(rows) == len(EDGE) and all(r.n_bytes == len(r.kept) + sum(s.end - s.start for s in r.removed) for r in rows)


# ---- 4 ----------------------------------------------------------------------------------------


def test_unit_dedup_edge_cases(spark, edge, empty):
    rows = unit_dedup.dedup_units(edge).collect()
    assert unit_dedup.dedup_units(empty).count() == 0
    first = [r for r in rows if r.doc_id is None and r.text]
    assert first[0].text == f"no id\n{LINE}"  # null ids rank first
    cut = [r for r in rows if r.doc_id == 5 and "other words" in r.text]
    assert [r.text for r in cut] == ["other words there"] * 2
    original = EDGE[4][1]
    assert [original[s.start : s.end] for s in cut[0].removed_spans] == [LINE.upper(), LINE]
    assert rows[0].__fields__ == [*DOCS.replace(" bigint", "").replace(" string", "").split(", "), "removed_spans"]


def test_cut_paragraphs():
    text = "a\nb\n \t\nc\n\nd"
    assert unit_dedup.cut_units(text, [1], "paragraph") == ("a\nb\n \t\nd", [{"start": 7, "end": 8}])
    assert unit_dedup.cut_units(text, [2], "paragraph")[0] == "a\nb\n \t\nc"
    assert unit_dedup.cut_units("x", [0]) == ("", [{"start": 0, "end": 1}])


# ---- 5 ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def word_tokens():
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_records_hold_what_the_tokenizer_gives(spark, folder, word_tokens):
    got = {r.doc_id: r for r in queries.op5_token_records(spark, folder).collect()}
    start = 0
    for doc_id, text in sorted(texts_of(spark, folder).items()):
        ids = [*word_tokens(text), 1]
        assert tuple(got[doc_id]) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_encoder_equals_the_tokenizer_on_odd_texts(word_tokens):
    rng, encoder = random.Random(2), token_records.StretchEncoder(P.path("word_bpe_49k.json"))
    letters = "!aAbÉé́.,'s\t\n\x0b\x85\xa0　LİΣς<|endoftext|>#1²日ß क़"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 16))) for _ in range(3000)]
    for k in range(0, 3000, 500):
        assert [e.tolist() for e in encoder.encode(texts[k : k + 500])] == [word_tokens(t) for t in texts[k : k + 500]]


def test_encoder_equals_the_tokenizer_on_added_tokens():
    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng, encoder = random.Random(7), token_records.StretchEncoder(P.path("word_bpe_49k.json"))
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "<", "x", "It's", ". ", " ", "\n", "!", "é", "Ab"]
    texts = ["hello <|endoftext|> world <|startoftext|>x", "<|endoftext|>", None, "", "<|endoftext|><|endoftext|>"]
    texts += ["".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(2000)]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[0] == [3306, 49407, 1002, 49406, 343]
    for _ in range(2):  # with an empty and a full memory
        assert [e.tolist() for e in encoder.encode(texts)] == want


def test_many_small_files_and_shuffled_reads(spark, edge, empty, word_tokens):
    encoder = spark.sparkContext.broadcast(token_records.StretchEncoder(P.path("word_bpe_49k.json")))
    root = new_work_dir(spark, "t")
    manifest = token_records.write_records(spark, edge, encoder, root, file_bytes=100)
    rows = sorted(token_records.read_records(spark, root, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r[0] for r in EDGE), key=lambda i: (i is not None, i))
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    files = [r.path for r in spark.read.format("binaryFile").load(f"{root}/records/*.rec").select("path").collect()]
    assert len(files) == manifest.count() > 3
    found = [x for f in files for x in token_records.read_shuffled(f.replace("file:/", "file:///", 1), f.replace("file:/", "file:///", 1)[:-4] + ".idx", 7)]
    assert sorted((i is not None, i, tuple(t.tolist())) for i, t in found) == sorted(
        (r[0] is not None, r[0], tuple([*word_tokens(r[1]), 1])) for r in EDGE)
    none = token_records.write_records(spark, empty, encoder, new_work_dir(spark, "t"))
    assert none.count() == 0


def test_damaged_frames_are_found():
    data = token_records.frame(b"first") + token_records.frame(b"second")
    assert list(token_records.read_frames(data)) == [b"first", b"second"]
    for at in (0, 9, 13, len(data) - 1):
        with pytest.raises(ValueError):
            list(token_records.read_frames(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]))
    with pytest.raises(ValueError):
        list(token_records.read_frames(data[:-3]))


# ---- 6 ----------------------------------------------------------------------------------------


def test_main_text_of_the_test_pages(spark, folder):
    got = {r.page_id: r.text for r in queries.op6_main_text(spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        article = re.sub(r"</?b>", "", re.search("<article>(.*)</article>", r.html, re.S)[1])
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>a<b>b</b>c<p>d<br>e", "abc d e"),
        ("<nav>menu</nav><div class='side-bar sidebar'>x</div><p>text</p><footer>f</footer>", "text"),
        ("<article><header><h1>t</h1></header>x <form>f</form><div id=comments>c</div></article><p>out", "t x"),
        ("<script>'<p>no</p>'</script><p>yes<!-- <p>no -->", "yes"),
        ("<p>open <i>never closed <div>next", "open never closed next"),
        ("<a href='x>y'>link</a> &lt;tag&gt; &#233;", "link <tag> é"),
        ("</div></p>stray<", "stray<"),
        ("<main>a<aside>b</aside></main><div>c</div>", "a"),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_main_text_of_odd_pages(page, want):
    assert main_text.Page(page).main_text(set()) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div class='layout has-sidebar'><article>the text</article><div class=sidebar>side</div></div>", "the text"),
        ("<article class='post comments-enabled'>the text<div class=comments>c</div></article>", "the text"),
        ("<article>t<div class='body with-share'>the whole text</div><div class=share>s</div></article>", "t the whole text"),
        ("<body><form action=x><div class=menu>m</div><p>the text of the page</p></form>", "the text of the page"),
        ("<form><main>the text</main></form><form>find</form>", "the text"),
        ("<html><head><title>t</title><meta charset=x><body><p>the text</p>", "the text"),
        ("<head><title>t</title><p>the text</p>", "the text"),
        ("<head><style>s</style>the text", "the text"),
        ("<head><title>t</title></head><body><p>the text<form>f</form>", "the text"),
        ("<p>the text</p><nav><article>menu</article></nav><div class=sidebar>s</div>", "the text"),
    ],
)
def test_main_text_within_wrappers(page, want):
    assert main_text.Page(page).main_text(set()) == want


def test_templates_go_and_articles_stay(spark):
    pages = [(i, "http://h.example/x", f"<div class=top>same on all pages</div><p>own {i}</p>") for i in range(8)]
    pages += [(20 + i, "http://h.example/y", "<article>the same article</article><div>same on all pages</div>") for i in range(4)]
    pages += [(30, "no host", "<div class=top>same on all pages</div>"), (31, None, None)]
    got = main_text.extract(spark, spark.createDataFrame(pages, "page_id int, url string, html string"), new_work_dir(spark, "t"))
    text = {r.page_id: r.text for r in got.collect()}
    assert text == {i: f"own {i}" for i in range(8)} | {20 + i: "the same article" for i in range(4)} | {
        30: "same on all pages", 31: ""}


# ---- 7 ----------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    scores = queries.op7_pu_quality(spark, folder)
    rows = scores.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9


def test_held_out_labels_are_never_read(spark, edge, empty):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a a a a").otherwise("a b c d").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    turned = labels.select("doc_id", F.when(pu_quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"))
    run = lambda t: sorted(pu_quality.quality_scores(spark, docs, t, new_work_dir(spark, "t")).collect())
    assert run(labels) == run(turned)
    assert [r.held_out for r in run(labels)] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(60)]
    none = labels.where("false")
    rows = pu_quality.quality_scores(spark, edge, none, new_work_dir(spark, "t")).collect()
    assert len(rows) == len(EDGE) and {r.score for r in rows} == {0.5}
    assert pu_quality.quality_scores(spark, empty, none, new_work_dir(spark, "t")).count() == 0


# ---- 8 ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def bpe():
    ranks = byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_bpe.ByteBPE(ranks, P.PATTERN), other


def test_perfect_hash_is_minimal_and_finds_only_its_keys(bpe):
    own = bpe[0]
    assert sorted(own.whole.values) == sorted(own.ranks.values()) and len(own.whole.keys) == len(own.ranks)
    assert all(own.whole.get(k) == v for k, v in list(own.ranks.items())[::97])
    assert own.whole.get(b"not a token at all") is None


def test_bpe_equals_the_library_on_odd_texts(bpe):
    own, other = bpe
    rng = random.Random(1)
    letters = "ab'sSt \t\n\r\x0b\x1c\x1f\x85\xa0   　​ éé1٣²Ⅷ.,!#日\U0001f600᠎﻿×'rell"
    for _ in range(4000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 14)))
        ids = own.encode(text).tolist()
        assert ids == other.encode_ordinary(text) and own.decode(ids) == text.encode()
    long = "a" * 20_000 + " " * 500 + "bc" * 5_000
    assert own.encode(long).tolist() == other.encode_ordinary(long)


def test_bpe_query(spark, folder, bpe, edge, empty):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op8_byte_bpe(spark, folder).collect()}
    for doc_id, text in texts_of(spark, folder).items():
        ids = bpe[1].encode_ordinary(text)
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id] == (len(ids), sha, hashlib.sha256(text.encode()).hexdigest())
    coder = byte_bpe.coder(spark, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    both = byte_bpe.decode_documents(byte_bpe.encode_documents(edge, coder), coder).collect()
    assert Counter(bytes(r.decoded) for r in both) == Counter((r[1] or "").encode() for r in EDGE)
    assert byte_bpe.round_trips(empty, coder).count() == 0 == byte_bpe.tokenised(empty, coder).count()


def test_tokenised_holds_the_ids_of_a_portion_at_a_time(spark, bpe, monkeypatch):
    own, other = bpe
    texts = ["alpha beta " * 50_000, None, "gamma, delta " * 50_000, "", "zzq " * 200_000, "end"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, work, schema: work)
    work = byte_bpe.tokenised(docs, SimpleNamespace(value=own))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = list(work(iter([batch])))
    assert len(got) >= 2 and max(b.num_rows for b in got) < len(texts)
    rows = [r for b in got for r in b.to_pylist()]
    assert [(r["doc_id"], r["text"]) for r in rows] == list(enumerate(texts)) and all(r["decodes"] for r in rows)
    ids = [other.encode_ordinary(t or "") for t in texts]
    assert [(r["token_ids"], r["n_tokens"]) for r in rows] == [(x, len(x)) for x in ids]


def test_bpe_remembers_bytes_and_decodes_many_texts_at_once(bpe, monkeypatch):
    own, other = pickle.loads(pickle.dumps(bpe[0])), bpe[1]
    monkeypatch.setattr(own.memory, "most", 3)
    monkeypatch.setattr(own.known, "most", 2)
    texts = [None, "", "xqzjv wqxzj", " ", "kjhgfq " * 3, "", "日本語 zzxqj\n\n", "q" * 100, "xqzjv wqxzj bvcxq", None]
    expected = [other.encode_ordinary(x or "") for x in texts]
    lists = [own.encode(x) for x in texts]
    assert [x.tolist() for x in lists] == expected
    held = [*own.memory.values(), *own.known.values()]
    assert held and not any(map(gc.is_tracked, held)) and len(own.memory) <= 3 and len(own.known) <= 2
    decimals = byte_bpe.taken(own.strings(lambda rank, _: b"%d," % rank), lists)
    assert [bytes(x) for x in decimals] == [b"".join(b"%d," % i for i in ids) for ids in expected]
    tokens = own.strings(lambda _, token: token)
    assert [bytes(x).decode() for x in byte_bpe.taken(tokens, lists)] == [x or "" for x in texts]
    assert byte_bpe.taken(tokens, []) == [] and byte_bpe.taken(tokens, lists[:2]) == [b"", b""]


def test_bpe_round_trips_across_portions(spark, bpe, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PORTION", 40)
    rows = [(i, None if i % 7 == 3 else f"text {i} zqxjk " * (i % 5)) for i in range(60)] + [(5, "a"), (None, "日" * 50)]
    coder = byte_bpe.coder(spark, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    got = byte_bpe.round_trips(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), coder).collect()
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    lists = [(i, x or "", bpe[1].encode_ordinary(x or "")) for i, x in rows]
    assert Counter(map(tuple, got)) == Counter((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(x.encode())) for i, x, ids in lists)


# ---- 9 ----------------------------------------------------------------------------------------


def test_roles_are_recovered(spark, folder):
    rows = queries.op9_transcripts(spark, folder).collect()
    turns = spark.read.parquet(f"{folder}/conversations.parquet").count()
    assert sum(r.n_right for r in rows) > 0.95 * turns


def test_transcript_edge_cases(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "hi\nthere"), (1, 1, "assistant", "hi\nthere"), (1, 2, None, "bye"),
            (None, 0, "System ", "rules"), (2, None, "robot", ""), (3, 600, "user", "late")]
    talk = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    sections = transcripts.sections(talk)
    got = {(r.conv_id, r.section): [tuple(t) for t in r.turns] for r in sections.collect()}
    assert got == {(1, 0): [("user", ""), ("assistant", "hi\nthere"), ("user", "bye")], (None, 0): [("system", "rules")],
                   (2, -1): [("user", "")], (3, 1): [("user", "late")]}
    model = transcripts.learn(sections)
    assert transcripts.format_sections(sections, model).count() == 4
    assert transcripts.format_sections(transcripts.sections(talk.where("false")), model).count() == 0
    found = transcripts.parse_transcripts(talk.limit(0), model, "conv_id")
    assert found.columns == ["conv_id", "turns", "rendered"]


def test_markers():
    assert transcripts.marker("User: hello") == ("user", "hello")
    assert transcripts.marker("### Human:") == ("user", "")
    assert transcripts.marker("[assistant] ok") == ("assistant", "ok")
    assert transcripts.marker("**AI:** ok") == ("assistant", "ok")
    assert transcripts.marker("note: this is text") == (None, "note: this is text")


# ---- 10 ---------------------------------------------------------------------------------------


def contained_by_hand(docs, items, threshold=0.8):
    def shingles(words, k):
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}

    out = set()
    for n, item in items:
        words = (item or "").encode().lower().split()
        k = min(5, len(words))
        wanted = shingles(words, k) if k else set()
        for i, doc in docs:
            shared = len(wanted & shingles((doc or "").encode().lower().split(), k)) if k else 0
            if wanted and shared >= threshold * len(wanted):
                out.add((i, n, len(wanted), shared))
    return out


@pytest.mark.parametrize("block_shingles", [500_000, 40])
def test_contained_items_of_all_sizes(spark, block_shingles):
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 3000)}"
    items = [(n, " ".join(word() for _ in range(size))) for n, size in enumerate([1, 3, 5, 6, 12, 20, 21, 22, 40, 70, 140, 300])]
    items += [(50, None), (51, " "), (52, items[8][1].upper())]
    docs = []
    for i in range(40):
        words = [word() for _ in range(rng.choice([0, 3, 200, 1500]))]
        item = items[i % 12][1].split()
        if i % 4 == 0 and len(item) > 20:
            item[rng.randrange(len(item))] = "edited"
        at = rng.randint(0, len(words))
        docs.append((i, " ".join(words[:at] + item + words[at:])))
    docs += [(None, items[9][1]), (90, None), (91, "")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    got = contamination.contained_items(spark, table, asked, block_shingles=block_shingles)
    want = contained_by_hand(docs, items)
    assert {tuple(r) for r in got.collect()} == want
    left = {r.doc_id for r in contamination.without_leaks(spark, table, asked, block_shingles=block_shingles).collect()}
    assert left == {i for i, _ in docs} - {i for i, *_ in want}


def test_contamination_of_nothing(spark, edge, empty):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert contamination.contained_items(spark, edge, items).count() == 0
    assert contamination.without_leaks(spark, edge, items).count() == len(EDGE)
    one = spark.createDataFrame([(1, LINE)], "item_id bigint, text string")
    assert contamination.contained_items(spark, empty, one).count() == 0
    assert contamination.contained_items(spark, edge, one).count() == 4
