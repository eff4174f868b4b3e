"""Repeated passages of words against all windows by hand, and their cutting."""

import random

import corpus_pipeline
import pytest

from promptscore import new_work_dir
from promptscore.llm import passages, unit_dedup
from promptscore.llm.words import whole
from pyspark.sql import functions as F


def later_by_hand(texts, words):
    """Per text the set of words that an equal earlier window has, for texts in the order of their ids."""
    seen, out = {}, []
    for i, text in enumerate(texts):
        own, gone = (text or "").lower().split(), set()
        for at in range(len(own) - words + 1):
            first = seen.setdefault(tuple(own[at : at + words]), (i, at))
            if first != (i, at):
                gone |= set(range(max(at, first[1] + words) if first[0] == i else at, at + words))
        out.append(gone)
    return out


@pytest.mark.parametrize("block", [4096, 1])
def test_passages_against_all_windows(spark, block):
    rng = random.Random(8)
    base = rng.choices("abcdefghij", k=120)
    texts = [" ".join(rng.choices("ab", k=rng.randint(0, 60))) for _ in range(12)] + ["x " * 50, "a b c " * 20, None, ""]
    texts += [" ".join([*rng.choices("klm", k=9), *base[a:b], *rng.choices("klm", k=7)]) for a, b in ((0, 60), (20, 90), (70, 120), (5, 15), (5, 14))]
    texts += [" ".join(base).upper(), "é " + "\n".join(base[30:50]) + " 日"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    docs = docs.unionAll(docs.where("doc_id = 17"))  # a row that comes twice is one document
    own = docs.select(F.col("doc_id").alias("_id"), whole(F.col("text")).alias("_text"))
    own = own.select("*", *unit_dedup._document("_id", "_text"))
    found = passages.later_passages(spark, own, new_work_dir(spark, "t"), words=10, gram=4, block=block)
    found = found.join(own.select("_id", "_doc", "_text_hash").distinct(), ["_doc", "_text_hash"]).collect()
    got = {r._id: {w for s in r.spans for w in range(s.start, s.end)} for r in found}
    assert got == {i: gone for i, gone in enumerate(later_by_hand(texts, 10)) if gone}


def test_words_of_equal_letters_in_another_order_differ():
    swap = str.maketrans("ab", "ba")
    word = "a"
    for _ in range(10):
        word += word.translate(swap)
    a, b, c = passages.word_hashes([word.encode(), word.translate(swap).encode(), word.upper().encode()])
    assert a[0] != b[0] and a[0] == c[0] and len(passages.word_hashes([b"", b" \n", b"x y"])[2]) == 2


def test_cut_passages():
    def cut(text, gone, *spans):
        return unit_dedup.cut_passages(text, gone, [{"start": a, "end": b} for a, b in spans])

    assert cut("a b c d", [], (1, 3)) == ("a d", [{"start": 2, "end": 6}])
    assert cut("a b\nc d", [], (1, 2))[0] == "a\nc d" and cut("a\nb c", [], (1, 2))[0] == "a\nc"
    assert cut("a b c", [], (0, 2))[0] == "c" and cut(" a b c", [], (1, 3))[0] == " a"
    assert cut("a b\n\nc d\n\ne", [], (1, 4))[0] == "a\n\ne" and cut("a\n\nb", [1]) == ("a", [{"start": 3, "end": 4}])
    assert unit_dedup.cut_passages("a b\nc\nd e f\ng", [], [{"start": 1, "end": 7}], 2)[0] == "a b\ng"
    assert cut("a b", [], (0, 2)) == ("", [{"start": 0, "end": 3}])


def test_passages_inside_lines_go(spark, folder):
    shared = " ".join(f"p{i}" for i in range(55))
    rows = [(i, f"one{i} own words{i} {shared.upper() if i else shared} and{i} the\nend{i} of it") for i in range(3)]
    rows = [(i, t, "en", "s", len(t)) for i, t in rows] + [(3, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.text for r in corpus_pipeline.substrings(spark, docs, folder).collect()}
    assert got == {0: rows[0][1], 3: ""} | {i: f"one{i} own words{i} and{i} the\nend{i} of it" for i in (1, 2)}
