r"""Substring deduplication by line or paragraph hashing.

A text is cut into lines (at \n) or paragraphs (at blank lines). Units of at least ``min_words`` words are
normalised (ASCII lower case, white-space runs as one space) and hashed to 128 bits. Over all documents the
earliest occurrence of each digest stays, by (id, text hash, position), and every later one is removed. The
removed units' offsets in the original text (code points, end exclusive, separators not included) are kept.
``dedup_passages`` removes repeated passages too, which need not begin or end at a line break (see ``passages``).

Size: digests are combined per task before the shuffle, and only repeated ones are joined back; a unit with
a third of all occurrences is one key of a sum with map-side combining and of a join that adaptive
execution splits. Texts are shuffled once, compressed, to meet their lists of removed positions.

Defined cases: a null text is an empty one; null ids rank first; rows equal in id and text are one document
and give equal rows; rows equal in id only rank by a hash of the text; other columns are ignored; an empty
table gives an empty result. Units are compared whole, whatever their length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptscore.llm.passages import WORDS, later_passages
from promptscore.llm.words import ascii_lower, numbered, packed, split_join, unpacked, whole, words_of

SEPARATORS = {"line": r"\n", "paragraph": r"\n[\x20\x09]*\n"}
MIN_WORDS = 20
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def _document(id_col: str, text: str) -> list[Column]:
    return [F.xxhash64(id_col, text).alias("_doc"), F.xxhash64(F.lit("text"), text).alias("_text_hash")]


def _units(own: DataFrame, unit: str, min_words: int) -> DataFrame:
    """(id, _doc, _text_hash, pos, hi, lo) for the units that are long enough."""
    cut = own.select("_id", "_doc", "_text_hash", F.posexplode(F.split("_text", SEPARATORS[unit])).alias("pos", "unit"))
    worded = cut.select("_id", "_doc", "_text_hash", "pos", words_of(ascii_lower(F.col("unit"))).alias("words"))
    normal = worded.where(F.size("words") >= min_words).withColumn("unit", F.array_join("words", " "))
    return normal.select(
        "_id", "_doc", "_text_hash", "pos", F.xxhash64("unit").alias("hi"), F.xxhash64(F.lit(1), "unit").alias("lo")
    )


def later_occurrences(own: DataFrame, unit: str, min_words: int) -> DataFrame:
    """(_doc, _text_hash, gone): positions of the units to remove, per document."""
    units = _units(own, unit, min_words)
    rank = F.struct("_id", "_text_hash", "pos")
    first = (
        units.groupBy("hi", "lo")
        .agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("hi", "lo", "first")
    )
    return (
        split_join(units, first, ["hi", "lo"])
        .where(rank != F.col("first"))
        .groupBy("_doc", "_text_hash")
        .agg(F.collect_set("pos").alias("gone"))
    )


def cut_units(text: str, gone: list[int], unit: str = "line") -> tuple[str, list[dict[str, int]]]:
    """The text without the units at these positions, and their spans; each unit goes with the separator after it."""
    bounds, at = [], 0
    for m in re.finditer(SEPARATORS[unit], text):
        bounds.append((at, m.start(), m.end()))
        at = m.end()
    bounds.append((at, len(text), len(text)))
    dropped = set(gone)
    kept = [text[a:c] for i, (a, _, c) in enumerate(bounds) if i not in dropped]
    if kept and len(bounds) - 1 in dropped:  # the last kept unit becomes the end of the text
        last = max(i for i in range(len(bounds)) if i not in dropped)
        kept[-1] = text[bounds[last][0] : bounds[last][1]]
    return "".join(kept), [{"start": bounds[i][0], "end": bounds[i][1]} for i in sorted(dropped)]


def _without_short_ends(text: str, taken: set[int], least: int) -> set[int]:
    """``taken`` without the first and last line's words of each run, where these are fewer than ``least``."""
    words, kept = [w.span() for w in _WORD.finditer(text)], set(taken)
    breaks = [k for k in range(1, len(words)) if "\n" in text[words[k - 1][1] : words[k][0]]]
    for start in sorted(k for k in taken if k - 1 not in taken):
        end = start + 1
        while end in taken:
            end += 1
        inner = [k for k in breaks[bisect_right(breaks, start) :][: end - start] if k < end]
        if inner:
            ends = [(start, inner[0]), (inner[-1], end)]
            kept.difference_update(k for a, b in ends if b - a < least for k in range(a, b))
    return kept


def cut_passages(
    text: str, gone: list[int], spans: list[dict[str, int]], least: int = 1
) -> tuple[str, list[dict[str, int]]]:
    """The text without the paragraphs at these positions and the words of these spans, and what was removed.

    Where a passage of several lines begins or ends with fewer than ``least`` words of a line, these stay.
    A paragraph that loses all its words goes as a whole; elsewhere, of the white space before and after a
    removed passage the part with more line breaks stays.
    """
    taken: set[int] = set()
    for span in spans:
        taken.update(range(span["start"], span["end"]))
    taken = _without_short_ends(text, taken, least)
    dropped, kept, removed, at, number = set(gone), [], [], 0, 0
    for i, m in enumerate([*re.finditer(SEPARATORS["paragraph"], text), None]):
        begin, (end, at) = at, (m.start(), m.end()) if m else (len(text), len(text))
        words = [w.span() for w in _WORD.finditer(text, begin, end)]
        out = [number + k in taken for k in range(len(words))]
        number += len(words)
        if i in dropped or (words and all(out)):
            removed.append((begin, end))
            continue
        own = []
        for k in range(len(words)):
            if not out[k] or (k and out[k - 1]):
                continue
            last = out.index(False, k) - 1 if False in out[k:] else len(words) - 1
            before = words[k - 1][1] if k else begin
            after = words[last + 1][0] if last + 1 < len(words) else end
            low, high = text[before : words[k][0]].count("\n"), text[words[last][1] : after].count("\n")
            late = k and (last + 1 == len(words) or high > low)
            own.append((before, words[last][1]) if late else (words[k][0], after))
        removed += own
        edges = [begin, *[x for cut in own for x in cut], end]
        kept.append(("".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), text[end:at]))
    body = "".join(unit + separator for unit, separator in kept[:-1]) + (kept[-1][0] if kept else "")
    return body, [{"start": a, "end": b} for a, b in removed]


def _without(
    docs: DataFrame,
    id_col: str,
    text: str,
    marks_of: Callable[[DataFrame], DataFrame],
    cut: Callable[..., tuple[str, list[dict[str, int]]]],
) -> DataFrame:
    """``docs`` with each text cut by ``cut(text, *marks)`` and the spans that it removed.

    ``marks_of`` finds (_doc, _text_hash, mark ...) from (_id, _text, _doc, _text_hash).
    """
    if "removed_spans" in docs.columns:
        docs = docs.drop("removed_spans")
    plain, name = numbered(docs)
    texts = plain.withColumn(name[text], whole(F.col(name[text])))
    texts = texts.select("*", *_document(name[id_col], name[text]))
    marks = marks_of(texts.select(F.col(name[id_col]).alias("_id"), F.col(name[text]).alias("_text"), "_doc", "_text_hash"))
    own = [c for c in marks.columns if c not in ("_doc", "_text_hash")]
    marked = marks.withColumn("_marked", F.lit(True)).hint("merge")  # small tables too: see ``packed``
    joined = split_join(packed(texts, name[text]), marked, ["_doc", "_text_hash"], "left")
    wide = joined.select(*name.values(), *own, "_marked")
    kinds = [T.StructField(c, T.StringType() if c == text else docs.schema[c].dataType) for c in docs.columns]
    schema = T.StructType([*kinds, T.StructField("removed_spans", T.ArrayType(SPAN))])
    at, n = docs.columns.index(text), len(docs.columns)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = unpacked(batch.column(at)), [[]] * batch.num_rows
            hit = [i for i, marked in enumerate(batch.column(n + len(own)).to_pylist()) if marked]
            if hit:
                bodies = texts.to_pylist()
                for i in hit:
                    bodies[i], spans[i] = cut(bodies[i], *[batch.column(n + k)[i].as_py() or [] for k in range(len(own))])
                texts = pa.array(bodies, pa.string())
            columns = [*batch.columns[:n], pa.array(spans, span)]
            columns[at] = texts
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return wide.mapInArrow(run, schema)


def dedup_units(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", unit: str = "line", min_words: int = MIN_WORDS
) -> DataFrame:
    """``docs`` with the kept text in ``text`` and ``removed_spans``, offsets into the original text."""
    return _without(
        docs, id_col, text, lambda own: later_occurrences(own, unit, min_words), lambda body, gone: cut_units(body, gone, unit)
    )


def dedup_passages(
    spark: SparkSession, docs: DataFrame, root: str, id_col: str = "doc_id", text: str = "text",
    min_words: int = MIN_WORDS, words: int = WORDS, least: int = 1,
) -> DataFrame:
    """``docs`` without paragraphs of ``min_words`` that an earlier one has, and without passages of ``words``
    words or more that occurred before, wherever these begin and end (see ``cut_passages`` for ``least``); with
    ``removed_spans``."""

    def marks(own: DataFrame) -> DataFrame:
        gone = later_occurrences(own, "paragraph", min_words)
        return gone.join(later_passages(spark, own, root, words), ["_doc", "_text_hash"], "full")

    return _without(docs, id_col, text, marks, lambda body, gone, spans: cut_passages(body, gone, spans, least))
