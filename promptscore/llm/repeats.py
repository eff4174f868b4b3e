"""Exact substring dedup by depth-limited radix passes over byte suffixes.

Every byte covered by a ``length``-byte string that also starts elsewhere (in any document, also the same) is
removed. Suffixes only matter through their first ``length`` bytes, so they are not sorted as a whole: passes
go from the most significant digit of that prefix to the least, every pass splits the groups of the pass
before by one more digit, and groups of one leave. Equal groups at full depth are the repeated windows.

The digits are hashes of ever longer parts of the window, found by a window's own content, so that equal
windows have equal digits:

1.  the anchor: the least hash of the window's GRAM-byte strings. Neighbouring windows share it, so one row
    stands for a run of up to ``length`` - GRAM + 1 windows (some seventy), and an anchor that occurs in one
    run only ends all of them at once;
2.  the run: a hash of all bytes that its windows cover. A run that occurs twice is repeated as a whole,
    whatever its number of copies, and goes no further;
3.  the window: for anchors whose runs differ, one text for each different run is read again, and its
    windows are split by a hash of all their ``length`` bytes.

A row is dropped only when it is alone in its group, so no repeat is missed; groups at full depth are equal
in 128 bits (anchor and window hash, or anchor and run hash).

Size: pass one moves one small row for some seventy bytes of text, pass three only the runs next to an edit.
All groups are sums with map-side combining, joined back so that adaptive execution can split a hot key; no
group is collected. Texts are shuffled twice, to meet the runs to read again and the spans to remove. Long
texts are worked through in pieces of PIECE bytes with an overlap, so memory does not grow with a text.

Defined cases: a null text is empty; texts shorter than ``length`` keep all; equal rows are repeats of each
other, and give equal rows; null ids are kept; other columns are ignored or passed on; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptscore.llm.shingles import mix, portions
from promptscore.llm.words import split_join, whole, written

LENGTH = 200
GRAM = 48
BLOCK = 4096
PIECE = 1 << 20
_BYTE = mix(np.random.default_rng(3).integers(0, 1 << 63, 256, dtype=np.uint64))
_K = np.uint64(0x9E3779B97F4A7C15)


def _join(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    h = (left ^ np.uint64(salt)) * _K + (right ^ (right >> np.uint64(32)))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _string_hashes(data: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """For each size the hash of the string of so many bytes at every position; built by doubling.

    ``data`` may also hold a 64-bit hash for each item of a sequence of other things, such as words.
    """
    powers = {1: _BYTE[data] if data.dtype == np.uint8 else data}
    size = 1
    while size * 2 <= max(sizes):
        h = powers[size]
        powers[2 * size] = _join(h[:-size] if len(h) > size else h[:0], h[size:], size)
        size *= 2
    out = []
    for wanted in sizes:
        n = len(data) - wanted + 1
        at, h = 0, None
        for power in sorted(powers, reverse=True):
            if n > 0 and wanted & power:
                part = powers[power][at : at + n]
                h = part if h is None else _join(h, part, wanted)
                at += power
        out.append(np.zeros(0, np.uint64) if h is None else h)
    return out


def _sliding(h: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    span, level = 1, h
    while span * 2 <= width:
        level = best(level[:-span], level[span:])
        span *= 2
    return best(level[: len(h) - width + 1], level[width - span :]) if span < width else level


class Runs:
    """Runs of windows of one buffer of texts: their first and last window, anchor hash and hash of all bytes."""

    def __init__(self, data: np.ndarray, valid: np.ndarray, length: int, gram: int):
        """``valid``: for each position whether a window starts there; windows never cross texts."""
        width = length - gram + 1
        grams, self.windows = _string_hashes(data, [gram, length])
        empty = np.zeros(0, np.int64)
        self.first = self.last = empty
        self.anchor = self.run = np.zeros(0, np.uint64)
        if not valid.any():
            return
        least = _sliding(grams, width, np.minimum)
        # A gram is an anchor where it is the least of some window. Equal grams within a window count
        # from the left, so a run ends where its leftmost one leaves.
        edge = np.flatnonzero((least[1:] != least[:-1]) | (valid[1:] != valid[:-1])) + 1
        first = np.concatenate(([0], edge))
        last = np.concatenate((edge, [len(least)])) - 1
        kept = valid[first]
        first, last = first[kept], last[kept]
        padded = np.concatenate((least, np.zeros(width - 1, np.uint64)))
        highest = _sliding(np.concatenate((np.zeros(width - 1, np.uint64), padded[: len(least)], np.zeros(width - 1, np.uint64))), width, np.maximum)
        places = np.flatnonzero(grams == highest[: len(grams)])
        values, rank = np.unique(grams[places], return_inverse=True)
        order = np.lexsort((places, rank))
        keys = rank[order].astype(np.int64) * len(data) + places[order]
        firsts, lasts = [], []
        while len(first):
            own = np.searchsorted(values, least[first]).astype(np.int64) * len(data)
            place = keys[np.searchsorted(keys, own + first)] - own
            stop = np.minimum(last, place)
            firsts.append(first)
            lasts.append(stop)
            more = stop < last
            first, last = stop[more] + 1, last[more]
        self.first, self.last = np.concatenate(firsts), np.concatenate(lasts)
        self.anchor = least[self.first]
        self.run = _join(
            self.windows[self.first], self.windows[self.last] + (self.last - self.first).astype(np.uint64), 77
        )


def _joined(parts: list[bytes] | list[np.ndarray]) -> np.ndarray:
    if parts and isinstance(parts[0], np.ndarray):
        return np.concatenate(parts)
    return np.frombuffer(b"".join(parts), np.uint8)


def _buffers(texts: list[bytes] | list[np.ndarray], length: int, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, valid, text number and offset of each buffer part's start, part starts) over pieces of the texts."""
    pieces = []
    for i, text in enumerate(texts):
        step = piece
        for at in range(0, max(1, len(text) - length + 1), step):
            pieces.append((i, at, min(len(text), at + step + length - 1)))
    for a, b in portions([end - at for _, at, end in pieces], piece):
        own = pieces[a:b]
        data = _joined([texts[i][at:end] for i, at, end in own])
        sizes = np.array([end - at for _, at, end in own], np.int64)
        starts = np.cumsum(sizes) - sizes
        valid = np.zeros(max(0, len(data) - length + 1), bool)
        if len(valid):
            marks = np.zeros(len(data) + 1, np.int64)
            fits = sizes >= length
            np.add.at(marks, starts[fits], 1)
            np.add.at(marks, starts[fits] + sizes[fits] - length + 1, -1)
            valid = np.cumsum(marks)[: len(valid)] > 0
        yield data, valid, np.array([(i, at) for i, at, _ in own], np.int64).reshape(-1, 2), starts


def _texts(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t_hi"), F.xxhash64(F.lit("repeats"), text).alias("t_lo")]


def _packed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(_id, t_hi, t_lo, packed): texts compressed for a shuffle."""
    body = whole(F.col(text))
    own = docs.select(F.col(id_col).alias("_id"), *_keys(body), body.alias("_text"))
    schema = T.StructType([*own.schema.fields[:3], T.StructField("packed", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = pa.array([press.compress(t) for t in _texts(batch.column(3))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], names=schema.names)

    return own.mapInArrow(pack, schema)


def _unpacked(column: pa.Array) -> list[bytes]:
    press = zstandard.ZstdDecompressor()
    return [press.decompress(x.as_buffer()) if x.as_buffer().size else b"" for x in column]


def _runs(docs: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """(t_hi, t_lo, anchor, run, place): the runs of all texts; ``place`` is the first window's start in bytes
    times 256 and the number of windows after it."""
    body = whole(F.col(text))
    own = docs.select(*_keys(body), body.alias("_text"))
    names = ["t_hi", "t_lo", "anchor", "run", "place"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, valid, parts, starts in _buffers(_texts(batch.column(2)), length, PIECE):
                runs = Runs(data, valid, length, gram)
                if not len(runs.first):
                    continue
                part = np.searchsorted(starts, runs.first, side="right") - 1
                row = pa.array(parts[part, 0])
                place = (runs.first + parts[part, 1] - starts[part]) * 256 + runs.last - runs.first
                anchor, run = runs.anchor.view(np.int64), runs.run.view(np.int64)
                columns = [batch.column(0).take(row), batch.column(1).take(row), anchor, run, place]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return own.mapInArrow(work, ", ".join(f"{n} long" for n in names))


def _contents(packed: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """(anchor, run, content): the bytes that the windows of each run in ``asked`` cover."""
    own = F.xxhash64("_id").alias("owner")
    wide = split_join(packed.select("t_hi", "t_lo", own, "packed"), asked, ["t_hi", "t_lo", "owner"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, rows in zip(_unpacked(batch.column(0)), batch.column(1)):
                anchor, run, place = (rows.values.field(i) for i in range(3))
                parts = [text[p // 256 : p // 256 + p % 256 + length] for p in place.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [anchor, run, pa.array(parts, pa.binary())], names=["anchor", "run", "content"]
                )

    return wide.select("packed", "asked").mapInArrow(work, "anchor long, run long, content binary")


def _window_rows(contents: list[bytes] | list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content number, position, hash) of all windows of the contents."""
    size = np.array([len(c) for c in contents], np.int64)
    hashes = _string_hashes(_joined(contents), [length])[0]
    count = size - length + 1
    of = np.repeat(np.arange(len(size)), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    return of, at, hashes[(np.cumsum(size) - size)[of] + at]


def _by_anchor(close: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """``close`` over rows that come sorted by their first column, some whole groups at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            anchors = batch.column(0).to_numpy()
            other = np.flatnonzero(anchors != anchors[-1])
            if held and len(other) == 0 and held[-1].column(0)[-1].as_py() == anchors[-1]:
                held.append(batch)
                continue
            done = int(other[-1]) + 1 if len(other) else 0
            held.append(batch.slice(0, done))
            whole_groups = pa.Table.from_batches(held)
            if whole_groups.num_rows:
                yield from close(whole_groups)
            held = [batch.slice(done)]
        if held:
            yield from close(pa.Table.from_batches(held))

    return work


def _split_groups(length: int):
    """Rows (anchor, run, content), sorted by anchor: ranges of the windows that another run of the anchor has."""

    def close(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        anchors = rows.column(0).to_numpy()
        contents = [c.as_buffer().to_pybytes() for c in rows.column(2)]
        group = np.concatenate(([0], np.cumsum(anchors[1:] != anchors[:-1])))
        edges = np.searchsorted(group, np.arange(group[-1] + 2))
        for low, high in portions(np.bincount(group, [len(c) for c in contents]).astype(int).tolist(), PIECE):
            a, b = edges[low], edges[high]
            of, at, window = _window_rows(contents[a:b], length)
            own = group[a:b][of]
            order = np.lexsort((window, own))  # groups of the anchor's pass, split by the digit of the last pass
            same = (window[order][1:] == window[order][:-1]) & (own[order][1:] == own[order][:-1])
            repeated = np.zeros(len(order), bool)
            repeated[order[1:][same]] = True
            repeated[order[:-1][same]] = True
            of, at = of[repeated], at[repeated]
            if not len(of):
                continue
            edge = np.flatnonzero((of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)) + 1
            first, last = np.concatenate(([0], edge)), np.concatenate((edge, [len(of)])) - 1
            kind = pa.array(a + of[first])
            columns = [rows.column(0).take(kind), rows.column(1).take(kind), pa.array(at[first]), pa.array(at[last])]
            table = pa.table(columns, names=["anchor", "run", "a", "b"])
            yield from table.combine_chunks().to_batches()

    return _by_anchor(close)


def _all_windows(contents: DataFrame, length: int) -> DataFrame:
    """(anchor, run, at, window): every window as a row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in portions([len(c.as_buffer()) for c in batch.column(2)], PIECE):
                own = batch.slice(a, b - a)
                of, at, window = _window_rows([c.as_buffer().to_pybytes() for c in own.column(2)], length)
                of = pa.array(of)
                columns = [own.column(0).take(of), own.column(1).take(of), pa.array(at), pa.array(window.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "run", "at", "window"])

    return contents.mapInArrow(work, "anchor long, run long, at long, window long")


def _split_runs(contents: DataFrame, sizes: DataFrame, length: int, block: int) -> DataFrame:
    """(anchor, run, a, b): ranges of windows that a different run of the same anchor has too.

    An anchor with up to ``block`` different runs is one group of a task. The windows of larger ones become
    rows, which a sum with map-side combining and a join bring together, however many they are.
    """
    sized = split_join(contents, sizes, ["anchor"])
    small = (
        sized.where(F.col("kinds") <= block)
        .select("anchor", "run", "content")
        .repartition("anchor")
        .sortWithinPartitions("anchor", "run")
        .mapInArrow(_split_groups(length), "anchor long, run long, a long, b long")
    )
    windows = _all_windows(sized.where(F.col("kinds") > block).select("anchor", "run", "content"), length)
    shared = (
        windows.groupBy("anchor", "window")
        .agg(F.min("run").alias("low"), F.max("run").alias("high"))
        .where("low <> high")
        .select("anchor", "window")
    )
    large = split_join(windows, shared, ["anchor", "window"]).select("anchor", "run", F.col("at").alias("a"), F.col("at").alias("b"))
    return small.unionAll(large)


def repeated_spans(
    spark: SparkSession,
    docs: DataFrame,
    packed: DataFrame,
    root: str,
    id_col: str,
    text: str,
    length: int = LENGTH,
    gram: int = GRAM,
    block: int = BLOCK,
) -> DataFrame:
    """(t_hi, t_lo, spans): per text, ranges (first, last) of window starts that are repeated."""
    runs = _runs(docs, text, length, gram)
    # pass 1: anchors of more than one run
    anchors = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    anchors = written(spark, anchors, f"{root}/anchors")
    open_ = written(spark, runs.join(anchors, "anchor"), f"{root}/open")
    # pass 2: a run that occurs twice is repeated as a whole; one occurrence stands for all of them
    kinds = open_.groupBy("anchor", "run").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("t_hi", "t_lo", "place")]
    )
    kinds = written(spark, kinds, f"{root}/kinds")
    whole_runs = kinds.where("n > 1").select("anchor", "run", F.lit(0).cast("long").alias("a"), F.pmod("place", F.lit(256)).alias("b"))
    # pass 3: where an anchor has different runs, these are split by window
    mixed = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    body = whole(F.col(text))
    owners = docs.select(*_keys(body), F.col(id_col).alias("_id")).groupBy("t_hi", "t_lo").agg(F.min("_id").alias("_id"))
    asked = (
        split_join(kinds, mixed, ["anchor"], "left_semi")
        .groupBy("t_hi", "t_lo")
        .agg(F.collect_set(F.struct("anchor", "run", "place")).alias("asked"))
        .join(owners, ["t_hi", "t_lo"])
        .select("t_hi", "t_lo", F.xxhash64("_id").alias("owner"), "asked")
    )
    contents = written(spark, _contents(packed, asked, length), f"{root}/contents")
    once = split_join(_split_runs(contents, mixed, length, block), kinds.where("n = 1").select("anchor", "run"), ["anchor", "run"], "left_semi")
    verdict = whole_runs.unionAll(once)
    first = F.shiftright("place", 8)
    hit = split_join(open_, verdict, ["anchor", "run"]).select(
        "t_hi", "t_lo", F.struct((first + F.col("a")).alias("first"), (first + F.col("b")).alias("last")).alias("span")
    )
    return hit.groupBy("t_hi", "t_lo").agg(F.collect_set("span").alias("spans"))


def remove_spans(text: bytes, starts: list[tuple[int, int]], length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes left and the maximal removed runs (start, end), given ranges of repeated windows' starts."""
    removed: list[list[int]] = []
    for first, last in sorted(starts):
        if removed and first <= removed[-1][1]:
            removed[-1][1] = max(removed[-1][1], last + length)
        else:
            removed.append([first, last + length])
    kept, at = [], 0
    for a, b in removed:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), [(a, b) for a, b in removed]


def without_repeats(
    spark: SparkSession,
    docs: DataFrame,
    root: str,
    id_col: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    block: int = BLOCK,
) -> DataFrame:
    """(id, n_bytes, removed, kept): the removed byte ranges and the bytes left of every document."""
    packed = _packed(docs, id_col, text)
    spans = repeated_spans(spark, docs, packed, root, id_col, text, length, gram, block)
    met = split_join(packed, spans, ["t_hi", "t_lo"], "left")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("removed", T.ArrayType(span)),
            T.StructField("kept", T.BinaryType()),
        ]
    )
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for body, spans in zip(_unpacked(batch.column(1)), batch.column(2).to_pylist()):
                starts = [(s["first"], s["last"]) for s in spans or ()]
                left, gone = remove_spans(body, starts, length)
                sizes.append(len(body))
                removed.append([{"start": a, "end": b} for a, b in gone])
                kept.append(left)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pairs), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return met.select("_id", "packed", "spans").mapInArrow(cut, schema)
