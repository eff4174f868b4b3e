"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is found in a document when at least ``threshold`` of its distinct word shingles (five lower-cased
words) occur in the document. A MinHash of a whole long document says little about a short item, so both
sides are partitioned by size: an item with n shingles belongs to the class of the next power of two B >= n,
and for that class a document is a row of windows of 2B shingles, a new one every B. An item's shingles then
make up at least a fifth of some window, and with HASHES minima per window, each a bucket of its own, an
item at the threshold is missed with a chance of 0.81 ** 64, about one in a million. The minima of blocks of
SMALLEST shingles are computed once and combined upwards for every class. Items of at most SMALLEST shingles
are too short for sharp minima: all their shingles are looked up. Candidates are verified by exact
containment over the whole document.

The items are the stated query set. They are handled in blocks of some ``block_shingles`` shingles (random
by hash of the item), each small enough to send to every task, with one pass over the documents per block.
Documents are never shuffled.

Defined cases: null or wordless items and documents match nothing; an item of fewer than five words is one
shingle of all its words; equal rows give equal rows, and null ids are kept; an item with equal ids in
several rows is matched per row; other columns are ignored or passed on; no items or no documents give no
matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptscore.llm.shingles import portions, shingle_hashes, word_hashes
from promptscore.llm.words import whole, words_of

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 64
SMALLEST = 16
BLOCK_SHINGLES = 500_000
_CHUNK = 1 << 20
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_FACTORS = np.random.default_rng(10).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class ItemBlock:
    """Signatures and shingles of a block of items."""

    def __init__(self, items: list[tuple]):
        self.ids, self.shingles, self.size_of = [], [], []
        for item_id, text in items:
            words, owner = word_hashes([text])
            size = min(SHINGLE, len(words))
            if size:
                self.ids.append(item_id)
                self.size_of.append(size)
                self.shingles.append(np.unique(shingle_hashes(words, owner, size)[0]))
        counts = np.array([len(s) for s in self.shingles], np.int64)
        self.counts = counts
        short = [i for i in range(len(counts)) if counts[i] <= SMALLEST or self.size_of[i] < SHINGLE]
        #: size of the shingle -> sorted shingles of the short items, and the item of each
        self.short = {}
        for size in sorted({self.size_of[i] for i in short}):
            own = [i for i in short if self.size_of[i] == size]
            self.short[size] = self._sorted([self.shingles[i] for i in own], own)
        #: class -> per hash function the sorted minima of its items, and the item of each
        self.classes = {}
        taken = set(short)
        rest = [i for i in range(len(counts)) if i not in taken]
        for bound in sorted({1 << int(counts[i] - 1).bit_length() for i in rest}):
            own = [i for i in rest if 1 << int(counts[i] - 1).bit_length() == bound]
            minima = [[(self.shingles[i] * f).min(keepdims=True) for i in own] for f in _FACTORS]
            self.classes[bound] = [self._sorted(m, own) for m in minima]

    @staticmethod
    def _sorted(values: list[np.ndarray], items: list[int]) -> tuple[np.ndarray, np.ndarray]:
        flat, of = np.concatenate(values), np.repeat(items, [len(v) for v in values])
        order = np.argsort(flat, kind="stable")
        return flat[order], of[order]


def _found(table: tuple[np.ndarray, np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, item) for every value that the table has, once for each item that has it."""
    keys, items = table
    low = np.searchsorted(keys, values)
    hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == values)
    low, high = low[hit], np.searchsorted(keys, values[hit], side="right")
    count = high - low
    at = np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(hit, count), items[at]


def _candidates(block: ItemBlock, shingles: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """(document, item) pairs whose windows share a minimum, from five-word shingles in document order."""
    if not len(shingles) or not block.classes:
        return np.zeros((0, 2), np.int64)
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    length = np.diff(np.append(first, len(owner)))
    blocks = -(-length // SMALLEST)
    gap = 2 * max(block.classes) // SMALLEST  # no window reaches into the next document
    slot_start = np.cumsum(blocks + gap) - (blocks + gap)
    slots = int((blocks + gap).sum())
    inner = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = np.repeat(first, blocks) + inner * SMALLEST
    slot = np.repeat(slot_start, blocks) + inner
    slot_owner = np.repeat(owner[first], blocks + gap)
    pairs = []
    for j, factor in enumerate(_FACTORS):
        level = np.full(slots, _EMPTY)
        level[slot] = np.minimum.reduceat(shingles * factor, starts)
        span = 1
        for bound, tables in block.classes.items():
            while span < 2 * bound // SMALLEST:
                level = np.minimum(level, np.append(level[span:], np.full(min(span, slots), _EMPTY))[:slots])
                span *= 2
            stride = bound // SMALLEST
            at, item = _found(tables[j], level[::stride])
            pairs.append(np.stack((slot_owner[at * stride], item), axis=1))
            if stride > 1:  # windows that begin before a document's first slot of the stride
                at, item = _found(tables[j], level[slot_start])
                pairs.append(np.stack((slot_owner[slot_start[at]], item), axis=1))
    return np.unique(np.concatenate(pairs), axis=0)


def search(block: ItemBlock, texts: list[str | None], threshold: float) -> list[tuple[int, int, int]]:
    """(text number, item number, shared shingles) for every item found, in order."""
    words, owner = word_hashes(texts)
    by_size = {SHINGLE: shingle_hashes(words, owner, SHINGLE)}
    pairs = [_candidates(block, *by_size[SHINGLE])]
    for size, short in block.short.items():
        if size not in by_size:
            by_size[size] = shingle_hashes(words, owner, size)
        shingles, of = by_size[size]
        if len(shingles):
            at, item = _found(short, shingles)
            pairs.append(np.stack((of[at], item), axis=1))
    out = []
    for doc, item in np.unique(np.concatenate(pairs), axis=0).tolist():
        shingles, of = by_size[block.size_of[item]]
        own = shingles[np.searchsorted(of, doc) : np.searchsorted(of, doc, side="right")]
        shared = int(np.isin(block.shingles[item], own).sum())
        if shared >= threshold * len(block.shingles[item]) - 1e-9:
            out.append((doc, item, shared))
    return out


def item_blocks(
    spark: SparkSession, items: DataFrame, id_col: str, text: str, block_shingles: int = BLOCK_SHINGLES
) -> Iterator[Broadcast]:
    """The items in blocks of bounded size, each read for itself."""
    own = items.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    size = own.agg(F.sum(F.size(words_of(whole(F.col("text")))))).first()[0] or 0
    blocks = max(1, -(-size // block_shingles))
    for b in range(blocks):
        part = own.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        block = ItemBlock([tuple(r) for r in part.toLocalIterator()])
        if block.ids:
            yield spark.sparkContext.broadcast(block)


def _searched(block: ItemBlock, column: pa.Array, threshold: float) -> Iterator[tuple[int, list]]:
    for a, b in portions([len(x.as_buffer()) if x.is_valid else 0 for x in column], _CHUNK):
        yield a, search(block, column.slice(a, b - a).to_pylist(), threshold)


def contained_items(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """(id, item id, item_shingles, shared): one row for each item found in a document."""
    own = docs.select(F.col(id_col), F.col(text).alias("_text"))
    item_type = items.schema[item_id].dataType
    schema = T.StructType(
        [
            own.schema[0],
            T.StructField(item_id, item_type),
            T.StructField("item_shingles", T.LongType()),
            T.StructField("shared", T.LongType()),
        ]
    )
    arrow_item = pa.array([], pa.int64()).type if item_type == T.LongType() else None

    def passes(held: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = held.value
            for batch in batches:
                for start, found in _searched(block, batch.column(1), threshold):
                    columns = [
                        batch.column(0).take(pa.array([start + d for d, _, _ in found], pa.int64())),
                        pa.array([block.ids[i] for _, i, _ in found], arrow_item),
                        pa.array([int(block.counts[i]) for _, i, _ in found], pa.int64()),
                        pa.array([n for _, _, n in found], pa.int64()),
                    ]
                    if found:
                        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return run

    out = None
    for held in item_blocks(spark, items, item_id, item_text, block_shingles):
        found = own.mapInArrow(passes(held), schema)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """``docs`` without the rows in which an item is found."""
    at = docs.columns.index(text)

    def passes(held: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaks = {s + d for s, found in _searched(held.value, batch.column(at), threshold) for d, _, _ in found}
                yield batch.take(pa.array([i for i in range(batch.num_rows) if i not in leaks], pa.int64()))

        return run

    for held in item_blocks(spark, items, item_id, item_text, block_shingles):
        docs = docs.mapInArrow(passes(held), docs.schema)
    return docs
