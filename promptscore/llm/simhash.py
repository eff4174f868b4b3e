"""SimHash near-duplicates by bit-sliced comparison.

Every text gets a 64-bit fingerprint of its lower-cased (A-Z) word shingles, repeats included: a bit is
set when more than half of the shingles' XXH64 have it. Texts link when their fingerprints differ in at
most ``radius`` bits, and linked texts form components.

Candidates of ``near_duplicates``: the 64 bits are cut into radius + 2 blocks. Two fingerprints within the
radius agree on at least two whole blocks, so each distinct fingerprint is filed once for every pair of
blocks under the bits of that pair (ten files of some 26 bits for radius 3). No link can be missed.
``keep_one`` takes the search for candidates only, with longer fingerprints filed under minima of the
shingles, and links texts by the exact Jaccard similarity of their sets of shingles. Pairs that this search
may miss are found by prefixes of the sets, see ``prefixes``.

Comparison: a file entry's fingerprints are laid out as vertical bit planes, 64 lanes to a word. A query
fingerprint is compared with 64 lanes at once: carry-save adders count differing bits two planes at a
time, a lane that passes the radius is marked, and words whose lanes are all marked are abandoned.
Entries larger than ``block`` are cut into slots, and every pair of slots is a group of its own, so no
task holds more than two slots. A tile of lanes already linked with the query is not compared again, and
a group yields a forest of links, never all its pairs.

Defined cases: a null or wordless text has fingerprint zero, linked like any other; fewer words than a
shingle make one shingle of all of them; rows with equal ids or equal texts each get a row; a null id
counts only if all ids of the component are null; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptscore.llm import prefixes
from promptscore.llm.components import components
from promptscore.llm.shingles import mix, portions
from promptscore.llm.words import numbered, packed, split_join, unpacked, written

SHINGLE = 3
RADIUS = 3
BLOCK = 1024
ITEMS = 1 << 13  # words of lanes compared at once
SLOT = 1 << 20  # shingles to a slot of sets that are compared exactly
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str | None, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The XXH64 of the text's word shingles in order, some at a time; none of a wordless text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return
    size = min(shingle, len(tokens))
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(tokens) - size] + 1))
    hash_of = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 16):
        pairs = zip(starts[at : at + (1 << 16)].tolist(), ends[at + size - 1 : at + size - 1 + (1 << 16)].tolist())
        yield np.array([hash_of(joined[a:b], 42) for a, b in pairs], np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The different shingles' hashes in ascending order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingles(text, shingle)]))


def fingerprint_of(parts: Iterable[np.ndarray], words: int = 1) -> list[int]:
    """The fingerprint of hashes as signed 64-bit words; the first is from the hashes, more from remixed ones."""
    total, set_bits = 0, np.zeros((words, 64), np.int64)
    for hashes in parts:
        total += len(hashes)
        for word in range(words):
            own = mix(hashes + np.uint64(word)) if word else hashes
            bits = np.unpackbits(own.view(np.uint8), bitorder="little").reshape(-1, 64)
            set_bits[word] += bits.sum(axis=0, dtype=np.int64)
    bits = (set_bits * 2 > total).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)[:, 0].tolist()


def fingerprint(text: str | None, shingle: int = SHINGLE, words: int = 1) -> list[int]:
    """The fingerprint of a text's shingles, repeats included."""
    return fingerprint_of(shingles(text, shingle), words)


def _names(words: int) -> list[str]:
    return [f"f{word}" for word in range(words)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, row_hi, row_lo, f0): the fingerprint of every row, and a hash of its id and text."""
    own = docs.select(F.col(id_col), *row_hashes(id_col, text), F.col(text).alias("_text"))
    schema = T.StructType([*own.schema.fields[:3], T.StructField("f0", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(x.as_py(), shingle)[0] for x in batch.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], prints], names=schema.names)

    return own.mapInArrow(run, schema)


class Minima:
    """File numbers of sets of hashes: a file's number is a hash of ``rows`` minima under random permutations.

    Two sets share a file with the chance J ** rows, J being their Jaccard similarity.
    """

    def __init__(self, files: int, rows: int):
        chance = np.random.default_rng(64)
        self.files, self.rows = files, rows
        self.turn, self.times = (chance.integers(0, 1 << 64, files * rows, np.uint64) for _ in range(2))
        self.times |= np.uint64(1)

    def of(self, sets: Sequence[np.ndarray]) -> np.ndarray:
        """A row of ``files`` numbers for each of the sets, none of which may be empty."""
        out = np.zeros((len(sets), self.files), np.uint64)
        sizes = [len(s) for s in sets]
        for a, b in portions(sizes, 1 << 14):
            hashes = np.concatenate(sets[a:b])
            starts = np.cumsum([0, *sizes[a : b - 1]])
            for k, (turn, times) in enumerate(zip(self.turn, self.times)):
                least = np.minimum.reduceat((hashes ^ turn) * times, starts)
                out[a:b, k // self.rows] = mix(out[a:b, k // self.rows] * times + least)
        return out


def set_prints(
    docs: DataFrame, id_col: str, text: str, shingle: int, words: int, files: int, rows: int, percent: int, classes: Broadcast
) -> DataFrame:
    """(id, row_hi, row_lo, set, f0 ..., n, bits, keys, prefix): a hash of every row's set of shingles, the set's
    fingerprint, size, bitmap and file numbers, and its prefix, which only the first row of a task with that set has.
    Repeats of a shingle do not count."""
    own = docs.select(F.col(id_col), *row_hashes(id_col, text), F.col(text).alias("_text"))
    longs = [T.StructField(c, T.LongType()) for c in ("set", *_names(words), "n")]
    lists = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("keys", "prefix")]
    schema = T.StructType([*own.schema.fields[:3], *longs, T.StructField("bits", T.BinaryType()), *lists])
    minima = Minima(files, rows)

    def listed(values: np.ndarray, sizes: Sequence[int]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(values.view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            texts = batch.column(3)
            for a, b in portions([len(x.as_buffer()) if x.is_valid else 0 for x in texts], 8 << 20):
                sets = [shingle_set(x.as_py(), shingle) for x in texts.slice(a, b - a)]
                named = [xxhash.xxh64_intdigest(s.tobytes()) for s in sets]
                prints = np.array([fingerprint_of([s], words) for s in sets], np.int64).reshape(-1, words)
                worded = [i for i, s in enumerate(sets) if len(s)]
                filed = minima.of([sets[i] for i in worded])
                first = []
                for name, s in zip(named, sets):
                    first.append(s[:0] if name in met else prefixes.prefix(s, classes.value, percent))
                    met.add(name)
                columns = [
                    *batch.slice(a, b - a).columns[:3],
                    pa.array(np.array(named, np.uint64).view(np.int64)),
                    *map(pa.array, prints.T),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([prefixes.bitmap(s) for s in sets], pa.binary()),
                    listed(filed.ravel(), [files if len(s) else 0 for s in sets]),
                    listed(np.concatenate(first), [len(s) for s in first]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return own.mapInArrow(run, schema)


def row_hashes(id_col: str, text: str) -> list[Column]:
    return [F.xxhash64(id_col, text).alias("row_hi"), F.xxhash64(F.lit("row"), text, id_col).alias("row_lo")]


class Planes:
    """Fingerprints of several groups as vertical bit planes; a tile is a word of 64 lanes of one group."""

    def __init__(self, prints: np.ndarray, sizes: np.ndarray):
        tiles_of = (sizes + 63) // 64
        self.group_tile = np.cumsum(tiles_of) - tiles_of
        start = np.cumsum(sizes) - sizes
        self.group = np.repeat(np.arange(len(sizes)), sizes)
        self.rank = np.arange(len(prints)) - start[self.group]
        self.tile = self.group_tile[self.group] + self.rank // 64
        self.lane = self.rank % 64
        self.tiles_of = tiles_of
        self.tile_row = np.zeros(int(tiles_of.sum()), np.int64)
        self.tile_row[self.tile[self.lane == 0]] = np.flatnonzero(self.lane == 0)
        words = prints.shape[1]
        lanes = np.zeros((len(self.tile_row), 64, words), np.uint64)
        lanes[self.tile, self.lane] = prints
        full = np.zeros((len(self.tile_row), 64), np.uint8)
        full[self.tile, self.lane] = 1
        self.full = np.packbits(full, axis=1, bitorder="little").view(np.uint64)[:, 0]
        self.planes = np.empty((64 * words, len(self.tile_row)), np.uint64)
        for bit in range(64 * words):
            column = ((lanes[:, :, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)).astype(np.uint8)
            self.planes[bit] = np.packbits(column, axis=1, bitorder="little").view(np.uint64)[:, 0]

    def near(self, queries: np.ndarray, tiles: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the (query, tile) items have lanes within the radius, and those lanes as words."""
        live = np.arange(len(tiles))
        size = max(1, radius.bit_length())
        head = (1 << size) - 1 - radius  # counters start here, so that the first bit past the radius overflows
        counters = [np.full(len(tiles), _ALL if head >> k & 1 else 0, np.uint64) for k in range(size)]
        past = ~self.full[tiles]
        for bit in range(0, len(self.planes), 2):
            first, second = (
                self.planes[b][tiles] ^ (((queries[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)) * _ALL)
                for b in (bit, bit + 1)
            )
            ones = counters[0]
            carry = (ones & first) | (ones & second) | (first & second)
            counters[0] = ones ^ first ^ second
            for k in range(1, size):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            past |= carry
            if bit % 16 == 14:
                kept = past != _ALL
                if np.count_nonzero(kept) < 0.8 * len(kept):
                    live, tiles, queries, past = live[kept], tiles[kept], queries[kept], past[kept]
                    counters = [c[kept] for c in counters]
        within = ~past
        hit = within != 0
        return live[hit], within[hit]


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least row of each part) after links between rows a and b."""
    while True:
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            return labels
        a, b = a[open_], b[open_]
        np.minimum.at(labels, np.maximum(la, lb)[open_], np.minimum(la, lb)[open_])
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels = jumped


def link_groups(prints: np.ndarray, sizes: np.ndarray, radius: int = RADIUS, step: int = 16) -> np.ndarray:
    """For each fingerprint the row of the least fingerprint of its group that it is linked with, itself if none."""
    planes, labels = Planes(prints, sizes), np.arange(len(prints))
    order = np.argsort(planes.rank, kind="stable")
    ranks = planes.rank[order]
    starts = planes.tile_row
    for low in range(0, int(sizes.max(initial=0)), step):
        rows = order[np.searchsorted(ranks, low) : np.searchsorted(ranks, low + step)]
        least, most = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
        for at in range(0, len(rows), 4096):
            own = rows[at : at + 4096]
            ahead = planes.tiles_of[planes.group[own]] - planes.rank[own] // 64
            item = np.repeat(np.arange(len(own)), ahead)
            tile = planes.tile[own][item] + np.arange(len(item)) - np.repeat(np.cumsum(ahead) - ahead, ahead)
            query = own[item]
            todo = (least[tile] != labels[query]) | (most[tile] != labels[query])
            query, tile = query[todo], tile[todo]
            for cut in range(0, len(query), ITEMS):
                q, t = query[cut : cut + ITEMS], tile[cut : cut + ITEMS]
                hit, lanes = planes.near(prints[q], t, radius)
                bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                which, lane = np.nonzero(bits)
                labels = _merge(labels, q[hit][which], starts[t[hit][which]] + lane)
    return labels


def _links(radius: int, words: int):
    """Links within groups of rows (key, i, j, f0 ...), which come sorted by group."""

    def close(rows: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
        sizes = np.diff(np.concatenate(([0], edge, [len(rows)])))
        signed = np.ascontiguousarray(rows[np.repeat(sizes > 1, sizes), 3:])
        labels = link_groups(signed.view(np.uint64), sizes[sizes > 1], radius)
        moved = labels != np.arange(len(labels))
        columns = [*signed[moved].T, *signed[labels[moved]].T]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_ends(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
            whole = np.concatenate(held)
            last = np.flatnonzero((whole[:, :3] != whole[-1, :3]).any(axis=1))
            done = last[-1] + 1 if len(last) else 0
            if done:
                yield close(whole[:done])
            held = [whole[done:]]
        if held and len(held[0]):
            yield close(held[0])

    return run


def _ends(words: int) -> list[str]:
    return [f"{end}{word}" for end in "ab" for word in range(words)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(radius: int = RADIUS) -> list[list[int]]:
    """Masks of all pairs of the radius + 2 blocks of one word: fingerprints within the radius agree on one."""
    edges = [64 * i // (radius + 2) for i in range(radius + 3)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [[_signed(a | b)] for a, b in combinations(blocks, 2)]


def _node(columns: list[str]) -> Column:
    """One long for a fingerprint: itself, or a hash of its words."""
    return F.col(columns[0]) if len(columns) == 1 else F.xxhash64(*columns)


def filed_by_blocks(prints: DataFrame, masks: list[list[int]]) -> DataFrame:
    """(key, f0 ...): each fingerprint once under each of the masks."""
    names = _names(len(masks[0]))
    listed = F.array(*[F.struct(*[F.lit(m).alias(f"m{k}") for k, m in enumerate(mask)]) for mask in masks])
    return prints.select(*names, F.posexplode(listed).alias("t", "m")).select(
        F.xxhash64("t", *[F.col(f).bitwiseAND(F.col(f"m.m{k}")) for k, f in enumerate(names)]).alias("key"), *names
    )


def near_links(spark: SparkSession, filed: DataFrame, root: str, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join the distinct fingerprints within the radius that are filed under one key."""
    names = [c for c in filed.columns if c != "key"]
    # The few entries above the block are a table of their own, whose size Spark knows when it plans the join.
    large = written(
        spark, filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block), f"{root}/large"
    )
    parts = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    groups = (
        filed.join(large, "key", "left")
        .select("key", *names, parts.alias("parts"), F.pmod(F.xxhash64(*names, F.lit(7)), parts).alias("slot"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), *names)
    )
    found = (
        groups.repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j", *names)
        .mapInArrow(_links(radius, len(names)), ", ".join(f"{c} long" for c in _ends(len(names))))
    )
    ends = _ends(len(names))
    return found.select(_node(ends[: len(names)]).alias("a"), _node(ends[len(names) :]).alias("b"))


def linked(
    spark: SparkSession, docs: DataFrame, root: str, id_col: str, text: str, shingle: int, radius: int, block: int
) -> tuple[DataFrame, DataFrame]:
    """(id, row_hi, row_lo, f0, node) of every row, and (node, root): the component of each fingerprint."""
    prints = fingerprints(docs, id_col, text, shingle)
    held = written(spark, prints.withColumn("node", F.col("f0")), f"{root}/prints")
    distinct = held.select("node", "f0").distinct()
    filed = filed_by_blocks(distinct, block_masks(radius))
    stars = components(spark, near_links(spark, filed, root, radius, block), f"{root}/components")
    rooted = distinct.select("node").join(stars, "node", "left")
    return held, rooted.select("node", F.coalesce("root", "node").alias("root"))


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    root: str,
    id_col: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: id, fp (64 bits), component (least id reachable by links). No link is missed."""
    held, rooted = linked(spark, docs, root, id_col, text, shingle, radius, block)
    least = held.groupBy("node").agg(F.min(id_col).alias("least")).join(rooted, "node")
    component = least.groupBy("root").agg(F.min("least").alias("component"))
    classes = split_join(least.select("node", "root"), component, ["root"]).select("node", "component")
    return split_join(held, classes, ["node"]).select(id_col, F.col("f0").alias("fp"), "component")


def similar_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the least row that is reached by links of pairs with at least that Jaccard similarity.

    A set is compared with all later ones that are not linked with it yet, by the lists of the sets that have
    each of its hashes; so copies of one text cost one comparison each.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    starts, labels = np.cumsum(sizes) - sizes, np.arange(len(sets))
    _, token = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(token, kind="stable")]
    many = np.bincount(token, minlength=1)
    begin = np.cumsum(many) - many
    for row in range(len(sets) - 1):
        open_ = (labels[row + 1 :] != labels[row]) & (
            np.minimum(sizes[row + 1 :], sizes[row]) * 100 >= np.maximum(sizes[row + 1 :], sizes[row]) * percent
        )
        if not open_.any():
            continue
        own = token[starts[row] : starts[row] + sizes[row]]
        n = many[own]
        at = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        shared = np.bincount(owner[at], minlength=len(sets))[row + 1 :]
        found = open_ & (shared * 100 >= (sizes[row] + sizes[row + 1 :] - shared) * percent)
        if found.any():
            joined = np.unique(np.append(labels[row + 1 :][found], labels[row]))
            labels[np.isin(labels, joined)] = joined[0]
    return labels


def exact_links(
    spark: SparkSession, docs: DataFrame, held: DataFrame, stars: DataFrame, root: str, id_col: str, text: str, shingle: int, percent: int, slot: int = SLOT
) -> DataFrame:
    """(a, b): links between the sets of shingles that are alike.

    Those in one component of candidates are compared with each other, and pairs that meet by their prefixes
    from different components each for itself, as a part of two. A component is cut into slots of about
    ``slot`` shingles, and every pair of slots is a group of its own.
    """
    one = held.groupBy("set", "node").agg(
        F.min(F.struct("row_hi", "row_lo")).alias("row"), F.first("n").alias("n"), F.first("bits").alias("bits")
    )
    put = split_join(one, stars, ["node"], "left").withColumn("part", F.coalesce("root", "node"))
    put = written(spark, put.select("set", "part", "row.row_hi", "row.row_lo", "n", "bits"), f"{root}/put")
    at = put.select("set", "part", "row_hi", "row_lo")
    several = put.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("part")
    pairs = prefixes.pairs(spark, held.select("set", "prefix"), put, root, percent)
    alone = pairs.select(F.xxhash64("a", "b").alias("part"), F.explode(F.array("a", "b")).alias("set"))
    suspects = split_join(at, several, ["part"]).select("set", "part", "row_hi", "row_lo").unionAll(
        split_join(alone, at.drop("part"), ["set"]).select("set", "part", "row_hi", "row_lo")
    )
    suspects = written(spark, suspects, f"{root}/suspects")
    texts = docs.select(*row_hashes(id_col, text), F.col(text).alias("_text"))
    met = split_join(packed(texts, "_text"), suspects.hint("merge"), ["row_hi", "row_lo"]).select("part", "set", "_text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), shingle) for x in unpacked(batch.column(2))]
            columns = [
                *batch.columns[:2], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "set", "n", "hashes"])

    sets = met.mapInArrow(cut, "part long, set long, n long, hashes binary").dropDuplicates(["part", "set"])
    sets = written(spark, sets, f"{root}/sets")
    slots = F.ceil(F.sum("n") / slot).cast("int")
    large = written(spark, sets.groupBy("part").agg(slots.alias("slots")).where("slots > 1"), f"{root}/large-parts")
    slotted = split_join(sets, large, ["part"], "left").select(
        "part", "set", "hashes", F.coalesce("slots", F.lit(1)).alias("slots")
    )
    slotted = slotted.withColumn("slot", F.pmod(F.xxhash64("set", F.lit(7)), F.col("slots")))
    groups = slotted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).select(
        "part", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), "set", "hashes"
    )

    def close(named: list[int], group: list[np.ndarray]) -> pa.RecordBatch:
        labels, own = similar_links(group, percent), np.array(named, np.int64)
        moved = labels != np.arange(len(labels))
        return pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(own[labels[moved]])], names=["a", "b"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, named, group = None, [], []
        for batch in batches:
            rows = zip(zip(*[c.to_pylist() for c in batch.columns[:3]]), batch.column(3).to_pylist(), batch.column(4))
            for key, name, hashes in rows:
                if key != last:
                    if len(named) > 1:
                        yield close(named, group)
                    last, named, group = key, [], []
                named.append(name)
                group.append(np.frombuffer(hashes.as_buffer().to_pybytes(), np.uint64))
        if len(named) > 1:
            yield close(named, group)

    return groups.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j", "set").mapInArrow(link, "a long, b long")


def keep_one(
    spark: SparkSession,
    docs: DataFrame,
    root: str,
    id_col: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    words: int = 4,
    radius: int = 80,
    files: int = 40,
    rows: int = 5,
    block: int = 8192,
    percent: int = 80,
) -> DataFrame:
    """``docs`` with one document of each component: the least id (nulls last), one of equal rows.

    Two texts are linked when their sets of five-word shingles have a Jaccard similarity of ``percent`` in a
    hundred or more, which is computed exactly. Candidates: a text is filed under ``files`` hashes of ``rows``
    minima, of which two texts at 0.8 have none in common with a chance of about one in ten million (for some
    texts, one in a hundred thousand), and those in one file are compared by fingerprints of 256 bits, which differ
    in some 39 bits at 0.8 and in 48 for four shingles against five, with a standard deviation of six, so that
    hardly any pass the radius. All sets that candidates connect are then compared, whether they were
    candidates themselves or not. Pairs that are not connected so meet by their prefixes, which leaves out none.
    """
    classes = prefixes.frequency_classes(docs, text, partial(shingle_set, shingle=shingle))
    classes = spark.sparkContext.broadcast(classes)
    prints = set_prints(docs, id_col, text, shingle, words, files, rows, percent, classes)
    names = _names(words)
    held = written(spark, prints.withColumn("node", _node(names)), f"{root}/prints")
    filed = held.select(*names, F.posexplode("keys").alias("t", "k")).select(
        F.xxhash64("t", "k").alias("key"), *names
    ).distinct()
    stars = components(spark, near_links(spark, filed, root, radius, block), f"{root}/candidates")
    links = exact_links(spark, docs, held, stars, root, id_col, text, shingle, percent)
    roots = components(spark, links, f"{root}/components").withColumnRenamed("node", "set")
    first = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), "row_hi", "row_lo")
    best = (
        held.groupBy("set")
        .agg(F.min(first).alias("first"))
        .join(roots, "set", "left")
        .groupBy(F.coalesce("root", "set").alias("root"))
        .agg(F.min("first").alias("f"))
    )
    kept = best.select("f.row_hi", "f.row_lo")
    plain, name = numbered(docs)
    keyed = plain.select("*", *row_hashes(name[id_col], name[text]))
    met = packed(keyed, name[text]).join(kept.hint("merge"), ["row_hi", "row_lo"], "left_semi")
    chosen = met.dropDuplicates(["row_hi", "row_lo"]).select(*[F.col(new).alias(old) for old, new in name.items()])
    at = docs.columns.index(text)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = unpacked(columns[at])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return chosen.mapInArrow(unpack, docs.schema)
