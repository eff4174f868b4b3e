"""Byte-level BPE encoding and decoding by two-tier lookup.

A text is cut into pre-tokens by the public pattern. Tier one: a minimal perfect hash over the vocabulary
(hash and displace) gives every pre-token one slot; if that slot's bytes are the pre-token's, its id is the
answer. Tier two: other pre-tokens are merged from single bytes, with a heap of (rank, position) over a
doubly linked list of the bytes, so a pre-token of n bytes takes O(n log n) whatever its length.

Stretches between white space recur, so each Python worker remembers the ids of recent ones; the memory is
cleared when it holds ``MEMORY`` entries and changes no result. The hash's tables are built once and sent
with the task; their size is that of the vocabulary. ``round_trips`` decodes the ids of many texts at once,
by taking their tokens from an Arrow array.

Defined cases: a null text encodes as the empty one, to no ids, which decode to nothing; lone surrogates
cannot occur in Spark strings; equal rows give equal rows; null ids of rows are kept; texts are encoded
whole whatever their length; other columns are ignored or passed on; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptscore.llm.shingles import portions

MEMORY = 600_000
REMEMBERED = 64  # longest stretch, in code points, that is remembered
PORTION = 1 << 20  # bytes of text that are encoded and decoded at once
# The code points with Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Stretches that the pattern never joins: words of Latin letters apart from the mark that ends them, other
#: runs without white space, and white space; a space before a run belongs to it.
_STRETCH = re.compile(
    f" ?[{_LATIN}]+(?=[.,]?(?:[{WHITE}]|\\Z))|[.,](?=[{WHITE}]|\\Z)| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]"
)


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one token in base64 and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys, n slots, one displacement per bucket of some four keys."""

    def __init__(self, keys: Iterable[bytes], values: Iterable[int]):
        keys, values = list(keys), np.fromiter(values, np.int64)
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 4)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, n)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        taken, at = np.zeros(n, bool), np.zeros(n, np.int64)
        self.displacement = [0] * self.buckets
        for b in np.argsort(edges[:-1] - edges[1:], kind="stable"):
            members = order[edges[b] : edges[b + 1]]
            own = hashes[members]
            for first in range(0, 1 << 40, 64):
                slots = self._slots(own[None, :], np.arange(first, first + 64, dtype=np.uint64)[:, None])
                free = ~taken[slots].any(axis=1)
                if len(members) > 1:
                    ordered = np.sort(slots, axis=1)
                    free &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if free.any() or not len(members):
                    k = int(np.argmax(free))
                    self.displacement[b] = first + k
                    taken[slots[k]] = True
                    at[members] = slots[k]
                    break
        back = np.empty(n, np.int64)
        back[at] = np.arange(n)
        self.keys = [keys[i] for i in back]
        self.values = values[back].tolist()

    def _slots(self, hashes: np.ndarray, displacement: np.ndarray) -> np.ndarray:
        mixed = (hashes ^ (displacement * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displacement[h % self.buckets]
        mixed = ((h ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        slot = (mixed >> 32) % self.n
        return self.values[slot] if self.keys[slot] == key else None


class Remembered(dict):
    """What ``make`` returned for a key, at most ``most`` of them; long keys are made anew each time."""

    def __init__(self, make: Callable, most: int):
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= REMEMBERED:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class ByteBPE:
    """Encoder and decoder for one vocabulary and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.whole = PerfectHash(ranks.keys(), ranks.values())
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
        self._remember()

    def _remember(self) -> None:
        self.memory = Remembered(self._stretch, MEMORY)  # stretch -> ids as unsigned 32-bit integers
        self.known = Remembered(self._merged, MEMORY // 6)  # pre-token outside the vocabulary -> the same

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("memory", "known")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._remember()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token outside the vocabulary: always the lowest rank first, then the leftmost."""
        ranks, n = self.ranks, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # an entry's end is the start of the next
        heap = []
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or after[j] != end:
                continue
            gone[j] = 1
            after[i] = end
            if end < n:
                before[end] = i
                rank = ranks.get(piece[i : after[end]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, after[end]))
            h = before[i]
            if h >= 0:
                rank = ranks.get(piece[h:end])
                if rank is not None:
                    heapq.heappush(heap, (rank, h, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def _merged(self, raw: bytes) -> bytes:
        return array("I", self.merge(raw)).tobytes()

    def piece(self, raw: bytes) -> bytes:
        """Ids of one pre-token: by the perfect hash, else by merging."""
        whole = self.whole.get(raw)
        return self.known[raw] if whole is None else array("I", (whole,)).tobytes()

    def _stretch(self, stretch: str) -> bytes:
        return b"".join([self.piece(x.encode("utf-8", "surrogatepass")) for x in self.pieces.findall(stretch)])

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text, as unsigned 32-bit integers."""
        return np.frombuffer(b"".join(map(self.memory.__getitem__, _STRETCH.findall(text or ""))), np.uint32)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def strings(self, form: Callable[[int, bytes], bytes]) -> pa.LargeBinaryArray:
        """``form(rank, token)`` at the place of every rank, null where there is none."""
        places = range(max(self.token, default=-1) + 1)
        return pa.array([form(r, self.token[r]) if r in self.token else None for r in places], pa.large_binary())


def coder(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    """The coder of a rank file, built once and sent to every worker; its size is the vocabulary's."""
    return spark.sparkContext.broadcast(ByteBPE(load_ranks(path), pattern))


def _int_lists(lists: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64))).astype(np.int32)
    values = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def taken(strings: pa.LargeBinaryArray, lists: list[np.ndarray]) -> list[memoryview]:
    """Per list the strings at its ids, one after the other."""
    if not any(map(len, lists)):
        return [memoryview(b"")] * len(lists)
    found = strings.take(pa.array(np.concatenate(lists)))
    ends = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    at = np.frombuffer(found.buffers()[1], np.int64)[found.offset + ends].tolist()
    data = memoryview(found.buffers()[2] or b"")
    return [data[a:b] for a, b in zip(at, at[1:])]


def encode_documents(docs: DataFrame, coder: Broadcast, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of each whole text as a list of ints."""
    kept = docs.drop(out)
    at = kept.columns.index(text)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _int_lists([coder.value.encode(x.as_py()) for x in batch.column(at)])
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=schema.names)

    return kept.mapInArrow(run, schema)


def tokenised(docs: DataFrame, coder: Broadcast, text: str = "text") -> DataFrame:
    """``docs`` with token_ids, n_tokens and decodes: whether the ids decode to the bytes of the text."""
    kept = docs.drop("token_ids", "n_tokens", "decodes")
    at = kept.columns.index(text)
    added = [
        T.StructField("token_ids", T.ArrayType(T.IntegerType())),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("decodes", T.BooleanType()),
    ]
    schema = T.StructType([*kept.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what earlier steps left in a worker that is used again
        bpe = coder.value
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(at)), 0).to_pylist()
            for a, b in portions(sizes, PORTION):  # a whole batch with its ids would be many times as large
                batch = whole.slice(a, b - a)
                texts = [x or "" for x in batch.column(at).to_pylist()]
                lists = [bpe.encode(t) for t in texts]
                same = [bpe.decode(i.tolist()) == t.encode("utf-8", "surrogatepass") for i, t in zip(lists, texts)]
                counts = pa.array([len(i) for i in lists], pa.int64())
                columns = [*batch.columns, _int_lists(lists), counts, pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(run, schema)


def decode_documents(docs: DataFrame, coder: Broadcast, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that the ids stand for; null ids decode to nothing."""
    kept = docs.drop(out)
    at = kept.columns.index(ids)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = coder.value.decode
        for batch in batches:
            texts = [decode(x.as_py() or []) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=schema.names)

    return kept.mapInArrow(run, schema)


def round_trips(docs: DataFrame, coder: Broadcast, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): both directions in one pass, without passing ids between them."""
    own = docs.select(F.col(id_col), F.col(text).alias("_text"))
    schema = T.StructType(
        [
            own.schema[0],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder.value
        tokens, decimals = bpe.strings(lambda _, token: token), bpe.strings(lambda rank, _: b"%d," % rank)
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in portions(sizes, PORTION):
                lists = [bpe.encode(x) for x in batch.column(1).slice(a, b - a).to_pylist()]
                counts += map(len, lists)
                ids_sha += [hashlib.sha256(x[:-1]).hexdigest() for x in taken(decimals, lists)]
                decoded_sha += [hashlib.sha256(x).hexdigest() for x in taken(tokens, lists)]
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(zip(schema.names, [c.type for c in columns]))))

    return own.mapInArrow(run, schema)
