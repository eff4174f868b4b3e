"""Token ids as length-delimited binary records, with a separate offset index.

Texts are ordered by id over range partitions, and every task encodes its range with the tokenizers library
and writes record files of some ``file_bytes`` bytes to the shared folder:

    record   u64 payload length | u32 masked CRC of the length | payload | u32 masked CRC of the payload
    payload  u8 "has an id" | u8 bytes per token id, 2 or 4 | 6 zero bytes | i64 id | token ids, the end id last
    index    u64 offset of the record | u64 payload length | i64 id      (file.idx beside file.rec)

All numbers are little-endian; CRC is the CRC-32 of zlib, masked as ((c >> 15) | (c << 17)) + 0xa282ead8.
The index allows records to be read in any order (``read_shuffled``) without reading the file through.

File names carry a random part, and a table of the files that successful tasks wrote is the manifest: files
of lost or repeated tasks are not in it and are never used. The first token's position over all documents
comes from sums per file, per partition and per thousand partitions; no task sees more than one of these.

Token ids take two bytes each where the vocabulary allows it. Words between white space are encoded once
and remembered (the cuts are ones that the tokenizer makes anyway); the memory is cleared at ``MEMORY``
entries and changes no result. Strings of the tokenizer's added tokens are one token each wherever they stand
in a text, also inside a word, as the tokenizer has it by default.

Defined cases: a null text is the empty one and gets the end id alone; null ids come first; rows with equal
ids follow each other by hash of the text; other columns are ignored; an empty table writes no files and
gives an empty result. Ids must be integers.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptscore.llm.shingles import Words, portions
from promptscore.llm.words import whole, written

FILE_BYTES = 8 << 20
MEMORY = 700_000
REMEMBERED = 64  # longest stretch, in code points, that is remembered
_HEAD = "<QI"
_ID = "<BB6xq"
_HEAD_SIZE, _ID_SIZE = struct.calcsize(_HEAD), struct.calcsize(_ID)


class StretchEncoder:
    """Ids of texts by a tokenizer that drops white space, lower-cases, and never joins across white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.definition = file.read()
        self._added()
        self.memory, self.tokenizer = {}, None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "memory": {}, "tokenizer": None}

    def _added(self) -> None:
        """The added tokens' ids by their strings, which are cut out of a text before anything else is done to it."""
        added = json.loads(self.definition).get("added_tokens") or []
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens must stand for exactly their own string")
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers.

        Words are told apart by a 64-bit hash, and each different one of these texts is looked up once.
        The stretches between added tokens are looked up like texts of their own.
        """
        if self.tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(self.definition)
        pieces = [self.cut.split(t) if t and self.cut and self.cut.search(t) else [t] for t in texts]
        encoded = self._encode_plain([p for own in pieces for p in own[::2]])
        out, at = [], 0
        for own in pieces:
            plain = encoded[at : at + len(own) // 2 + 1]
            at += len(plain)
            if len(own) > 1:
                added = [np.array([self.added[p]], "<u4") for p in own[1::2]]
                plain = [np.concatenate([x for pair in zip(plain, [*added, plain[0][:0]]) for x in pair])]
            out += plain
        return out

    def _encode_plain(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of texts without added tokens."""
        words = Words(texts, marks=True)
        different, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        parts = list(map(self.memory.get, different.tolist()))
        new = [i for i, part in enumerate(parts) if part is None]
        bounds = zip(words.starts[first[new]].tolist(), words.ends[first[new]].tolist())
        strings = [words.joined[a:b].decode("utf-8", "surrogatepass") for a, b in bounds]
        if len(self.memory) + len(new) > MEMORY:
            self.memory.clear()
        for i, s, own in zip(new, strings, self._encode_words(strings)):
            parts[i] = own
            if len(s) <= REMEMBERED:
                self.memory[int(different[i])] = parts[i]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat, start = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size
        count = size[which]
        total = np.cumsum(count)
        ids = flat[np.repeat(start[which] - (total - count), count) + np.arange(int(count.sum()))]
        per_text = np.bincount(words.owner, count, len(texts)).astype(np.int64)
        return np.split(ids, np.cumsum(per_text)[:-1])

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of single words. Those without "!" go to the tokenizer many at a time, with "!" between them,
        whose one id no other text has."""
        (mark,) = self.tokenizer.encode("!", add_special_tokens=False).ids
        plain = [i for i, w in enumerate(words) if "!" not in w]
        rest = [i for i, w in enumerate(words) if "!" in w]
        texts = [" ! ".join([words[i] for i in plain[k : k + 256]]) + " !" for k in range(0, len(plain), 256)]
        encoded = self.tokenizer.encode_batch_fast(texts + [words[i] for i in rest], add_special_tokens=False)
        out = [b""] * len(words)
        if plain:
            ids = np.concatenate([np.array(e.ids, "<u4") for e in encoded[: len(texts)]])
            ends = np.flatnonzero(ids == mark).tolist()
            data, start = ids.tobytes(), 0
            for i, end in zip(plain, ends):
                out[i] = data[4 * start : 4 * end]
                start = end + 1
        for i, e in zip(rest, encoded[len(texts) :]):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join(
        (length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload)))
    )


def payload_of(record_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack(_ID, record_id is not None, width, record_id or 0) + ids.astype(f"<u{width}").tobytes()


def parse_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    """(id, token ids as unsigned 32-bit integers)."""
    has_id, width, record_id = struct.unpack_from(_ID, payload)
    return (record_id if has_id else None), np.frombuffer(payload, f"<u{width}", offset=_ID_SIZE).astype("<u4")


def read_frames(data: bytes) -> Iterator[bytes]:
    """Payloads of a record file; ValueError where a length or a checksum is wrong."""
    at = 0
    while at < len(data):
        if at + _HEAD_SIZE > len(data):
            raise ValueError(f"a record is cut off at {at}")
        length, crc = struct.unpack_from(_HEAD, data, at)
        if masked_crc(data[at : at + 8]) != crc or at + 16 + length > len(data):
            raise ValueError(f"wrong length at {at}")
        payload = data[at + 12 : at + 12 + length]
        if masked_crc(payload) != struct.unpack_from("<I", data, at + 12 + length)[0]:
            raise ValueError(f"wrong checksum at {at}")
        yield payload
        at += 16 + length


def read_shuffled(record_file: str, index_file: str, seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, token ids) of one file's records in a random order, read one by one by the index."""
    files, path = fs.FileSystem.from_uri(record_file)
    with files.open_input_stream(fs.FileSystem.from_uri(index_file)[1]) as stream:
        index = np.frombuffer(stream.read(), np.dtype([("offset", "<u8"), ("length", "<u8"), ("id", "<i8")]))
    with files.open_input_file(path) as data:
        for i in np.random.default_rng(seed).permutation(len(index)):
            data.seek(int(index["offset"][i]))
            (payload,) = read_frames(data.read(int(index["length"][i]) + 16))
            yield parse_payload(payload)


class _Writer:
    """One task's record files."""

    def __init__(self, folder: str, part: int, file_bytes: int, width: int):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.width = width
        self.part, self.file_bytes, self.sequence, self.records = part, file_bytes, 0, None

    def add(self, record_id: int | None, ids: np.ndarray) -> tuple | None:
        """The finished file, where this record ends one."""
        if self.records is None:
            self.name = f"{self.part:06d}-{self.sequence:06d}-{uuid.uuid4().hex}"
            self.records = self.files.open_output_stream(f"{self.folder}/{self.name}.rec")
            self.index, self.offset, self.tokens = [], 0, 0
        payload = payload_of(record_id, ids, self.width)
        self.records.write(frame(payload))
        self.index.append(struct.pack("<QQq", self.offset, len(payload), record_id or 0))
        self.offset += len(payload) + 16
        self.tokens += len(ids)
        return self.close() if self.offset >= self.file_bytes else None

    def close(self) -> tuple | None:
        if self.records is None:
            return None
        self.records.close()
        self.records = None
        with self.files.open_output_stream(f"{self.folder}/{self.name}.idx") as stream:
            stream.write(b"".join(self.index))
        self.sequence += 1
        return self.name, self.part, self.sequence - 1, len(self.index), self.tokens


def _uri(spark: SparkSession, root: str) -> str:
    """The folder as Spark's readers name it, with its file system."""
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{root}/place")
    uri = spark.read.parquet(f"{root}/place").inputFiles()[0].rsplit("/place/", 1)[0]
    return uri if "://" in uri else uri.replace("file:/", "file:///", 1)


def write_records(
    spark: SparkSession,
    docs: DataFrame,
    encoder: Broadcast,
    root: str,
    end_id: int = 1,
    max_id: int = 49_407,
    id_col: str = "doc_id",
    text: str = "text",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Writes the records under ``root``/records; the manifest: (name, part, sequence, records, tokens)."""
    folder = f"{_uri(spark, root)}/records"
    own = docs.select(F.col(id_col).cast("long").alias("id"), whole(F.col(text)).alias("text"))
    ordered = own.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h")
    end, width = np.array([end_id], "<u4"), 2 if max(max_id, end_id) < 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["name", "part", "sequence", "records", "tokens"]
        fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
        writer = _Writer(folder, TaskContext.get().partitionId(), file_bytes, width)
        done = []
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in portions([len(x.as_buffer()) for x in texts], 3 << 20):
                encoded = encoder.value.encode(texts.slice(a, b - a).to_pylist())
                done += [writer.add(i, np.concatenate((e, end))) for i, e in zip(ids.slice(a, b - a).to_pylist(), encoded)]
        done = [d for d in [*done, writer.close()] if d]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)

    schema = "name string, part long, sequence long, records long, tokens long"
    return written(spark, ordered.select("id", "text").mapInArrow(run, schema), f"{root}/manifest")


def file_starts(manifest: DataFrame) -> DataFrame:
    """(name, file_start): tokens in all files before each."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select(
        "name",
        "part",
        F.coalesce(F.sum("tokens").over(before(Window.partitionBy("part").orderBy("sequence"))), F.lit(0)).alias("a"),
    )
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("n")).withColumn("block", F.expr("part div 1000"))
    blocks = parts.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select(
        "block", F.coalesce(F.sum("n").over(before(Window.partitionBy(F.lit(0)).orderBy("block"))), F.lit(0)).alias("c")
    )
    parts = parts.select(
        "part",
        "block",
        F.coalesce(F.sum("n").over(before(Window.partitionBy("block").orderBy("part"))), F.lit(0)).alias("b"),
    )
    joined = files.join(parts, "part").join(blocks, "block")
    return joined.select("name", (F.col("a") + F.col("b") + F.col("c")).alias("file_start"))


def read_records(spark: SparkSession, root: str, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every record of the manifest's files, read from the files.

    Raises where a checksum is wrong. Files outside the manifest are read too, but whatever is in them,
    also broken records, is dropped by name.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.rec")
        .option("recursiveFileLookup", "true")
        .load(f"{root}/*/")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["name", "id", "in_file", "n_tokens", "crc", "fault"]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, at, fault = [], 0, None
                try:
                    for payload in read_frames(content.as_buffer().to_pybytes()):
                        record_id, ids = parse_payload(payload)
                        rows.append((name, record_id, at, len(ids), zlib.crc32(ids.tobytes()), None))
                        at += len(ids)
                except ValueError as error:
                    fault = str(error)
                    rows.append((name, None, 0, 0, 0, fault))
                types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                columns = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    named = raw.select(F.regexp_extract("path", r"([^/]+)\.rec$", 1).alias("name"), "content")
    records = named.mapInArrow(run, "name string, id long, in_file long, n_tokens long, crc long, fault string")
    return records.join(file_starts(manifest), "name").select(
        F.col("id").alias(id_col),
        F.when(F.col("fault").isNotNull(), F.raise_error(F.concat_ws(": ", "name", "fault")).cast("long"))
        .otherwise(F.col("in_file") + F.col("file_start"))
        .alias("start"),
        "n_tokens",
        F.col("crc").alias("ids_crc32"),
    )
