"""Pages as WARC archives, and a salvage reader that gets past damaged bytes.

Writing. Every page is one record whose payload is its html in UTF-8 (null: empty), behind a short HTTP
response head. Pages with equal payloads (SHA-1 and length) are stored once: the one with the largest
page_id (then the earliest row) is a ``response`` record, the others are ``revisit`` records of the
identical-payload-digest profile that refer to it and keep only the HTTP head, which still states the
payload's length. The choice is an aggregate per digest joined back to the pages, so a digest shared by a
third of all pages is a hot join key that adaptive execution splits. Each task writes its rows as
gzip-compressed records (one gzip member per record) to files of about ``file_bytes`` in the shared
folder; the files that successful tasks wrote are the manifest, and no other file is ever read.

Reading. A file's gzip members are read one after another; a record must have a version line, a
Content-Length that fits, and a block digest and (for responses) a payload digest that match. After a failed
check the reader searches forward for the next gzip member start or, in uncompressed text, the next
``WARC/1.`` version line, reads on from there, and logs the skipped byte range as a quarantined gap. A file
is read by one task and held in memory, which ``file_bytes`` bounds.

Defined cases: null html is the empty payload; a null page_id is written without a page id, reads back as
null, and loses to every other id; equal page_ids with equal payloads give one response, the others
revisit it; a null url leaves out the target URI; control characters of a url are percent-encoded; an empty
table writes no files and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptscore.llm.token_records import _uri
from promptscore.llm.words import written

FILE_BYTES = 64 << 20
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_RECORDS = (
    "file string, offset long, record_type string, page_id long, refers_to long, payload_bytes long, "
    "payload_digest string"
)
_GAPS = "file string, start long, end long, reason string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record_id(page_id: int | None, digest: str, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{row}')}>"


def _uri_field(url: str | None) -> str | None:
    if url is None:
        return None
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def _http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def record(page_id, url, payload: bytes, response_row: int, response_page, row: int, is_response: bool) -> bytes:
    """One gzip member holding one WARC record."""
    digest = base32_sha1(payload)
    block = _http_head(len(payload)) + (payload if is_response else b"")
    fields = [
        ("WARC-Type", "response" if is_response else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest, row)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri_field(url)),
        ("WARC-Page-ID", "" if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
    ]
    if not is_response:
        fields += [
            ("WARC-Refers-To", record_id(response_page, digest, response_row)),
            ("WARC-Refers-To-Page-ID", "" if response_page is None else str(response_page)),
            ("WARC-Profile", PROFILE),
        ]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return gzip_member(head.encode("utf-8") + block + b"\r\n\r\n")


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Files:
    """One task's archive files."""

    def __init__(self, folder: str, part: int, file_bytes: int):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.part, self.file_bytes, self.sequence, self.stream, self.done = part, file_bytes, 0, None, []

    def add(self, member: bytes) -> None:
        if self.stream is None:
            self.name = f"{self.part:06d}-{self.sequence:06d}-{uuid.uuid4().hex}.warc.gz"
            self.stream, self.size, self.records = self.files.open_output_stream(f"{self.folder}/{self.name}", compression=None), 0, 0
        self.stream.write(member)
        self.size, self.records = self.size + len(member), self.records + 1
        if self.size >= self.file_bytes:
            self.close()

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.done.append((self.name, self.records, self.size))
            self.stream, self.sequence = None, self.sequence + 1


def write_archives(spark: SparkSession, pages: DataFrame, root: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives under ``root``/warc; the manifest: (name, records, bytes)."""
    folder = f"{_uri(spark, root)}/warc"
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.monotonically_increasing_id().alias("row"),
    ).select("*", F.sha1("payload").alias("sha1"), F.length("payload").alias("size"))
    # the response of each payload: largest page_id, then earliest row; a struct's null field is the smallest
    chosen = rows.groupBy("sha1", "size").agg(
        F.max(F.struct("page_id", (-F.col("row")).alias("neg_row"))).alias("best")
    )
    decided = rows.join(chosen, ["sha1", "size"]).select(
        "page_id", "url", "payload", "row",
        F.col("best.page_id").alias("response_page"),
        (-F.col("best.neg_row")).alias("response_row"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
        files = _Files(folder, TaskContext.get().partitionId(), file_bytes)
        for batch in batches:
            for page, url, data, row, response_page, response_row in zip(*[c.to_pylist() for c in batch.columns]):
                files.add(record(page, url, data, response_row, response_page, row, row == response_row))
        files.close()
        if files.done:
            names, counts, sizes = zip(*files.done)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["name", "records", "bytes"])

    manifest = decided.mapInArrow(run, "name string, records long, bytes long")
    return written(spark, manifest, f"{root}/manifest")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no version line")
    out = {}
    for line in lines[1:]:
        if line:
            key, sep, value = line.partition(":")
            if not sep:
                raise ValueError("bad header line")
            out[key.strip().lower()] = value.strip()
    return out


def parse_record(data: bytes) -> tuple:
    """(record_type, page_id, refers_to, payload_bytes, payload_digest) of one record's bytes, or ValueError."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("no end of header")
    fields = _fields(data[:end])
    length = int(fields["content-length"])
    block = data[end + 4 : end + 4 + length]
    if len(block) != length or data[end + 4 + length :] != b"\r\n\r\n":
        raise ValueError("content length does not fit")
    if fields.get("warc-block-digest") != f"sha1:{base32_sha1(block)}":
        raise ValueError("block digest")
    split = block.find(b"\r\n\r\n")
    http = block[:split].decode("latin-1").split("\r\n")
    stated = int(next(line.split(":", 1)[1] for line in http if line.lower().startswith("content-length:")))
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    page = int(fields["warc-page-id"]) if fields.get("warc-page-id") else None
    if kind == "response":
        payload = block[split + 4 :]
        if len(payload) != stated or base32_sha1(payload) != digest:
            raise ValueError("payload digest")
        return kind, page, None, len(payload), digest
    if kind != "revisit":
        raise ValueError(f"record type {kind}")
    refers = int(fields["warc-refers-to-page-id"]) if fields.get("warc-refers-to-page-id") else None
    return kind, page, refers, stated, digest


def salvage(data: bytes) -> tuple[list[tuple], list[tuple]]:
    """([(offset, *parse_record)], [(start, end, reason)]) of one archive file's bytes."""
    records, gaps, at = [], [], 0
    while at < len(data):
        try:
            if data.startswith(_GZIP, at):
                unpacker, pieces, pos, view = zlib.decompressobj(31), [], at, memoryview(data)
                while not unpacker.eof and pos < len(data):
                    chunk = view[pos : pos + (1 << 16)]
                    pieces.append(unpacker.decompress(chunk))
                    pos += len(chunk)
                if not unpacker.eof:
                    raise ValueError("member ends early")
                end, content = pos - len(unpacker.unused_data), b"".join(pieces)
            elif data.startswith(_VERSION, at):
                head_end = data.find(b"\r\n\r\n", at)
                if head_end < 0:
                    raise ValueError("no end of header")
                end = head_end + 8 + int(_fields(data[at:head_end])["content-length"])
                content = data[at:end]
            else:
                raise ValueError("no record starts here")
            records.append((at, *parse_record(content)))
            at = end
        except (ValueError, KeyError, StopIteration, UnicodeDecodeError, zlib.error) as error:
            starts = [p for p in (data.find(_GZIP, at + 1), data.find(_VERSION, at + 1)) if p >= 0]
            nxt = min(starts) if starts else len(data)
            gaps.append((at, nxt, str(error) or type(error).__name__))
            at = nxt
    return records, gaps


def _read(spark: SparkSession, root: str, manifest: DataFrame, want_gaps: bool) -> DataFrame:
    folder = f"{_uri(spark, root)}/warc"
    names = manifest.select("name").repartition("name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    data = stream.read()
                records, gaps = salvage(data)
                if want_gaps:
                    columns = list(zip(*gaps)) if gaps else [[], [], []]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(gaps), pa.string()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                        names=["file", "start", "end", "reason"],
                    )
                else:
                    columns = list(zip(*records)) if records else [[]] * 6
                    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                    arrays = [pa.array([name] * len(records), pa.string())] + [pa.array(c, t) for c, t in zip(columns, types)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["file", "offset", "record_type", "page_id", "refers_to", "payload_bytes", "payload_digest"])

    return names.mapInArrow(run, _GAPS if want_gaps else _RECORDS)


def read_archives(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """Every record that passes its checks: (file, offset, record_type, page_id, refers_to, payload_bytes, payload_digest)."""
    return _read(spark, root, manifest, want_gaps=False)


def quarantined(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """The byte ranges the reader skipped: (file, start, end, reason)."""
    return _read(spark, root, manifest, want_gaps=True)


def archived_pages(spark: SparkSession, pages: DataFrame, root: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, read back from its archive."""
    manifest = write_archives(spark, pages, root, file_bytes)
    return read_archives(spark, root, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
