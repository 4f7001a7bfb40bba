"""WARC archives as seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each holding whole WARC records, and a
seek table in a skippable frame at its end. The index maps a record to (bundle, frame, offset inside
the frame's plain bytes, length), so one record costs one seek, one frame and one cut.

Bundle names carry a random part and the index rows are committed by Spark's own writer: files of a
lost or repeated task are never referred to."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowforge.llm.store import shared_folder, stage
from rowforge.operators.skew import attach

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80

INDEX = "page_id long, bundle string, frame int, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
REVISIT_BYTES = 100


def payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def plan_records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to of each row of ``pages`` (page_id, url, html).

    Payloads of at least ``revisit_bytes`` that are equal share one response, the one with the smallest
    page_id; refers_to is null for it and for every smaller payload. Rows that repeat the response's
    page_id are responses too. Rows without a page_id revisit the smallest id of their group, and are
    responses when the group has none. Other columns of ``pages`` are ignored; an empty table gives none."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload(F.col("html")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    own = F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    rows = rows.withColumn("_group", F.when(F.octet_length("payload") >= revisit_bytes, F.col("digest")).otherwise(own))
    shared = (
        pages.select("page_id", payload(F.col("html")).alias("payload"))
        .where(F.octet_length("payload") >= revisit_bytes)
        .groupBy(F.sha2("payload", 256).alias("_group"))
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1").drop("_n")
    )
    joined = attach(rows, shared, ["_group"])
    return joined.select(
        "page_id", "url", "payload", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"),
    )


def record(page_id: int | None, url: str | None, body: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit carries headers and the size of its payload, not the payload."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or 'urn:unknown', safe=':/?#[]@!$&()*+,;=%~-._')}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Truncated: length"]
    block = http if refers_to is not None else http + body
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Frames of about ``frame_bytes`` plain bytes, then the seek table."""

    def __init__(self, files: pa.fs.FileSystem, path: str, frame_bytes: int):
        self.out, self.frame_bytes = files.open_output_stream(path, compression=None), frame_bytes
        self.packer = zstandard.ZstdCompressor(level=3)
        self.entries: list[tuple[int, int, int]] = []
        self.buffer = bytearray()
        self.written = 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        """(frame, offset, length) of the record."""
        if self.buffer and len(self.buffer) + len(data) > self.frame_bytes:
            self.flush()
        place = (len(self.entries), len(self.buffer), len(data))
        self.buffer += data
        return place

    def flush(self) -> None:
        if self.buffer:
            plain = bytes(self.buffer)
            packed = self.packer.compress(plain)
            self.out.write(packed)
            self.entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            self.written += len(packed)
            self.buffer = bytearray()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + 9) + table)
        self.out.write(struct.pack("<IBI", len(self.entries), WITH_CHECKSUMS, SEEKABLE_MAGIC))
        self.out.close()


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write planned records to bundles in ``folder``; returns the index. Each task writes its own bundles."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pa.fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
        bundle, name = None, ""
        for batch in batches:
            rows = []
            for page_id, url, body, digest, refers_to in zip(*batch.to_pydict().values(), strict=True):
                if bundle is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = BundleWriter(files, f"{root}/{name}", frame_bytes)
                rows.append((page_id, name, *bundle.add(record(page_id, url, body, digest, refers_to, date))))
                if bundle.written >= bundle_bytes:
                    bundle.close()
                    bundle = None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, schema.types, strict=True)], schema=schema)
        if bundle is not None:
            bundle.close()

    return stage(records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, INDEX), "warc-index")


class BundleReader:
    """Random access by the seek table at the end of a bundle."""

    def __init__(self, folder: str, name: str):
        files, root = pa.fs.FileSystem.from_uri(folder)
        self.file = files.open_input_file(f"{root}/{name}")
        size = self.file.size()
        n, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{name} has no seek table")
        width = 12 if descriptor & WITH_CHECKSUMS else 8
        table = self.file.read_at(n * width, size - 9 - n * width)
        self.frames, at = [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<II", table, k * width)
            check = struct.unpack_from("<I", table, k * width + 8)[0] if width == 12 else None
            self.frames.append((at, packed, plain, check))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain, check = self.frames[k]
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)
        if len(data) != plain or check is not None and xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that starts at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
    stop = end + 4 + int(head["Content-Length"])
    return head, data[end + 4 : stop], stop + 4


def described(head: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    """A row of RECORDS. A response's digest is computed again and must agree with its header."""
    http, _, body = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda uri: int(text) if (text := uri.removeprefix("<urn:page:").removesuffix(">")) else None
    if head["WARC-Type"] == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
    refers_to = number(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
    return number(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], refers_to


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """All records of the bundles that ``index`` names, frame by frame."""
    bundles = index.select("bundle").distinct()
    spread = bundles.repartition(max(1, bundles.count()), F.hash("bundle"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                bundle = BundleReader(folder, name)
                for k in range(len(bundle.frames)):
                    data, at, rows = bundle.frame(k), 0, []
                    while at < len(data):
                        head, block, at = parse(data, at)
                        rows.append(described(head, block))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return spread.mapInArrow(read, RECORDS)


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write ``pages`` to bundles; the index and the folder."""
    folder = folder or shared_folder(spark, "warc")
    return write_bundles(plan_records(pages), folder), folder
