"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a skippable frame at the end of a bundle
lists the compressed and plain size of every frame (the seekable format), and an index maps record ids
to frame number, offset inside the frame and length. A reader needs the footer and one frame."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescout.llm.common import written

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20

# Fixed values of the formats.
_SKIPPABLE = 0x184D2A5E
_SEEKABLE = 0x8F92EAB1
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ENTRY = pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("start", pa.int32()), ("length", pa.int32())])
_BUNDLE = "bundle string, archive binary, entries array<struct<record_id:string,frame:int,start:int,length:int>>"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def page_of(name: str) -> int | None:
    page = name.split(":")[2]
    return int(page) if page else None


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> tuple[str, bytes]:
    """Record id and bytes. A revisit keeps the head of the response and the length and digest of the
    full payload, but not the payload."""
    digest = sha1_base32(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    name = record_id(page_id, digest)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {_SAME_PAYLOAD}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return name, "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record; `payload` is None for a revisit. Raises if a response's digest is not its payload's."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.decode().rpartition("Content-Length: ")[2])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or sha1_base32(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    refers = fields.get("WARC-Refers-To")
    return {
        "page_id": page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": length,
        "payload_digest": digest, "record_type": kind, "refers_to": page_of(refers) if refers else None,
        "payload": payload if kind == "response" else None,
    }


class BundleWriter:
    """Collects records into frames and frames into one bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.zstd = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[int] = []
        self.entries: list[dict] = []
        self.open = bytearray()

    def add(self, name: str, record: bytes) -> None:
        self.entries.append({"record_id": name, "frame": len(self.frames), "start": len(self.open), "length": len(record)})
        self.open += record
        if len(self.open) >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            self.frames.append(self.zstd.compress(bytes(self.open)))
            self.sizes.append(len(self.open))
            self.open = bytearray()

    @property
    def size(self) -> int:
        return sum(map(len, self.frames)) + len(self.open)

    def finish(self) -> bytes:
        self._close_frame()
        table = b"".join(struct.pack("<II", len(f), n) for f, n in zip(self.frames, self.sizes))
        footer = struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", _SKIPPABLE, len(table) + len(footer)) + table + footer


def seek_table(archive: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of every frame, from the footer alone."""
    count, _, magic = struct.unpack("<IBI", archive[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    frames, at = [], 0
    for compressed, plain in struct.iter_unpack("<II", archive[-9 - 8 * count : -9]):
        frames.append((at, compressed, plain))
        at += compressed
    return frames


def read_frame(archive: bytes, frame: int) -> bytes:
    at, compressed, plain = seek_table(archive)[frame]
    return zstandard.ZstdDecompressor().decompress(archive[at : at + compressed], max_output_size=plain)


def read_record(archive: bytes, entry: dict) -> dict:
    """One record by its index entry: decompresses its frame only."""
    return parse_record(read_frame(archive, entry["frame"])[entry["start"] : entry["start"] + entry["length"]])


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds refers_to: the largest page_id among the rows of equal payload (at least `least_bytes`), null for
    that row itself and for unique payloads. Rows that repeat the largest page_id are responses each;
    rows without page_id revisit, unless no row of the payload has one.

    Copies are counted by digest before anything is joined; a payload that fills a third of the table is
    one row on the other side, so the join's hot partition can be split."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.withColumn("_digest", F.sha1(payload)).withColumn("_bytes", F.length(payload))
    keepers = (
        keyed.groupBy("_digest").agg(F.max("page_id").alias("_keeper"), F.count(F.lit(1)).alias("_n"))
        .where((F.col("_n") > 1) & F.col("_keeper").isNotNull()).drop("_n")
    )
    again = (F.col("_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("_keeper"))
    return keyed.join(keepers, "_digest", "left").withColumn("refers_to", F.when(again, F.col("_keeper"))).drop(
        "_digest", "_bytes", "_keeper"
    )


def write_bundles(
    pages: DataFrame, least_bytes: int = 0, bundle_bytes: int = BUNDLE_BYTES, date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Bundles (bundle, archive, entries) of pages(page_id, url, html), stored in the shared folder.

    Null html is an empty payload. One bundle holds at most about `bundle_bytes` of compressed frames
    unless a single record is larger; a task keeps one open bundle. Other columns are not stored."""
    rows = with_revisits(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), least_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, writer = TaskContext.get().partitionId(), 0, BundleWriter()

        def closed() -> pa.RecordBatch:
            nonlocal made, writer
            name, entries = f"part-{part:05d}-{made:05d}.warc.zst", writer.entries
            row = [pa.array([name]), pa.array([writer.finish()], pa.binary()), pa.array([entries], pa.list_(_ENTRY))]
            made, writer = made + 1, BundleWriter()
            return pa.RecordBatch.from_arrays(row, ["bundle", "archive", "entries"])

        for batch in batches:
            columns = (batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "refers_to"))
            for page_id, url, html, refers_to in zip(*columns):
                html = html.as_py()
                writer.add(*make_record(page_id.as_py(), url.as_py(), html.encode() if html else b"", refers_to.as_py(), date))
                if writer.size >= bundle_bytes:
                    yield closed()
        if writer.entries:
            yield closed()

    return written(rows.mapInArrow(run, _BUNDLE), "warc")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """All records of the bundles: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html
    (null for revisits). Frames are read one at a time and records found by their entries."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, entries in zip(batch.column(0), batch.column(1)):
                archive, frame, plain, rows = archive.as_py(), -1, b"", []
                for entry in entries.as_py():
                    if entry["frame"] != frame:
                        if rows:
                            yield packed(rows)
                        frame, rows = entry["frame"], []
                        plain = read_frame(archive, frame)
                    rows.append(parse_record(plain[entry["start"] : entry["start"] + entry["length"]]))
                if rows:
                    yield packed(rows)

    def packed(rows: list[dict]) -> pa.RecordBatch:
        for r in rows:
            r["html"] = None if r["payload"] is None else r["payload"].decode()
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
    return bundles.select("archive", "entries").mapInArrow(run, schema)
