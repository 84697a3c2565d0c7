"""WARC records in seekable Zstandard bundles with a record index."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators.staging import shared_folder, staged

FRAME_BYTES = 1 << 20  # records of a frame, before compression
BUNDLE_BYTES = 1 << 30  # compressed bytes after which a task starts another bundle
MIN_REVISIT_BYTES = 100
SMALL_DIGESTS = 200_000  # digests sent to every executor at most

# Fixed values of the seekable Zstandard and WARC formats.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<II")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:page:"
CRAWL_DATE = "2024-01-01T00:00:00Z"  # of pages whose table has no date


def _urn(page) -> str:
    return f"<{RECORD_URN}{'' if page is None else page}>"


def _page(urn: str) -> str | None:
    return urn.removeprefix(f"<{RECORD_URN}").removesuffix(">") or None


def record_bytes(page, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with HTTP headers only."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    target = (url or f"{RECORD_URN}{page}").replace("\r", "%0D").replace("\n", "%0A")
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page)}",
        f"WARC-Date: {CRAWL_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """(fields of the record that starts at ``at``, where the next one starts)."""
    stop = data.index(b"\r\n\r\n", at)
    head = dict(
        line.split(": ", 1) for line in data[at:stop].decode().split("\r\n")[1:]
    )
    start = stop + 4
    end = start + int(head["Content-Length"])
    body = data.index(b"\r\n\r\n", start, end) + 4
    http = dict(line.split(": ", 1) for line in data[start : body - 4].decode().split("\r\n")[1:])
    kind = head["WARC-Type"]
    payload = data[body:end] if kind == "response" else None
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
    return {
        "page": _page(head["WARC-Record-ID"]),
        "kind": kind,
        "payload": payload,
        "bytes": int(http["Content-Length"]) if payload is None else len(payload),
        "digest": digest,
        "refers_to": _page(head["WARC-Refers-To"]) if kind == "revisit" else None,
    }, end + 4


class BundleWriter:
    """Appends records to one file of independent frames and ends it with a seek table."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.out = files.open_output_stream(path, compression=None)
        self.compress = zstandard.ZstdCompressor(level=3).compress
        self.entries: list[tuple[int, int]] = []
        self.frame = bytearray()
        self.written = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset inside the frame) where the record will stand."""
        if self.frame and len(self.frame) + len(record) > FRAME_BYTES:
            self._flush()
        place = len(self.entries), len(self.frame)
        self.frame += record
        return place

    def _flush(self) -> None:
        packed = self.compress(bytes(self.frame))
        self.out.write(packed)
        self.entries.append((len(packed), len(self.frame)))
        self.written += len(packed)
        self.frame = bytearray()

    def close(self) -> None:
        if self.frame:
            self._flush()
        table = b"".join(ENTRY.pack(*e) for e in self.entries)
        table += FOOTER.pack(len(self.entries), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


def seek_table(file) -> list[tuple[int, int]]:
    """(position, compressed size) of every frame, from the end of a bundle."""
    size = file.size()
    file.seek(size - FOOTER.size)
    count, flags, magic = FOOTER.unpack(file.read(FOOTER.size))
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("no seek table at the end of the bundle")
    file.seek(size - FOOTER.size - count * ENTRY.size)
    places, at = [], 0
    for packed, _ in ENTRY.iter_unpack(file.read(count * ENTRY.size)):
        places.append((at, packed))
        at += packed
    return places


def read_frame(file, place: tuple[int, int]) -> bytes:
    file.seek(place[0])
    return zstandard.ZstdDecompressor().decompressobj().decompress(file.read(place[1]))


def read_record(bundle: str, frame: int, offset: int) -> dict:
    """One record by its index entry: only its frame is read and decompressed."""
    files, path = fs.FileSystem.from_uri(bundle)
    with files.open_input_file(path) as file:
        return parse_record(read_frame(file, seek_table(file)[frame]), offset)[0]


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        writer = name = None
        for batch in batches:
            pages, places = [], []
            for page, url, text, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    name = f"part-{context.partitionId():05d}-{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(files, f"{root}/{name}")
                record = record_bytes(page, url, text.encode(), digest, refers)
                places.append((f"{folder}/{name}", *writer.add(record), len(record)))
                pages.append(page)
                if writer.written >= BUNDLE_BYTES:
                    writer.close()
                    writer = None
            columns = list(zip(*places)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(pages, batch.schema.field(0).type), pa.array(columns[0], pa.string()),
                    pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                    pa.array(columns[3], pa.int64()),
                ],
                names=["page_id", "bundle", "frame", "offset", "length"],
            )
        if writer is not None:
            writer.close()

    return write


def write_bundles(
    pages: DataFrame,
    folder: str | None = None,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
) -> DataFrame:
    """Write a WARC record per row and return the index of all records.

    Among rows with equal payloads of at least ``MIN_REVISIT_BYTES`` the one with the
    smallest id is the response, the others revisit it; digests are counted before they are
    shuffled, and the few that repeat are sent to the executors (or joined by a shuffle
    beyond ``SMALL_DIGESTS``), so payloads are not shuffled. Every task packs its rows into
    frames of about 1 MB that can be decompressed alone, with a seek table at the end of
    each bundle. A repeated task writes new files; only files that the index names count.

    Index: ``page_id``, ``bundle``, ``frame``, ``offset`` (inside the decompressed frame)
    and ``length``. ``folder`` must lie on storage that all executors share (default: a new
    folder under ``spark.checkpoint.dir``). A null payload is empty; rows that repeat the
    smallest id with the same payload are responses too; a null url becomes a URN; a null
    id is kept, never referred to while its group has other ids; an empty table gives an
    empty index. Other columns are ignored, so their names cannot clash.
    """
    spark = pages.sparkSession
    if folder is None:
        folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    rows = pages.select(
        F.col(id_column).alias("page_id"),
        F.col(url_column).cast("string").alias("url"),
        F.coalesce(F.col(payload_column), F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    repeated = staged(
        rows.where(F.octet_length("payload") >= MIN_REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .select("digest", "first"),
        "digests",
    )
    few = repeated.count() <= SMALL_DIGESTS
    planned = rows.join(F.broadcast(repeated) if few else repeated, "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"),
    )
    kind = planned.schema["page_id"].dataType.simpleString()
    index = planned.mapInArrow(
        _writer(folder),
        f"page_id {kind}, bundle string, frame long, offset long, length long",
    )
    return staged(index, "warc-index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = ("page", "bytes", "digest", "kind", "refers_to")
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    for batch in batches:
        for bundle in batch.column(0).to_pylist():
            files, path = fs.FileSystem.from_uri(bundle)
            with files.open_input_file(path) as file:
                for place in seek_table(file):
                    data, at, found = read_frame(file, place), 0, []
                    while at < len(data):
                        record, at = parse_record(data, at)
                        found.append([record[f] for f in fields])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=list(fields)
                    )


def read_bundles(spark: SparkSession, index: DataFrame) -> DataFrame:
    """All records of the bundles that an index names, one task per bundle or few.

    Result: ``page_id`` (as in the index), ``payload_bytes`` and ``payload_digest`` of the
    full payload (of a response recomputed and compared, of a revisit from its headers),
    ``record_type`` and ``refers_to``. A damaged bundle or payload fails the read.
    """
    bundles = staged(index.select("bundle").distinct(), "bundles")
    tasks = max(1, min(bundles.count(), 10_000))
    kind = index.schema["page_id"].dataType
    rows = bundles.repartition(tasks, "bundle").mapInArrow(
        _read, "page string, bytes long, digest string, kind string, refers_to string"
    )
    return rows.select(
        F.col("page").cast(kind).alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
