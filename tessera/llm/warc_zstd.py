"""Seekable Zstandard WARC bundles.

Records are grouped into independent Zstandard frames; a footer seek table (a skippable frame with the sizes of
all frames) makes each frame reachable by itself, and an index table maps record ids to (bundle, frame, offset
in the frame's content, length). Bundles are written under a name of their own attempt and renamed when whole;
only those that the index names are ever read, so tasks may fail and run again.

Defined results: null html is an empty payload; null url leaves the target out; a null page_id is written without
a number; rows that share page_id and payload with the largest page_id are all responses; extra columns are
ignored; an empty table gives no bundle and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, new_path

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 28
LEAST_REVISIT = 1000
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "bundle string, record_id string, page_id long, frame int, offset long, length long"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, kind: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(page_id)}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{record_id(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return "urn:page:" + ("" if page_id is None else str(page_id))


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields (names in lower case), block, and the end of the record that starts at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    start, n = end + 4, int(head["content-length"])
    return head, data[start : start + n], start + n + 4


def content(head: dict[str, str], block: bytes) -> tuple[str, int, str, bytes | None]:
    """Type, full payload size, bare hex digest and, of a response, the payload (checked against its digest)."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    if head["warc-type"] == "revisit":
        return "revisit", size, digest, None
    if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload does not match its digest")
    return head["warc-type"], size, digest, payload


def page_of(uri: str | None) -> int | None:
    number = (uri or "").strip("<>").removeprefix("urn:page:")
    return int(number) if number else None


class BundleWriter:
    """Frames of whole records, then the seek table. ``out`` is a binary stream."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.out, self.frame_bytes, self.frames, self.buffer, self.size, self.written = out, frame_bytes, [], [], 0, 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Frame, offset in its content, and length of the record."""
        place = (len(self.frames), self.size, len(data))
        self.buffer.append(data)
        self.size += len(data)
        if self.size >= self.frame_bytes:
            self._flush()
        return place

    def _flush(self) -> None:
        if self.size:
            frame = self.zstd.compress(b"".join(self.buffer))
            self.out.write(frame)
            self.frames.append((len(frame), self.size))
            self.written += len(frame)
            self.buffer, self.size = [], 0

    def close(self) -> None:
        self._flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class BundleReader:
    """Random access by frame; ``file`` has read, seek and size."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        file.seek(size - 9 - 8 * n)
        sizes = list(struct.iter_unpack("<II", file.read(8 * n)))
        self.places, at = [], 0
        for packed, whole in sizes:
            self.places.append((at, packed, whole))
            at += packed

    def frame(self, k: int) -> bytes:
        import zstandard

        at, packed, whole = self.places[k]
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=whole)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def classify(pages: DataFrame) -> DataFrame:
    """page_id, url, html with payload_digest, record_type and refers_to.

    Equal payloads are found by SHA-256; per digest one row with the largest page_id is summed up before the
    shuffle, and only digests seen twice or more are joined (a hot one is split by the adaptive skew join)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha2(html, 256).alias("__key"))
    large = own.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("__key").agg(F.max("page_id").alias("__origin"), F.count("*").alias("__n"))
    origin = large.where("__n > 1").select("__key", "__origin")
    revisit = F.col("__origin").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__origin"))
    return own.join(origin, "__key", "left").select(
        "page_id", "url", "html", F.sha1("html").alias("payload_digest"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("__origin")).alias("refers_to")
    )


def write(pages: DataFrame, out_dir: str) -> DataFrame:
    """Writes bundles of ``pages`` to out_dir (a URI all executors reach); the index, materialized."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(out_dir)
        fs.create_dir(root, recursive=True)
        rows, writer, stream, temporary, name = [], None, None, None, None

        def finish() -> pa.RecordBatch:
            writer.close()
            stream.close()
            fs.move(temporary, f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["bundle", "record_id", "page_id", "frame", "offset", "length"])

        for b in batches:
            for page_id, url, html, digest, kind, refers_to in zip(*b.columns, strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    temporary = f"{root}/.{name}.part"
                    stream = fs.open_output_stream(temporary)
                    rows, writer = [], BundleWriter(stream)
                data = record(page_id.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), refers_to.as_py(), kind.as_py())
                rows.append((name, record_id(page_id.as_py()), page_id.as_py(), *writer.add(data)))
                if writer.written >= BUNDLE_BYTES:
                    yield finish()
                    writer = None
        if writer:
            yield finish()

    return materialize(classify(pages).mapInArrow(run, INDEX), "warc-index")


def _rows(head: dict[str, str], block: bytes) -> tuple:
    kind, size, digest, _ = content(head, block)
    return page_of(head["warc-record-id"]), size, digest, kind, page_of(head.get("warc-refers-to"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read(spark: SparkSession, index: DataFrame, out_dir: str) -> DataFrame:
    """Every record that the index names, from its frame and the offset there; payloads are checked against their
    digests, ids and lengths against the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(out_dir)
        file = bundle = name = frame = None
        data = b""
        try:
            for b in batches:
                rows = []
                for own, rid, k, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if own != name:
                        if file:
                            file.close()
                        name, frame, file = own, None, fs.open_input_file(f"{root}/{own}")
                        bundle = BundleReader(file)
                    if k != frame:
                        frame, data = k, bundle.frame(k)
                    head, block, end = parse(data, offset)
                    if end - offset != length or head["warc-record-id"] != f"<{rid}>":
                        raise ValueError(f"{rid} is not where the index has it")
                    rows.append(_rows(head, block))
                yield _batch(rows)
        finally:
            if file:
                file.close()

    # A bundle is read by one task, frame by frame.
    bundles = max(1, index.select("bundle").distinct().count())
    places = index.select("bundle", "record_id", "frame", "offset", "length").repartition(min(10_000, bundles), "bundle").sortWithinPartitions("bundle", "frame", "offset")
    return places.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def lookup(index: DataFrame, wanted: DataFrame, out_dir: str) -> DataFrame:
    """page_id and payload of the wanted page ids by seeking to their frames; of revisits, the response's payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(out_dir)
        for b in batches:
            out = []
            for name, frame, offset in zip(b["bundle"].to_pylist(), b["frame"].to_pylist(), b["offset"].to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as file:
                    head, block, _ = parse(BundleReader(file).frame(frame), offset)
                out.append((page_of(head["warc-record-id"]), page_of(head.get("warc-refers-to")), content(head, block)[3]))
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["page_id", "refers_to", "payload"])

    schema = "page_id long, refers_to long, payload binary"
    ids = wanted.select(F.col("page_id").cast("long")).distinct()
    first = index.join(ids, "page_id", "left_semi").select("bundle", "frame", "offset").mapInArrow(run, schema)
    targets = first.where("payload is null").select(F.col("refers_to").alias("page_id")).distinct()
    second = index.join(targets, "page_id", "left_semi").select("bundle", "frame", "offset").mapInArrow(run, schema).select(F.col("page_id").alias("refers_to"), F.col("payload").alias("__p")).dropDuplicates(["refers_to"])
    return first.join(second, "refers_to", "left").select("page_id", F.coalesce("payload", "__p").alias("payload"))


def round_trip(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    out_dir = new_path(spark, "warc")
    return read(spark, write(pages, out_dir), out_dir)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS origin FROM p WHERE strlen(h) >= 1000 GROUP BY h HAVING count(*) > 1)
SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN g.origin IS NOT NULL AND p.page_id IS DISTINCT FROM g.origin THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id IS DISTINCT FROM g.origin THEN g.origin END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""
