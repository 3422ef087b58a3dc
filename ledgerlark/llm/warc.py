"""Operator 1: WARC archives as seekable Zstandard bundles.

Records are grouped into frames that are compressed independently; a bundle is some frames and, in
a skippable frame at its end, the seek table of the published seekable format. Beside it stands the
map from record identifiers to frame, offset in the frame, and length. A reader opens one record by
reading the footer, one frame and a slice of it.

Bundles are rows of a table (name, data, index) that Spark writes to the shared folder: executors
have no other way to a store that only Spark reaches. Each row's `data` is a complete .warc.zst file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import make, pieces
from .scratch import Scratch

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 4 << 20
#: Magic numbers of the seekable format: skippable frame, and the end of the seek table. Fixed values.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"
#: Record identifiers carry the page's number; revisits name the identifier of their response.
_SPACE = b"ldglark\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=_SPACE + struct.pack('>q', page_id))}>"


def page_of(identifier: str) -> int | None:
    raw = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).bytes
    return struct.unpack(">q", raw[8:])[0] if raw[:8] == _SPACE else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, serial: bytes = b"") -> bytes:
    """One WARC/1.1 record. A revisit has no block; its payload's digest and length are in the headers."""
    own = record_id(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, (url or '') + digest(payload) + serial.hex())}>"
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", str(len(payload)))]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    block = b"" if revisit else payload
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at an offset, and the next record's offset."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    body = end + 4
    size = int(head["Content-Length"])
    return head, data[body : body + size], body + size + 4


class Bundle:
    """Collects records; `finish` gives the archive and the index of its records."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.frames, self.open, self.size, self.total, self.index = frame_bytes, [], [], 0, 0, []
        self.zstd = zstandard.ZstdCompressor(level=3)

    def add(self, identifier: str, data: bytes) -> None:
        if self.size and self.size + len(data) > self.frame_bytes:
            self._close()
        self.index.append((identifier, len(self.frames), self.size, len(data)))
        self.open.append(data)
        self.size += len(data)
        self.total += len(data)

    def _close(self) -> None:
        self.frames.append((self.zstd.compress(b"".join(self.open)), self.size))
        self.open, self.size = [], 0

    def finish(self) -> tuple[bytes, list[tuple[str, int, int, int]]]:
        if self.size:
            self._close()
        entries = b"".join(struct.pack("<II", len(f), n) for f, n in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        table = struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer
        return b"".join(f for f, _ in self.frames) + table, self.index


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, from the footer."""
    n, descriptor, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE or descriptor & 0x7C:
        raise ValueError("no seek table")
    width = 12 if descriptor & 0x80 else 8
    at, out = len(data) - 9 - n * width, []
    offset = 0
    for k in range(n):
        c, d = struct.unpack_from("<II", data, at + k * width)
        out.append((offset, c, d))
        offset += c
    return out


def read_frame(data: bytes, frame: int) -> bytes:
    offset, c, d = seek_table(data)[frame]
    return zstandard.ZstdDecompressor().decompress(data[offset : offset + c], max_output_size=max(d, 1))


def read_record(data: bytes, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index: only its frame is decompressed."""
    return parse(read_frame(data, frame)[offset : offset + length])[:2]


BUNDLES = "bundle string, data binary, index array<struct<record_id:string,frame:int,offset:bigint,length:bigint>>"


def write_bundles(pages: DataFrame, scratch: Scratch, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """The pages as a written table of bundles (see BUNDLES); one record per row.

    Of rows with equal payloads of at least `min_bytes` bytes, the one with the smallest key is a
    response and the others revisit it; smaller payloads are all responses. Null html is an empty
    payload; null urls have no target; rows with a null key are responses, as are exact repeats of
    the smallest key. A record larger than a frame or bundle has one of its own. An empty table has
    no bundles.
    """
    rows = pages.select(F.col(key).cast("bigint").alias("_id"), F.col(url).cast("string").alias("_url"), F.coalesce(F.col(html), F.lit("")).alias("_html"))
    rows = rows.withColumn("_sha", F.sha1(F.col("_html").cast("binary")))
    # only digests that occur again are kept: this table is small beside the pages and is joined, not collected
    groups = rows.where(F.octet_length("_html") >= min_bytes).groupBy("_sha").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    firsts = scratch.write(groups.where("_n > 1 and _first is not null").select("_sha", "_first"))
    joined = rows.join(firsts, "_sha", "left").select("_id", "_url", "_html", "_first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
        schema = pa.schema([("bundle", pa.string()), ("data", pa.binary()), ("index", index)])

        def made(b: Bundle) -> pa.RecordBatch:
            data, places = b.finish()
            name = hashlib.sha1(data).hexdigest() + ".warc.zst"
            return make(schema, [name], [data], pa.array([[dict(zip(("record_id", "frame", "offset", "length"), p, strict=True)) for p in places]], index))

        bundle, serial = Bundle(frame_bytes), 0
        for batch in pieces(batches, "_html"):
            for i, u, h, first in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                revisit = first is not None and i is not None and i > first
                serial += 1
                data = record(i, u, h.encode(), first, revisit, serial.to_bytes(8, "big"))
                if bundle.total and bundle.total + len(data) > bundle_bytes:
                    yield made(bundle)
                    bundle = Bundle(frame_bytes)
                bundle.add(parse(data)[0]["WARC-Record-ID"], data)
        if bundle.total:
            yield made(bundle)

    return scratch.write(joined.mapInArrow(run, BUNDLES), compression="uncompressed")


RECORDS = "record_id string, page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"


def read_bundles(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the bundles (see RECORDS), frame by frame from the seek tables.

    A response whose payload does not have the digest in its header raises an error.
    payloads=False leaves the payload column null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for cell in batch.column("data"):
                data = cell.as_py()
                for frame in range(len(seek_table(data))):
                    raw, at, out = read_frame(data, frame), 0, []
                    while at < len(raw):
                        head, block, at = parse(raw, at)
                        sha, revisit = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "revisit"
                        if not revisit and digest(block) != sha:
                            raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                        refers = page_of(head["WARC-Refers-To"]) if revisit else None
                        out.append((head["WARC-Record-ID"], page_of(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Type"], sha, int(head["X-Payload-Length"]), refers, block if payloads and not revisit else None))
                    yield make(schema, *map(list, zip(*out, strict=True)))

    return bundles.select("data").mapInArrow(run, RECORDS)


def query(pages: DataFrame) -> DataFrame:
    scratch = Scratch(pages.sparkSession, "warc")
    return read_bundles(write_bundles(pages, scratch), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
