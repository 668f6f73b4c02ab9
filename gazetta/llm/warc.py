"""WARC archives in seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each with one or more whole records,
and a skippable footer frame with the sizes of all frames (the public seekable
format), so that any frame can be read alone. The index, a table, maps each record
to its bundle, frame and offset inside the frame.

Tasks write bundles under names of their own attempt; only bundles that the index lists
count, so a lost and repeated task leaves no wrong records behind.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, picked, salted_left_join, shuffle_partitions, written

FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 32 * 1024 * 1024
#: Fixed values of the seekable format.
_SKIPPABLE, _FOOTER_MAGIC = 0x184D2A5E, 0x8F92EAB1
_DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, bundle string, frame int, frame_start long, frame_bytes long, offset long, length long"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub(r"^s3[an]:", "s3:", path)
    if re.match(r"[a-z][a-z0-9+.-]+:", path):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if re.match(r"file:/[^/]", path) else path)
    return pafs.LocalFileSystem(), path


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    value = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response or revisit record; a revisit has the headers of its payload only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_uri(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(frame: bytes, offset: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at an offset of a frame."""
    end = frame.index(b"\r\n\r\n", offset)
    lines = frame[offset:end].decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    start = end + 4
    stop = start + int(headers["Content-Length"])
    return headers, frame[start:stop], stop + 4


class BundleWriter:
    """Writes frames to one file and closes it with the seek table."""

    def __init__(self, path: str):
        self.path, self.sizes, self.at = path, [], 0
        files, name = filesystem(path)
        files.create_dir(name.rpartition("/")[0], recursive=True)
        self.out = files.open_output_stream(name, compression=None)
        self.zstd = zstandard.ZstdCompressor(level=3)

    def frame(self, data: bytes) -> tuple[int, int, int]:
        """(number, start, bytes) of the frame that holds the data."""
        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.sizes.append((len(packed), len(data)))
        start, self.at = self.at, self.at + len(packed)
        return len(self.sizes) - 1, start, len(packed)

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _FOOTER_MAGIC)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(start, bytes, bytes of data) of each frame, from the bundle's footer."""
    size = file.size()
    file.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != _FOOTER_MAGIC:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * count)
    out, at = [], 0
    for packed, data in struct.iter_unpack("<II", file.read(8 * count)):
        out.append((at, packed, data))
        at += packed
    return out


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Writes a record per row into bundles under `path`; returns the index.

    Of rows with equal payloads of at least `least` bytes the one with the largest id is
    a response and the others revisit it; rows that repeat that id are
    responses too. A null payload is empty, a null url is about:blank; a null id is smaller
    than all others. Other columns are ignored; an empty table writes nothing.
    """
    rows = picked(pages, page_id=(id_col, "long"), url=(url_col, "string"), payload=(payload_col, "string"))
    rows = rows.withColumn("payload", F.encode(F.coalesce("payload", F.lit("")), "utf-8"))
    rows = rows.withColumn("sha", F.when(F.octet_length("payload") >= least, F.unhex(F.sha2("payload", 256))))
    groups = rows.filter("sha IS NOT NULL").groupBy("sha").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    roles = salted_left_join(rows, groups, "sha").select("page_id", "url", "payload", "owner")
    names = [f.split()[0] for f in INDEX.split(", ")]
    types = [pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        label = f"{path}/bundle-{task.partitionId():06d}-{task.taskAttemptId()}"
        bundle: BundleWriter | None = None
        made = 0
        held: list[tuple[int | None, int, int]] = []
        data = bytearray()
        done: list[tuple] = []

        def flush() -> None:
            nonlocal bundle, made
            if not held:
                return
            if bundle is None:
                bundle = BundleWriter(f"{label}-{made}.warc.zst")
                made += 1
            number, start, size = bundle.frame(bytes(data))
            done.extend((page, bundle.path, number, start, size, at, length) for page, at, length in held)
            held.clear()
            data.clear()
            if bundle.at >= BUNDLE_BYTES:
                bundle.close()
                bundle = None

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], schema=schema)
            done.clear()
            return out

        for batch in batches:
            for page, url, body, owner in zip(*(batch[c] for c in ("page_id", "url", "payload", "owner")), strict=True):
                page, owner = page.as_py(), owner.as_py()
                one = record(page, url.as_py(), body.as_py(), owner, owner is not None and owner != page)
                held.append((page, len(data), len(one)))
                data += one
                if len(data) >= FRAME_BYTES:
                    flush()
            if done:
                yield sent()
        flush()
        if bundle is not None:
            bundle.close()
        if done:
            yield sent()

    return written(roles.mapInArrow(write, INDEX), "warc-index")


_READ = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
])
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def describe(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    http, _, body = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
    claimed = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = headers["WARC-Type"] == "revisit"
    if not revisit and (len(body) != size or digest(body) != claimed):
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    refers = page_of(headers["WARC-Refers-To"]) if revisit else None
    return page_of(headers["WARC-Record-ID"]), size, claimed, headers["WARC-Type"], refers, headers["WARC-Target-URI"], body if payloads and not revisit else None


def read_warc(index: DataFrame, payloads: bool = True) -> DataFrame:
    """All records that an index lists: each frame is read alone, by its place in the bundle, and each record
    by its offset in the frame.

    Each payload is checked against its digest; a revisit has no payload. An empty index gives an empty result.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzstd = zstandard.ZstdDecompressor()
        for batch in batches:
            for path, start, packed, offsets in zip(*(batch[c].to_pylist() for c in ("bundle", "frame_start", "frame_bytes", "offsets")), strict=True):
                files, name = filesystem(path)
                with files.open_input_file(name) as file:
                    file.seek(start)
                    frame = unzstd.decompressobj().decompress(file.read(packed))
                rows = []
                for at in offsets:
                    headers, block, _ = parse(frame, at)
                    rows.append(describe(headers, block, payloads))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ.types, strict=True)], schema=_READ)

    # a frame has few records: FRAME_BYTES and one record at most
    frames = index.groupBy("bundle", "frame", "frame_start", "frame_bytes").agg(F.collect_list("offset").alias("offsets"))
    dealt = frames.repartition(shuffle_partitions(index.sparkSession), "bundle", "frame")
    return dealt.mapInArrow(read, READ)


def read_record(bundle: str, frame_start: int, frame_bytes: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record, by reading and unpacking only its frame."""
    files, name = filesystem(bundle)
    with files.open_input_file(name) as file:
        file.seek(frame_start)
        frame = zstandard.ZstdDecompressor().decompressobj().decompress(file.read(frame_bytes))
    headers, block, _ = parse(frame, offset)
    return headers, block


def warc_round_trip(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes the pages to archives and returns what reading them back gives."""
    at = path or fresh_dir(pages.sparkSession, f"warc-{uuid.uuid4().hex[:8]}")
    return read_warc(write_warc(pages, at, id_col, url_col, payload_col), payloads=False).drop("url", "payload")
