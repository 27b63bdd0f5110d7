"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames, so a record is read by decompressing its frame
alone. A bundle is a file of

    frames     of about FRAME_BYTES of records each
    index      a skippable frame: for every record its id, frame, offset in the frame's content
               and length
    seek table a skippable frame in the seekable format: per frame its compressed and its full
               size and a checksum, closed by a footer

Spark's text writer places the files, and ends each frame with an empty skippable frame of 8
bytes, so the footer lies 8 bytes before the end of a file. Any Zstandard reader unpacks a
bundle to plain WARC/1.1.

Of equal payloads one record is a response; the others are revisits that refer to it and repeat
its digest and HTTP header, but no payload.
"""

from __future__ import annotations

import base64
import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shuffle_partitions
from .common import freeze

FRAME_BYTES = 1 << 20  # of records before compression; a larger record is a frame of its own
BUNDLE_BYTES = 128 << 20  # of payload for one file, about
LEVEL = 3  # of compression

# Magic numbers of skippable frames and of the seek table's footer, and the record
# form of the WARC format.
INDEX_MAGIC = 0x184D2A5D
SEEK_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80
GAP = "\x50\x2a\x4d\x18\x00\x00\x00\x00"  # an empty skippable frame
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

_SEEK = np.dtype([("packed", "<u4"), ("full", "<u4"), ("checksum", "<u4")])
_INDEX = np.dtype([("frame", "<u4"), ("offset", "<u8"), ("length", "<u8"), ("id", "<u4")])


def record_id(page: int | None, row: int) -> str:
    """The id of a record: that of its page, and a number for pages with the same id."""
    return f"urn:page:{'' if page is None else page}:{row}"


def page_of(record: str) -> int | None:
    page = record.split(":")[2]
    return int(page) if page else None


def _plain(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(
    name: str, url: str | None, date: str, payload: bytes, digest: str, first: str | None
) -> bytes:
    """One record; a revisit of the record `first` if there is one."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if first else http + payload
    head = {
        "WARC-Type": "revisit" if first else "response",
        "WARC-Record-ID": f"<{name}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else _plain(url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": PROFILE if first else None,
        "WARC-Refers-To": f"<{first}>" if first else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return VERSION + lines.encode() + b"\r\n" + block + END


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return dict(line.split(": ", 1) for line in lines if ": " in line)


def parse(data: bytes) -> dict:
    """The parts of one record; raises if it is cut short or its payload is not its digest's."""
    if not data.startswith(VERSION) or not data.endswith(END):
        raise ValueError("no whole record")
    head, _, rest = data[len(VERSION) :].partition(END)
    fields = _fields(head)
    block = rest[: int(fields["Content-Length"])]
    if len(block) + len(END) != len(rest):
        raise ValueError(f"{fields['WARC-Record-ID']}: wrong length")
    http, _, payload = block.partition(END)
    size = int(_fields(http)["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or _digest(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: not the payload that was written")
    first = fields.get("WARC-Refers-To")
    return {
        "record_id": fields["WARC-Record-ID"][1:-1],
        "url": fields.get("WARC-Target-URI"),
        "warc_date": fields["WARC-Date"],
        "record_type": kind,
        "payload_digest": digest,
        "payload_bytes": size,
        "refers_to_record": first[1:-1] if first else None,
        "payload": payload if kind == "response" else None,
    }


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class Bundle:
    """Frames of one file, one after the other, and its index and seek table at the end."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes = frame_bytes
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.held: list[bytes] = []
        self.size = 0
        self.frames = 0
        self.seek: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []
        self.names: list[bytes] = []

    def add(self, name: str, data: bytes) -> bytes | None:
        """Take a record; returns the frame that it closes, if any."""
        out = self.close() if self.held and self.size + len(data) > self.frame_bytes else None
        self.index.append((self.frames, self.size, len(data), len(name)))
        self.names.append(name.encode())
        self.held.append(data)
        self.size += len(data)
        return out

    def close(self) -> bytes:
        content = b"".join(self.held)
        packed = self.packer.compress(content)
        self._seen(len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF)
        self.held, self.size, self.frames = [], 0, self.frames + 1
        return packed

    def _seen(self, packed: int, full: int, checksum: int) -> None:
        nothing = xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF
        self.seek += [(packed, full, checksum), (len(GAP), 0, nothing)]

    def end(self) -> bytes:
        """Index and seek table."""
        entries = np.array(self.index, dtype=_INDEX).tobytes()
        index = _skippable(
            INDEX_MAGIC, struct.pack("<I", len(self.index)) + entries + b"".join(self.names)
        )
        self.seek.append((len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = np.array(self.seek, dtype=_SEEK)
        footer = struct.pack("<IBI", len(table), CHECKSUMS, FOOTER_MAGIC)
        return index + _skippable(SEEK_MAGIC, table.tobytes() + footer)


def seek_table(content: bytes) -> list[tuple[int, int, int, int]]:
    """(place in the file, compressed size, full size, checksum) of every frame of a bundle,
    read from its end."""
    content = content[: -len(GAP)]
    n, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != FOOTER_MAGIC or flags != CHECKSUMS:
        raise ValueError("no seek table at the end of the bundle")
    table = np.frombuffer(content[-9 - n * _SEEK.itemsize : -9], dtype=_SEEK)
    ends = np.cumsum(table["packed"].astype(np.int64))
    return list(
        zip(
            (ends - table["packed"]).tolist(), table["packed"].tolist(),
            table["full"].tolist(), table["checksum"].tolist(), strict=True,
        )
    )


def entries(content: bytes) -> tuple[list[tuple[int, int, int, int]], list[tuple[str, int, int, int]]]:
    """Frames with content, and (record id, frame, offset, length) of every record."""
    table = seek_table(content)
    at, size = table[-1][:2]
    index = content[at + 8 : at + size]
    (n,) = struct.unpack("<I", index[:4])
    names_at = 4 + n * _INDEX.itemsize
    rows = np.frombuffer(index[4:names_at], dtype=_INDEX)
    ends = (names_at + np.cumsum(rows["id"].astype(np.int64))).tolist()
    names = [index[e - k : e].decode() for e, k in zip(ends, rows["id"].tolist(), strict=True)]
    places = [rows[c].tolist() for c in ("frame", "offset", "length")]
    return table[:-1:2], list(zip(names, *places, strict=True))


def records_of(content: bytes, wanted: set[str] | None = None) -> Iterator[bytes]:
    """Records of a bundle, whole; only frames that hold one of `wanted` are decompressed."""
    frames, index = entries(content)
    held, data = -1, b""
    unpack = zstandard.ZstdDecompressor()
    for name, frame, offset, length in index:
        if wanted is not None and name not in wanted:
            continue
        if frame != held:
            at, packed, full, checksum = frames[frame]
            data, held = unpack.decompress(content[at : at + packed], max_output_size=full), frame
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
                raise ValueError(f"frame {frame} is damaged")
        yield data[offset : offset + length]


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    least_bytes: int = 0,
    frame_bytes: int = FRAME_BYTES,
) -> None:
    """Write one record for every row of `pages` to bundles below `path`.

    Null payloads are empty. Of equal payloads of `least_bytes` or more the row with the smallest
    id is a response (a null id is larger than any; of rows with one id, any), the others are
    revisits of it; smaller ones are all responses. Payloads are equal if length and SHA-256 are.
    Null and repeated ids and equal rows are records of their own, told apart by a number in the
    record id. A null URL gives no URI; control characters in one are percent-encoded. Strings are
    written as UTF-8. An empty table writes no bundle. Other columns are not read.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
    ).withColumns({"row": F.monotonically_increasing_id(), "size": F.octet_length("payload")})
    rows = freeze(rows.withColumn("key", F.unhex(F.sha2("payload", 256))), "records")
    size = rows.agg(F.sum("size")).first()[0] or 0
    parts = max(shuffle_partitions(pages.sparkSession), math.ceil(size / BUNDLE_BYTES))

    # Who comes first is found on narrow rows; payloads are moved once, by row.
    order = F.struct(F.col("page").isNull().alias("none"), "page", "row")
    named = rows.filter(F.col("size") >= least_bytes).select("key", "page", "row")
    first = named.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    first = first.filter("n > 1").select(F.col("key").alias("same"), "first")
    revisits = named.join(first, (F.col("key") == F.col("same")) & (F.col("row") != F.col("first.row")))
    revisits = revisits.select(
        F.col("row").alias("of"), F.col("first.page").alias("first_page"),
        F.col("first.row").alias("first_row"),
    )
    dealt = rows.drop("key", "size").join(revisits, F.col("row") == F.col("of"), "left")
    dealt = dealt.drop("of").repartition(parts, "row")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Bundle(frame_bytes)
        for batch in batches:
            for r in batch.to_pylist():
                name = record_id(r["page"], r["row"])
                first = r["first_row"] is not None and record_id(r["first_page"], r["first_row"])
                digest = _digest(r["payload"])
                frame = out.add(
                    name, record(name, r["url"], date, r["payload"], digest, first or None)
                )
                if frame:
                    yield one(frame)
        if out.held:
            yield one(out.close())
            yield one(out.end())

    def one(frame: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([frame], pa.binary())], names=["frame"])

    frames = dealt.mapInArrow(bundle, "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("lineSep", GAP).text(path)


def _bundles(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.filter("length > 0")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record below `path`: record_id, page_id, url, warc_date, record_type,
    payload_digest, payload_bytes (both of the full payload), refers_to_record, refers_to, and
    with `payloads` payload (BINARY, null in revisits). Digests and checksums are verified."""
    names = [
        "record_id", "page_id", "url", "warc_date", "record_type", "payload_digest",
        "payload_bytes", "refers_to_record", "refers_to", *(["payload"] if payloads else []),
    ]
    kinds = {"page_id": "long", "payload_bytes": "long", "refers_to": "long", "payload": "binary"}
    types = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    typed = [types[kinds.get(n, "string")] for n in names]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for data in records_of(content.as_py()):
                    r = parse(data)
                    r["page_id"] = page_of(r["record_id"])
                    r["refers_to"] = r["refers_to_record"] and page_of(r["refers_to_record"])
                    held.append(r)
                    size += len(data)
                    if size > 8 << 20:
                        yield rows(held)
                        held, size = [], 0
                if held:
                    yield rows(held)

    def rows(held: list[dict]) -> pa.RecordBatch:
        columns = [
            pa.array([r[n] for r in held], type=t) for n, t in zip(names, typed, strict=True)
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)
    return _bundles(spark, path).select("content").mapInArrow(read, schema)


def record_index(spark: SparkSession, path: str) -> DataFrame:
    """Where every record lies: record_id, file, frame, frame_start (in the file), frame_bytes,
    offset (in the frame's content), length. Nothing is decompressed."""
    names = ["record_id", "file", "frame", "frame_start", "frame_bytes", "offset", "length"]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = zip(batch.column("path").to_pylist(), batch.column("content"), strict=True)
            for file, content in files:
                frames, index = entries(content.as_py())
                rows = [(n, file, f, *frames[f][:2], o, k) for n, f, o, k in index]
                columns = [list(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    schema = "record_id string, file string, frame long, frame_start long, frame_bytes long, "
    files = _bundles(spark, path).select("path", "content")
    return files.mapInArrow(places, schema + "offset long, length long")


def full_payload(records: DataFrame) -> DataFrame:
    """`records` (see `read_archives`) with the payload of their response in every revisit."""
    responses = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("response"), F.col("payload").alias("their")
    )
    joined = records.join(responses, F.col("refers_to_record") == F.col("response"), "left")
    payload: Column = F.coalesce("payload", "their")
    return joined.withColumn("payload", payload).drop("response", "their")
