"""Token ids in binary files, byte-aligned with separate control bytes.

A file holds blocks. In a block the ids that occur are ranked by how often they do, most
frequent first, and each token is written as its rank in 1 to 4 bytes; the byte counts, two bits
each, four to a control byte, stand apart from the data. A block is decoded with two numpy table
lookups: control byte to lengths, rank to id. A block is complete in itself, so counting and
coding take one pass, and a lost file costs nothing but itself.

Block, all numbers little-endian:
    8 bytes   "TOKBLK1" and a zero byte
    10 int64  part, block, documents, tokens, ranked ids, bytes of the last four sections,
              documents without an id
    sections  document ids (int64), tokens per document (int64), null flags (uint8),
              ids by rank (uint32), control bytes, data bytes
    1 byte    line feed
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import shuffle_partitions
from .common import freeze
from .encode import encoding, in_slices

MAGIC = b"TOKBLK1\0"
END_ID = 2  # closes a document
BLOCK_TOKENS = 2_000_000  # a block is closed when it holds that many
FILE_TEXT = 48 << 20  # bytes of text for one file, about
_LENGTHS = np.array([[1 + (c >> 2 * i & 3) for i in range(4)] for c in range(256)], dtype=np.uint8)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of uint32 numbers."""
    extra = (ranks > 0xFF).astype(np.uint8)
    extra += ranks > 0xFFFF
    extra += ranks > 0xFFFFFF
    four = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    four[: len(ranks)] = extra
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    ends = np.cumsum(extra, dtype=np.int64) + np.arange(1, len(ranks) + 1)
    data = np.empty(ends[-1] if len(ends) else 0, dtype=np.uint8)
    data[ends - extra - 1] = ranks.astype(np.uint8)
    for k in range(1, int(extra.max(initial=0)) + 1):
        at = np.flatnonzero(extra >= k)
        data[ends[at] - extra[at] - 1 + k] = (ranks[at] >> np.uint32(8 * k)).astype(np.uint8)
    return control.tobytes(), data.tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers that `pack_ranks` wrote."""
    lengths = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    body = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(3, dtype=np.uint8)])
    out = body[starts].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        at = np.flatnonzero(lengths > k)
        out[at] |= body[starts[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_block(part: int, block: int, docs: list[int | None], ids: list[bytes]) -> bytes:
    """One block of documents; `ids` are little-endian uint32."""
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    counts = np.bincount(flat)
    used = np.flatnonzero(counts)
    order = np.lexsort((used, -counts[used]))
    rank = np.empty(len(counts), dtype=np.uint32)
    rank[used[order]] = np.arange(len(used), dtype=np.uint32)
    control, data = pack_ranks(rank[flat])
    null = np.array([d is None for d in docs], dtype=np.uint8)
    sections = [
        np.array([d or 0 for d in docs], dtype="<i8").tobytes(),
        np.array([len(x) // 4 for x in ids], dtype="<i8").tobytes(),
        null.tobytes(),
        used[order].astype("<u4").tobytes(),
        control,
        data,
    ]
    head = [part, block, len(docs), len(flat), len(used), *map(len, sections[2:]), int(null.sum())]
    return MAGIC + np.array(head, dtype="<i8").tobytes() + b"".join(sections)


def read_blocks(content: bytes) -> Iterator[tuple[int, int, list, np.ndarray, np.ndarray]]:
    """(part, block, document ids, tokens per document, all ids) of a file's blocks."""
    at, view = 0, memoryview(content)
    while at < len(view):
        if bytes(view[at : at + 8]) != MAGIC:
            raise ValueError(f"no block at byte {at}")
        head = np.frombuffer(view[at + 8 : at + 88], dtype="<i8").tolist()
        part, block, n_docs, n_tokens = head[:4]
        at += 88
        parts = []
        for size in (8 * n_docs, 8 * n_docs, *head[5:9]):
            parts.append(view[at : at + size])
            at += size
        at += 1
        docs, counts = (np.frombuffer(x, dtype="<i8") for x in parts[:2])
        names = [
            None if null else d for d, null in zip(docs.tolist(), bytes(parts[2]), strict=True)
        ]
        ranks = unpack_ranks(bytes(parts[4]), bytes(parts[5]), n_tokens)
        yield part, block, names, counts, np.frombuffer(parts[3], dtype="<u4")[ranks]


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
) -> None:
    """Write the token ids of every document, each closed by `end_id`, to files below `path`.

    Files and documents in them ascend by id, null ids first; rows of one id by the hash of
    their text. Null texts are empty, and have their `end_id` only. Every row is written,
    repeated ones too. Ranges of ids that hold many rows are split by the text's hash, so one
    id cannot fill a file alone. An empty table gives files without blocks.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(docs.sparkSession), math.ceil(size / FILE_TEXT))
    keyed = rows.withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    order = ["doc", "tie", "place"]
    sorted_ = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4").tobytes()
        part, block, names, held, tokens = TaskContext.get().partitionId(), 0, [], [], 0
        with encoding(tokenizer) as encode:
            for batch in batches:
                doc, texts = batch.column("doc").to_pylist(), batch.column("text").to_pylist()
                for a, b in in_slices(texts):
                    for name, ids in zip(doc[a:b], encode.batch(texts[a:b]), strict=True):
                        names.append(name)
                        held.append(ids + end)
                        tokens += len(ids) // 4 + 1
                        if tokens >= block_tokens:
                            yield one(write_block(part, block, names, held))
                            block, names, held, tokens = block + 1, [], [], 0
        if names:
            yield one(write_block(part, block, names, held))

    def one(block: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])

    # Bytes pass through the text writer as they are, so Spark's committer places the files.
    coded = sorted_.select("doc", "text").mapInArrow(blocks, "block binary")
    coded.select(F.col("block").cast("string")).write.text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every document in the files below `path`: part and block that hold it, doc_id, inside
    (ids before it in the block), n_tokens and ids (BINARY, little-endian uint32)."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for part, block, names, counts, ids in read_blocks(content.as_py()):
                    ends = np.cumsum(counts)
                    body = pa.py_buffer(ids.astype("<u4").tobytes())
                    edges = pa.py_buffer(
                        np.concatenate([[0], 4 * ends]).astype(np.int32).tobytes()
                    )
                    n = len(names)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, part), pa.int64()),
                            pa.array(np.full(n, block), pa.int64()),
                            pa.array(names, pa.int64()),
                            pa.array(ends - counts, pa.int64()),
                            pa.array(counts, pa.int64()),
                            pa.Array.from_buffers(pa.binary(), n, [None, edges, body]),
                        ],
                        names=["part", "block", "doc_id", "inside", "n_tokens", "ids"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(
        decoded,
        "part long, block long, doc_id long, inside long, n_tokens long, ids binary",
    )


def with_starts(tokens: DataFrame) -> DataFrame:
    """Replace part, block and inside by start, from the sums of the blocks before."""
    before = Window.unboundedPreceding, -1
    # Written, as the files would be decoded again for each use.
    sums = freeze(tokens.groupBy("part", "block").agg(F.sum("n_tokens").alias("n")), "block-sums")
    parts = sums.groupBy("part").agg(F.sum("n").alias("n"))
    zero = F.lit(0)
    first = parts.select(
        "part",
        F.coalesce(
            F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(*before)), zero
        ).alias("first"),
    )
    starts = sums.join(first, "part").select(
        "part",
        "block",
        (
            F.col("first")
            + F.coalesce(
                F.sum("n").over(Window.partitionBy("part").orderBy("block").rowsBetween(*before)),
                zero,
            )
        ).alias("first"),
    )
    return tokens.join(starts, ["part", "block"]).select(
        "doc_id",
        (F.col("first") + F.col("inside")).alias("start"),
        *[c for c in tokens.columns if c not in ("part", "block", "doc_id", "inside")],
    )
