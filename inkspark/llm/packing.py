"""Best-fit packing by minimum bin slack.

A bin starts with the longest piece left; a bitset of reachable sums over the other lengths
then finds the fullest combination that still fits, which is taken out. The search sees only
how many pieces there are of each length (at most `capacity` numbers, however many pieces), and
a combination is taken as often as the counts allow, so at most one search per length and a few
more are needed. Pieces are then dealt to the combinations by their number within their length,
in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freeze, spare
from .encode import encoding, in_slices

CAPACITY = 2048
END_ID = 0  # closes a document


def fullest(counts: np.ndarray, room: int) -> list[int]:
    """Lengths (repeats allowed up to their counts) with the largest sum up to `room`.

    Longer lengths come first in the search, so among equal sums the one found uses them.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in range(min(room, len(counts) - 1), 0, -1):
        left, times = min(int(counts[length]), room // length), 1
        while left > 0 and not reach >> room & 1:
            take = min(times, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, times = left - take, times * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * take
            total -= length * take
    return chosen


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how many such bins) for `counts[length]` pieces of each length."""
    counts, out = counts.copy(), []
    longest = capacity
    while True:
        while longest > 0 and counts[longest] == 0:
            longest -= 1
        if longest == 0:
            return out
        counts[longest] -= 1
        bin_ = [longest, *fullest(counts, capacity - longest)]
        counts[longest] += 1
        used = np.bincount(bin_, minlength=capacity + 1)
        some = used > 0
        times = int((counts[some] // used[some]).min())
        counts -= used * times
        out.append((sorted(bin_, reverse=True), times))


def _deal(bins: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: for each run of pieces its first number, first bin, pieces per bin, offset."""
    dealt: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first_bin = 0
    for lengths, times in bins:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            each = lengths.count(length)
            start = used.get(length, 0)
            dealt.setdefault(length, []).append((start, first_bin, each, offset))
            used[length] = start + each * times
            offset += each * length
        first_bin += times
    return {
        length: tuple(np.array(x, dtype=np.int64) for x in zip(*runs, strict=True))
        for length, runs in dealt.items()
    }


def numbered_by(df: DataFrame, key: str, name: str, label: str) -> DataFrame:
    """Add a LONG number from 0 within each value of `key`, which has few values.

    Every partition numbers its own rows and starts after those of the partitions before it,
    so no value's rows need to meet in one task. The rows are shuffled once: the places and the
    starts meet them by the same columns, the key in a struct, in which a null equals a null.
    """
    part, place, start, same, key_, part_ = spare(
        df, "part_no", "place", "first_no", "same_key", "k", "p"
    )
    held = freeze(
        df.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id()}),
        label,
    )
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # Written, so that its size is known before the rows and what they carry are dealt to it.
    starts = held.groupBy(key, part).count().select(
        F.struct(F.col(key)).alias(key_),
        F.col(part).alias(part_),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias(start),
    )
    starts = freeze(starts, f"{label}-starts")
    here = Window.partitionBy(same, part).orderBy(place)
    return (
        held.withColumn(same, F.struct(F.col(key)))
        .withColumn(place, F.row_number().over(here) - 1)
        # The starts grow with the partitions, so they are not broadcast.
        .join(
            starts.hint("merge"), (F.col(same) == F.col(key_)) & (F.col(part) == F.col(part_))
        )
        .select(*df.columns, (F.col(start) + F.col(place)).cast("long").alias(name))
    )


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """`pieces` with sequence_id (LONG) and offset (LONG), its place in that sequence.

    Sequences hold at most `capacity`; offsets have no gaps. Lengths from 1 to `capacity` are
    packed; rows with a null or smaller length take no room and get nulls; a greater length is
    an error. Equal rows are pieces of their own. An empty table gives an empty one.
    """
    (number,) = spare(pieces, "number")
    rows = numbered_by(pieces, length_col, number, "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    known = rows.filter(F.col(length_col) > 0)
    # One row per length: at most `capacity` of them reach the driver.
    for length, n in known.groupBy(length_col).count().limit(capacity + 1).collect():
        if length > capacity:
            raise ValueError(f"a piece of {length} exceeds the capacity of {capacity}")
        counts[length] = n
    dealt = _deal(plan(counts, capacity))
    names = ["sequence_id", "offset"]
    kept = [c for c in pieces.columns if c.lower() not in names]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(length_col).to_pandas().fillna(0).to_numpy(np.int64)
            number_ = batch.column(number).to_numpy()
            seq = np.full(len(length), -1, dtype=np.int64)
            offset = np.full(len(length), -1, dtype=np.int64)
            for value in np.unique(length[length > 0]):
                at = np.flatnonzero(length == value)
                first, bin_, each, begin = dealt[int(value)]
                run = np.searchsorted(first, number_[at], side="right") - 1
                place = number_[at] - first[run]
                seq[at] = bin_[run] + place // each[run]
                offset[at] = begin[run] + place % each[run] * value
            cols = [batch.column(c) for c in kept]
            cols += [pa.array(x, mask=x < 0) for x in (seq, offset)]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *names])

    kinds = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept
    )
    return rows.mapInArrow(assign, f"{kinds}, sequence_id long, offset long")


def digests(packed: DataFrame) -> DataFrame:
    """`packed` with ids_crc32 taken from the packed ids, which go. Null ids give a null; an empty
    table gives an empty one."""
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def pieces_of(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of the token ids of every document: doc_id, piece, start, length, ids_crc32, and
    with `with_ids` ids (BINARY, little-endian uint32).

    A document's ids end with `end_id`; a null text is empty. Only documents longer than
    `capacity` are cut, into pieces of `capacity`, of which the first may be shorter. Null ids of
    documents stay null; repeated rows are documents of their own; an empty table gives an empty
    one. Other columns are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4").tobytes()
        with encoding(tokenizer) as encode:
            for batch in batches:
                doc, texts = batch.column("doc").to_pylist(), batch.column("text").to_pylist()
                for a, b in in_slices(texts):
                    rows = []
                    for d, ids in zip(doc[a:b], encode.batch(texts[a:b]), strict=True):
                        ids += end
                        total = len(ids) // 4
                        first = total % capacity or capacity
                        starts = [0, *range(first, total, capacity)]
                        for piece, (x, y) in enumerate(zip(starts, [*starts[1:], total], strict=True)):
                            part = ids[4 * x : 4 * y]
                            rows.append((d, piece, x, y - x, zlib.crc32(part), part))
                    cols = [
                        pa.array(list(values), type=kind)
                        for values, kind in zip(zip(*rows, strict=True), types, strict=False)
                    ]
                    yield pa.RecordBatch.from_arrays(cols[: len(names)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long"
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return texts.mapInArrow(cut, kinds + (", ids binary" if with_ids else ""))
