"""Streaming consumers of the event log: dedup, reorder, snapshots, fan-out."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.documents import new_snapshots
from ..operators.rooms import delivery_ranges

_ORDERED = "doc_id STRING, position LONG, revision LONG, operation_id STRING"


def dedup_stream(records: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop events published again after a lost acknowledgement.

    Input: doc_id, revision and applied_at (TIMESTAMP); repeats come within `delay`.
    """
    return records.withWatermark("applied_at", delay).dropDuplicatesWithinWatermark(
        ["doc_id", "revision"]
    )


def _reorder(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, position, waiting = state.get if state.exists else (0, 0, "{}")
    held = {int(r): v for r, v in json.loads(waiting).items()}
    for rows in chunks:
        for revision, operation, at_ms in zip(rows.revision, rows.operation_id, rows.at_ms):
            if revision > last:
                held.setdefault(int(revision), [operation, int(at_ms)])
    watermark = state.getCurrentWatermarkMs()
    out = []
    for revision in sorted(held):
        operation, at_ms = held[revision]
        # Across a gap, go on only when the watermark says the missing events are not coming.
        if revision != last + 1 and at_ms >= watermark:
            break
        position += 1
        out.append((*key, position, revision, operation))
        last = revision
        del held[revision]
    state.update((last, position, json.dumps(held)))
    if held:
        due = max(held[min(held)][1], watermark) + 1
        state.setTimeoutTimestamp(due)
    if out:
        yield pd.DataFrame(out, columns=["doc_id", "position", "revision", "operation_id"])


def reorder_stream(records: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each document's events in revision order, numbered as they are passed on.

    Events above a missing revision are held until it arrives, or until the watermark has
    passed them, when the revision counts as lost. What is held is bounded by `delay`.
    """
    rows = records.withWatermark("applied_at", delay).select(
        "doc_id", "revision", "operation_id", "applied_at",
        F.unix_millis("applied_at").alias("at_ms"),
    )
    return rows.groupBy("doc_id").applyInPandasWithState(
        _reorder,
        _ORDERED,
        "last LONG, position LONG, held STRING",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


class SnapshotSink:
    """Insert-ignore of each micro-batch into a snapshot table.

    A batch run again finds its own rows stored and adds nothing.
    """

    def __init__(self, path: str):
        self.path = path

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        stored = rows.sparkSession.read.parquet(self.path).select("document_id", "revision")
        touched = rows.select("document_id").distinct()
        fresh = new_snapshots(rows, stored.join(touched, "document_id", "left_semi"))
        fresh.write.mode("append").parquet(self.path)


class FanoutSink:
    """Delivery ranges of each micro-batch against the stays known when it runs, of which only
    those of its documents are swept."""

    def __init__(self, stays: Callable[[], DataFrame], out: str):
        self.stays = stays
        self.out = out

    def __call__(self, ops: DataFrame, batch_id: int) -> None:
        touched = ops.select("doc_id").distinct()
        ranges = delivery_ranges(ops, self.stays().join(touched, "doc_id", "left_semi"))
        ranges.write.mode("overwrite").parquet(f"{self.out}/batch={batch_id}")


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """One range per stay from the ranges of single micro-batches."""
    return ranges.groupBy("conn_id", "doc_id", "joined_us").agg(
        F.min("first_revision").alias("first_revision"),
        F.max("last_revision").alias("last_revision"),
        F.sum("ops_in_stay").alias("ops_in_stay"),
        F.sum("delivered").alias("delivered"),
    )
