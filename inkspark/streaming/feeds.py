"""Replay a table as a file stream, in the order of a clock column."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from ..runtime import largest_group, materialize, new_path

KEY_ROWS = 100_000  # rows of one key that a micro-batch may bring to its task
# A frame of a processor's rows is given on when it holds as many rows, or characters.
FRAME_ROWS, FRAME_CHARS = 10_000, 8_000_000


def time_slices(rows: DataFrame, clock: str, count: int) -> list[DataFrame]:
    """Split rows into `count` equal spans of the LONG column `clock`."""
    low, high = rows.agg(F.min(clock), F.max(clock)).first()
    if low is None:
        return [rows]
    span = (high - low) // count + 1
    return [rows.filter(F.floor((F.col(clock) - F.lit(low)) / span) == n) for n in range(count)]


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# State variables, timers and times to live need this store.
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def state_variables(spark: SparkSession, idle: bool = True) -> Iterator[None]:
    """Queries that are started inside keep their state in a store with state variables. Without
    `idle` they run no micro-batch without rows: where state has a time to live, Spark would
    never be done with those."""
    before = {k: spark.conf.get(k) for k in (_PROVIDER, _IDLE)}
    spark.conf.set(_PROVIDER, _ROCKSDB)
    spark.conf.set(_IDLE, str(idle).lower())
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def replay(
    slices: list[DataFrame],
    start: Callable[[DataFrame], DataStreamWriter],
    checkpoint: str,
    idle: bool = True,
    lines: Callable[[SparkSession, str], DataFrame] | None = None,
) -> None:
    """Append each slice to a folder and run the stream until it has taken it in.

    The query stops and resumes from its checkpoint between slices, as after a restart. With
    `lines` the folder holds text files, one line per row, which `lines(spark, folder)` reads.
    """
    spark = slices[0].sparkSession
    folder = new_path(spark, "feed")
    for rows in slices:
        if lines is None:
            rows.write.mode("append").parquet(folder)
            stream = spark.readStream.schema(slices[0].schema).parquet(folder)
        else:
            rows.write.mode("append").text(folder)
            stream = lines(spark, folder)
        writer = start(stream).option("checkpointLocation", checkpoint)
        with state_variables(spark, idle):
            writer.trigger(availableNow=True).start().awaitTermination()


def even_slices(rows: DataFrame, clock: str, count: int) -> list[DataFrame]:
    """Split rows into `count` parts of about as many rows by the LONG column `clock`; those of
    one time stay together."""
    cuts = rows.agg(
        F.percentile_approx(clock, [n / count for n in range(1, count)], 100 * count)
    ).first()[0]
    edges = [None, *sorted(set(cuts or [])), None]
    at = F.col(clock)
    return [
        rows.filter(
            (at.isNotNull() if low is None else at > low) & (F.lit(True) if up is None else at <= up)
        )
        for low, up in zip(edges[:-1], edges[1:], strict=True)
    ]


def _in_slices(
    rows: DataFrame, clock: str, slices: int, closing: DataFrame | None, key: str | None = None
) -> list[DataFrame]:
    rows = materialize(rows, "feed-rows")
    needed = math.ceil(largest_group(rows, [key]) / KEY_ROWS) if key else 0
    if needed > slices:
        parts = even_slices(rows, clock, needed)
    else:
        parts = time_slices(rows, clock, slices)
    if closing is not None:
        parts.append(closing.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema.fields]))
    return parts


def replay_to_table(
    rows: DataFrame,
    clock: str,
    transform: Callable[[DataFrame], DataFrame],
    slices: int = 3,
    closing: DataFrame | None = None,
    idle: bool = True,
    key: str | None = None,
) -> DataFrame:
    """Stream `rows` through `transform` into an append-only table and return the table.

    `closing` rows come last; with a time far ahead they end everything still waiting. Where one
    task takes all rows of a `key` in a micro-batch, there are as many slices as it needs to get
    about `KEY_ROWS` of them at a time.
    """
    spark = rows.sparkSession
    out = new_path(spark, "stream-out")
    schema = []

    def start(stream: DataFrame) -> DataStreamWriter:
        result = transform(stream)
        schema.append(result.schema)
        return result.writeStream.outputMode("append").format("parquet").option("path", out)

    parts = _in_slices(rows, clock, slices, closing, key)
    replay(parts, start, new_path(spark, "stream-checkpoint"), idle)
    return spark.read.schema(schema[0]).parquet(out)


def replay_batches(
    rows: DataFrame,
    clock: str,
    on_batch: Callable[[DataFrame, int], None],
    slices: int = 3,
    closing: DataFrame | None = None,
) -> None:
    """Stream `rows` in micro-batches through `on_batch(rows, batch_id)`."""
    spark = rows.sparkSession

    def start(stream: DataFrame) -> DataStreamWriter:
        return stream.writeStream.foreachBatch(on_batch)

    replay(_in_slices(rows, clock, slices, closing), start, new_path(spark, "stream-checkpoint"))


def replay_lines(
    rows: DataFrame,
    clock: str,
    line: str,
    source: Callable[[SparkSession, str], DataFrame],
    on_batch: Callable[[DataFrame, int], None],
    slices: int = 3,
) -> None:
    """Stream column `line` of `rows` as text files, read by `source`, through `on_batch`."""

    def start(stream: DataFrame) -> DataStreamWriter:
        return stream.writeStream.foreachBatch(on_batch)

    parts = [part.select(line) for part in _in_slices(rows, clock, slices, None)]
    replay(parts, start, new_path(rows.sparkSession, "stream-checkpoint"), lines=source)


class RowProcessor(StatefulProcessor):
    """A processor that takes and gives rows as tuples instead of data frames: `on_rows(key,
    rows, timers)` and, where timers are used, `on_timer(key, timers)`."""

    def __init__(self, schema: str):
        fields = [c.split()[:2] for c in schema.split(", ")]
        self.names = [n for n, _ in fields]
        # Integers and flags that may be missing need pandas' own types.
        kinds = {"LONG": "Int64", "INT": "Int32", "BOOLEAN": "boolean"}
        self.kinds = {n: kinds[t] for n, t in fields if t in kinds}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [r for frame in rows for r in frame.itertuples(index=False)]
        return self._frames(self.on_rows(key, held, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._frames(self.on_timer(key, timerValues))

    def _frames(self, rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        out, chars = [], 0
        for row in rows:
            out.append(row)
            chars += sum(len(v) for v in row if isinstance(v, str))
            if len(out) >= FRAME_ROWS or chars >= FRAME_CHARS:
                yield self._frame(out)
                out, chars = [], 0
        if out:
            yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.names).astype(self.kinds)

    def on_timer(self, key, timers) -> Iterator[tuple]:
        return iter(())

    def close(self) -> None:
        pass
