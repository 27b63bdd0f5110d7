"""Op sequencing: submissions in arrival order become accepted ops with dense revisions.

Whether a submission is accepted depends on what was accepted before it, so the rule is
a fold over each document. Rows are shuffled by document, sorted by arrival and streamed
through the fold in Arrow batches; a task keeps only the revision and one mark per client.

A document too large for one task is cut into arrival slices that run side by side from a
guessed entry state. Each run reports for which entry states its result holds; slices whose
real entry state (the exit of the slices before) falls outside are run again. The first
wrong slice is right after every round, so the loop ends with the exact result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..batches import rows as rows_of_batch
from ..functions.deltas import ops_decode, ops_valid
from ..runtime import hot_keys, materialize, range_slices, shuffle_partitions
from ..schemas import ACCEPTED, CONFLICT, DUPLICATE, INVALID_OPS, INVALID_POSITION, OPS

_STEP = ["doc_id", "slice_no", "is_entry", "client_id", "client_seq", "base_revision", "fault"]
_FAR = 2**62


class _Slice:
    """State of one (document, slice) while its rows stream by."""

    def __init__(self, key):
        self.key = key
        self.revision = 0
        self.entry = 0
        self.marks: dict[str, int] = {}
        # per client: [highest seq refused, lowest seq let through, accepted mark or None]
        self.seen: dict[str, list] = {}

    def enter(self, client, mark, revision):
        self.revision = self.entry = revision
        if client is not None:
            self.marks[client] = mark

    def submit(self, client, seq, base, fault):
        last = self.marks.get(client, 0)
        seen = self.seen.get(client)
        if seen is None:
            seen = self.seen[client] = [-_FAR, _FAR, None]
        if seen[2] is None:
            if seq <= last:
                seen[0] = max(seen[0], seq)
            else:
                seen[1] = min(seen[1], seq)
        if seq <= last:
            return DUPLICATE
        if base != self.revision:
            return CONFLICT
        if fault is not None:
            return fault
        self.revision += 1
        self.marks[client] = seen[2] = seq
        return ACCEPTED


def _walk(batch: pa.RecordBatch, state: _Slice | None):
    """Yield (slice state, outcome or None for an entry row) for each row."""
    for doc, slice_no, is_entry, client, seq, base, fault in rows_of_batch(batch, _STEP):
        if state is None or state.key != (doc, slice_no):
            state = _Slice((doc, slice_no))
        if is_entry:
            state.enter(client, seq, base)
            yield state, None
        else:
            yield state, state.submit(client, seq, base, fault)


def _label(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = None
    for batch in arriving:
        keep, status, revision = [], [], []
        for state, outcome in _walk(batch, state):
            keep.append(outcome is not None)
            if outcome is not None:
                status.append(outcome)
                revision.append(state.revision if outcome == ACCEPTED else None)
        rows = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays(
            [*rows.columns, pa.array(status, pa.string()), pa.array(revision, pa.int64())],
            names=[*rows.schema.names, "status", "revision"],
        )


_EXIT_SCHEMA = (
    "doc_id STRING, slice_no INT, entry_revision LONG, exit_revision LONG, client_id STRING, "
    "refused_max LONG, passed_min LONG, accepted_mark LONG"
)


def _summarize(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (document, slice, client): exit state and the entry states it holds for."""

    def rows(done: _Slice):
        for client, (refused, passed, mark) in done.seen.items():
            yield (*done.key, done.entry, done.revision, client, refused, passed, mark)

    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()] + [pa.int64()] * 3
    names = [c.split()[0] for c in _EXIT_SCHEMA.split(", ")]

    def pack(out):
        columns = list(zip(*out)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], names=names
        )

    current = None
    for batch in arriving:
        out = []
        for state, _ in _walk(batch, current):
            if current is not None and state is not current:
                out.extend(rows(current))
            current = state
        if out:
            yield pack(out)
    if current is not None:
        yield pack(list(rows(current)))


def _in_arrival_order(df: DataFrame) -> DataFrame:
    parts = shuffle_partitions(df.sparkSession)
    return df.repartition(parts, "doc_id", "slice_no").sortWithinPartitions(
        "doc_id", "slice_no", F.desc("is_entry"), "arrival_seq"
    )


def ops_fault(ops: Column) -> Column:
    """Why a delta in JSON text must be refused; null where it is sound.

    A missing delta is an empty one. Without a minus sign no position can be negative.
    """
    torn = ops.isNotNull() & F.from_json(ops, OPS).isNull()
    below = F.contains(ops, F.lit("-")) & ~F.coalesce(ops_valid(ops_decode(ops)), F.lit(True))
    return F.when(torn, INVALID_OPS).when(below, INVALID_POSITION)


def _stepped(submissions: DataFrame, keep: list[str] | None) -> DataFrame:
    rows = submissions.withColumns(
        {
            "is_entry": F.lit(False),
            "fault": ops_fault(F.col("ops")),
            # Fields a client leaves out count as 0 and ''.
            "client_id": F.coalesce("client_id", F.lit("")),
            "client_seq": F.coalesce("client_seq", F.lit(0).cast("long")),
            "base_revision": F.coalesce("base_revision", F.lit(0).cast("long")),
        }
    )
    if keep is None:
        return rows
    used = [c for c in _STEP if c in rows.columns] + ["arrival_seq"]
    return rows.select(*used, *[c for c in keep if c not in used])


def _entry_rows(entry: DataFrame, slice_no: Column) -> DataFrame:
    """State rows (doc_id, client_id, last_seq, revision) in the shape of submissions."""
    return entry.select(
        "doc_id",
        slice_no.cast("int").alias("slice_no"),
        "client_id",
        F.col("last_seq").alias("client_seq"),
        F.col("revision").alias("base_revision"),
        F.lit(True).alias("is_entry"),
        F.lit(None).cast("string").alias("fault"),
    )


def _label_rows(rows: DataFrame, entry: DataFrame | None) -> DataFrame:
    if entry is not None:
        rows = rows.unionByName(entry, allowMissingColumns=True)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    ordered = _in_arrival_order(rows)
    labelled = ordered.mapInArrow(_label, f"{schema}, status STRING, revision LONG")
    return labelled.drop("slice_no", "is_entry", "fault")


def sequence(
    submissions: DataFrame, entry: DataFrame | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Submissions plus `status` and, for accepted rows, `revision`.

    `keep` names the columns wanted besides those the rule reads; the others, such as the
    ops themselves, then stay out of the shuffle and of the Python workers.
    `entry` resumes from stored state: rows (doc_id, client_id, last_seq, revision), with a
    null client for a document whose clients have no mark yet.
    """
    hot = hot_keys(submissions, ["doc_id"])
    if hot is not None:
        # Only the hot documents are sliced; every row of the others goes the plain way.
        def part(df: DataFrame | None, how: str) -> DataFrame | None:
            return None if df is None else df.join(hot, "doc_id", how).select(*df.columns)

        split = _sequence_sliced(part(submissions, "left_semi"), part(entry, "left_semi"), keep)
        rest = _sequence_plain(part(submissions, "left_anti"), part(entry, "left_anti"), keep)
        return rest.unionByName(split)
    return _sequence_plain(submissions, entry, keep)


def _sequence_plain(
    submissions: DataFrame, entry: DataFrame | None, keep: list[str] | None
) -> DataFrame:
    rows = _stepped(submissions, keep).withColumn("slice_no", F.lit(0))
    return _label_rows(rows, None if entry is None else _entry_rows(entry, F.lit(0)))


def _sequence_sliced(
    submissions: DataFrame, entry: DataFrame | None, keep: list[str] | None
) -> DataFrame:
    rows = range_slices(_stepped(submissions, keep), ["doc_id"], [F.col("arrival_seq")])
    slim = rows.select(*_STEP, "arrival_seq")
    if entry is None:
        spark = rows.sparkSession
        entry = spark.createDataFrame(
            [], "doc_id STRING, client_id STRING, last_seq LONG, revision LONG"
        )

    by_doc = Window.partitionBy("doc_id").orderBy("slice_no")
    by_client = Window.partitionBy("doc_id", "client_id").orderBy("slice_no")
    earlier = by_client.rowsBetween(Window.unboundedPreceding, -1)
    doc_start = entry.groupBy("doc_id").agg(F.max("revision").alias("start_revision"))
    client_start = entry.filter("client_id IS NOT NULL").select(
        "doc_id", "client_id", F.col("last_seq").alias("start_mark")
    )

    def entries(per_client: DataFrame, per_slice: DataFrame) -> DataFrame:
        """Entry state of every (document, slice, client) from the exits before it."""
        marks = (
            per_client.withColumn("before", F.max("mark").over(earlier))
            .join(client_start, ["doc_id", "client_id"], "left")
            .withColumn(
                "last_seq",
                F.greatest(F.coalesce("before", F.lit(0)), F.coalesce("start_mark", F.lit(0))),
            )
        )
        starts = (
            per_slice.withColumn("slice_rank", F.row_number().over(by_doc))
            .join(doc_start, "doc_id", "left")
            .select(
                "doc_id",
                "slice_no",
                F.when(F.col("slice_rank") == 1, F.coalesce("start_revision", F.lit(0)))
                .otherwise(F.col("at_entry"))
                .alias("revision"),
            )
        )
        return marks.join(starts, ["doc_id", "slice_no"]).select(
            "doc_id", "slice_no", "client_id", "last_seq", "revision"
        )

    # Guess: each slice starts at the base revision of its first row, each client at the
    # highest sequence number it sent before.
    guess = materialize(
        entries(
            slim.groupBy("doc_id", "slice_no", "client_id").agg(F.max("client_seq").alias("mark")),
            slim.groupBy("doc_id", "slice_no").agg(
                F.min_by("base_revision", "arrival_seq").alias("at_entry")
            ),
        ),
        "entry",
    )
    exits, todo = None, slim
    while True:
        # Only slices whose entry state was wrong run again; the others keep their exits.
        run = todo.unionByName(
            _entry_rows(guess, F.col("slice_no")), allowMissingColumns=True
        )
        fresh = _in_arrival_order(run).mapInArrow(_summarize, _EXIT_SCHEMA)
        if exits is not None:
            kept = exits.join(wrong, ["doc_id", "slice_no"], "left_anti")
            fresh = fresh.unionByName(kept)
        exits = materialize(fresh, "exits")
        per_slice = exits.groupBy("doc_id", "slice_no").agg(
            F.first("exit_revision").alias("exit_revision")
        )
        true_entry = materialize(
            entries(
                exits.withColumn("mark", F.col("accepted_mark")),
                per_slice.withColumn("at_entry", F.lag("exit_revision").over(by_doc)),
            ),
            "entry",
        )
        wrong = (
            exits.join(
                true_entry.withColumnRenamed("revision", "true_revision"),
                ["doc_id", "slice_no", "client_id"],
            )
            .filter(
                (F.col("entry_revision") != F.col("true_revision"))
                | (F.col("last_seq") < F.col("refused_max"))
                | (F.col("last_seq") >= F.col("passed_min"))
            )
            .select("doc_id", "slice_no")
            .distinct()
        )
        wrong = materialize(wrong, "wrong")
        if wrong.isEmpty():
            return _label_rows(rows, _entry_rows(true_entry, F.col("slice_no")))
        todo = slim.join(wrong, ["doc_id", "slice_no"], "left_semi")
        guess = true_entry.join(wrong, ["doc_id", "slice_no"], "left_semi")


def exit_state(labelled: DataFrame, entry: DataFrame | None = None) -> DataFrame:
    """State rows after the labelled submissions, in the shape `sequence` resumes from."""
    accepted = labelled.filter(F.col("status") == ACCEPTED)
    marks = labelled.select("doc_id").distinct().select(
        "doc_id",
        F.lit(None).cast("string").alias("client_id"),
        F.lit(0).cast("long").alias("last_seq"),
        F.lit(0).cast("long").alias("revision"),
    )
    marks = marks.unionByName(
        accepted.select("doc_id", "client_id", F.col("client_seq").alias("last_seq"), "revision")
    )
    if entry is not None:
        marks = marks.unionByName(entry)
    per_client = marks.groupBy("doc_id", "client_id").agg(F.max("last_seq").alias("last_seq"))
    per_doc = marks.groupBy("doc_id").agg(F.max("revision").alias("revision"))
    return per_client.join(per_doc, "doc_id")


def resumed_fold(doc_id: str, revision: int, marks: dict[str, int]) -> _Slice:
    """The fold of one document, resumed from its state."""
    fold = _Slice((doc_id, 0))
    fold.revision, fold.marks = revision, marks
    return fold
