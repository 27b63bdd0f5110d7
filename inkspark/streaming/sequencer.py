"""Streaming documents: op sequencing, ring, text, saves and catch-up reads."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from ..functions.deltas import ops_decode, ops_encode
from ..operators.pieces import Pieces
from ..operators.sequencer import exit_state, ops_fault, resumed_fold, sequence
from ..schemas import ACCEPTED, RING_CAP
from .feeds import RowProcessor

SUBMIT, SAVE, SINCE = "submit", "save", "since"
_OUT = (
    "doc_id STRING, arrival_seq LONG, client_id STRING, client_seq LONG, base_revision LONG, "
    "status STRING, revision LONG"
)
DOCUMENT_EVENT = (
    "doc_id STRING, arrival_seq LONG, kind STRING, client_id STRING, client_seq LONG, "
    "base_revision LONG, status STRING, revision LONG, operation_id STRING, author_id LONG, "
    "ops STRING, content STRING, truncated BOOLEAN"
)
_EMPTY = dict.fromkeys(c.split()[0] for c in DOCUMENT_EVENT.split(", "))


class _Document(RowProcessor):
    """One document: its revision, a mark per client, the ring of recent ops, its text.

    Each is a state variable of its own, of which a micro-batch reads and writes only the
    entries it needs: marks of the clients that submit, slots of the ring, blocks of the text.
    """

    def __init__(self, ring_cap: int, with_text: bool):
        super().__init__(DOCUMENT_EVENT)
        self.ring_cap = ring_cap
        self.with_text = with_text

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "revision LONG")
        self.marks = handle.getMapState("marks", "client_id STRING", "client_seq LONG")
        if self.with_text:
            self.ring = handle.getMapState(
                "ring", "slot INT",
                "revision LONG, operation_id STRING, author_id LONG, ops STRING",
            )
            self.order = handle.getValueState(
                "layout", "ids ARRAY<LONG>, lengths ARRAY<LONG>, next_id LONG"
            )
            self.blocks = handle.getMapState("blocks", "id LONG", "text STRING")

    def on_rows(self, key, rows, timers) -> Iterator[tuple]:
        doc = key[0]
        rows = sorted(rows, key=lambda r: (r.arrival_seq, r.kind != SUBMIT))
        (revision,) = self.head.get() or (0,)
        known: dict[str, int] = {}
        for client in {r.client_id for r in rows if r.kind == SUBMIT}:
            mark = self.marks.getValue((client,))
            if mark is not None:
                known[client] = mark[0]
        fold, before = resumed_fold(doc, revision, dict(known)), dict(known)
        text = self._text() if self.with_text else None
        recent: dict[int, tuple] = {}
        for r in rows:
            if r.kind == SUBMIT:
                status = fold.submit(
                    r.client_id, int(r.client_seq), int(r.base_revision), r.fault
                )
                done = status == ACCEPTED
                if done and self.with_text:
                    name = f"o-{doc}-{fold.revision}"
                    recent[fold.revision] = (fold.revision, name, int(r.author_id), r.ops)
                    recent.pop(fold.revision - self.ring_cap, None)
                    text.apply(json.loads(r.steps) if r.steps else [])
                yield self._row(
                    r, client_id=r.client_id, client_seq=r.client_seq,
                    base_revision=r.base_revision, status=status,
                    revision=fold.revision if done else None,
                )
            elif r.kind == SAVE:
                yield self._row(r, revision=fold.revision, content=text.text())
            else:
                yield from self._since(r, fold.revision, recent)
        self.head.update((fold.revision,))
        for client, mark in fold.marks.items():
            if before.get(client) != mark:
                self.marks.updateValue((client,), (mark,))
        if self.with_text:
            for number in range(max(revision, fold.revision - self.ring_cap) + 1, fold.revision + 1):
                self.ring.updateValue((number % self.ring_cap,), recent[number])
            self._keep(text)

    def _since(self, r, revision: int, recent: dict) -> Iterator[tuple]:
        """The ops after a revision, as far back as the ring goes."""
        oldest, base = max(1, revision - self.ring_cap + 1), int(r.base_revision)
        first = max(base + 1, oldest)
        for number in range(first, revision + 1):
            op = recent.get(number) or self.ring.getValue((number % self.ring_cap,))
            yield self._row(
                r, base_revision=base, revision=op[0], operation_id=op[1],
                author_id=op[2], ops=op[3], truncated=oldest > base + 1,
            )

    def _text(self) -> Pieces:
        ids, lengths, next_id = self.order.get() or ([], [], 0)
        text = Pieces(
            layout=zip(ids, lengths, strict=True), load=lambda i: self.blocks.getValue((i,))[0]
        )
        text.next_id = next_id  # the ids of dropped blocks are not used again
        self.stored = set(ids)
        return text

    def _keep(self, text: Pieces) -> None:
        for i, name in enumerate(text.ids):
            if name in text.changed:
                self.blocks.updateValue((name,), (text.texts[i],))
        for name in text.dropped & self.stored:
            self.blocks.removeKey((name,))
        if text.changed or text.dropped:
            self.order.update((*map(list, (text.ids, text.sizes)), text.next_id))

    @staticmethod
    def _row(r, **values) -> tuple:
        known = {"doc_id": r.doc_id, "arrival_seq": r.arrival_seq, "kind": r.kind}
        return tuple((_EMPTY | known | values).values())


def _submitted(submissions: DataFrame) -> DataFrame:
    return submissions.select(
        "doc_id", "arrival_seq", F.lit(SUBMIT).alias("kind"),
        F.coalesce("client_id", F.lit("")).alias("client_id"),
        F.coalesce("client_seq", F.lit(0).cast("long")).alias("client_seq"),
        F.coalesce("base_revision", F.lit(0).cast("long")).alias("base_revision"),
        ops_fault(F.col("ops")).alias("fault"), "author_id", "ops",
        ops_encode(ops_decode(F.col("ops"))).alias("steps"),
    )


def sequence_stream(submissions: DataFrame) -> DataFrame:
    """Label submissions as they come. No watermark: a late one is rejected, never reordered.

    A micro-batch must hold whole stretches of a document's submissions; inside it they are
    sorted by arrival. What one task holds is bounded by the size of a micro-batch.
    """
    rows = _submitted(submissions).drop("ops", "steps")
    labelled = rows.groupBy("doc_id").transformWithStateInPandas(
        _Document(RING_CAP, False), DOCUMENT_EVENT, "append", "None"
    )
    return labelled.select(*[c.split()[0] for c in _OUT.split(", ")])


def document_stream(
    submissions: DataFrame, requests: DataFrame | None = None, ring_cap: int = RING_CAP
) -> DataFrame:
    """Sequenced submissions, and what each request got when it came.

    `requests`: doc_id, arrival_seq, kind (`save` or `since`) and base_revision. A request comes
    after the submission with its arrival number. A save gives the revision and the text; a
    `since` gives one row for every op above base_revision that the ring of `ring_cap` ops still
    holds, with `truncated` where older ones are gone. Streams of the two may share a source.
    """
    rows = _submitted(submissions)
    if requests is not None:
        rows = rows.unionByName(
            requests.select("doc_id", "arrival_seq", "kind", "base_revision"),
            allowMissingColumns=True,
        )
    return rows.groupBy("doc_id").transformWithStateInPandas(
        _Document(ring_cap, True), DOCUMENT_EVENT, "append", "None"
    )


class BatchSequencer:
    """Sequencing per micro-batch with the batch operator, which splits large documents.

    The marks that a micro-batch moved are written beside its rows, under its own number; the
    latest ones of its documents are where the next goes on. So a batch run again reads what was
    there before it, and documents that a batch does not touch are not written again.
    """

    STATE = "doc_id STRING, client_id STRING, last_seq LONG, revision LONG, batch LONG"

    def __init__(self, spark, out: str):
        self.out = out
        self.marks = f"{out}-marks"

    def _before(self, rows: DataFrame, batch_id: int) -> DataFrame | None:
        if batch_id == 0:
            return None
        written = rows.sparkSession.read.schema(self.STATE).parquet(self.marks)
        touched = rows.select("doc_id").distinct()
        marks = written.filter(F.col("batch") < batch_id).join(touched, "doc_id", "left_semi")
        clients = marks.groupBy("doc_id", "client_id").agg(F.max("last_seq").alias("last_seq"))
        return clients.join(marks.groupBy("doc_id").agg(F.max("revision").alias("revision")), "doc_id")

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        spark, path = rows.sparkSession, f"{self.out}/batch={batch_id}"
        sequence(rows, self._before(rows, batch_id)).write.mode("overwrite").parquet(path)
        moved = exit_state(spark.read.parquet(path))
        moved.write.mode("overwrite").parquet(f"{self.marks}/batch={batch_id}")
