"""Load and save messages, answered from the state their document is in when they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.scalars import document_text
from ..runtime import hot_keys, hot_within
from .replay import content_for
from .scan import numbered, running

LOAD, SAVE = "loadDocumentContent", "saveDocument"
NOT_FOUND = "document not found"
TOGETHER = 1000  # requests of a revision that go along with one text


def requests(decoded: DataFrame) -> DataFrame:
    """(event_id, ts, type, doc_id) of the load and save messages among decoded ones; a missing
    document is ''."""
    message = F.col("message")
    return decoded.filter(~F.col("broken") & message["type"].isin(LOAD, SAVE)).select(
        "event_id",
        "ts",
        message["type"].alias("type"),
        F.coalesce(message["docId"], F.lit("")).alias("doc_id"),
    )


def served(asked: DataFrame, labelled: DataFrame) -> DataFrame:
    """Requests with the revision their document has when they arrive, or an error where nothing
    was submitted to it before.

    `asked`: from `requests`. `labelled`: doc_id, arrival_seq, ts and revision (null where it was
    rejected) of submissions; those of the same instant come first. `stores` marks the saves that
    add a snapshot, the first ones of a document and revision; it is null for loads. A load that
    fails has no answer; a save that fails is answered twice, as the original goes on after it.
    """
    submitted = labelled.select(
        "doc_id", "ts", F.lit(0).alias("phase"), F.col("arrival_seq").alias("number"), "revision"
    )
    rows = submitted.unionByName(
        asked.select(
            "doc_id", "ts", F.lit(1).alias("phase"), F.col("event_id").alias("number"), "type"
        ),
        allowMissingColumns=True,
    )
    order = ["ts", "phase", "number"]
    submission = F.when(F.col("phase") == 0, 1)
    hot = hot_keys(rows, ["doc_id"])
    rows = running(
        rows, ["doc_id"], order,
        {"reached": ("max", F.col("revision")), "known": ("max", submission)}, hot=hot,
    ).filter("phase = 1")
    reached = F.when(F.col("known").isNotNull(), F.coalesce("reached", F.lit(0)))
    rows = rows.withColumn("revision", reached.cast("long"))
    # Revisions only grow, so the save before tells whether this one is the first of its revision.
    kind = ["doc_id", "type"]
    hot = hot_within(hot, rows, kind)
    rows = running(rows, kind, order, {"before": ("prev", F.col("revision"))}, hot=hot)
    first = F.col("revision").isNotNull() & ~F.col("revision").eqNullSafe(F.col("before"))
    saved = document_text(F.col("doc_id"), "saved")
    failed = F.concat_ws("\n", document_text(F.col("doc_id"), "save failed"), saved)
    is_save, found = F.col("type") == SAVE, F.col("revision").isNotNull()
    return rows.select(
        F.col("number").alias("event_id"),
        "type",
        "doc_id",
        "revision",
        F.when(is_save, first).alias("stores"),
        F.when(is_save, F.when(found, saved).otherwise(failed)).alias("answer"),
        F.when(~found, NOT_FOUND).alias("error"),
    )


def texts_served(answered: DataFrame, log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The answered requests that found their document, with the text of it at that moment.

    One replay gives the text at every revision asked for. The requests go along with it,
    `TOGETHER` of a revision at most, so that no text is shuffled to meet them; `snapshots`
    (doc_id, revision, content) spare the replay what is below them.
    """
    found = answered.filter("revision IS NOT NULL")
    names = [c for c in found.columns if c not in ("doc_id", "revision")]
    point = ["doc_id", "revision"]
    turns = numbered(found.filter("revision > 0"), point, ["event_id"], "turn")
    marks = (
        turns.groupBy(*point, F.floor((F.col("turn") - 1) / TOGETHER).alias("chunk"))
        .agg(F.to_json(F.collect_list(F.struct(*names))).alias("tag"))
        .select(*point, "tag")
    )
    asked = F.from_json("tag", ArrayType(found.select(*names).schema))
    texts = content_for(log, snapshots, marks).select(*point, F.inline(asked), "content")
    new = found.filter("revision <= 0").select(*point, *names, F.lit("").alias("content"))
    return texts.unionByName(new)
