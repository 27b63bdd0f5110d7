"""Operators on labelled submissions and the op log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import epoch_micros
from ..runtime import largest_group
from ..schemas import ACCEPTED, RING_CAP
from .replay import content_at, latest_content
from .scan import running


def op_log(labelled: DataFrame) -> DataFrame:
    """Accepted submissions as op-log rows; the operation id names document and revision."""
    revision = F.col("revision")
    return labelled.filter(F.col("status") == ACCEPTED).select(
        "doc_id",
        "revision",
        F.concat(F.lit("o-"), "doc_id", F.lit("-"), revision.cast("string")).alias("operation_id"),
        "author_id",
        "conn_id",
        "client_id",
        "client_seq",
        "base_revision",
        "ops",
        "ts",
    )


def acks(labelled: DataFrame) -> DataFrame:
    """One answer per submission: `op_applied` with both revisions, or `error` with its text."""
    ok = F.col("status") == ACCEPTED
    return labelled.select(
        "doc_id",
        "arrival_seq",
        F.when(ok, "op_applied").otherwise("error").alias("type"),
        "client_id",
        "client_seq",
        F.when(ok, F.col("base_revision")).alias("base_revision"),
        F.col("revision").alias("current_revision"),
        F.when(~ok, F.col("status")).alias("content"),
    )


def current_revision(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Highest revision of each requested document, 0 where it has none."""
    latest = log.groupBy("doc_id").agg(F.max("revision").alias("latest"))
    return requests.join(latest, "doc_id", "left").select(
        "doc_id", F.coalesce("latest", F.lit(0)).alias("revision")
    )


def client_high_water(log: DataFrame) -> DataFrame:
    return log.groupBy("doc_id", "client_id").agg(F.max("client_seq").alias("last_seq"))


def document_content(submissions: DataFrame, log: DataFrame, requests: DataFrame) -> DataFrame:
    """Text, revision and length per requested document.

    A document exists from its first submission on, even if all were rejected; a request
    for any other document gets an error.
    """
    known = submissions.select("doc_id").distinct().withColumn("known", F.lit(True))
    exists = F.col("known")
    return (
        requests.join(known, "doc_id", "left")
        .join(latest_content(log, largest_group(submissions, ["doc_id"])), "doc_id", "left")
        .withColumn("content", F.when(exists, F.coalesce("content", F.lit(""))))
        .select(
            "doc_id",
            F.when(exists, F.coalesce("revision", F.lit(0))).alias("revision"),
            "content",
            F.length("content").cast("long").alias("length"),
            F.when(exists.isNull(), "document not found").alias("error"),
        )
    )


def document_at_revision(log: DataFrame, snapshots: DataFrame, requests: DataFrame) -> DataFrame:
    """Text at each requested revision; revisions not reached yet get an error."""
    latest = log.groupBy("doc_id").agg(F.max("revision").alias("latest"))
    asked = requests.join(latest, "doc_id", "left").withColumn(
        "reached", F.col("revision") <= F.coalesce("latest", F.lit(0))
    )
    texts = content_at(log, snapshots, asked.filter("reached"))
    return asked.join(texts, ["doc_id", "revision"], "left").select(
        "doc_id",
        "revision",
        "content",
        F.when(~F.col("reached"), "REVISION_NOT_REACHED").alias("error"),
    )


def snapshot_rows(log: DataFrame) -> DataFrame:
    """The rows a save of every document would store."""
    return latest_content(log).select(F.col("doc_id").alias("document_id"), "revision", "content")


def ring(log: DataFrame, cap: int = RING_CAP) -> DataFrame:
    """The newest `cap` ops of each document. Revisions are dense, so no ranking is needed."""
    latest = log.groupBy("doc_id").agg(F.max("revision").alias("latest"))
    return log.join(latest, "doc_id").filter(F.col("revision") > F.col("latest") - cap).drop("latest")


def ops_since(retained: DataFrame, requests: DataFrame) -> DataFrame:
    """Retained ops above `from_revision`, ascending, at most `lim` (all when lim <= 0).

    Each request becomes the exact revisions it will receive (never more than the ring
    holds), so the ops are found by an equi-join. `truncated` marks a gap below the ring.
    """
    span = retained.groupBy("doc_id").agg(
        F.min("revision").alias("oldest"), F.max("revision").alias("latest")
    )
    first = F.greatest(F.col("from_revision") + 1, F.col("oldest"))
    last = F.when(F.col("lim") > 0, F.least(F.col("latest"), F.col("first") + F.col("lim") - 1)).otherwise(
        F.col("latest")
    )
    wanted = (
        requests.join(span, "doc_id")
        .withColumn("first", first)
        .withColumn("last", last)
        .filter("first <= last")
        .select(
            "doc_id",
            "from_revision",
            "lim",
            (F.col("oldest") > F.col("from_revision") + 1).alias("truncated"),
            F.explode(F.sequence("first", "last")).alias("revision"),
        )
    )
    ops = retained.select("doc_id", "revision", "operation_id", "author_id", "ops")
    return wanted.join(ops, ["doc_id", "revision"])


def log_gaps(records: DataFrame) -> DataFrame:
    """Revision ranges missing from a log that may have lost or repeated events."""
    seen = records.select("doc_id", "revision").distinct()
    seen = running(seen, ["doc_id"], ["revision"], {"before": ("prev", F.col("revision"))})
    before = F.coalesce("before", F.lit(0))
    return seen.filter(F.col("revision") - before > 1).select(
        "doc_id",
        (before + 1).alias("missing_from"),
        (F.col("revision") - 1).alias("missing_to"),
        (F.col("revision") - before - 1).alias("missing"),
    )


def dedup(records: DataFrame) -> DataFrame:
    """One event per (document, revision); repeats of an event are identical."""
    return records.dropDuplicates(["doc_id", "revision"])


def op_times(log: DataFrame) -> DataFrame:
    return log.select("doc_id", "revision", "conn_id", epoch_micros(F.col("ts")).alias("ts_us"))
