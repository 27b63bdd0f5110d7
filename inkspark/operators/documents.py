"""Keyed lookups and unique inserts on documents, snapshots and users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import document_text, expire_at
from ..runtime import hot_keys
from ..schemas import PRESENCE_TTL
from .presence import EARLIEST
from .scan import COUNT, running


def _ids_by_title(documents: DataFrame) -> DataFrame:
    """Titles may repeat; the smallest id, compared as a number, stands for the title."""
    return documents.groupBy("title").agg(
        F.min(F.col("id").cast("long")).cast("string").alias("document_id")
    )


def id_by_title(requests: DataFrame, documents: DataFrame) -> DataFrame:
    return requests.join(_ids_by_title(documents), "title", "left")


def user_by_username(requests: DataFrame, users: DataFrame) -> DataFrame:
    found = users.select("username", F.col("id").alias("user_id"))
    return requests.join(found, "username", "left").withColumn(
        "error", F.when(F.col("user_id").isNull(), "USER_NOT_FOUND")
    )


def created_documents(requests: DataFrame, id_base: int) -> DataFrame:
    """Create requests with created_id, the id of the document that each one inserts."""
    return requests.withColumn("created_id", (F.col("event_id") + F.lit(id_base)).cast("string"))


def _ids_over_time(events: DataFrame, documents: DataFrame) -> DataFrame:
    """`events` with document_id, the smallest id that bears the title by then.

    `events`: title, ts, event_id, phase and id, which is null where nothing is inserted. The
    documents that were there before them are one row per title at the start of time.
    """
    before = _ids_by_title(documents.filter("title IS NOT NULL")).select(
        "title",
        F.expr(EARLIEST).alias("ts"),
        F.lit(-1).cast("long").alias("event_id"),
        F.lit(0).alias("phase"),
        F.col("document_id").cast("long").alias("id"),
    )
    rows = events.unionByName(before, allowMissingColumns=True)
    order = ["ts", "event_id", "phase"]
    rows = running(rows, ["title"], order, {"document_id": ("min", F.col("id"))})
    return rows.withColumn("document_id", F.col("document_id").cast("string"))


def _as_event(phase: int, inserted: Column, request: Column | None = None) -> list[Column]:
    carried = [] if request is None else [request.alias("request")]
    row = [F.col("title"), F.col("ts"), F.col("event_id"), F.lit(phase).alias("phase")]
    return [*row, inserted.cast("long").alias("id"), *carried]


def ids_by_title_at(requests: DataFrame, created: DataFrame, documents: DataFrame) -> DataFrame:
    """Requests with document_id: the id their title resolves to when they arrive, null if no
    document bears it yet. A document created in the same event comes first.

    `requests`: title, ts, event_id and any other columns; a null title finds nothing.
    `created`: from `created_documents`; `documents`: those that were there before.
    """
    named = created.filter("title IS NOT NULL").select(_as_event(0, F.col("created_id")))
    whole = F.struct(*[F.col(f"`{c}`") for c in requests.columns])
    asked = requests.select(_as_event(1, F.lit(None), whole))
    rows = _ids_over_time(asked.unionByName(named, allowMissingColumns=True), documents)
    return rows.filter("request IS NOT NULL").select("request.*", "document_id")


def _with_names(joins: DataFrame, created: DataFrame, documents: DataFrame) -> DataFrame:
    """Join requests with `named`, the document they move their connection to, and `refused`."""
    titled = F.coalesce(F.col("title"), F.lit("")) != ""
    found = ids_by_title_at(joins.filter(titled), created, documents)
    untitled = joins.filter(~titled).withColumn("document_id", F.lit(None).cast("string"))
    named = F.when(titled, F.col("document_id")).otherwise(F.col("doc_id"))
    return found.unionByName(untitled).withColumns(
        {"named": named, "refused": titled & F.col("document_id").isNull()}
    )


def join_targets(
    joins: DataFrame, created: DataFrame, documents: DataFrame, hot=COUNT
) -> DataFrame:
    """The document that each join request is for, and the error where its title is unknown.

    `joins`: event_id, ts, conn_id, user_id, title, and doc_id, the document a connection was
    opened on. A known title becomes the connection's document; an unknown one is refused and
    leaves the connection where it was; without either the join is for the current document,
    '' if there never was one. Refused requests have a null doc_id. `hot`: the connections too large
    for one task, if known.
    """
    # One row per join: counted on the joins, the titles need not be resolved for it.
    hot = hot_keys(joins, ["conn_id"]) if hot is COUNT else hot
    rows = _with_names(joins, created, documents)
    current = {"current": ("last", F.col("named"))}
    rows = running(rows, ["conn_id"], ["ts", "event_id"], current, hot=hot)
    return rows.select(
        "event_id",
        "ts",
        "conn_id",
        "user_id",
        F.when(~F.col("refused"), F.coalesce("current", F.lit(""))).alias("doc_id"),
        F.when(F.col("refused"), "GET_DOCID_FAILED").alias("error"),
    )


def documents_asked(
    asks: DataFrame, joins: DataFrame, created: DataFrame, documents: DataFrame
) -> DataFrame:
    """Asks (event_id, ts, conn_id and more) with doc_id, the document their connection is in
    when they arrive, '' if there never was one. A join of the same event comes first."""
    moves = _with_names(joins, created, documents).select(
        "event_id", "ts", "conn_id", "named", F.lit(0).alias("phase")
    )
    whole = F.struct(*[F.col(f"`{c}`") for c in asks.columns]).alias("request")
    asked = asks.select("event_id", "ts", "conn_id", F.lit(1).alias("phase"), whole)
    rows = moves.unionByName(asked, allowMissingColumns=True)
    order = ["ts", "event_id", "phase"]
    rows = running(rows, ["conn_id"], order, {"current": ("last", F.col("named"))})
    return rows.filter("request IS NOT NULL").select(
        "request.*", F.coalesce("current", F.lit("")).alias("doc_id")
    )


def create_documents(requests: DataFrame, documents: DataFrame, id_base: int) -> DataFrame:
    """Insert a document per request, then answer with the id its title resolves to by then.

    Returns one row per request: the new row (created_id, owner_id, title), the resolved id,
    the owner's presence in the resolved document (name and expiry) and the answer text. A null
    title is inserted too, but resolves to nothing.
    """
    created = created_documents(requests, id_base)
    whole = F.struct("user_id", "username", "sec", "created_id")
    own = F.when(F.col("title").isNotNull(), F.col("created_id"))
    rows = _ids_over_time(created.select(_as_event(0, own, whole)), documents)
    return rows.filter("request IS NOT NULL").select(
        "event_id",
        "request.created_id",
        F.col("request.user_id").alias("owner_id"),
        "title",
        "document_id",
        "request.username",
        expire_at(F.col("request.sec"), F.lit(PRESENCE_TTL)).alias("expire_at"),
        document_text(F.col("document_id"), "created by user ", F.col("request.user_id"))
        .alias("content"),
    )


def new_snapshots(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Batch rows whose (document_id, revision) is not stored, one per key: the first by the
    batch's column `write_no` where it has one, else the smallest text."""
    key = ["document_id", "revision"]
    first = F.min("content")
    if "write_no" in batch.columns:
        first = F.min_by("content", "write_no")
    unique = batch.groupBy(*key).agg(first.alias("content"))
    return unique.join(stored.select(*key), key, "left_anti")


def insert_ignore(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored snapshots after the batch; an existing key keeps its first content."""
    return stored.unionByName(new_snapshots(batch, stored))


def register_users(requests: DataFrame, users: DataFrame) -> DataFrame:
    """First request for a free name creates it; all others are rejected."""
    # All that is needed meets on the name: the first request, and the user who has it.
    first = requests.groupBy("username").agg(F.min("request_id").alias("first_request"))
    taken = users.select("username").distinct().withColumn("taken", F.lit(True))
    won = F.col("taken").isNull() & (F.col("request_id") == F.col("first_request"))
    return (
        requests.join(first, "username", "left")
        .join(taken, "username", "left")
        .select(
            "request_id",
            "username",
            F.when(won, "created").otherwise("USERNAME_TAKEN").alias("status"),
        )
    )
