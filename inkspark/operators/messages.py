"""Inbound messages and requests: decode, route, project, validate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.deltas import ops_encode
from ..schemas import CLIENT_MESSAGE

# Message types with a route, in the main and in the older server.
ROUTES = [
    "heartbeat", "createDocument", "joinDocument", "show_alive_members", "op_submit",
    "saveDocument", "loadDocumentContent",
]
OLDER_ROUTES = [*ROUTES, "register", "login", "setCursor", "getCursor"]


def decode(messages: DataFrame) -> DataFrame:
    """JSON text to one wide struct `message`; `broken` marks text that is not JSON, blank text too."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = messages.withColumn("message", F.from_json("json", CLIENT_MESSAGE, options))
    blank = F.coalesce(F.trim("json") == "", F.lit(False))
    return rows.withColumn("broken", F.col("message._corrupt").isNotNull() | blank)


def _route(kind: Column, known: list[str]) -> Column:
    return (
        F.when(F.col("broken"), "quarantine").when(kind.isin(*known), kind).otherwise("ignored")
    )


def route(decoded: DataFrame) -> DataFrame:
    """Name the handler of each message, and the fixed reply of those that have one."""
    kind = F.col("message.type")
    routed = decoded.withColumns(
        {"route": _route(kind, ROUTES), "older_route": _route(kind, OLDER_ROUTES)}
    )
    reply = F.when(F.col("route") == "heartbeat", "Heartbeat received").when(
        F.col("route") == "ignored", "Unknown message type"
    )
    return routed.withColumn("reply", reply)


def submissions(decoded: DataFrame) -> DataFrame:
    """The submission carried by each `op_submit` message; absent fields are 0 or ''."""
    message = F.col("message")
    return decoded.filter(~F.col("broken") & (message["type"] == "op_submit")).select(
        "event_id",
        F.coalesce(message["docId"], F.lit("")).alias("doc_id"),
        F.coalesce(message["baseRevision"], F.lit(0)).alias("base_revision"),
        F.coalesce(message["clientId"], F.lit("")).alias("client_id"),
        F.coalesce(message["clientSeq"], F.lit(0)).alias("client_seq"),
        ops_encode(message["ops"]).alias("ops"),
    )


def _given(col: str) -> Column:
    return F.nullif(F.col(col), F.lit(""))


def request_doc_id(requests: DataFrame) -> DataFrame:
    """First non-blank of the two query parameters and the two headers."""
    doc = F.coalesce(*[_given(c) for c in ("q_doc_id", "q_docid_camel", "h_docid", "h_docid_camel")])
    return requests.select(
        "event_id", doc.alias("doc_id"), F.when(doc.isNull(), "missing doc_id").alias("error")
    )


def validate_writes(requests: DataFrame) -> DataFrame:
    """Flag write requests without a document or without a user, the document first."""
    return requests.withColumn(
        "error",
        F.when(_given("doc_id").isNull(), "missing doc_id").when(
            F.col("user_id").isNull(), "unauthorized"
        ),
    )
