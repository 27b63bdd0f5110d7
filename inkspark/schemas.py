"""Row schemas of the collaboration tables, streams and messages."""

from __future__ import annotations

OP = "STRUCT<kind: STRING, count: INT, text: STRING, attrs: STRING>"
OPS = f"ARRAY<{OP}>"

# Submissions; `ops` is the JSON text of a delta, decoded only where its content matters.
SUBMISSION = (
    "doc_id STRING, arrival_seq LONG, author_id LONG, conn_id STRING, client_id STRING, "
    "client_seq LONG, base_revision LONG, ops STRING, ts TIMESTAMP_NTZ"
)

OP_LOG = (
    "doc_id STRING, revision LONG, operation_id STRING, author_id LONG, conn_id STRING, "
    "client_id STRING, client_seq LONG, base_revision LONG, ops STRING, ts TIMESTAMP_NTZ"
)

DOC_OP_EVENT = (
    "eventType STRING, docId STRING, operationId STRING, revision LONG, authorId LONG, "
    f"clientId STRING, clientSeq LONG, baseRevision LONG, ops {OPS}, appliedAt STRING"
)

CLIENT_MESSAGE = (
    "type STRING, docId STRING, docTitle STRING, range STRING, baseRevision LONG, "
    f"clientId STRING, clientSeq LONG, ops {OPS}, content STRING, "
    "userId LONG, username STRING, _corrupt STRING"
)

# Fixed values shared with the clients.
ACCEPTED = "accepted"
DUPLICATE = "DUPLICATE_OR_OUT_OF_ORDER"
CONFLICT = "REVISION_CONFLICT"
INVALID_POSITION = "INVALID_POSITION"
INVALID_OPS = "INVALID_OPS"
EVENT_TYPE = "OP_APPLIED"
RING_CAP = 1024
PRESENCE_TTL = 600
KINDS = ["like", "question_mark", "share"]
