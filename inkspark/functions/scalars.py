"""Column builders for times, keys, counts and user-facing strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a TIMESTAMP_NTZ, whatever the session zone is."""
    return F.timestamp_diff("SECOND", F.expr(_EPOCH), ts)


def epoch_micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), ts)


def utc_time(text: Column) -> Column:
    """RFC 3339 text to a TIMESTAMP_NTZ in UTC; null if it is no time."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(F.try_to_timestamp(text)), F.expr(_EPOCH))


def expire_at(sec: Column, ttl: Column) -> Column:
    return sec + ttl


# Key formats shared with the serving stores.
DOC_KEYS = {
    "like_key": "Like:{docID:%s}",
    "question_mark_key": "QuestionMark:{docID:%s}",
    "share_key": "Share:{docID:%s}",
    "liked_user_key": "LikedUser:{docID:%s}",
    "question_marked_user_key": "QuestionMarkedUser:{docID:%s}",
    "shared_user_key": "SharedUser:{docID:%s}",
    "room_key": "presence:room:{docID:%s}",
    "names_key": "presence:room:names:{docID:%s}",
    "plain_room_key": "presence:room:%s",
    "plain_names_key": "presence:room:names:%s",
}
DOC_USER_KEYS = {
    "member_key": "presence:member:%s:%d",
    "cursor_key": "presence:cursor:%s:%d",
}
USER_KEYS = {"auth_user_key": "auth:user:{%d}"}
LOGIN_KEYS = {"auth_login_key": "auth:login:name:{%s}"}
DOCS_KEY = "presence:docs"


def key_columns(doc_id: Column, user_id: Column, username: Column) -> dict[str, Column]:
    out = {n: F.format_string(f, doc_id) for n, f in DOC_KEYS.items()}
    out |= {n: F.format_string(f, doc_id, user_id) for n, f in DOC_USER_KEYS.items()}
    out |= {n: F.format_string(f, user_id) for n, f in USER_KEYS.items()}
    out |= {n: F.format_string(f, username) for n, f in LOGIN_KEYS.items()}
    out["docs_key"] = F.lit(DOCS_KEY)
    return out


def to_count(raw: Column) -> Column:
    """Integer text to LONG; null for anything else, overflow included."""
    return F.when(raw.rlike(r"^[+-]?[0-9]+$"), raw.try_cast("bigint"))


def clamp_count(value: Column) -> Column:
    return F.greatest(value, F.lit(0).cast("long"))


def online_text(user_id: Column, username: Column) -> Column:
    return F.format_string("User %d(%s) is online", user_id, username)


def document_text(doc_id: Column, what: str, user_id: Column | None = None) -> Column:
    tail = [] if user_id is None else [user_id.cast("string")]
    return F.concat(F.lit("Document "), doc_id, F.lit(f" {what}"), *tail)
