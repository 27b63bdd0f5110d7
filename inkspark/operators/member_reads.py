"""Reads of a document's members as events that delete.

A read removes the members that have expired by then, with their names; a clean-up does so too
and takes a document without members out of the active ones. Reads ("asks") are folded together
with the writes of `presence.member_events`: no read is paired with the members it saw.

Asks have event_id, ts, sec, doc_id and clean (whether it is a clean-up). Within one event they
come after all that makes a member. Asks of a null document are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import expire_at
from ..runtime import hot_keys, hot_within
from .presence import ASK_PHASE, PHASES
from .scan import running

_ORDER = ["ts", "event_id"]
_MEMBER = ["doc_id", "user_id"]
# Of one second an expiry comes first, then writes and reads in their order.
_SWEEP = ["at", "phase", *_ORDER]


def _turn() -> Column:
    return F.struct(*_ORDER)


def numbered_asks(asks: DataFrame) -> DataFrame:
    """Asks under ids that order them among the member events."""
    return asks.withColumn("event_id", F.col("event_id") * PHASES + ASK_PHASE)


def sweep(events: DataFrame, asks: DataFrame) -> DataFrame:
    """Writes, expiries and reads of every document in order of time.

    `kind` is write, expiry, read or clean; `alive` the members alive after the row. An expiry is
    of a write that expires before the member's next one: `removed_by` is the read that takes
    the member away, null if none does, and `final` tells that no write of the member follows.
    """
    rows = events.filter("doc_id <> ''").select(
        *_ORDER, "sec", *_MEMBER, "username", expire_at(F.col("sec"), F.col("ttl")).alias("expire_at")
    )
    asked = numbered_asks(asks).filter("doc_id IS NOT NULL").select(
        *_ORDER, "doc_id", F.col("sec").alias("at"), F.lit(1).alias("phase"),
        F.lit(0).cast("long").alias("step"),
        F.when(F.col("clean"), "clean").otherwise("read").alias("kind"),
    )
    # A write becomes two rows at most, so documents are counted at twice their writes.
    doubled = rows.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))))
    hot = hot_keys(doubled.select("doc_id").unionByName(asked.select("doc_id")), ["doc_id"])
    by_member = hot_within(hot, rows, _MEMBER)
    rows = running(rows, _MEMBER, _ORDER, {"held_until": ("prev", F.col("expire_at"))}, hot=by_member)
    following = {"next_sec": ("prev", F.col("sec")), "next_turn": ("prev", _turn())}
    rows = running(rows, _MEMBER, _ORDER, following, True, by_member)
    enters = F.col("held_until").isNull() | (F.col("held_until") <= F.col("sec"))
    runs_out = F.col("next_sec").isNull() | (F.col("next_sec") >= F.col("expire_at"))

    def step(at: str, phase: int, change: Column, kind: str) -> Column:
        return F.struct(
            F.col(at).alias("at"), F.lit(phase).alias("phase"), change.cast("long").alias("step"),
            F.lit(kind).alias("kind"),
        )

    write = step("sec", 1, F.when(enters, 1).otherwise(0), "write")
    expiry = step("expire_at", 0, F.lit(-1), "expiry")
    moves = F.when(runs_out, F.array(write, expiry)).otherwise(F.array(write))
    steps = rows.select(
        *_ORDER, *_MEMBER, "username", "expire_at", "next_turn", F.inline(moves)
    ).unionByName(asked, allowMissingColumns=True)
    steps = running(steps, ["doc_id"], _SWEEP, {"alive": ("sum", F.col("step"))}, hot=hot)
    read = F.when(F.col("kind").isin("read", "clean"), _turn())
    steps = running(steps, ["doc_id"], _SWEEP, {"next_read": ("last", read)}, True, hot)
    in_time = F.col("next_turn").isNull() | (F.col("next_read") < F.col("next_turn"))
    ends = F.col("kind") == "expiry"
    return steps.select(
        *_ORDER, *_MEMBER, "username", "expire_at", "kind", "alive",
        F.when(ends & in_time, F.col("next_read.event_id")).alias("removed_by"),
        (ends & F.col("next_turn").isNull()).alias("final"),
    )


def answers(swept: DataFrame) -> DataFrame:
    """Per ask, under its own id: the members it removed, those left (all alive), and whether
    the document has none left and, being cleaned up, leaves the active ones."""
    asked = swept.filter("kind IN ('read', 'clean')").select("event_id", "doc_id", "kind", "alive")
    gone = (
        swept.filter("removed_by IS NOT NULL")
        .groupBy(F.col("removed_by").alias("event_id"))
        .agg(F.count("*").alias("removed"))
    )
    return asked.join(gone, "event_id", "left").select(
        F.floor(F.col("event_id") / PHASES).cast("long").alias("event_id"),
        "doc_id",
        F.coalesce("removed", F.lit(0)).alias("removed"),
        F.col("alive").alias("members_left"),
        ((F.col("kind") == "clean") & (F.col("alive") == 0)).alias("leaves_active"),
    )


def members_after(swept: DataFrame) -> DataFrame:
    """The members, with their names, that are stored after all writes and reads: those whose
    last write no read found expired."""
    return swept.filter("final AND removed_by IS NULL").select(*_MEMBER, "username", "expire_at")


def active_after(swept: DataFrame) -> DataFrame:
    """The active documents after all writes and clean-ups: each write adds its document, a
    clean-up that leaves no member takes it out."""
    emptied = (F.col("kind") == "clean") & (F.col("alive") == 0)
    per_doc = swept.groupBy("doc_id").agg(
        F.max(F.when(F.col("kind") == "write", _turn())).alias("written"),
        F.max(F.when(emptied, _turn())).alias("cleaned"),
    )
    still = F.col("cleaned").isNull() | (F.col("cleaned") < F.col("written"))
    return per_doc.filter(F.col("written").isNotNull() & still).select("doc_id")
