"""Rooms and fan-out.

A message goes to every connection in a room, so its deliveries number messages times
connections. They are kept in exact compact forms that grow with the input only: per stay
of a connection, the range of revisions it receives; per message, how many receive it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import epoch_micros
from ..runtime import hot_keys, hot_within
from .presence import join_gate
from .scan import COUNT, running

_FOREVER = 2**62


def intervals(joins: DataFrame, active: DataFrame, hot=COUNT) -> DataFrame:
    """Stays of connections in rooms: joined_us, and left_us (null while still there).

    Joining another document leaves the old room first; if the new document is not active at
    that time the connection is then in no room, and may try again. Joining the document one
    is in changes nothing. `active`: doc_id and since. `hot`: the connections too large for one
    task, if known.
    """
    order = ["ts", "event_id"]
    hot = hot_keys(joins, ["conn_id"]) if hot is COUNT else hot
    last = F.struct("doc_id", "ok")
    rows = running(join_gate(joins, active), ["conn_id"], order, {"last": ("prev", last)}, hot=hot)
    stays_in = (F.col("last.doc_id") == F.col("doc_id")) & F.col("last.ok")
    moves = rows.filter(~F.coalesce(stays_in, F.lit(False)))
    moves = running(moves, ["conn_id"], order, {"left_at": ("prev", F.col("ts"))}, True, hot)
    return moves.filter("ok").select(
        "conn_id",
        "user_id",
        "doc_id",
        epoch_micros(F.col("ts")).alias("joined_us"),
        epoch_micros(F.col("left_at")).alias("left_us"),
    )


def _stay_edges(stays: DataFrame) -> DataFrame:
    """Two rows per stay; at equal times an edge comes before a message."""
    edges = F.array(
        F.struct(F.col("joined_us").alias("at"), F.lit(1).alias("step")),
        F.struct(F.coalesce("left_us", F.lit(_FOREVER)).alias("at"), F.lit(-1).alias("step")),
    )
    return stays.select("doc_id", "conn_id", "joined_us", F.inline(edges)).withColumn("phase", F.lit(0))


def sent_times(ops: DataFrame, hot=COUNT) -> DataFrame:
    """`ops` with ts_us raised to the latest time up to their revision."""
    return running(ops, ["doc_id"], ["revision"], {"sent_us": ("max", F.col("ts_us"))}, hot=hot).select(
        *[F.col("sent_us").alias(c) if c == "ts_us" else F.col(c) for c in ops.columns]
    )


def delivery_ranges(ops: DataFrame, stays: DataFrame) -> DataFrame:
    """Per stay that saw ops: their revision range, their number, and how many were delivered
    (all but the connection's own).

    `ops`: doc_id, revision, conn_id (the sender) and ts_us. Messages are sent in the order of
    the log, so an op goes out no sooner than the ops before it, whatever its own clock says:
    its time is the latest up to its revision. So the ops of a stay are one unbroken range.
    """
    hot = hot_keys(ops.select("doc_id").unionByName(_stay_edges(stays).select("doc_id")), ["doc_id"])
    messages = sent_times(ops, hot).select(
        "doc_id", "conn_id", F.lit(None).cast("long").alias("joined_us"),
        F.col("ts_us").alias("at"), F.lit(0).alias("step"), F.lit(1).alias("phase"), "revision",
    )
    rows = _stay_edges(stays).withColumn("revision", F.lit(None).cast("long")).unionByName(messages)
    rows = rows.withColumn("tie", F.coalesce("revision", "joined_us"))
    order = ["at", "phase", "step", "tie"]
    sent = F.col("revision").isNotNull().cast("long")
    pairs = ["doc_id", "conn_id"]
    rows = running(rows, pairs, order, {"own": ("sum", sent)}, hot=hot_within(hot, rows, pairs))
    rows = running(
        rows, ["doc_id"], [*order, "conn_id"],
        {"total": ("sum", sent), "reached": ("last", F.col("revision"))}, hot=hot,
    )
    joined, left = F.col("step") == 1, F.col("step") == -1

    def at(edge, name):
        return F.max(F.when(edge, F.col(name)))

    return (
        rows.filter("phase = 0")
        .groupBy("conn_id", "doc_id", "joined_us")
        .agg(
            at(left, "reached").alias("last_revision"),
            (at(left, "total") - at(joined, "total")).alias("ops_in_stay"),
            (at(left, "own") - at(joined, "own")).alias("own_ops"),
        )
        .filter("ops_in_stay > 0")
        .select(
            "conn_id", "doc_id", "joined_us",
            (F.col("last_revision") - F.col("ops_in_stay") + 1).alias("first_revision"),
            "last_revision", "ops_in_stay",
            (F.col("ops_in_stay") - F.col("own_ops")).alias("delivered"),
        )
    )


def outbox(ranges: DataFrame, ops: DataFrame) -> DataFrame:
    """The single messages of chosen stays: one row per (connection, op it receives).

    Filter `ranges` (from `delivery_ranges`) to the connections to serve first. A range
    becomes its revisions, so ops are found by an equi-join on (document, revision).
    `ops`: doc_id, revision, conn_id (the sender) and any payload columns.
    """
    wanted = ranges.select(
        "conn_id", "doc_id", F.explode(F.sequence("first_revision", "last_revision")).alias("revision")
    )
    sent = ops.withColumnRenamed("conn_id", "sender")
    return wanted.join(sent, ["doc_id", "revision"]).filter("sender <> conn_id").drop("sender")


def recipients(messages: DataFrame, stays: DataFrame, skip_sender: bool) -> DataFrame:
    """Connections in the room at each message, the sender's own left out if asked.

    `messages`: doc_id, conn_id (the sender), ts_us and a unique LONG `message_id`.
    """
    sent = messages.select(
        "doc_id", "conn_id", F.col("ts_us").alias("at"), F.lit(0).alias("step"),
        F.lit(1).alias("phase"), F.col("message_id").alias("tie"),
    )
    edges = _stay_edges(stays).withColumnRenamed("joined_us", "tie")
    rows = edges.select(*sent.columns).unionByName(sent)
    order = ["at", "phase", "step", "tie"]
    count = F.col("step").cast("long")
    hot = hot_keys(rows, ["doc_id"])
    if skip_sender:
        pairs = ["doc_id", "conn_id"]
        rows = running(rows, pairs, order, {"own": ("sum", count)}, hot=hot_within(hot, rows, pairs))
    else:
        rows = rows.withColumn("own", F.lit(0).cast("long"))
    rows = running(rows, ["doc_id"], [*order, "conn_id"], {"here": ("sum", count)}, hot=hot)
    return rows.filter("phase = 1").select(
        "doc_id", F.col("tie").alias("message_id"), (F.col("here") - F.col("own")).alias("recipients")
    )


def receivers(messages: DataFrame, stays: DataFrame) -> DataFrame:
    """The connections in the room at each of some chosen messages: (event_id, conn_id).

    `messages`: event_id, doc_id, ts_us. Stays and messages meet in the days they share, so
    the time conditions only see rows of one document and day.
    """
    day = 86_400_000_000
    last = messages.agg(F.max("ts_us")).first()[0]
    until = F.least(F.coalesce("left_us", F.lit(_FOREVER)), F.lit(last or 0))
    held = stays.filter(F.col("joined_us") <= F.lit(last or 0)).select(
        "doc_id", "conn_id", "joined_us", F.coalesce("left_us", F.lit(_FOREVER)).alias("left_us"),
        F.explode(
            F.sequence(F.floor(F.col("joined_us") / day), F.floor(F.greatest(until, "joined_us") / day))
        ).alias("day"),
    )
    asked = messages.withColumn("day", F.floor(F.col("ts_us") / day))
    return (
        asked.join(held, ["doc_id", "day"])
        .filter("joined_us <= ts_us AND left_us > ts_us")
        .select("event_id", "doc_id", "conn_id")
    )


def in_room(stays: DataFrame, now_us: int) -> DataFrame:
    """Connections in each room at an instant."""
    return stays.filter(
        (F.col("joined_us") <= now_us) & (F.coalesce("left_us", F.lit(_FOREVER)) > now_us)
    ).select("conn_id", "user_id", "doc_id")


def presence_fanout(connections: DataFrame, alive: DataFrame) -> DataFrame:
    """One presence message per connection in a room, the sender included.

    The member list itself is kept once per document (`member_pages`), not once per message.
    """
    sizes = alive.groupBy("doc_id").agg(F.count("*").alias("members"))
    return connections.join(sizes, "doc_id", "left").select(
        "conn_id", "doc_id", F.coalesce("members", F.lit(0)).alias("members")
    )
