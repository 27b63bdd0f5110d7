"""Presence with expiry, sessions, cursors and what each heartbeat saw.

`now` is always a parameter. A member is alive while expire_at > now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import epoch_seconds, expire_at
from ..runtime import hot_keys, hot_within, materialize
from .scan import numbered, running

_ORDER = ["ts", "event_id"]
_MEMBER = ["doc_id", "user_id"]
MEMBERS_PER_PAGE = 1000
ASKED_BLOCK = 2048  # chosen heartbeats of a document that meet members together
SMALL_EDGES = 100_000  # blocks whose first and last turns every task may hold
# Time of rows carried over from earlier input.
EARLIEST = "TIMESTAMP_NTZ'0001-01-01 00:00:00'"


def _timed(heartbeats: DataFrame) -> DataFrame:
    """Heartbeats of a document; one sent before joining any belongs to none."""
    return heartbeats.filter("doc_id <> ''").withColumn("expire_at", expire_at(F.col("sec"), F.col("ttl")))


def unplaced(heartbeats: DataFrame) -> DataFrame:
    """The heartbeats that the operators here leave out: those of no document."""
    return heartbeats.filter("doc_id IS NULL OR doc_id = ''")


def state(heartbeats: DataFrame, now: int | None = None) -> DataFrame:
    """Per (document, user): name and expiry of the latest heartbeat, even if it expires sooner.

    With `now`, heartbeats after that second are not looked at.
    """
    last = F.max_by(F.struct("username", "expire_at"), F.struct(*_ORDER))
    seen = _timed(heartbeats)
    if now is not None:
        seen = seen.filter(F.col("sec") <= now)
    return (
        seen.groupBy(*_MEMBER)
        .agg(last.alias("last"))
        .select(*_MEMBER, "last.username", "last.expire_at")
    )


def is_alive(now: int) -> Column:
    return F.col("expire_at") > F.lit(now)


def expired(members: DataFrame, now: int) -> DataFrame:
    return members.filter(~is_alive(now)).select(*_MEMBER, "expire_at")


def alive_with_names(members: DataFrame, names: DataFrame, now: int) -> DataFrame:
    """Alive members with their names ('' if unknown), numbered by expiry, then id as text."""
    alive = members.filter(is_alive(now)).select(*_MEMBER, "expire_at")
    rows = alive.join(names.select(*_MEMBER, "username"), _MEMBER, "left").withColumns(
        {"username": F.coalesce("username", F.lit("")), "member": F.col("user_id").cast("string")}
    )
    return numbered(rows, ["doc_id"], ["expire_at", "member"], "ord").drop("member")


def alive_by_heartbeat_key(
    room: DataFrame, heartbeat_keys: DataFrame, names: DataFrame, now: int
) -> DataFrame:
    """Room members whose own heartbeat key has not expired."""
    live = heartbeat_keys.filter(is_alive(now)).select(*_MEMBER)
    return (
        room.join(live, _MEMBER, "left_semi")
        .join(names.select(*_MEMBER, "username"), _MEMBER, "left")
        .select(*_MEMBER, F.coalesce("username", F.lit("")).alias("username"))
    )


def room_members(heartbeats: DataFrame) -> DataFrame:
    return _timed(heartbeats).select(*_MEMBER).distinct()


def active_documents(heartbeats: DataFrame, now: int) -> DataFrame:
    """Documents that received a heartbeat at or before `now`."""
    return _timed(heartbeats).filter(F.col("sec") <= now).select("doc_id").distinct()


def active_since(heartbeats: DataFrame) -> DataFrame:
    """Per document: when its first member came (`since`, a struct of time and event)."""
    return _timed(heartbeats).groupBy("doc_id").agg(F.min(F.struct(*_ORDER)).alias("since"))


# Within one event: a created document has its owner first, then heartbeats, then joins, then reads.
PHASES = 4
ASK_PHASE = 3


def member_events(
    heartbeats: DataFrame, creates: DataFrame | None = None, joins: DataFrame | None = None
) -> DataFrame:
    """All that makes a member: heartbeats, created documents and joins that succeeded.

    The three have event_id, ts, sec, doc_id, user_id, username and ttl. Event ids become
    unique over them and keep their order.
    """
    columns = ["ts", "sec", "doc_id", "user_id", "username", "ttl"]
    out = None
    for phase, rows in enumerate((creates, heartbeats, joins)):
        if rows is not None:
            numbered_ = (F.col("event_id") * PHASES + phase).alias("event_id")
            rows = rows.select(numbered_, *columns)
            out = rows if out is None else out.unionByName(rows)
    return out


def of_heartbeats(answers: DataFrame) -> DataFrame:
    """Of answers per member event those per heartbeat, under the heartbeats' own ids."""
    return answers.filter(F.pmod("event_id", F.lit(PHASES)) == 1).withColumn(
        "event_id", F.floor(F.col("event_id") / PHASES).cast("long")
    )


def documents_from_keys(keys: DataFrame) -> DataFrame:
    """Document ids from scanned room keys; the name keys under the same prefix are left out."""
    return (
        keys.filter("key LIKE 'presence:room:%' AND key NOT LIKE 'presence:room:names:%'")
        .select(F.regexp_replace("key", "^presence:room:", "").alias("doc_id"))
        .distinct()
    )


def cleanup(members: DataFrame, now: int) -> DataFrame:
    """Per document: members to expire, members left, and whether the document goes inactive."""
    return (
        members.groupBy("doc_id")
        .agg(F.count_if(~is_alive(now)).alias("expired"), F.count_if(is_alive(now)).alias("alive"))
        .withColumn("remove_doc", F.col("alive") == 0)
    )


def join_gate(requests: DataFrame, active: DataFrame) -> DataFrame:
    """Flag requests whose document is active when they arrive.

    `active`: doc_id and since, from `active_since`; an event that makes a document active
    comes before a join of the same event.
    """
    found = requests.join(active.select("doc_id", "since"), "doc_id", "left")
    asked = F.struct(F.col("ts").alias("ts"), F.col("event_id").alias("event_id"))
    return found.withColumn("ok", F.coalesce(F.col("since") <= asked, F.lit(False))).drop("since")


def sessions(heartbeats: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Stretches a user was online in a document without a break.

    A heartbeat at or before the expiry set by the one before it keeps the session going.
    `carried`: sessions still open from earlier heartbeats, which the first ones may extend.
    """
    rows = _timed(heartbeats).select(
        "event_id", "ts", "sec", *_MEMBER, "expire_at", F.lit(1).cast("long").alias("beats")
    )
    if carried is not None:
        rows = rows.unionByName(
            carried.select(
                F.lit(-1).cast("long").alias("event_id"),
                F.expr(EARLIEST).alias("ts"),
                F.col("session_start").alias("sec"),
                *_MEMBER,
                F.col("session_end").alias("expire_at"),
                F.col("heartbeats").alias("beats"),
            )
        )
    hot = hot_keys(rows, _MEMBER)
    rows = running(rows, _MEMBER, _ORDER, {"held_until": ("prev", F.col("expire_at"))}, hot=hot)
    starts = F.col("held_until").isNull() | (F.col("sec") > F.col("held_until"))
    opened = F.when(starts, 1).otherwise(0).cast("long")
    rows = running(rows, _MEMBER, _ORDER, {"session_no": ("sum", opened)}, hot=hot)
    return (
        rows.groupBy(*_MEMBER, "session_no")
        .agg(
            F.min("sec").alias("session_start"),
            F.max_by("expire_at", F.struct(*_ORDER)).alias("session_end"),
            F.sum("beats").alias("heartbeats"),
        )
        .drop("session_no")
    )


def alive_at_heartbeats(heartbeats: DataFrame) -> DataFrame:
    """Members alive in the document at each heartbeat, the sender included, as a count.

    A sweep: every heartbeat that finds its sender not alive adds one, every expiry that is
    reached before the user's next heartbeat takes one away. No heartbeat is paired with
    the members it saw; those are the `sessions` that cover its second.
    """
    rows = _timed(heartbeats).select("event_id", "ts", "sec", *_MEMBER, "expire_at")
    # A heartbeat becomes two steps at most, so documents are counted at twice their rows.
    rooms_ = hot_keys(rows.select("doc_id").withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))), ["doc_id"])
    hot = hot_within(rooms_, rows, _MEMBER)
    rows = running(rows, _MEMBER, _ORDER, {"held_until": ("prev", F.col("expire_at"))}, hot=hot)
    rows = running(rows, _MEMBER, _ORDER, {"next_sec": ("prev", F.col("sec"))}, True, hot)
    enters = F.col("held_until").isNull() | (F.col("held_until") <= F.col("sec"))
    runs_out = F.col("next_sec").isNull() | (F.col("next_sec") >= F.col("expire_at"))
    beat = F.struct(
        F.col("sec").alias("at"), F.lit(1).alias("phase"), F.when(enters, 1).otherwise(0).alias("step")
    )
    end = F.struct(F.col("expire_at").alias("at"), F.lit(0).alias("phase"), F.lit(-1).alias("step"))
    moves = F.when(runs_out, F.array(beat, end)).otherwise(F.array(beat))
    steps = rows.select("event_id", "ts", *_MEMBER, F.inline(moves))
    swept = running(
        steps, ["doc_id"], ["at", "phase", "ts", "event_id"],
        {"alive_members": ("sum", F.col("step").cast("long"))}, hot=rooms_,
    )
    return swept.filter("phase = 1").select("event_id", *_MEMBER, "alive_members")


def members_seen(chosen: DataFrame, heartbeats: DataFrame) -> DataFrame:
    """The members alive at chosen heartbeats: one row per (heartbeat, member).

    `chosen`: event_id, ts, sec (that of ts, as in `heartbeats`) and doc_id of the heartbeats to
    answer. Each heartbeat of a member holds until its expiry or the next one, and meets blocks
    of `ASKED_BLOCK` chosen heartbeats in order of time; what it sees of a block is one range.
    Both inputs are read here and not by the result, whose rows of a block stand together.
    """
    asked = chosen.filter("doc_id <> '' AND sec IS NOT NULL").select(*_ORDER, "sec", "doc_id")
    ranges, _ = _seen_by(asked, heartbeats)
    seen = F.slice("ids", F.col("low") + 1, F.col("high") - F.col("low"))
    return _each(ranges, seen, "event_id").select("event_id", *_MEMBER, "username")


def _seen_by(asked: DataFrame, heartbeats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Heartbeats, once per block that they meet, with the places from `low` and below `high`
    in `ids` of those in `asked` that see them; and the blocks as a written table."""
    blocks = _asked_blocks(asked)
    held = materialize(_held(heartbeats), "held")
    begin = F.struct(epoch_seconds(F.col("ts")).alias("sec"), *_ORDER)
    # An expiry has no time, so it lies before all that is asked in its second.
    end_sec = F.coalesce("expire_at", epoch_seconds(F.col("next_ts")))
    end = F.struct(end_sec.alias("sec"), F.col("next_ts").alias("ts"), F.col("next_id").alias("event_id"))

    edges, most = _block_edges(blocks)
    met = held.join(edges, "doc_id").withColumns({"begin": begin, "end": end})
    met = _count_before(met, "from_block", F.col("lasts"), F.col("begin"), most)
    met = _count_before(met, "to_block", F.col("firsts"), F.col("end"), most)
    these = F.when(F.col("from_block") < F.col("to_block"), F.expr("sequence(from_block, to_block - 1)"))
    met = _each(met, these, "block").select(*held.columns, "block")
    # In order of time within a block, so that the stretches of ids in the result, which are much
    # the same from one member to the next, take little room where it is written. Spark leaves out
    # a sort below a join, but not below a filter that depends on the row's place.
    met = met.repartition("doc_id", "block").sortWithinPartitions("doc_id", "block", "ts")
    met = met.filter(F.monotonically_increasing_id() >= 0)
    found = met.join(blocks.hint("merge").withColumn("ids", F.col("asked.event_id")), ["doc_id", "block"])
    found = found.withColumns({"begin": begin, "end": end})
    found = _count_before(found, "low", F.col("asked"), F.col("begin"), ASKED_BLOCK)
    found = _count_before(found, "high", F.col("asked"), F.col("end"), ASKED_BLOCK)
    return found.select(*_MEMBER, "username", "ids", "low", "high"), blocks


def _asked_blocks(asked: DataFrame) -> DataFrame:
    """What is asked in each document, in order of time and in blocks, as a written table."""
    numbers = numbered(asked, ["doc_id"], ["sec", *_ORDER], "number")
    block = F.floor((F.col("number") - 1) / ASKED_BLOCK).cast("int").alias("block")
    turns = F.sort_array(F.collect_list(F.struct("sec", *_ORDER))).alias("asked")
    return materialize(numbers.groupBy("doc_id", block).agg(turns), "asked-blocks")


def _block_edges(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Per document the first and last turn of each of its blocks, in order; and the most blocks
    of a document."""
    last = F.element_at("asked", -1).alias("last")
    edge = F.struct("block", F.element_at("asked", 1).alias("first"), last)
    edges = (
        blocks.groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(edge)).alias("edges"))
        .select("doc_id", F.col("edges.first").alias("firsts"), F.col("edges.last").alias("lasts"))
    )
    count, most = blocks.agg(F.count("*"), F.coalesce(F.max("block") + 1, F.lit(0))).first()
    return F.broadcast(edges) if count <= SMALL_EDGES else edges, most


def _held(heartbeats: DataFrame) -> DataFrame:
    """Heartbeats that hold for a while, with what ends them: `expire_at`, or the member's next
    heartbeat (`next_ts`, `next_id`) where that comes sooner and `expire_at` is null."""
    rows = (
        _timed(heartbeats)
        .filter("sec IS NOT NULL")
        .select(*_ORDER, *_MEMBER, "username", "ttl")
    )
    hot = hot_within(hot_keys(rows.select("doc_id"), ["doc_id"]), rows.select(*_MEMBER), _MEMBER)
    rows = running(rows, _MEMBER, _ORDER, {"next": ("prev", F.struct(*_ORDER))}, True, hot)
    until = expire_at(epoch_seconds(F.col("ts")), F.col("ttl"))
    moves = epoch_seconds(F.col("next.ts")) < until
    return rows.filter("ttl > 0").select(
        *_ORDER, *_MEMBER, "username",
        F.when(~F.coalesce(moves, F.lit(False)), until).alias("expire_at"),
        F.when(moves, F.col("next.ts")).alias("next_ts"),
        F.when(moves, F.col("next.event_id")).alias("next_id"),
    )


def _each(rows: DataFrame, values: Column, name: str) -> DataFrame:
    """`F.explode`, but Spark puts no filter on `values` below it (see `_count_before`)."""
    out = rows.select("*", F.posexplode_outer(values).alias("place", name))
    return out.filter("place IS NOT NULL").drop("place")


def _count_before(rows: DataFrame, name: str, turns: Column, turn: Column, most: int) -> DataFrame:
    """Add `name`: how many of the sorted array `turns`, `most` at most, come before `turn`.

    A binary search in plain columns, as a function over the array would be interpreted. Do not
    filter by `name`: a filter moves below the steps, which it then repeats within each other.
    """
    out, step = rows.withColumn(name, F.lit(0)), 1 << max(most.bit_length() - 1, 0)
    while step:
        before = F.get(turns, F.col(name) + (step - 1)) < turn
        out = out.withColumn(name, F.when(before, F.col(name) + step).otherwise(F.col(name)))
        step >>= 1
    return out


def _set_cursors(cursors: DataFrame, carried: DataFrame | None) -> DataFrame:
    rows = cursors.select(
        "event_id", "ts", "sec", *_MEMBER, "op", "cursor_json",
        expire_at(F.col("sec"), F.col("ttl")).alias("until"),
    )
    if carried is None:
        return rows
    return rows.unionByName(
        carried.select(
            F.lit(-1).cast("long").alias("event_id"), F.expr(EARLIEST).alias("ts"),
            F.lit(0).cast("long").alias("sec"), *_MEMBER, F.lit("set").alias("op"),
            "cursor_json", "until",
        )
    )


def cursors_as_of(cursors: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """For each read: the cursor last set for that user and document, unless it expired.

    `carried`: cursors (doc_id, user_id, cursor_json, until) set before these rows.
    """
    latest = F.when(F.col("op") == "set", F.struct("cursor_json", "until"))
    rows = running(_set_cursors(cursors, carried), _MEMBER, _ORDER, {"last": ("last", latest)})
    live = F.col("last.until") > F.col("sec")
    return rows.filter("op = 'get'").select(
        "event_id", *_MEMBER, F.when(live, F.col("last.cursor_json")).alias("cursor_json"),
        F.coalesce(live, F.lit(False)).alias("found"),
    )


def latest_cursors(cursors: DataFrame, carried: DataFrame | None, now: int) -> DataFrame:
    """Cursors (doc_id, user_id, cursor_json, until) in force after these rows."""
    last = F.max_by(F.struct("cursor_json", "until"), F.struct(*_ORDER))
    return (
        _set_cursors(cursors, carried)
        .filter("op = 'set'")
        .groupBy(*_MEMBER)
        .agg(last.alias("last"))
        .select(*_MEMBER, "last.cursor_json", "last.until")
        .filter(F.col("until") > now)
    )


def member_pages(alive: DataFrame) -> DataFrame:
    """The member list of each document in pages of bounded size, from `alive_with_names`:
    as JSON (`content`) and as the text shown to users (`listing`)."""
    page = F.floor((F.col("ord") - 1) / MEMBERS_PER_PAGE).cast("long")
    member = F.struct(
        F.col("user_id").alias("userId"), F.nullif(F.col("username"), F.lit("")).alias("username")
    )
    shown = F.format_string("{%d %s}", "user_id", "username")
    entries = F.array_sort(F.collect_list(F.struct("ord", member.alias("member"), shown.alias("shown"))))
    return (
        alive.withColumn("page", page)
        .groupBy("doc_id", "page")
        .agg(entries.alias("entries"))
        .select(
            "doc_id",
            "page",
            F.to_json(F.col("entries.member")).alias("content"),
            F.concat(F.lit("Alive members: ["), F.concat_ws(" ", "entries.shown"), F.lit("]")).alias("listing"),
        )
    )
