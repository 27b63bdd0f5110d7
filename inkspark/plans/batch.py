"""Batch queries: each wires derived inputs to operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import deltas, scalars
from ..operators import documents, interactions, member_reads, messages, oplog, presence, ranks, replay, rooms, served
from ..operators.scan import COUNT, running
from ..operators.sequencer import sequence
from ..runtime import drop_paths, hot_keys, materialize, new_path, recorded_paths, shuffles_dropped
from ..schemas import ACCEPTED, PRESENCE_TTL
from ..sources import event_log
from ..sources.fixtures import AS_OF, BATCH_UNIT, NEW_ID_BASE, SMALL_RING, SNAPSHOT_UNIT, Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
    return fn


# -- derived tables shared by several queries --


def labelled(i: Inputs) -> DataFrame:
    """Labelled submissions without their ops."""
    return sequence(i.submissions(), keep=[])


def log(i: Inputs) -> DataFrame:
    return oplog.op_log(sequence(i.submissions()))


def log_table(i: Inputs) -> DataFrame:
    """The op log as a written table, for queries that read it more than once."""
    return materialize(log(i), "op-log")


def _doubling(unit: int) -> Column:
    """Revisions unit, 2 unit, 4 unit, ...: spaced so that snapshots stay linear in the text."""
    n = F.floor(F.col("revision") / unit)
    return (F.col("revision") % unit == 0) & (n.bitwiseAND(n - 1) == 0)


def stored_snapshots(op_log: DataFrame) -> DataFrame:
    return replay.content_where(op_log, _doubling(SNAPSHOT_UNIT))


def snapshot_batch(op_log: DataFrame) -> DataFrame:
    """Snapshots to insert; the ones that clash with stored keys carry other text."""
    wanted = _doubling(BATCH_UNIT) | _doubling(3 * BATCH_UNIT)
    return replay.content_where(op_log, wanted).withColumn(
        "content",
        F.when(_doubling(SNAPSHOT_UNIT), F.concat(F.lit("changed:"), "content")).otherwise(F.col("content")),
    )


def lossy_log(i: Inputs) -> DataFrame:
    """The log as a careless producer leaves it: some revisions lost, some repeated."""
    kept = log_table(i).filter("revision % 17 <> 0")
    return kept.unionByName(kept.filter("revision % 13 = 0"))


def repeated_log(i: Inputs) -> DataFrame:
    """The log with some events published twice, none lost."""
    whole = log_table(i)
    return whole.unionByName(whole.filter("revision % 13 = 0"))


def member_state(i: Inputs) -> DataFrame:
    return presence.state(member_events(i), AS_OF)


def some_names(members: DataFrame) -> DataFrame:
    """A name table with some names missing."""
    return members.filter("user_id % 7 <> 0").select("doc_id", "user_id", "username")


def alive(i: Inputs) -> DataFrame:
    state = materialize(member_state(i), "members")
    return presence.alive_with_names(state, state, AS_OF)


def create_events(i: Inputs) -> DataFrame:
    """The owners of created documents as members of the document their title resolves to."""
    made = documents.create_documents(i.create_requests(), i.documents(), NEW_ID_BASE)
    return i.create_requests().join(
        made.select("event_id", F.col("document_id").alias("doc_id")), "event_id"
    ).withColumn("ttl", F.lit(PRESENCE_TTL).cast("long"))


def active(i: Inputs) -> DataFrame:
    """Documents and when they became active, through a heartbeat or by being created."""
    first = presence.active_since(presence.member_events(i.heartbeats(), create_events(i)))
    # Back from the order over all events to the ids of the inputs.
    since = F.struct(
        F.col("since.ts").alias("ts"), F.floor(F.col("since.event_id") / 4).alias("event_id")
    )
    return first.select("doc_id", since.alias("since"))


def active_table(i: Inputs) -> DataFrame:
    """One row per document, written: it stands beside the heartbeats it is made of."""
    return materialize(active(i), "active")


def join_targets(i: Inputs, hot=COUNT) -> DataFrame:
    """Join requests with the documents they are for, by the titles known when they arrive."""
    made = documents.created_documents(i.create_requests(), NEW_ID_BASE)
    return documents.join_targets(i.join_requests(), made, i.documents(), hot)


def join_events(i: Inputs) -> DataFrame:
    """Joins that succeeded, as members."""
    return (
        presence.join_gate(join_targets(i), active_table(i))
        .filter("ok")
        .withColumns(
            {
                "sec": scalars.epoch_seconds(F.col("ts")),
                "username": F.concat(F.lit("u"), F.col("user_id").cast("string")),
                "ttl": F.lit(PRESENCE_TTL).cast("long"),
            }
        )
    )


def member_events(i: Inputs) -> DataFrame:
    return presence.member_events(i.heartbeats(), create_events(i), join_events(i))


def member_table(i: Inputs) -> DataFrame:
    """Member events as a written table, for queries that read them more than once. Seconds are
    those of their times and not written."""
    rows = materialize(member_events(i.written()).drop("sec"), "member-events")
    return rows.withColumn("sec", scalars.epoch_seconds(F.col("ts")))


def asks(i: Inputs) -> DataFrame:
    """Reads and clean-ups of the documents that connections are in."""
    made = documents.created_documents(i.create_requests(), NEW_ID_BASE)
    return documents.documents_asked(i.member_asks(), i.join_requests(), made, i.documents())


def swept(i: Inputs) -> DataFrame:
    i = i.written()
    return member_reads.sweep(member_table(i), materialize(asks(i), "asks"))


def messages_served(i: Inputs, submissions: DataFrame) -> DataFrame:
    """Load and save messages with the revision they met, given labelled submissions."""
    asked = materialize(served.requests(messages.decode(i.messages())), "served-requests")
    return served.served(asked, submissions)


def stays(i: Inputs) -> DataFrame:
    # Counted once on the requests; the rows of a connection only get fewer after that.
    hot = hot_keys(i.join_requests(), ["conn_id"])
    return rooms.intervals(join_targets(i, hot).filter("error IS NULL"), active(i), hot)


def stays_table(i: Inputs) -> DataFrame:
    """Stays as a written table, for the sweeps, which read them more than once."""
    return materialize(stays(i), "stays")


# -- op log --


@query
def op_sequence(i: Inputs) -> DataFrame:
    return labelled(i).select(
        "doc_id", "arrival_seq", "client_id", "client_seq", "base_revision", "status", "revision"
    )


@query
def op_ack(i: Inputs) -> DataFrame:
    return oplog.acks(labelled(i))


@query
def current_revision(i: Inputs) -> DataFrame:
    accepted = labelled(i).filter(F.col("status") == ACCEPTED)
    return oplog.current_revision(accepted, i.document_requests())


@query
def client_high_water(i: Inputs) -> DataFrame:
    return oplog.client_high_water(labelled(i).filter(F.col("status") == ACCEPTED))


@query
def document_content(i: Inputs) -> DataFrame:
    return oplog.document_content(i.submissions(), log(i), i.document_requests())


@query
def document_at_revision(i: Inputs) -> DataFrame:
    asked = i.ops_since_requests().select("doc_id", F.col("from_revision").alias("revision")).distinct()
    op_log = log_table(i)
    return oplog.document_at_revision(op_log, stored_snapshots(op_log), asked)


@query
def snapshot_rows(i: Inputs) -> DataFrame:
    return oplog.snapshot_rows(log(i))


@query
def documents_served(i: Inputs) -> DataFrame:
    """The answer to every load and save message as of its arrival."""
    i = i.written()
    return messages_served(i, materialize(sequence(i.submissions(), keep=["ts"]), "labelled"))


@query
def document_texts_served(i: Inputs) -> DataFrame:
    """The text that every 20th load and save message met."""
    i = i.written()
    submissions = materialize(sequence(i.submissions()), "labelled")
    op_log = oplog.op_log(submissions)
    chosen = materialize(messages_served(i, submissions).filter("event_id % 20 = 0"), "served")
    texts = served.texts_served(chosen, op_log, stored_snapshots(op_log))
    return texts.select("event_id", "type", "doc_id", "revision", "stores", "content")


@query
def snapshot_insert_ignore(i: Inputs) -> DataFrame:
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("doc_id", "document_id")

    op_log = log_table(i)
    stored = materialize(keyed(stored_snapshots(op_log)), "snapshots")
    return documents.insert_ignore(keyed(snapshot_batch(op_log)), stored)


def _ring_columns(ring: DataFrame) -> DataFrame:
    return ring.select("doc_id", "revision", "operation_id", "author_id", "ops")


@query
def op_ring(i: Inputs) -> DataFrame:
    return _ring_columns(oplog.ring(log_table(i)))


@query
def ops_since(i: Inputs) -> DataFrame:
    return oplog.ops_since(oplog.ring(log_table(i)), i.ops_since_requests())


@query
def op_small_ring(i: Inputs) -> DataFrame:
    return _ring_columns(oplog.ring(log_table(i), SMALL_RING))


@query
def ops_since_small_ring(i: Inputs) -> DataFrame:
    """Catch-up from a ring so short that most requests find a gap below it."""
    return oplog.ops_since(oplog.ring(log_table(i), SMALL_RING), i.ops_since_requests())


@query
def op_log_gaps(i: Inputs) -> DataFrame:
    return oplog.log_gaps(lossy_log(i))


@query
def op_log_dedup(i: Inputs) -> DataFrame:
    return oplog.dedup(repeated_log(i)).select("doc_id", "revision", "operation_id", "client_id", "client_seq")


def _event_columns(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "key", "doc_id", "operation_id", "revision", "author_id", "client_id", "client_seq",
        "base_revision", deltas.ops_encode(F.col("ops")).alias("ops"),
        scalars.epoch_micros(F.col("applied_at")).alias("applied_us"),
    )


@query
def op_log_encode(i: Inputs) -> DataFrame:
    """Encoded records, compared by the fields in their JSON text."""
    value = {
        "event_type": "eventType", "doc_id": "docId", "operation_id": "operationId",
        "client_id": "clientId", "applied_at": "appliedAt",
    }
    numbers = {
        "revision": "revision", "author_id": "authorId", "client_seq": "clientSeq",
        "base_revision": "baseRevision", "retained": "ops[0].count", "deleted": "ops[1].count",
    }
    return event_log.encode(log(i)).select(
        "key",
        *[F.get_json_object("value", f"$.{path}").alias(n) for n, path in value.items()],
        *[F.get_json_object("value", f"$.{path}").cast("long").alias(n) for n, path in numbers.items()],
        F.get_json_object("value", "$.ops[1].text").alias("inserted"),
    )


@query
def op_log_decode(i: Inputs) -> DataFrame:
    """Good rows of a log in which some records were cut short."""
    records = event_log.encode(log(i))
    revision = F.get_json_object("value", "$.revision").cast("long")
    torn = records.withColumn(
        "value", F.when(revision % 31 == 0, F.substring("value", 1, 40)).otherwise(F.col("value"))
    )
    good, _ = event_log.split_corrupt(event_log.decode(torn))
    return _event_columns(good)


@query
def op_log_quarantine(i: Inputs) -> DataFrame:
    records = event_log.encode(log(i)).withColumn(
        "revision", F.get_json_object("value", "$.revision").cast("long")
    )
    text_revision = F.regexp_replace("value", '"revision":\\d+', '"revision":"x7"')
    torn = records.withColumn(
        "value",
        F.when(F.col("revision") % 31 == 0, F.substring("value", 1, 40))
        .when(F.col("revision") % 23 == 0, text_revision)
        .otherwise(F.col("value")),
    ).drop("revision")
    _, bad = event_log.split_corrupt(event_log.decode(torn))
    return bad


@query
def op_log_files(i: Inputs) -> DataFrame:
    """The keyed log written to files and read back: per document its events, its records in
    the order of files and lines that break the order of revisions, and its last revision."""
    path = new_path(i.spark, "keyed-log")
    event_log.write_files(log(i), path)
    rows = event_log.read_ordered(i.spark, path)
    order = ["file_no", "line_no"]
    rows = running(rows, ["doc_id"], order, {"before": ("prev", F.col("revision"))})
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("revision") <= F.col("before")).alias("out_of_order"),
        F.max_by("revision", F.struct(*order)).alias("last_revision"),
    )


# -- interactions --


@query
def interaction_apply(i: Inputs) -> DataFrame:
    return interactions.apply_requests(i.interactions())


@query
def interaction_counts(i: Inputs) -> DataFrame:
    return interactions.counts(i.interactions())


@query
def interaction_members(i: Inputs) -> DataFrame:
    return interactions.members(i.interactions())


@query
def doc_stats_build(i: Inputs) -> DataFrame:
    return interactions.build_doc_stats(i.interactions())


@query
def doc_stats_lookup(i: Inputs) -> DataFrame:
    return interactions.lookup_doc_stats(i.document_requests(), i.doc_stats())


@query
def stat_read_through(i: Inputs) -> DataFrame:
    requests = i.interactions().select("event_id", "kind", "doc_id")
    return interactions.read_through(requests, i.stat_cache(), i.doc_stats())


@query
def count_convert(i: Inputs) -> DataFrame:
    return interactions.convert_counts(i.raw_counts())


# -- presence --


@query
def presence_state(i: Inputs) -> DataFrame:
    return presence.state(member_events(i))


@query
def presence_expired(i: Inputs) -> DataFrame:
    return presence.expired(member_state(i), AS_OF)


@query
def presence_alive(i: Inputs) -> DataFrame:
    """With some names missing from the name table."""
    state = materialize(member_state(i), "members")
    return presence.alive_with_names(state, some_names(state), AS_OF)


@query
def presence_quarantine(i: Inputs) -> DataFrame:
    """Heartbeats that belong to no document."""
    return presence.unplaced(i.loose_heartbeats()).select("event_id", "user_id", "doc_id")


@query
def presence_alive_semi(i: Inputs) -> DataFrame:
    events = member_table(i)
    state = materialize(presence.state(events, AS_OF), "members")
    return presence.alive_by_heartbeat_key(
        presence.room_members(events), state, some_names(state), AS_OF
    )


@query
def room_members(i: Inputs) -> DataFrame:
    return presence.room_members(member_events(i))


@query
def active_documents(i: Inputs) -> DataFrame:
    # A join needs an active document, so it never makes one.
    events = presence.member_events(i.heartbeats(), create_events(i))
    return presence.active_documents(events, AS_OF)


@query
def active_documents_from_keys(i: Inputs) -> DataFrame:
    rooms_seen = i.heartbeats().select("doc_id")
    keys = [F.format_string(scalars.DOC_KEYS[k], "doc_id") for k in ("plain_room_key", "plain_names_key")]
    return presence.documents_from_keys(rooms_seen.select(F.explode(F.array(*keys)).alias("key")))


@query
def presence_cleanup(i: Inputs) -> DataFrame:
    return presence.cleanup(member_state(i), AS_OF)


@query
def member_reads_answered(i: Inputs) -> DataFrame:
    """What every read and clean-up removed and left."""
    return member_reads.answers(materialize(swept(i), "swept"))


@query
def members_after_reads(i: Inputs) -> DataFrame:
    return member_reads.members_after(swept(i))


@query
def active_after_reads(i: Inputs) -> DataFrame:
    return member_reads.active_after(swept(i))


@query
def members_shown(i: Inputs) -> DataFrame:
    """The members that every 20th request showed, each with its text."""
    i = i.written()
    chosen = member_reads.numbered_asks(asks(i).filter("NOT clean AND event_id % 20 = 0"))
    seen = presence.members_seen(chosen, member_table(i))
    return seen.select(
        F.floor(F.col("event_id") / presence.PHASES).cast("long").alias("event_id"),
        "doc_id",
        "user_id",
        scalars.online_text(F.col("user_id"), F.col("username")).alias("content"),
    )


@query
def join_gate(i: Inputs) -> DataFrame:
    """Join requests, the title step included, with their answers."""
    rows = presence.join_gate(join_targets(i), active(i))
    return rows.select(
        "event_id",
        "conn_id",
        "doc_id",
        "ok",
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("ok"), scalars.document_text(F.col("doc_id"), "joined by user ", F.col("user_id")))
        .otherwise(scalars.document_text(F.col("doc_id"), "not found"))
        .alias("content"),
    )


@query
def presence_sessions(i: Inputs) -> DataFrame:
    return presence.sessions(member_table(i))


@query
def heartbeat_alive(i: Inputs) -> DataFrame:
    """Members alive at each heartbeat, whatever made them members."""
    seen = presence.alive_at_heartbeats(member_table(i))
    return presence.of_heartbeats(seen)


@query
def cursor_asof(i: Inputs) -> DataFrame:
    return presence.cursors_as_of(i.cursors())


@query
def presence_messages(i: Inputs) -> DataFrame:
    return alive(i).select(
        "doc_id", "user_id", scalars.online_text(F.col("user_id"), F.col("username")).alias("content")
    )


# -- rooms --


@query
def room_intervals(i: Inputs) -> DataFrame:
    return stays(i)


@query
def op_fanout(i: Inputs) -> DataFrame:
    return rooms.delivery_ranges(oplog.op_times(log_table(i)), stays_table(i))


@query
def op_outbox(i: Inputs) -> DataFrame:
    """The single messages of the connections of every 20th user, from clocks that run apart:
    those of even users are six hours behind."""
    hours = F.lit(6 * 3_600_000_000)
    log_ = log_table(i)
    even = F.col("author_id") % 2 == 0
    ops = log_.select(
        "doc_id", "revision", "conn_id",
        (scalars.epoch_micros(F.col("ts")) - F.when(even, hours).otherwise(0)).alias("ts_us"),
    )
    ranges = rooms.delivery_ranges(ops, stays_table(i))
    user = F.regexp_extract("conn_id", r"^u(\d+)-", 1).cast("long")
    payload = log_.select("doc_id", "revision", "conn_id", "operation_id", "author_id")
    return rooms.outbox(ranges.filter(user % 20 == 0), payload)


@query
def heartbeat_members(i: Inputs) -> DataFrame:
    """The members that every 20th heartbeat saw alive."""
    # Each table goes as soon as the next one is written.
    with shuffles_dropped(i.spark), recorded_paths() as paths:
        i = i.written()
        members = member_table(i)
        done = paths[:-1]
        chosen = presence.member_events(i.heartbeats().filter("event_id % 20 = 0"))
        chosen = materialize(chosen, "chosen")
        drop_paths(i.spark, done)
        seen = presence.members_seen(chosen, members)
    drop_paths(i.spark, [p for p in paths if not p.rsplit("/", 1)[1].startswith(("held-", "asked-blocks-"))])
    return presence.of_heartbeats(seen)


@query
def cursor_receivers(i: Inputs) -> DataFrame:
    """The connections that every 20th cursor message went to."""
    sets = i.cursors().filter("op = 'set' and event_id % 20 = 0").select(
        "event_id", "doc_id", scalars.epoch_micros(F.col("ts")).alias("ts_us")
    )
    return rooms.receivers(sets, stays_table(i))


@query
def op_recipients(i: Inputs) -> DataFrame:
    ops = rooms.sent_times(oplog.op_times(log_table(i))).withColumnRenamed("revision", "message_id")
    return rooms.recipients(ops, stays_table(i), skip_sender=True).withColumnRenamed("message_id", "revision")


@query
def presence_fanout(i: Inputs) -> DataFrame:
    return rooms.presence_fanout(rooms.in_room(stays(i), AS_OF * 1_000_000), alive(i))


@query
def presence_pages(i: Inputs) -> DataFrame:
    return presence.member_pages(alive(i))


@query
def cursor_fanout(i: Inputs) -> DataFrame:
    sets = i.cursors().filter("op = 'set'").select(
        "doc_id",
        F.lit("").alias("conn_id"),
        scalars.epoch_micros(F.col("ts")).alias("ts_us"),
        F.col("event_id").alias("message_id"),
    )
    return rooms.recipients(sets, stays_table(i), skip_sender=False).withColumnRenamed("message_id", "event_id")


# -- documents, users, messages --


@query
def document_id_by_title(i: Inputs) -> DataFrame:
    return documents.id_by_title(i.title_requests(), i.documents())


@query
def user_by_username(i: Inputs) -> DataFrame:
    return documents.user_by_username(i.register_requests(), i.users())


@query
def create_documents(i: Inputs) -> DataFrame:
    return documents.create_documents(i.create_requests(), i.documents(), NEW_ID_BASE)


@query
def register_users(i: Inputs) -> DataFrame:
    return documents.register_users(i.register_requests(), i.users())


@query
def message_route(i: Inputs) -> DataFrame:
    return messages.route(messages.decode(i.messages())).select("event_id", "route", "older_route", "reply")


@query
def submission_project(i: Inputs) -> DataFrame:
    return messages.submissions(messages.decode(i.messages()))


@query
def request_doc_id(i: Inputs) -> DataFrame:
    return messages.request_doc_id(i.request_params())


@query
def request_validate(i: Inputs) -> DataFrame:
    return messages.validate_writes(i.write_requests())


# -- scalar functions, ranks, bitmaps --


@query
def apply_delta_cases(i: Inputs) -> DataFrame:
    ops = deltas.ops_decode(F.col("ops"))
    cases = i.delta_cases().withColumn("decoded", ops)
    return cases.select(
        "event_id",
        deltas.apply_delta(F.col("initial"), F.col("decoded")).alias("result"),
        F.when(~deltas.ops_valid(F.col("decoded")), "INVALID_POSITION").alias("error"),
    )


@query
def key_format(i: Inputs) -> DataFrame:
    rows = presence.state(i.heartbeats())
    keys = scalars.key_columns(F.col("doc_id"), F.col("user_id"), F.col("username"))
    return rows.select("doc_id", "user_id", *[c.alias(n) for n, c in keys.items()])


@query
def score_rank(i: Inputs) -> DataFrame:
    scores = i.ev().groupBy("doc_id", F.col("user_id").cast("string").alias("member")).agg(
        F.count("*").alias("score")
    )
    return ranks.score_ranks(scores)


@query
def activity_bitmap(i: Inputs) -> DataFrame:
    return ranks.activity_days(i.ev())


@query
def active_user_bitmap(i: Inputs) -> DataFrame:
    return ranks.active_user_bitmap(i.ev())
