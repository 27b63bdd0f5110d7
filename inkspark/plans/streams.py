"""Streaming queries: each replays derived inputs as a stream and must equal its batch twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import epoch_micros
from ..operators import messages, oplog
from ..runtime import materialize, new_path
from ..sources import tables
from ..sources.fixtures import Inputs
from ..streaming import feeds, interactions, log, presence, sequencer, sinks
from . import batch
from .oracle import BODIES, ORACLE, sql_for

STREAM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    STREAM_QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
    return fn


def _clocked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts_us", epoch_micros(F.col("ts")))


def _far_row(rows: DataFrame, **values) -> DataFrame:
    """A closing row of no document, a century after the data."""
    spark = rows.sparkSession
    names = {f.name: F.lit(None) for f in rows.schema.fields}
    names |= {k: F.lit(v) for k, v in values.items()}
    return spark.range(1).select(*[c.alias(n) for n, c in names.items()])


DOCUMENT_RING = 4
_FAR = "2124-01-01 00:00:00"
_FAR_US = 4_859_740_800_000_000


@query
def stream_message_route(i: Inputs) -> DataFrame:
    """Messages decoded and routed as they arrive; torn ones go to the quarantine route."""

    def route(stream: DataFrame) -> DataFrame:
        return messages.route(messages.decode(stream)).select("event_id", "route", "older_route", "reply")

    return feeds.replay_to_table(i.messages(), "event_id", route)


@query
def stream_message_lines(i: Inputs) -> DataFrame:
    """Lines of JSON files as they arrive: good ones decoded and routed, torn ones kept as they are."""
    sink = sinks.MessageSink(new_path(i.spark, "message-lines"))
    feeds.replay_lines(i.messages(), "event_id", "json", tables.stream_message_lines, sink)
    good = sink.good(i.spark).select(
        F.lit(sink.GOOD).alias("kept_in"), "type", F.col("docId").alias("doc_id"),
        F.col("baseRevision").alias("base_revision"), F.col("clientId").alias("client_id"),
        F.col("clientSeq").alias("client_seq"), "route", "older_route", "reply",
    )
    torn = sink.quarantine(i.spark).select(F.lit(sink.TORN).alias("kept_in"), "line")
    return good.unionByName(torn, allowMissingColumns=True)


@query
def stream_sequencer(i: Inputs) -> DataFrame:
    return feeds.replay_to_table(_clocked(i.submissions()), "ts_us", sequencer.sequence_stream)


@query
def stream_sequencer_batches(i: Inputs) -> DataFrame:
    out = new_path(i.spark, "labelled")
    feeds.replay_batches(_clocked(i.submissions()), "ts_us", sequencer.BatchSequencer(i.spark, out))
    return i.spark.read.parquet(out).select(
        "doc_id", "arrival_seq", "client_id", "client_seq", "base_revision", "status", "revision"
    )


def _presence_events(i: Inputs) -> DataFrame:
    rows = _clocked(batch.member_events(i))
    closing = _far_row(rows, doc_id="-", user_id=-1, event_id=-1, ts=_FAR, ts_us=_FAR_US,
                       sec=_FAR_US // 1_000_000, ttl=1)
    out = feeds.replay_to_table(rows, "ts_us", presence.presence_stream, closing=closing)
    return out.filter("doc_id <> '-'")


@query
def stream_presence(i: Inputs) -> DataFrame:
    """Sessions, as members leave."""
    left = _presence_events(i).filter(F.col("event") == presence.LEAVE)
    return left.select("doc_id", "user_id", "session_start", "session_end", "heartbeats")


@query
def stream_presence_events(i: Inputs) -> DataFrame:
    """Members as they join, refresh and leave."""
    return _presence_events(i).select("doc_id", "user_id", "event", "sec", "expire_at")


@query
def stream_interactions(i: Inputs) -> DataFrame:
    out = feeds.replay_to_table(
        _clocked(i.interactions()), "ts_us", interactions.toggle_stream
    )
    return interactions.merge_counts(out)


@query
def stream_cursor(i: Inputs) -> DataFrame:
    rows = _clocked(i.cursors())
    longest = rows.agg(F.max("ttl")).first()[0] or 0
    return feeds.replay_to_table(
        rows, "ts_us", lambda s: presence.cursor_stream(s, longest), idle=False
    )


def _document_requests(rows: DataFrame) -> DataFrame:
    """Saves and catch-up reads that come with some submissions."""
    number = F.col("arrival_seq")
    kind = F.when(number % 50 == 0, sequencer.SAVE).when(number % 37 == 0, sequencer.SINCE)
    back = F.greatest(F.floor(number / 3) - 6, F.lit(0)).cast("long")
    asked = rows.select(
        "doc_id", "arrival_seq", kind.alias("kind"),
        F.when(kind == sequencer.SINCE, back).alias("base_revision"),
    )
    return asked.filter("kind IS NOT NULL")


@query
def stream_documents(i: Inputs) -> DataFrame:
    """Submissions, saves and catch-up reads of documents, answered from the state they meet:
    status and revision, the saved text, the ops of a ring of four."""
    rows = _clocked(i.submissions())

    def documents(stream: DataFrame) -> DataFrame:
        return sequencer.document_stream(stream, _document_requests(stream), DOCUMENT_RING)

    out = feeds.replay_to_table(rows, "ts_us", documents, key="doc_id")
    return out.select(
        "doc_id", "arrival_seq", "kind", "status", "revision", "operation_id", "content", "truncated"
    )


def _published(i: Inputs, lossy: bool) -> DataFrame:
    """The log as published: in each run of four revisions the earlier ones are sent later,
    and repeated events are sent again six hours after. A lossy one misses some revisions."""
    hour = 3_600_000_000
    late = (3 - F.col("revision") % 4) * F.lit(8 * hour)
    rows = batch.log(i).withColumn("ts_us", epoch_micros(F.col("ts")))
    if lossy:
        rows = rows.filter("revision % 17 <> 0")
    rows = rows.withColumn("applied_at", F.timestamp_micros("ts_us"))
    rows = rows.withColumn("sent", F.col("ts_us") + late)
    again = rows.filter("revision % 13 = 0").withColumn("sent", F.col("sent") + F.lit(6 * hour))
    return rows.unionByName(again)


@query
def stream_oplog_dedup(i: Inputs) -> DataFrame:
    rows = _published(i, False).select(
        "doc_id", "revision", "operation_id", "client_id", "client_seq", "applied_at", "sent"
    )
    out = feeds.replay_to_table(rows, "sent", lambda s: log.dedup_stream(s, "2 days"))
    return out.drop("applied_at", "sent")


@query
def stream_oplog_reorder(i: Inputs) -> DataFrame:
    rows = _published(i, True).select("doc_id", "revision", "operation_id", "applied_at", "sent")
    closing = _far_row(rows, doc_id="-", revision=1, operation_id="-", applied_at=_FAR, sent=_FAR_US)
    out = feeds.replay_to_table(
        rows, "sent", lambda s: log.reorder_stream(s, "2 days"), closing=closing
    )
    return out.filter("doc_id <> '-'")


@query
def stream_snapshots(i: Inputs) -> DataFrame:
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("doc_id", "document_id")

    table = sinks.PartedSnapshots(new_path(i.spark, "snapshots"))
    op_log = batch.log_table(i)
    table.load(keyed(batch.stored_snapshots(op_log)))
    feeds.replay_batches(keyed(batch.snapshot_batch(op_log)), "revision", table)
    return table.read(i.spark)


@query
def stream_fanout(i: Inputs) -> DataFrame:
    stays = materialize(batch.stays(i), "stays")
    out = new_path(i.spark, "ranges")
    feeds.replay_batches(
        oplog.op_times(batch.log(i)), "ts_us", log.FanoutSink(lambda: stays, out)
    )
    return log.merge_ranges(i.spark.read.parquet(out))


STREAM_ORACLE = {
    "stream_message_route": ORACLE["message_route"],
    "stream_message_lines": sql_for(
        """SELECT CASE WHEN broken THEN 'quarantine' ELSE 'messages' END AS kept_in,
                  CASE WHEN NOT broken THEN m.type END AS type, CASE WHEN NOT broken THEN doc_id END AS doc_id,
                  CASE WHEN NOT broken AND event_id % 5 <> 0 THEN k END AS base_revision,
                  CASE WHEN NOT broken AND event_id % 5 <> 0 THEN 'c' || CAST(user_id % 4 AS VARCHAR) END AS client_id,
                  CASE WHEN NOT broken AND event_id % 5 <> 0 THEN event_id END AS client_seq,
                  CASE WHEN broken THEN NULL WHEN m.type IN ('setCursor', 'ping') THEN 'ignored'
                       ELSE m.type END AS route,
                  CASE WHEN broken THEN NULL WHEN m.type = 'ping' THEN 'ignored' ELSE m.type END AS older_route,
                  CASE WHEN broken THEN NULL WHEN m.type = 'heartbeat' THEN 'Heartbeat received'
                       WHEN m.type IN ('setCursor', 'ping') THEN 'Unknown message type' END AS reply,
                  CASE WHEN broken THEN substr('{"type":"' || m.type || '","docId":"', 1, 20) END AS line
           FROM messages m"""
    ),
    "stream_sequencer": ORACLE["op_sequence"],
    "stream_sequencer_batches": ORACLE["op_sequence"],
    "stream_presence": ORACLE["presence_sessions"],
    "stream_interactions": ORACLE["interaction_apply"],
    "stream_cursor": ORACLE["cursor_asof"],
    "stream_presence_events": sql_for(
        """SELECT * FROM (WITH turn AS (
             SELECT *, (sec > held) IS NOT FALSE AS opens
             FROM (SELECT *, lag(expire_at) OVER w AS held FROM beats
                   WINDOW w AS (PARTITION BY doc_id, user_id ORDER BY ts, event_id, phase)))
           SELECT doc_id, user_id, CASE WHEN opens THEN 'join' ELSE 'refresh' END AS event, sec, expire_at
           FROM turn
           UNION ALL
           SELECT doc_id, user_id, 'leave', last_expire, last_expire
           FROM (SELECT doc_id, user_id, arg_max(expire_at, (ts, event_id, phase)) AS last_expire
                 FROM (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END)
                                 OVER (PARTITION BY doc_id, user_id ORDER BY ts, event_id, phase) AS no
                       FROM turn)
                 GROUP BY doc_id, user_id, no))"""
    ),
    "stream_documents": sql_for(
        f"""SELECT * FROM (WITH reached AS (
             SELECT doc_id, arrival_seq,
                    coalesce(max(revision) OVER (PARTITION BY doc_id ORDER BY arrival_seq), 0) AS rev
             FROM labelled)
           SELECT doc_id, arrival_seq, 'submit' AS kind, status, revision,
                  CAST(NULL AS VARCHAR) AS operation_id, CAST(NULL AS VARCHAR) AS content,
                  CAST(NULL AS BOOLEAN) AS truncated
           FROM labelled
           UNION ALL
           SELECT r.doc_id, arrival_seq, 'save', NULL, rev, NULL, coalesce(t.content, ''), NULL
           FROM reached r LEFT JOIN texts t ON t.doc_id = r.doc_id AND t.revision = r.rev
           WHERE arrival_seq % 50 = 0
           UNION ALL
           SELECT r.doc_id, arrival_seq, 'since', NULL, l.revision, l.operation_id, NULL,
                  greatest(1, rev - {DOCUMENT_RING} + 1) > greatest(arrival_seq // 3 - 6, 0) + 1
           FROM reached r JOIN log l ON l.doc_id = r.doc_id AND l.revision <= rev
            AND l.revision > greatest(arrival_seq // 3 - 6, 0, rev - {DOCUMENT_RING})
           WHERE arrival_seq % 37 = 0 AND arrival_seq % 50 <> 0)"""
    ),
    "stream_oplog_dedup": ORACLE["op_log_dedup"],
    "stream_oplog_reorder": sql_for(
        f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY revision) AS position,
                   revision, operation_id
            FROM (SELECT DISTINCT doc_id, revision, operation_id FROM lossy)"""
    ),
    "stream_snapshots": ORACLE["snapshot_insert_ignore"],
    "stream_fanout": ORACLE["op_fanout"],
}
