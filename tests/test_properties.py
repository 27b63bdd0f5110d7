"""Invariants between operators, and independence from input order."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path
from urllib.parse import urlparse

import pytest
from compare import spark_rows
from conftest import DATA
from pyspark.sql import Window
from pyspark.sql import functions as F

from inkspark.operators import interactions, presence, rooms
from inkspark.operators.oplog import op_log, op_times
from inkspark.operators.sequencer import sequence
from inkspark.plans.batch import QUERIES
from inkspark.runtime import DROP_SHUFFLES, shared_dir
from inkspark.sources.fixtures import Inputs

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, SF)


def test_revisions_are_dense_and_marks_ascend(inputs):
    log = op_log(sequence(inputs.submissions()))
    per_doc = log.groupBy("doc_id").agg(
        F.min("revision").alias("low"), F.max("revision").alias("high"), F.count("*").alias("n")
    )
    assert per_doc.filter("low <> 1 OR high <> n").isEmpty()
    by_client = Window.partitionBy("doc_id", "client_id").orderBy("revision")
    steps = log.withColumn("before", F.lag("client_seq", 1, 0).over(by_client))
    assert steps.filter("client_seq <= before").isEmpty()


def test_last_applied_value_is_the_count(inputs):
    requests = inputs.interactions()
    applied = interactions.apply_requests(requests).join(requests.select("event_id", "ts"), "event_id")
    last = applied.groupBy("kind", "doc_id").agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("cnt")
    )
    assert spark_rows(last) == spark_rows(interactions.counts(requests).select(*last.columns))


def test_toggles_go_on_from_members_and_counts(inputs):
    requests = inputs.interactions()
    early, late = requests.filter("event_id < 400"), requests.filter("event_id >= 400")
    members = interactions.members(early)
    counts = interactions.counts(early)
    both = interactions.apply_requests(early).unionByName(
        interactions.apply_requests(late, members, counts)
    )
    assert spark_rows(both) == spark_rows(interactions.apply_requests(requests))
    after = interactions.members_after(late, members)
    assert spark_rows(after) == spark_rows(interactions.members(requests).select(*after.columns))


def test_input_order_does_not_matter(spark, inputs):
    def shuffled(df):
        return df.repartition(13, F.xxhash64("event_id", F.lit("mix")))

    beats, toggles, joins = inputs.heartbeats(), inputs.interactions(), inputs.joins()
    active = presence.active_since(beats)
    for build, rows in [
        (presence.sessions, beats),
        (presence.alive_at_heartbeats, beats),
        (interactions.apply_requests, toggles),
        (lambda df: rooms.intervals(df, active), joins),
    ]:
        assert spark_rows(build(shuffled(rows))) == spark_rows(build(rows))


def test_shorter_expiry_overwrites_a_longer_one(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2024-01-01 00:00:00', 1000L, 'd', 5L, 'u', 500L),"
        "(2, TIMESTAMP_NTZ'2024-01-01 00:00:10', 1010L, 'd', 5L, 'u', 20L),"
        "(3, TIMESTAMP_NTZ'2024-01-01 00:00:00', 1000L, '', 5L, 'u', 20L)"
        " AS t(event_id, ts, sec, doc_id, user_id, username, ttl)"
    )
    members = presence.state(rows)
    assert [tuple(r) for r in members.collect()] == [("d", 5, "u", 1030)]
    assert presence.expired(members, 1030).count() == 1
    assert presence.expired(members, 1029).count() == 0


def test_fanout_skips_only_the_sending_connection(spark):
    stays = spark.createDataFrame(
        [("a1", 1, "d", 0, None), ("a2", 1, "d", 5, None), ("b", 2, "d", 0, 6)],
        "conn_id STRING, user_id LONG, doc_id STRING, joined_us LONG, left_us LONG",
    )
    ops = spark.createDataFrame(
        [("d", 1, "a1", 1), ("d", 2, "b", 5), ("d", 3, "x", 6)],
        "doc_id STRING, revision LONG, conn_id STRING, ts_us LONG",
    )
    got = {r.conn_id: (r.first_revision, r.last_revision, r.delivered) for r in rooms.delivery_ranges(ops, stays).collect()}
    assert got == {"a1": (1, 3, 2), "a2": (2, 3, 2), "b": (1, 2, 1)}
    ranges = rooms.delivery_ranges(ops, stays)
    messages = rooms.outbox(ranges.filter("conn_id <> 'b'"), ops.select("doc_id", "revision", "conn_id"))
    assert sorted((r.conn_id, r.revision) for r in messages.collect()) == [
        ("a1", 2), ("a1", 3), ("a2", 2), ("a2", 3),
    ]
    sent = ops.withColumnRenamed("revision", "message_id")
    per_op = {r.message_id: r.recipients for r in rooms.recipients(sent, stays, True).collect()}
    assert per_op == {1: 1, 2: 2, 3: 2}


def test_outbox_holds_every_delivery(inputs):
    log = op_log(sequence(inputs.submissions()))
    stays = rooms.intervals(inputs.joins(), presence.active_since(inputs.heartbeats()))
    ranges = rooms.delivery_ranges(op_times(log), stays)
    messages = rooms.outbox(ranges, log.select("doc_id", "revision", "conn_id"))
    per_op = messages.groupBy("doc_id", "revision").agg(F.count("*").alias("recipients"))
    ops = op_times(log).withColumnRenamed("revision", "message_id")
    swept = rooms.recipients(ops, stays, True).filter("recipients > 0")
    assert spark_rows(per_op) == spark_rows(swept.withColumnRenamed("message_id", "revision"))
    assert messages.count() == ranges.agg(F.sum("delivered")).first()[0]


def test_members_seen_are_as_many_as_counted(inputs):
    beats = inputs.heartbeats()
    seen = presence.members_seen(beats, beats)
    assert seen.count() == seen.select("event_id", "user_id").distinct().count()
    counted = seen.groupBy("event_id").agg(F.count("*").alias("alive_members"))
    swept = presence.alive_at_heartbeats(beats).select("event_id", "alive_members")
    assert spark_rows(counted) == spark_rows(swept)
    own = seen.join(beats.select("event_id", "user_id"), ["event_id", "user_id"], "left_semi")
    assert own.count() == beats.count()


@pytest.mark.parametrize("limit", [10_000_000, 40])
def test_members_meet_only_those_who_see_them(spark, limit, monkeypatch):
    """Crowded heartbeats, equal times, lives of no length, lost times and repeated rows."""
    monkeypatch.setattr(presence, "ASKED_BLOCK", 8)
    pick, start = random.Random(limit), datetime(2024, 1, 1)
    rows = []
    for event in range(240):
        sec, ttl = pick.randrange(200), pick.choice([-5, 0, 1, 10, 90, None])
        ts = None if event % 50 == 0 else start + timedelta(seconds=sec, microseconds=pick.choice([0, 5]))
        at = None if ts is None else int((ts - datetime(1970, 1, 1)).total_seconds())
        rows.append((event, ts, at, pick.choice(["a", "a", "b", "", None]), pick.randrange(5), f"n{event}", ttl))
    schema = "event_id long, ts timestamp_ntz, sec long, doc_id string, user_id long, username string, ttl long"
    beats = spark.createDataFrame(rows, schema)
    chosen = beats.filter("event_id % 3 = 0").unionByName(beats.filter("event_id = 9"))
    expected = []
    for event, ts, sec, doc, *_ in [*[r for r in rows if r[0] % 3 == 0], rows[9]]:
        latest = {}
        for r in sorted((r for r in rows if r[1] and r[3] == doc and doc), key=lambda r: (r[1], r[0])):
            if ts and (r[1], r[0]) <= (ts, event):
                latest[r[4]] = r
        expected += [
            (event, doc, user, r[5]) for user, r in latest.items() if r[6] is not None and r[2] + r[6] > sec
        ]
    spark.conf.set("spark.inkspark.maxGroupRows", limit)
    try:
        seen = presence.members_seen(chosen, beats)
        assert sorted(map(tuple, seen.collect())) == sorted(expected) and expected
        ranges, _ = presence._seen_by(chosen.filter("doc_id <> '' AND sec IS NOT NULL"), beats)
        assert ranges.agg(F.sum(F.col("high") - F.col("low"))).first()[0] == len(expected)
    finally:
        spark.conf.unset("spark.inkspark.maxGroupRows")


def test_members_seen_stand_in_order_of_time(spark, monkeypatch):
    """Members of one block come as their heartbeats did, so their stretches of ids lie close
    when written; edges of blocks need not fit into a task."""
    monkeypatch.setattr(presence, "SMALL_EDGES", 0)
    schema = "event_id long, sec long, doc_id string, user_id long, username string, ttl long"
    users = random.Random(7).sample(range(1000), 120)
    rows = [(event, 1000 + event, "d", user, f"u{user}", 40) for event, user in enumerate(users)]
    beats = spark.createDataFrame(rows, schema).withColumn("ts", F.col("sec").cast("timestamp").cast("timestamp_ntz"))
    seen = presence.members_seen(beats, beats).collect()
    came = [r.user_id for r, before in zip(seen, [None, *seen]) if before is None or r.user_id != before.user_id]
    assert came == users
    assert [r.event_id for r in seen] == [e for b in range(120) for e in range(b, min(b + 40, 120))]


def test_heartbeat_members_keeps_only_what_its_result_reads(spark, tmp_path):
    def stored():
        return {p.name for p in Path(urlparse(shared_dir(spark)).path).glob("*")}

    columns = ["id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id) AS ts", "id % 7 AS user_id",
               "'view' AS event_type", "0D AS value", "concat('{\"k\": ', id % 30, '}') AS props"]
    spark.range(200).selectExpr(*columns).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(5).selectExpr("id AS doc_id", "'src1' AS source", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    before = stored()
    seen = QUERIES["heartbeat_members"](spark, str(tmp_path))
    assert sorted(p.rsplit("-", 1)[0] for p in stored() - before) == ["asked-blocks", "held"]
    assert spark.conf.get(DROP_SHUFFLES) == "false"
    assert seen.count() == seen.count() > 0
