"""Reads that delete expired members, against a store that is stepped through one by one."""

from __future__ import annotations

import random

import pytest

from inkspark import runtime
from inkspark.operators import member_reads

EVENTS = "event_id LONG, ts TIMESTAMP_NTZ, sec LONG, doc_id STRING, user_id LONG, username STRING, ttl LONG"
ASKS = "event_id LONG, ts TIMESTAMP_NTZ, sec LONG, doc_id STRING, clean BOOLEAN"


def tables(spark, writes, asks):
    def timed(rows, schema):
        plain = schema.replace("ts TIMESTAMP_NTZ, ", "")
        df = spark.createDataFrame(rows, plain)
        return df.withColumn("ts", df.sec.cast("timestamp").cast("timestamp_ntz"))

    # Writes are heartbeats: phase 1 of their event.
    return timed([(e * 4 + 1, *r) for e, *r in writes], EVENTS), timed(asks, ASKS)


def stepped(writes, asks):
    """Answers, members and active documents of a plain store."""
    log = [((sec, e, 0), "write", (doc, user, name, sec + ttl)) for e, sec, doc, user, name, ttl in writes]
    log += [((sec, e, 1), "ask", (e, sec, doc, clean)) for e, sec, doc, clean in asks]
    rooms, active, answers = {}, set(), {}
    for _, kind, row in sorted(log):
        if kind == "write":
            doc, user, name, until = row
            if not doc:
                continue
            rooms.setdefault(doc, {})[user] = (name, until)
            active.add(doc)
            continue
        e, sec, doc, clean = row
        if doc is None:
            continue
        room = rooms.setdefault(doc, {})
        late = [u for u, (_, until) in room.items() if until <= sec]
        for u in late:
            del room[u]
        answers[e] = (doc, len(late), len(room), clean and not room)
        if clean and not room:
            active.discard(doc)
    members = {(d, u, n, t) for d, room in rooms.items() for u, (n, t) in room.items()}
    return answers, members, active


def check(spark, writes, asks):
    swept = member_reads.sweep(*tables(spark, writes, asks))
    answers, members, active = stepped(writes, asks)
    got = {r.event_id: (r.doc_id, r.removed, r.members_left, r.leaves_active) for r in member_reads.answers(swept).collect()}
    assert got == answers
    assert {tuple(r) for r in member_reads.members_after(swept).collect()} == members
    assert {r.doc_id for r in member_reads.active_after(swept).collect()} == active


def test_reads_at_the_edges(spark):
    writes = [
        (1, 10, "d", 5, "a", 10), (2, 15, "d", 6, "b", 3),
        (5, 20, "d", 5, "a", 10),  # in the second in which the first one expires, before the read
        (9, 40, "d", 7, None, 5), (10, 40, "", 7, "c", 5), (11, 41, None, 7, "c", 5),
    ]
    asks = [
        (5, 20, "d", False), (6, 30, "d", False), (7, 30, "d", True), (8, 31, "d", True),
        (12, 45, "x", True), (13, 45, None, False), (14, 45, "", True),
    ]
    check(spark, writes, asks)


def test_an_unread_member_stays(spark):
    check(spark, [(1, 10, "d", 5, "a", 1)], [])
    check(spark, [], [(1, 10, "d", True)])
    check(spark, [(2, 10, "d", 5, "a", 1)], [(1, 10, "d", True)])


@pytest.mark.parametrize("limit", [None, 12])
def test_random_logs(spark, limit):
    rng = random.Random(4)
    if limit:
        spark.conf.set(runtime.MAX_GROUP_ROWS, str(limit))
    try:
        writes = [
            (e, rng.randint(0, 120), rng.choice(["d", "d", "e", "f"]), rng.randint(1, 5), "n", rng.randint(1, 20))
            for e in range(0, 120, 2)
        ]
        asks = [
            (e, rng.randint(0, 140), rng.choice(["d", "e", "f", "g"]), rng.random() < 0.4)
            for e in range(1, 80, 2)
        ]
        check(spark, writes, asks)
    finally:
        spark.conf.unset(runtime.MAX_GROUP_ROWS)


def test_asks_follow_the_connection(spark):
    from inkspark.operators import documents

    joins = spark.sql(
        "SELECT e AS event_id, to_timestamp_ntz('2024-01-01 00:00:0' || t) AS ts, 'c' AS conn_id, 1L AS user_id, d AS doc_id, n AS title "
        "FROM VALUES (1L, 1, '3', NULL), (2L, 2, NULL, 'none'), (4L, 4, NULL, 'plan') AS v(e, t, d, n)"
    )
    asks = spark.sql(
        "SELECT e AS event_id, to_timestamp_ntz('2024-01-01 00:00:0' || t) AS ts, 'c' AS conn_id, true AS clean "
        "FROM VALUES (0L, 0), (1L, 1), (3L, 3), (4L, 4) AS v(e, t)"
    )
    old = spark.createDataFrame([("9", "plan")], "id STRING, title STRING")
    made = spark.createDataFrame([], "event_id LONG, ts TIMESTAMP_NTZ, title STRING, created_id STRING")
    got = documents.documents_asked(asks, joins, made, old).collect()
    assert {r.event_id: r.doc_id for r in got} == {0: "", 1: "3", 3: "3", 4: "9"}
