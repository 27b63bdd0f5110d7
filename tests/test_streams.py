"""Streams give the rows of their batch twins, and go on correctly after a restart."""

from __future__ import annotations

import pytest
from compare import connect, duck_rows, spark_rows
from conftest import DATA
from pyspark.sql import functions as F

from inkspark.operators.oplog import op_log
from inkspark.operators.sequencer import sequence
from inkspark.plans.streams import STREAM_ORACLE, STREAM_QUERIES
from inkspark.sources.fixtures import Inputs
from inkspark.streaming import feeds, presence, sequencer
from inkspark.streaming.log import SnapshotSink

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(STREAM_QUERIES))
def test_matches_sql(spark, name):
    df = STREAM_QUERIES[name](spark, SF)
    columns, expected = duck_rows(connect(SF), STREAM_ORACLE[name])
    assert sorted(df.columns) == sorted(columns)
    assert spark_rows(df) == expected


def test_a_batch_run_twice_changes_nothing(spark, tmp_path):
    rows = Inputs(spark, SF).submissions()
    first, second = rows.filter("arrival_seq <= 60"), rows.filter("arrival_seq > 60")
    sink = sequencer.BatchSequencer(spark, str(tmp_path / "out"))
    for batch_id, part in [(0, first), (0, first), (1, second), (1, second)]:
        sink(part, batch_id)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert spark_rows(got.select(*sequence(rows).columns)) == spark_rows(sequence(rows))


def test_snapshot_sink_keeps_the_first_write(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    schema = "document_id STRING, revision LONG, content STRING"
    spark.createDataFrame([("a", 1, "first")], schema).write.parquet(path)
    sink = SnapshotSink(path)
    batch = spark.createDataFrame([("a", 1, "later"), ("a", 2, "two")], schema)
    sink(batch, 0)
    sink(batch, 0)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1, "first"), ("a", 2, "two")]


BEAT = "event_id LONG, ts TIMESTAMP_NTZ, sec LONG, doc_id STRING, user_id LONG, ttl LONG"


def beats(spark, values):
    """(user, second, ttl) rows as heartbeats of one document."""
    rows = [(n, None, sec, "d", user, ttl) for n, (user, sec, ttl) in enumerate(values)]
    at = F.timestamp_seconds("sec").cast("timestamp_ntz")
    return spark.createDataFrame(rows, BEAT).withColumn("ts", at).repartition(1)


def run_parts(spark, parts, transform, idle=True):
    """Micro-batches one by one; the query starts anew for each, as after a restart."""
    from inkspark.runtime import new_path

    out, schema = new_path(spark, "out"), []

    def start(stream):
        result = transform(stream)
        schema.append(result.schema)
        return result.writeStream.outputMode("append").format("parquet").option("path", out)

    feeds.replay(parts, start, new_path(spark, "checkpoint"), idle)
    return spark.read.schema(schema[0]).parquet(out)


def presence_rows(spark, parts, delay="0 seconds"):
    out = run_parts(spark, parts, lambda s: presence.presence_stream(s, delay))
    return sorted(
        (r.user_id, r.sec, r.event, r.expire_at, r.session_start, r.session_end, r.heartbeats)
        for r in out.collect() if r.user_id < 9
    )


FAR = (9, 10_000, 1)


def test_presence_waits_for_the_watermark_over_restarts_and_empty_batches(spark):
    rows = beats(spark, [(1, 100, 50), (1, 150, 10), (1, 161, 5), (2, 120, 50), FAR])
    picks = ["event_id = 0", "false", "event_id in (1, 2)", "event_id = 3", "event_id = 4"]
    parts = [rows.filter(p) for p in picks]
    expected = [
        (1, 100, "join", 150, 100, None, 1), (1, 150, "refresh", 160, 100, None, 2),
        (1, 160, "leave", 160, 100, 160, 2), (1, 161, "join", 166, 161, None, 1),
        (1, 166, "leave", 166, 161, 166, 1),
    ]
    # The second user's row is older than the watermark by then and is left out.
    assert presence_rows(spark, parts) == expected


def test_presence_takes_rows_within_the_delay_in_order_of_time(spark):
    values = [(1, 130, 20), (1, 100, 40), (1, 300, 5), (1, 145, 30), FAR]
    rows = beats(spark, values)
    parts = [rows.filter(p) for p in ("event_id in (0, 2)", "event_id in (1, 3)", "event_id = 4")]
    got = presence_rows(spark, parts, "10 minutes")
    from inkspark.operators import presence as batch

    ended = {(r.session_start, r.session_end, r.heartbeats) for r in batch.sessions(rows).collect()}
    assert {r[4:] for r in got if r[2] == "leave"} == ended - {(10_000, 10_001, 1)}


def test_presence_calls_and_timers_are_per_part_of_members(spark, tmp_path):
    many = 3 * presence.MEMBER_PARTS
    rows = beats(spark, [(user, 100, 50) for user in [None, None, *range(many)]])
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(BEAT).parquet(str(tmp_path / "in"))
    with feeds.state_variables(spark, idle=False):
        query = (
            presence.presence_stream(stream).writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "checkpoint"))
            .trigger(availableNow=True).start(str(tmp_path / "out"))
        )
        query.awaitTermination()
    state = query.lastProgress.stateOperators[0]
    assert 0 < state.customMetrics["numRegisteredTimers"] <= presence.MEMBER_PARTS


def test_presence_keeps_members_without_a_user_apart(spark):
    rows = beats(spark, [(None, 100, 50), (1, 110, 50), (None, 120, 50), FAR])
    parts = [rows.filter("event_id < 3"), rows.filter("event_id = 3")]
    out = run_parts(spark, parts, presence.presence_stream)
    left = {
        (r.user_id, r.session_start, r.session_end, r.heartbeats)
        for r in out.filter("event = 'leave'").collect()
    }
    assert left == {(None, 100, 170, 2), (1, 110, 160, 1)}


def test_cursors_go_when_their_time_is_over(spark):
    import time

    cols = "event_id LONG, ts TIMESTAMP_NTZ, sec LONG, doc_id STRING, user_id LONG, op STRING, cursor_json STRING, ttl LONG"
    at = F.timestamp_seconds("sec").cast("timestamp_ntz")
    values = [
        (0, None, 100, "d", 1, "set", "a", 50), (1, None, 149, "d", 1, "get", None, 50),
        (2, None, 150, "d", 1, "get", None, 50), (3, None, 120, "d", 2, "get", None, 50),
    ]
    rows = spark.createDataFrame(values, cols).withColumn("ts", at).repartition(1)
    parts = [rows.filter("event_id = 0"), rows.filter("event_id > 0")]
    out = run_parts(spark, parts, lambda s: presence.cursor_stream(s, 50), idle=False)
    got = sorted((r.event_id, r.cursor_json, r.found) for r in out.collect())
    assert got == [(1, "a", True), (2, None, False), (3, None, False)]

    # With a store that keeps entries for a second, a later read finds none, whatever its clock.
    def slow(stream):
        time.sleep(3)
        return presence.cursor_stream(stream, 1, lag=0)

    out = run_parts(spark, parts[:2], slow, idle=False)
    assert sorted((r.event_id, r.found) for r in out.collect()) == [(n, False) for n in (1, 2, 3)]


def test_counts_of_sub_keys_merge_from_any_row_on(spark):
    from inkspark.streaming import interactions

    rows = Inputs(spark, SF).interactions().filter("doc_id = '3'")
    parts = [rows.filter(F.col("event_id") % 3 == 0), rows.limit(0), rows.filter(F.col("event_id") % 3 != 0)]
    out = run_parts(spark, parts, interactions.toggle_stream)
    first = out.filter(F.col("event_id") % 3 == 0)
    second = out.filter(F.col("event_id") % 3 != 0)
    late = interactions.merge_counts(second, interactions.set_totals(first))
    # The same requests, the second part after the first, in one batch.
    later = F.when(F.col("event_id") % 3 == 0, F.col("ts")).otherwise(
        F.col("ts") + F.expr("INTERVAL 100 YEARS")
    )
    from inkspark.operators.interactions import apply_requests

    whole = apply_requests(rows.withColumn("ts", later))
    expected = spark_rows(whole.filter(F.col("event_id") % 3 != 0))
    assert spark_rows(late.select(*whole.columns)) == expected


def test_documents_go_on_with_text_ring_and_marks_after_a_restart(spark, monkeypatch):
    import random

    from inkspark.operators import pieces

    monkeypatch.setattr(pieces.Pieces.__init__, "__defaults__", ("", None, None, 8))
    rng, rows, text, log = random.Random(3), [], "", []
    for n in range(1, 41):
        at, new = rng.randint(0, len(text) + 3), rng.choice(["ab", "é", "long enough to split"])
        cut = rng.randint(0, 4)
        ops = f'[{{"kind":"retain","count":{at}}},{{"kind":"delete","count":{cut}}},{{"kind":"insert","text":"{new}"}}]'
        rows.append(("d", n, 1, "c", "c1", n, n - 1, ops))
        text = text[:at] + new + text[at + cut:]
        log.append((f"o-d-{n}", text))
    schema = (
        "doc_id STRING, arrival_seq LONG, author_id LONG, conn_id STRING, client_id STRING, "
        "client_seq LONG, base_revision LONG, ops STRING"
    )
    df = spark.createDataFrame(rows, schema).repartition(1)
    parts = [df.filter(f"arrival_seq > {a} AND arrival_seq <= {a + 20}") for a in (0, 20)]

    def transform(stream):
        number = F.col("arrival_seq")
        asked = stream.select(
            "doc_id", "arrival_seq", F.when(number % 2 == 0, "save").otherwise("since").alias("kind"),
            F.greatest(number - 5, F.lit(0)).cast("long").alias("base_revision"),
        )
        return sequencer.document_stream(stream, asked, ring_cap=3)

    out = run_parts(spark, parts, transform).collect()
    for r in out:
        if r.kind == "submit":
            assert (r.status, r.revision) == ("accepted", r.arrival_seq)
        elif r.kind == "save":
            assert (r.revision, r.content) == (r.arrival_seq, log[r.arrival_seq - 1][1])
    for n in range(1, 41, 2):
        got = sorted((r.revision, r.operation_id, r.truncated) for r in out if r.kind == "since" and r.arrival_seq == n)
        first = max(1, n - 2, max(n - 5, 0) + 1)
        cut = max(1, n - 2) > max(n - 5, 0) + 1
        assert got == [(k, f"o-d-{k}", cut) for k in range(first, n + 1)]


def test_reorder_waits_for_late_events_and_gives_up_on_lost_ones(spark):
    log = op_log(sequence(Inputs(spark, SF).submissions())).filter("doc_id = '3'")
    log = log.withColumn("applied_at", F.timestamp_millis(F.col("revision") * 1000))
    rows = log.filter("revision NOT IN (5, 6)").withColumn(
        "sent", F.when(F.col("revision") == 9, 14).otherwise(F.col("revision"))
    ).select("doc_id", "revision", "operation_id", "applied_at", "sent")
    from inkspark.streaming.log import reorder_stream

    closing = spark.sql(
        "SELECT '-' doc_id, 1 revision, '' operation_id, TIMESTAMP'2100-01-01 00:00:00' applied_at, 1 sent"
    )
    out = feeds.replay_to_table(
        rows, "sent", lambda s: reorder_stream(s, "8 seconds"), slices=6, closing=closing
    ).filter("doc_id = '3'")
    got = [r.revision for r in out.orderBy("position").collect()]
    assert got == sorted(r.revision for r in rows.collect())


class Doubler(feeds.RowProcessor):
    def init(self, handle):
        pass

    def on_rows(self, key, rows, timers):
        for r in rows:
            yield r.n, r.text


def test_frames_of_a_processor_are_bounded():
    import pandas as pd

    def frames(rows):
        taken = pd.DataFrame(rows, columns=["n", "text"])
        return list(Doubler("n LONG, text STRING").handleInputRows(("k",), iter([taken]), None))

    many = frames([(n, "") for n in range(2 * feeds.FRAME_ROWS + 1)])
    assert [len(f) for f in many] == [feeds.FRAME_ROWS, feeds.FRAME_ROWS, 1]
    assert [n for f in many for n in f.n] == list(range(2 * feeds.FRAME_ROWS + 1))
    long = frames([(n, "x" * (feeds.FRAME_CHARS // 2)) for n in range(5)])
    assert [len(f) for f in long] == [2, 2, 1]


def test_a_key_with_many_rows_comes_in_more_slices(spark, monkeypatch):
    rows = spark.range(1000).selectExpr("id", "id * id AS at", "CAST(id % 2 AS STRING) AS k")
    rows = rows.unionByName(rows.filter("id % 10 = 0"))
    assert len(feeds._in_slices(rows, "at", 3, None, "k")) == 3
    monkeypatch.setattr(feeds, "KEY_ROWS", 100)
    parts = [[r.id for r in p.collect()] for p in feeds._in_slices(rows, "at", 3, None, "k")]
    assert len(parts) == 6 and max(map(len, parts)) <= 250
    assert sorted(n for p in parts for n in p) == sorted(r.id for r in rows.collect())
    assert all(max(a) < min(b) for a, b in zip(parts, parts[1:]))
