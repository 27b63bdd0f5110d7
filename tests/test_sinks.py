"""Sinks of micro-batches: batches run again, batches that were killed while they wrote."""

from __future__ import annotations

import pytest

from inkspark.streaming.sinks import MessageSink, PartedSnapshots

SNAPSHOT = "document_id string, revision long, content string"


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_messages_and_quarantine_of_repeated_batches(spark, tmp_path):
    sink = MessageSink(str(tmp_path / "out"))
    first = spark.createDataFrame(
        [('{"type":"heartbeat","docId":"a"}',), ('{"type":"he',), ("",), ('{"type":"heartbeat","docId":"a"}',)],
        "json string",
    )
    second = spark.createDataFrame([('{"type":"ping"}',)], "json string")
    none = spark.createDataFrame([], "json string")
    for batch_id, lines in [(0, first), (0, first), (1, second), (2, none)]:
        sink(lines, batch_id)
    good = sink.good(spark).select("batch", "type", "docId", "route", "reply")
    assert _rows(good.filter("batch = 0")) == [(0, "heartbeat", "a", "heartbeat", "Heartbeat received")] * 2
    assert _rows(good.filter("batch > 0")) == [(1, "ping", None, "ignored", "Unknown message type")]
    assert _rows(sink.quarantine(spark)) == [("", 0), ('{"type":"he', 0)]


def test_no_messages_at_all(spark, tmp_path):
    sink = MessageSink(str(tmp_path / "out"))
    sink(spark.createDataFrame([], "json string"), 0)
    assert _rows(sink.good(spark)) == _rows(sink.quarantine(spark)) == []


def test_a_killed_batch_leaves_one_copy(spark, tmp_path):
    table = PartedSnapshots(str(tmp_path / "snapshots"), parts=4)
    table.load(spark.createDataFrame([("a", 1, "first")], SNAPSHOT))
    batch = spark.createDataFrame(
        [("a", 1, "later"), *[(d, r, f"{d}{r}") for d in "abcdef" for r in (2, 3)]], SNAPSHOT
    )
    # The first try ends after half of its rows are there.
    table._write(batch.filter("document_id < 'd' AND revision > 1"), 0)
    table(batch, 0)
    table(batch, 0)
    expected = [("a", 1, "first"), *[(d, r, f"{d}{r}") for d in "abcdef" for r in (2, 3)]]
    assert _rows(table.read(spark)) == expected
    # A later batch with other text for stored keys adds only what is new.
    table(spark.createDataFrame([("f", 3, "other"), ("f", 4, "f4"), ("f", 4, "f4")], SNAPSHOT), 1)
    assert _rows(table.read(spark)) == [*expected, ("f", 4, "f4")]
    table(spark.createDataFrame([], SNAPSHOT), 2)
    assert _rows(table.read(spark)) == [*expected, ("f", 4, "f4")]


def test_only_touched_parts_are_read(spark, tmp_path):
    table = PartedSnapshots(str(tmp_path / "snapshots"), parts=8)
    many = spark.range(200).selectExpr("CAST(id AS string) AS document_id", "1L AS revision", "'x' AS content")
    table.load(many)
    one = many.filter("document_id = '17'")
    keys = table.stored_keys(one, 0)
    plan = keys._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "part#" in filters and "batch#" in filters
    read = keys.withColumn("part", table._part()).select("part").distinct().count()
    assert read == 1 < many.select(table._part()).distinct().count()


@pytest.mark.parametrize("line", ["null", "[]", "5"])
def test_lines_that_are_no_objects(spark, tmp_path, line):
    sink = MessageSink(str(tmp_path / "out"))
    sink(spark.createDataFrame([(line,)], "json string"), 0)
    kept = sink.good(spark).count() + sink.quarantine(spark).count()
    assert kept == 1
