"""Event log files, snapshot appends and message lines."""

from __future__ import annotations

from compare import spark_rows
from conftest import DATA
from pyspark.sql import functions as F

from inkspark.operators import messages
from inkspark.operators.oplog import op_log
from inkspark.operators.sequencer import sequence
from inkspark.sources import event_log, tables
from inkspark.sources.fixtures import Inputs

SF = f"{DATA}/sf0.001"


def test_event_log_files_round_trip_in_order(spark, tmp_path):
    log = op_log(sequence(Inputs(spark, SF).submissions()))
    event_log.write_files(log, str(tmp_path / "log"))
    back = event_log.read_files(spark, str(tmp_path / "log"))
    assert back.filter("corrupt").isEmpty()
    columns = ["doc_id", "revision", "operation_id", "author_id", "client_id", "client_seq", "base_revision"]
    assert spark_rows(back.select(*columns)) == spark_rows(log.select(*columns))
    assert spark_rows(back.select(F.col("applied_at"))) == spark_rows(log.select("ts"))
    # Read file by file in name order, a document's revisions ascend.
    for doc in ("0", "7"):
        seen = [
            r.revision
            for path in sorted((tmp_path / "log").glob("part-*"))
            for r in event_log.read_files(spark, str(path)).filter(F.col("doc_id") == doc).collect()
        ]
        assert seen == sorted(seen) and seen


def test_torn_records_go_to_quarantine(spark):
    records = spark.createDataFrame(
        [("a", '{"eventType":"OP_APPLIED","docId":"a"'), ("a", "junk"), ("b", None)],
        "key STRING, value STRING",
    )
    good, bad = event_log.split_corrupt(event_log.decode(records))
    assert good.isEmpty() and bad.count() == 3


def test_records_with_fields_of_another_type_go_to_quarantine(spark):
    whole = (
        '{"eventType":"OP_APPLIED","docId":"a","operationId":"o","revision":1,"authorId":1,'
        '"clientId":"c","clientSeq":1,"baseRevision":0,"ops":[],"appliedAt":"2024-01-01T00:00:00.0Z"}'
    )
    bad = [
        whole.replace('"revision":1', '"revision":"x7"'), whole.replace("[]", '"nonsense"'),
        whole.replace('"revision":1,', ""), whole.replace("OP_APPLIED", "OTHER"),
    ]
    records = spark.createDataFrame([("a", v) for v in [whole, *bad]], "key STRING, value STRING")
    good, torn = event_log.split_corrupt(event_log.decode(records))
    assert good.count() == 1 and {r.value for r in torn.collect()} == set(bad)


def test_snapshot_append_skips_stored_keys(spark, tmp_path):
    schema = "document_id STRING, revision LONG, content STRING"
    path = str(tmp_path / "snapshots")
    tables.append_table(spark.createDataFrame([("a", 1, "old")], schema), path)
    batch = spark.createDataFrame([("a", 1, "new"), ("b", 1, "x"), ("b", 1, "x")], schema)
    tables.append_snapshots(batch, path, tables.read_table(spark, path, schema))
    got = sorted(map(tuple, tables.read_table(spark, path).collect()))
    assert got == [("a", 1, "old"), ("b", 1, "x")]


def test_message_lines(spark, tmp_path):
    lines = [
        '{"type":"op_submit","docId":"d","baseRevision":3,"clientId":"c","clientSeq":4,'
        '"ops":[{"kind":"insert","text":"hi"}],"range":{"a":1}}',
        '{"type":"login","username":"bo","password":"secret"}',
        '{"type":"op_sub',
        '{"type":"nonsense"}',
    ]
    (tmp_path / "in.txt").write_text("\n".join(lines))
    decoded = messages.decode(tables.read_message_lines(spark, str(tmp_path)))
    assert "password" not in decoded.schema.simpleString()
    routes = messages.route(decoded).select("route", "older_route").collect()
    assert sorted(map(tuple, routes)) == [
        ("ignored", "ignored"), ("ignored", "login"), ("op_submit", "op_submit"), ("quarantine", "quarantine"),
    ]
    row = messages.submissions(decoded.withColumn("event_id", F.lit(1))).first()
    assert (row.doc_id, row.base_revision, row.client_id, row.client_seq) == ("d", 3, "c", 4)
    assert row.ops == '[{"kind":"insert","text":"hi"}]'
