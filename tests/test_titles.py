"""Titles resolved when a request arrives, and the document a connection is in."""

from __future__ import annotations

import pytest

from inkspark.operators import documents

BASE = 1000


def at(spark, rows, schema):
    """Rows whose `ts` is given in seconds."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("ts", df.ts.cast("timestamp").cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def tables(spark):
    old = spark.createDataFrame([("10", "plan"), ("9", "plan"), ("7", None)], "id STRING, title STRING")
    creates = at(
        spark,
        [(1, 50, 5, "u5", 50, "note"), (4, 20, 6, "u6", 20, "note"), (6, 60, 6, "u6", 60, "plan"), (8, 70, 6, "u6", 70, None)],
        "event_id LONG, ts LONG, user_id LONG, username STRING, sec LONG, title STRING",
    )
    return old, creates


JOINS = "event_id LONG, ts LONG, conn_id STRING, user_id LONG, doc_id STRING, title STRING"


def targets(spark, tables, rows):
    old, creates = tables
    joins = at(spark, rows, JOINS)
    made = documents.created_documents(creates, BASE)
    out = documents.join_targets(joins, made, old).collect()
    return {r.event_id: (r.doc_id, r.error) for r in out}


def test_a_title_resolves_to_the_smallest_id_so_far(spark, tables):
    old, creates = tables
    made = documents.create_documents(creates, old, BASE).collect()
    # The later row has the smaller id: the title moves to it.
    assert {r.event_id: r.document_id for r in made} == {4: "1004", 1: "1001", 6: "9", 8: None}
    assert {r.event_id: r.created_id for r in made} == {4: "1004", 1: "1001", 6: "1006", 8: "1008"}


def test_join_by_title_as_of_the_request(spark, tables):
    got = targets(spark, tables, [
        (3, 20, "c", 1, None, "note"),  # before the create of the same time
        (4, 20, "d", 1, None, "note"),  # in the same event
        (5, 49, "e", 1, None, "note"),
        (6, 50, "f", 1, None, "note"),
        (7, 0, "g", 1, None, "plan"),
    ])
    assert got == {
        3: (None, "GET_DOCID_FAILED"), 4: ("1004", None), 5: ("1004", None),
        6: ("1001", None), 7: ("9", None),
    }


def test_a_refused_title_leaves_the_connection_where_it_was(spark, tables):
    got = targets(spark, tables, [
        (1, 1, "c", 1, None, ""),  # nothing joined yet
        (2, 2, "c", 1, "3", None),
        (3, 3, "c", 1, None, "none such"),
        (4, 4, "c", 1, None, None),
        (5, 5, "c", 1, None, "plan"),
        (6, 6, "c", 1, None, ""),
        (7, 7, "other", 2, None, None),
    ])
    assert got == {
        1: ("", None), 2: ("3", None), 3: (None, "GET_DOCID_FAILED"), 4: ("3", None),
        5: ("9", None), 6: ("9", None), 7: ("", None),
    }


def test_empty_tables(spark, tables):
    old, creates = tables
    assert targets(spark, tables, []) == {}
    none = documents.created_documents(creates.limit(0), BASE)
    joins = at(spark, [(1, 1, "c", 1, None, "note")], JOINS)
    assert documents.join_targets(joins, none, old.limit(0)).first().error == "GET_DOCID_FAILED"
    assert documents.create_documents(creates.limit(0), old, BASE).count() == 0
