"""The ways taken for keys too large for one task give the same rows as the plain ways."""

from __future__ import annotations

import json
import random

import pytest
from compare import connect, duck_rows, spark_rows
from conftest import DATA

from pyspark.sql import functions as F

from inkspark import runtime
from inkspark.operators import replay
from inkspark.operators.replay import content_at, content_where, latest_content
from inkspark.operators.scan import running
from inkspark.operators.sequencer import exit_state, sequence
from inkspark.plans.batch import QUERIES
from inkspark.plans.oracle import ORACLE
from inkspark.schemas import ACCEPTED, CONFLICT, DUPLICATE

SF = f"{DATA}/sf0.001"
# Query, and the rows above which a key counts as too large (1,000 events, 10 documents).
SPLIT = {
    "op_sequence": 60,
    "document_content": 25,
    "document_at_revision": 40,
    "snapshot_insert_ignore": 25,
    "op_log_gaps": 25,
    "interaction_apply": 25,
    "presence_alive": 8,
    "presence_sessions": 8,
    "heartbeat_alive": 8,
    "cursor_asof": 8,
    "room_intervals": 20,
    "join_gate": 8,
    "member_reads_answered": 8,
    "create_documents": 3,
    "op_fanout": 30,
    "op_recipients": 30,
    "cursor_fanout": 30,
    "score_rank": 8,
}


def hot(spark, rows, chunk=8):
    spark.conf.set(runtime.MAX_GROUP_ROWS, str(rows))
    spark.conf.set(runtime.MAX_REPLAY_OPS, str(rows))
    spark.conf.set(runtime.REPLAY_CHUNK, str(chunk))


@pytest.fixture(autouse=True)
def plain_settings_after(spark):
    yield
    for key in runtime.DEFAULTS:
        spark.conf.unset(key)


def test_a_key_of_equal_rows_is_hot(spark, tmp_path):
    """Rows that compress to almost nothing still count one by one."""
    path = str(tmp_path / "equal")
    rows = spark.range(3000).select(F.lit("a").alias("k"), F.lit(1).alias("t"))
    rows.unionByName(spark.sql("SELECT 'b' k, 1 t")).coalesce(1).write.parquet(path)
    table = spark.read.parquet(path)
    assert runtime.hot_keys(table, ["k"]) is None
    spark.conf.set(runtime.MAX_GROUP_ROWS, "1000")
    assert [r.k for r in runtime.hot_keys(table, ["k"]).collect()] == ["a"]


@pytest.mark.parametrize("name", sorted(SPLIT))
def test_split_keys_match_sql(spark, name):
    _, expected = duck_rows(connect(SF), ORACLE[name])
    hot(spark, SPLIT[name])
    assert spark_rows(QUERIES[name](spark, SF)) == expected


@pytest.mark.parametrize("descending", [False, True])
def test_running_values_over_split_keys(spark, descending):
    rng = random.Random(7)
    rows = [
        (rng.choice(["big", "big", "big", None, "x"]), t // 3, t, rng.choice([None, rng.randint(-9, 9)]))
        for t in range(400)
    ]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k STRING, t LONG, id LONG, v LONG").repartition(5)
    columns = {kind: (kind, F.col("v")) for kind in ("sum", "max", "min", "last", "prev")}
    expected = spark_rows(running(df, ["k"], ["t", "id"], columns, descending))
    hot(spark, 20)
    assert spark_rows(running(df, ["k"], ["t", "id"], columns, descending)) == expected


def test_merged_deltas_equal_their_sequence():
    """Deltas over a text of unknown length, merged pairwise, against applying each."""
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice("abcdef") for _ in range(60))
        expected, deltas = text, []
        for _ in range(rng.randint(1, 9)):
            run = replay._Run(("d", 0, 0))
            for _ in range(rng.randint(1, 5)):
                ops = [{"kind": "retain", "count": rng.randint(0, 10)},
                       rng.choice([{"kind": "insert", "text": rng.choice(["X", "YZ"])},
                                   {"kind": "delete", "count": rng.randint(0, 3)}])]
                run.apply(ops)
                expected = replay_one(expected, ops)
            assert run.need <= 60
            deltas.append(json.loads(json.dumps(run.pieces)))
        if max(len(expected), 1) > 45:  # otherwise a cut-off cannot be ruled out
            assert replay._apply_pieces(text, replay._merge_all(deltas)) == expected


def simulate(rows):
    """The sequencing rule, one submission at a time."""
    revision, marks, out = {}, {}, []
    for doc, arrival, client, seq, base in sorted(rows):
        if seq <= marks.get((doc, client), 0):
            out.append((doc, arrival, DUPLICATE, None))
        elif base != revision.get(doc, 0):
            out.append((doc, arrival, CONFLICT, None))
        else:
            revision[doc] = base + 1
            marks[doc, client] = seq
            out.append((doc, arrival, ACCEPTED, base + 1))
    return out


def random_submissions(rng, docs, length):
    """Submissions near the real revision, with stale, repeated and far-off ones among them."""
    rows = []
    for d in range(docs):
        mode, revision, marks = d % 4, 0, {}
        for arrival in range(1, length + 1):
            client = f"c{rng.randint(0, 3)}"
            seq = marks.get(client, 0) + rng.choice([1, 1, 1, 2, 0, -1] if mode != 2 else [1, -3, 0])
            base = revision + (rng.choice([0, 0, 0, -1, 1]) if mode != 1 else rng.randint(-3, 1))
            if mode == 3:
                seq, base = rng.randint(-1, 40), rng.randint(0, 12)
            rows.append((f"d{d}", arrival, client, seq, base))
            if seq > marks.get(client, 0) and base == revision:
                revision, marks[client] = revision + 1, seq
    return rows


@pytest.mark.parametrize("limit", [10**6, 30])
def test_sequencing_matches_simulation(spark, limit):
    rows = random_submissions(random.Random(11), 8, 240)
    df = spark.createDataFrame(
        rows, "doc_id STRING, arrival_seq LONG, client_id STRING, client_seq LONG, base_revision LONG"
    ).withColumn("ops", F.lit("[]"))
    hot(spark, limit)
    got = sequence(df.repartition(7)).select("doc_id", "arrival_seq", "status", "revision").collect()
    assert sorted(map(tuple, got)) == sorted(simulate(rows))


def test_sequencing_resumes_from_state(spark):
    rows = random_submissions(random.Random(5), 6, 120)
    schema = "doc_id STRING, arrival_seq LONG, client_id STRING, client_seq LONG, base_revision LONG"
    df = spark.createDataFrame(rows, schema).withColumn("ops", F.lit("[]"))
    first = sequence(df.filter("arrival_seq <= 50"))
    state = exit_state(first)
    hot(spark, 25)
    second = sequence(df.filter("arrival_seq > 50"), state)
    got = first.unionByName(second).select("doc_id", "arrival_seq", "status", "revision").collect()
    assert sorted(map(tuple, got)) == sorted(simulate(rows))


def random_ops(rng):
    ops = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["retain", "insert", "delete", "other"])
        if kind == "insert":
            ops.append({"kind": kind, "text": rng.choice(["", "a", "bc", "é😀", "wxyz"])})
        else:
            ops.append({"kind": kind, "count": rng.randint(0, 12)})
    return ops


def replay_one(text, ops):
    pos = 0
    for op in ops:
        if op["kind"] == "retain":
            pos += op["count"]
        elif op["kind"] == "insert":
            at = min(pos, len(text))
            text = text[:at] + op["text"] + text[at:]
            pos += len(op["text"])
        elif op["kind"] == "delete":
            text = "".join(c for n, c in enumerate(text) if not pos <= n < pos + op["count"])
    return text


@pytest.mark.parametrize("limit", [10**6, 20])
def test_replay_matches_simulation(spark, limit, monkeypatch):
    """Positions past the end are common here, so many composed runs are doubtful."""
    rng = random.Random(3)
    rows, expected = [], {}
    for d in range(6):
        text = ""
        for revision in range(1, 101):
            ops = random_ops(rng)
            if d % 2:  # a document that mostly grows, where composing holds
                ops = [{"kind": "insert", "text": "growing"}, *ops]
            rows.append((f"d{d}", revision, json.dumps(ops)))
            text = replay_one(text, ops)
            expected[f"d{d}", revision] = text
    log = spark.createDataFrame(rows, "doc_id STRING, revision LONG, ops STRING").repartition(5)
    points = spark.createDataFrame(
        [(f"d{d}", r) for d in range(6) for r in (1, 7, 33, 50, 99, 100)], "doc_id STRING, revision LONG"
    )
    hot(spark, limit)
    monkeypatch.setattr(replay, "_MERGE", 3)

    def texts(df):
        return {(r.doc_id, r.revision): r.content for r in df.collect()}

    assert texts(latest_content(log)) == {k: v for k, v in expected.items() if k[1] == 100}
    snapshots = content_where(log, F.col("revision") % 20 == 0)
    assert texts(snapshots) == {k: v for k, v in expected.items() if k[1] % 20 == 0}
    at = texts(content_at(log, snapshots.filter("revision <> 60"), points))
    assert at == {k: expected[k] for k in at} and len(at) == 36
