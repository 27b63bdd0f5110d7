"""Delta, key and count functions on fixed vectors."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from inkspark.functions import deltas, scalars

RETAIN = lambda n: {"kind": "retain", "count": n}
INSERT = lambda t: {"kind": "insert", "text": t}
DELETE = lambda n: {"kind": "delete", "count": n}

CASES = [
    ("Hello world", [], "Hello world"),
    ("Hello world", [RETAIN(5), INSERT(" collaborative")], "Hello collaborative world"),
    ("Hello collaborative world", [RETAIN(5), DELETE(14)], "Hello world"),
    ("ab", [RETAIN(100), INSERT("x"), INSERT("y")], "abxy"),
    ("a😀b", [RETAIN(2), INSERT("é")], "a😀éb"),
    ("ab", [{"kind": "bogus", "count": 1}, DELETE(-3), DELETE(99)], ""),
    ("", [INSERT("中文")], "中文"),
    ("abcdef", [RETAIN(4), RETAIN(-2), INSERT("X")], "abXcdef"),
    ("abc", [RETAIN(1), INSERT(""), DELETE(1)], "ac"),
    ("abc", [RETAIN(-1), INSERT("X")], None),
    ("abc", [RETAIN(-1), RETAIN(2), INSERT("X")], "aXbc"),
    ("abc", [{"retain": 5}, {"kind": "insert", "text": "X", "attrs": {"bold": True}}], "Xabc"),
]


def test_apply_delta(spark):
    rows = [(n, text, json.dumps(ops)) for n, (text, ops, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "n INT, initial STRING, ops STRING")
    ops = deltas.ops_decode(F.col("ops"))
    got = df.select("n", deltas.apply_delta(F.col("initial"), ops), deltas.ops_valid(ops)).collect()
    assert [r[1] for r in sorted(got)] == [c[2] for c in CASES]
    assert [r[2] for r in sorted(got)] == [c[2] is not None for c in CASES]


def test_ops_encode_drops_empty_fields(spark):
    text = '[{"kind":"retain","count":0},{"kind":"insert","text":"x","attrs":{"b":1}},{"kind":"delete","count":2}]'
    df = spark.createDataFrame([(text,)], "ops STRING")
    out = df.select(deltas.ops_encode(deltas.ops_decode(F.col("ops")))).first()[0]
    assert json.loads(out) == [
        {"kind": "retain"},
        {"kind": "insert", "text": "x", "attrs": {"b": 1}},
        {"kind": "delete", "count": 2},
    ]


@pytest.mark.parametrize(
    ("raw", "value"),
    [("12", 12), ("-5", -5), ("+7", 7), (" 1", None), ("1.5", None), ("", None), ("x", None),
     ("9223372036854775807", 2**63 - 1), ("9223372036854775808", None)],
)
def test_to_count(spark, raw, value):
    df = spark.createDataFrame([(raw,)], "raw STRING")
    assert df.select(scalars.to_count(F.col("raw"))).first()[0] == value


def test_keys_share_a_hash_tag(spark):
    df = spark.createDataFrame([("7", 3, "bo")], "doc_id STRING, user_id LONG, username STRING")
    keys = scalars.key_columns(F.col("doc_id"), F.col("user_id"), F.col("username"))
    row = df.select(*[c.alias(n) for n, c in keys.items()]).first()
    assert row.like_key == "Like:{docID:7}" and row.liked_user_key == "LikedUser:{docID:7}"
    assert row.member_key == "presence:member:7:3" and row.auth_login_key == "auth:login:name:{bo}"


def test_epoch_seconds_ignores_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-16 00:00:00.9' AS ts")
        assert df.select(scalars.epoch_seconds(F.col("ts"))).first()[0] == 1705363200
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_utc_time_reads_offsets(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame(
            [("2024-01-16T08:00:00.25+08:00",), ("2024-01-16T00:00:00.25Z",), ("soon",)], "t STRING"
        )
        got = df.select(scalars.epoch_micros(scalars.utc_time(F.col("t")))).collect()
        assert [r[0] for r in got] == [1705363200250000, 1705363200250000, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
