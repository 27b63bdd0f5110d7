"""WARC bundles: exact round trips, the seek table, revisits."""

from __future__ import annotations

import base64
import hashlib
import io
import random

import pytest
import zstandard
from compare import connect, duck_rows, spark_rows
from fixtures import SF, prose

from inkspark.llm import warc
from inkspark.llm.queries import ORACLE, QUERIES
from inkspark.runtime import new_path

SCHEMA = "page_id long, url string, html string, payload string, row string, size int"


def pages(spark):
    rng = random.Random(2)
    long = prose(rng, 200_000)
    texts = [
        (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two</p>"), (3, None, "<p>one</p>"),
        (4, "http://a/4", None), (5, "http://a/5", ""), (6, "http://ä/é\r\nX: y", "é😀\x00\r\n\r\n"),
        (7, "u", "<p>two</p>"), (None, "u", "<p>two</p>"), (None, "u", "only here"),
        (8, "u", "WARC/1.1\r\n\r\n"), (9, "u", long), (0, "u", long), (10, "u", "same"),
        (10, "u", "same"), (-3, "u", "same"), (11, "u", "\x50\x2a\x4d\x18\n"),
    ]
    texts += [(100 + i, "u", "hot") for i in range(300)]
    rows = [(*t, "x", "y", 1) for t in texts]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("frame_bytes", [1, 500, warc.FRAME_BYTES])
@pytest.mark.parametrize("least", [0, 5])
def test_round_trip_of_odd_pages(spark, frame_bytes, least):
    rows, df = pages(spark)
    path = new_path(spark, "warc-test")
    warc.write_archives(df, path, frame_bytes=frame_bytes, least_bytes=least)
    found = warc.full_payload(warc.read_archives(spark, path)).collect()
    assert len(found) == len(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r.page_id, bytes(r.payload)) for r in found), key=key)
    assert got == sorted(((p, (t or "").encode()) for p, _, t, *_ in rows), key=key)
    first: dict[bytes, list] = {}
    for p, _, t, *_ in rows:
        first.setdefault((t or "").encode(), []).append(p)
    responses = [bytes(r.payload) for r in found if r.record_type == "response"]
    for payload, ids in first.items():
        known = [i for i in ids if i is not None]
        if len(payload) >= least:
            assert responses.count(payload) == 1
        else:
            assert responses.count(payload) == len(ids)
        for r in found:
            if bytes(r.payload) == payload:
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                assert (r.payload_digest, r.payload_bytes) == (digest, len(payload))
                if r.record_type == "revisit":
                    assert r.refers_to == min(known)
                else:
                    assert r.refers_to is None
                    assert len(payload) < least or r.page_id == (min(known) if known else None)


def test_bundles_are_plain_zstandard_and_seekable(spark):
    rows, df = pages(spark)
    path = new_path(spark, "warc-test")
    warc.write_archives(df, path, frame_bytes=400)
    files = warc._bundles(spark, path).collect()
    places = {r.record_id: r for r in warc.record_index(spark, path).collect()}
    assert len(places) == len(rows)
    seen = 0
    for f in files:
        content = bytes(f.content)
        table = warc.seek_table(content)
        # Places of the table tile the file up to the seek table itself.
        assert table[0][0] == 0
        assert all(a[0] + a[1] == b[0] for a, b in zip(table, table[1:], strict=False))
        frames = b""
        for at, packed, full, _ in table[:-1]:
            if full:
                frames += zstandard.ZstdDecompressor().decompress(content[at : at + packed])
        stream = zstandard.ZstdDecompressor().stream_reader(
            io.BytesIO(content), read_across_frames=True
        )
        assert stream.read() == frames
        records = list(warc.records_of(content))
        assert b"".join(records) == frames
        for data in records:
            name = warc.parse(data)["record_id"]
            place = places[name]
            frame = content[place.frame_start : place.frame_start + place.frame_bytes]
            whole = zstandard.ZstdDecompressor().decompress(frame)
            assert whole[place.offset : place.offset + place.length] == data
            assert list(warc.records_of(content, {name})) == [data]
            seen += 1
    assert seen == len(rows)


def test_damage_is_noticed():
    out = warc.Bundle()
    name = warc.record_id(1, 0)
    data = warc.record(name, "u", "1970-01-01T00:00:00Z", b"body", warc._digest(b"body"), None)
    assert out.add(name, data) is None
    gap = warc.GAP.encode()
    content = out.close() + gap + out.end() + gap
    assert [warc.parse(x)["payload"] for x in warc.records_of(content)] == [b"body"]
    with pytest.raises(ValueError, match="not the payload"):
        warc.parse(data.replace(b"body", b"busy"))
    with pytest.raises(ValueError, match="no whole record"):
        warc.parse(data[:-1])
    with pytest.raises(ValueError, match="no seek table"):
        warc.seek_table(content[:-1])


def test_no_pages(spark):
    path = new_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_archives(spark, path).collect() == []
    assert warc.record_index(spark, path).collect() == []


def test_query_matches_sql(spark):
    out = QUERIES["op13_warc"](spark, SF)
    columns, expected = duck_rows(connect(SF), ORACLE["op13_warc"])
    assert sorted(out.columns) == sorted(columns)
    assert spark_rows(out) == expected
