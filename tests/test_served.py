"""Loads and saves as of their arrival, compared with a service that is stepped through."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from inkspark.operators import replay
from inkspark.operators.served import LOAD, SAVE, served, texts_served

SUBMITTED = "doc_id string, arrival_seq long, ts timestamp_ntz, revision long, ops string"
ASKED = "event_id long, ts timestamp_ntz, type string, doc_id string"
START = datetime(2024, 1, 1)


def _case(seed: int, minutes: int):
    """Random submissions and requests that often fall on the same instant, with the answers of a
    plain loop over them in order of time."""
    pick = random.Random(seed)
    events = []
    for number in range(300):
        doc, ts = pick.choice("abbbbbb"), START + timedelta(minutes=pick.randrange(minutes))
        events.append((ts, pick.random() < 0.6, number, doc if pick.random() < 0.9 else "none"))
    events.sort(key=lambda e: (e[0], not e[1], e[2]))
    submitted, asked, answers = [], [], {}
    revisions, texts, stored = {}, {}, set()
    for at, (ts, is_submission, number, doc) in enumerate(events):
        if is_submission:
            if doc == "none":
                continue
            revisions.setdefault(doc, 0)
            texts.setdefault(doc, "")
            accepted = pick.random() < 0.7
            if accepted:
                revisions[doc] += 1
                texts[doc] = f"{number}." + texts[doc]
            revision = revisions[doc] if accepted else None
            ops = f'[{{"kind":"insert","text":"{number}."}}]'
            submitted.append((doc, at, ts, revision, ops))
            continue
        kind = pick.choice([LOAD, SAVE])
        asked.append((number, ts, kind, doc))
        revision = revisions.get(doc)
        stores = None if kind == LOAD else revision is not None and (doc, revision) not in stored
        if stores:
            stored.add((doc, revision))
        answers[number] = (revision, stores, texts.get(doc))
    return submitted, asked, answers


@pytest.mark.parametrize("limit", [10_000_000, 20])
@pytest.mark.parametrize("minutes", [400, 15])
def test_answers_as_of_arrival(spark, limit, minutes):
    submitted, asked, answers = _case(minutes, minutes)
    spark.conf.set("spark.inkspark.maxGroupRows", limit)
    try:
        labelled = spark.createDataFrame(submitted, SUBMITTED)
        found = served(spark.createDataFrame(asked, ASKED), labelled)
        rows = {r.event_id: r for r in found.collect()}
        assert {n: (r.revision, r.stores) for n, r in rows.items()} == {
            n: a[:2] for n, a in answers.items()
        }
        for row in rows.values():
            assert row.error == (None if row.revision is not None else "document not found")
            lines = (row.answer or "").split("\n")
            assert len(lines) == (2 if row.error and row.type == SAVE else 1)
            assert (row.answer is None) == (row.type == LOAD)
        log = labelled.filter("revision IS NOT NULL").select("doc_id", "revision", "ops")
        none = spark.createDataFrame([], "doc_id string, revision long, content string")
        texts = {r.event_id: r.content for r in texts_served(found, log, none).collect()}
        assert texts == {n: a[2] for n, a in answers.items() if a[0] is not None}
    finally:
        spark.conf.unset("spark.inkspark.maxGroupRows")


def test_no_rows(spark):
    labelled = spark.createDataFrame([], SUBMITTED)
    asked = spark.createDataFrame([], ASKED)
    found = served(asked, labelled)
    none = spark.createDataFrame([], "doc_id string, revision long, content string")
    assert found.collect() == []
    assert texts_served(found, labelled.select("doc_id", "revision", "ops"), none).collect() == []


def test_texts_stay_where_they_are_replayed(spark, monkeypatch):
    """Requests travel with the replay: nothing is joined or shuffled behind it."""
    monkeypatch.setattr("inkspark.operators.served.TOGETHER", 3)
    submitted, asked, answers = _case(7, 15)
    labelled = spark.createDataFrame(submitted, SUBMITTED)
    found = served(spark.createDataFrame(asked, ASKED), labelled)
    log = labelled.filter("revision IS NOT NULL").select("doc_id", "revision", "ops")
    none = spark.createDataFrame([], "doc_id string, revision long, content string")
    rows = texts_served(found, log, none)
    behind = rows._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert "Join" not in behind and "Exchange" not in behind
    before = found.filter("revision IS NOT NULL").collect()
    same = {r.event_id: (r.type, r.doc_id, r.revision, r.stores, r.answer, r.error) for r in before}
    got = {r.event_id: (r.type, r.doc_id, r.revision, r.stores, r.answer, r.error) for r in rows.collect()}
    assert got == same and len(got) == rows.count()
    assert {r.event_id: r.content for r in rows.collect()} == {n: answers[n][2] for n in same}


def test_close_marks_are_folded_op_by_op(spark, monkeypatch):
    """Composed runs cost a text each, so marks that lie close get none; far ones do."""
    composed = []
    steps = replay._composed_steps
    monkeypatch.setattr(replay, "_composed_steps", lambda ops: composed.append(1) or steps(ops))
    rows = [("a", r, '[{"kind":"insert","text":"x"}]') for r in range(1, 101)]
    log = spark.createDataFrame(rows, "doc_id string, revision long, ops string")
    none = spark.createDataFrame([], "doc_id string, revision long, content string")
    spark.conf.set("spark.inkspark.maxReplayOps", 20)
    spark.conf.set("spark.inkspark.replayChunk", 10)
    try:
        for step, times in ((5, 0), (50, 1)):
            points = spark.createDataFrame([("a", r) for r in range(step, 101, step)], "doc_id string, revision long")
            texts = {r.revision: r.content for r in replay.content_at(log, none, points).collect()}
            assert texts == {r: "x" * r for r in range(step, 101, step)}
            assert len(composed) == times
    finally:
        spark.conf.unset("spark.inkspark.maxReplayOps")
        spark.conf.unset("spark.inkspark.replayChunk")
