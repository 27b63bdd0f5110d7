"""Idempotent like / question-mark / share toggles, their counts and read-through stats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp_count, to_count
from ..runtime import hot_keys, hot_within
from ..schemas import KINDS
from .scan import running


_MEMBER = ["kind", "doc_id", "user_id"]
_SET = ["kind", "doc_id"]


def apply_requests(
    requests: DataFrame, carried: DataFrame | None = None, held: DataFrame | None = None
) -> DataFrame:
    """Per request: whether it changed the set, and the count right after it.

    To go on from earlier requests, pass the members (kind, doc_id, user_id) and the counts
    (kind, doc_id, cnt) they left.
    """
    order = ["ts", "event_id"]
    rows = requests.select("event_id", "ts", *_MEMBER, "action", F.lit(True).alias("asked"))
    if carried is not None:
        known = carried.join(rows.select(*_MEMBER).distinct(), _MEMBER, "left_semi").select(
            F.lit(None).cast("long").alias("event_id"),
            F.expr("TIMESTAMP_NTZ'0001-01-01 00:00:00'").alias("ts"),
            *_MEMBER,
            F.lit("add").alias("action"),
            F.lit(False).alias("asked"),
        )
        rows = rows.unionByName(known)
    hot = hot_keys(rows, _SET)
    order = ["asked", *order]
    rows = running(
        rows, _MEMBER, order, {"before": ("prev", F.col("action"))},
        hot=hot_within(hot, rows, _MEMBER),
    )
    rows = rows.filter("asked").withColumn(
        "changed", F.col("action") != F.coalesce("before", F.lit("remove"))
    )
    step = F.when(~F.col("changed"), 0).when(F.col("action") == "add", 1).otherwise(-1)
    rows = running(rows, _SET, order, {"value": ("sum", step.cast("long"))}, hot=hot)
    if held is not None:
        rows = rows.join(held.select(*_SET, F.col("cnt").alias("held")), _SET, "left").withColumn(
            "value", F.col("value") + F.coalesce("held", F.lit(0))
        )
    return rows.select("event_id", *_MEMBER, "changed", "value")


def members_after(requests: DataFrame, carried: DataFrame) -> DataFrame:
    """Members (kind, doc_id, user_id) after the requests, given those before."""
    untouched = carried.join(requests.select(*_MEMBER).distinct(), _MEMBER, "left_anti")
    return untouched.select(*_MEMBER).unionByName(members(requests))


def counts_after(applied: DataFrame, requests: DataFrame, held: DataFrame) -> DataFrame:
    """Counts (kind, doc_id, cnt) after the requests: those before plus all changes."""
    step = F.when(F.col("action") == "add", 1).otherwise(-1).cast("long")
    changes = (
        applied.filter("changed")
        .join(requests.select("event_id", "action"), "event_id")
        .select(*_SET, step.alias("cnt"))
    )
    return held.select(*_SET, "cnt").unionByName(changes).groupBy(*_SET).agg(F.sum("cnt").alias("cnt"))


def members(requests: DataFrame) -> DataFrame:
    """Users currently in each set: those whose latest request was an add."""
    last = F.max_by("action", F.struct("ts", "event_id"))
    return (
        requests.groupBy("kind", "doc_id", "user_id")
        .agg(last.alias("last_action"))
        .filter("last_action = 'add'")
        .drop("last_action")
    )


def counts(requests: DataFrame) -> DataFrame:
    """Members per (kind, document), 0 included once a set was ever touched."""
    last = F.max_by("action", F.struct("ts", "event_id"))
    return (
        requests.groupBy("kind", "doc_id", "user_id")
        .agg(last.alias("last_action"))
        .groupBy("kind", "doc_id")
        .agg(F.count_if(F.col("last_action") == "add").alias("cnt"))
    )


def build_doc_stats(requests: DataFrame) -> DataFrame:
    """One stats row per document; nothing ever counts views."""
    wide = counts(requests).groupBy("doc_id").pivot("kind", KINDS).agg(F.sum("cnt"))

    def count(kind: str):
        return F.coalesce(kind, F.lit(0)).alias(f"{kind}_count")

    return wide.select(
        "doc_id",
        count("like"),
        F.lit(0).cast("long").alias("view_count"),
        count("share"),
        count("question_mark"),
    )


def lookup_doc_stats(requests: DataFrame, stats: DataFrame) -> DataFrame:
    return requests.join(stats, "doc_id", "left")


def read_through(requests: DataFrame, cache: DataFrame, stats: DataFrame) -> DataFrame:
    """The cached count, else the stored one, else 0, and which of the three it was.

    A cached -1 marks a known absence and counts as not cached.
    """
    cached = cache.select("doc_id", "kind", to_count(F.col("cached")).alias("hit"))
    stored = stats.select(
        "doc_id",
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_count").alias("n")) for k in KINDS])).alias("s"),
    ).select("doc_id", "s.kind", F.col("s.n").alias("stored"))
    hit = F.when(F.col("hit") != -1, F.col("hit"))
    return (
        requests.join(cached, ["doc_id", "kind"], "left")
        .join(stored, ["doc_id", "kind"], "left")
        .select(
            *requests.columns,
            clamp_count(F.coalesce(hit, "stored", F.lit(0))).alias("value"),
            F.when(hit.isNotNull(), "cache")
            .when(F.col("stored").isNotNull(), "store")
            .otherwise("default")
            .alias("source"),
        )
    )


def convert_counts(raw: DataFrame) -> DataFrame:
    value = to_count(F.col("raw"))
    return raw.select(
        *raw.columns,
        clamp_count(value).alias("count_value"),
        F.when(value.isNull(), "invalid result").alias("error"),
    )
