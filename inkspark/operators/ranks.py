"""Ranks of scored members and activity bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import numbered


def score_ranks(scores: DataFrame) -> DataFrame:
    """0-based rank and reverse rank per document by score, ties by member text."""
    sizes = scores.groupBy("doc_id").agg(F.count("*").alias("size"))
    ranked = numbered(scores, ["doc_id"], ["score", "member"], "position")
    return ranked.join(sizes, "doc_id").select(
        "doc_id",
        "member",
        "score",
        (F.col("position") - 1).alias("rank"),
        (F.col("size") - F.col("position")).alias("reverse_rank"),
    )


def activity_days(events: DataFrame) -> DataFrame:
    """One bit per day of the month a user was active on a document."""
    bit = F.expr("shiftleft(1L, dayofmonth(ts) - 1)")
    return (
        events.groupBy("doc_id", "user_id")
        .agg(F.bit_or(bit).alias("bits"))
        .select(
            "doc_id",
            "user_id",
            "bits",
            F.bit_count("bits").cast("long").alias("days"),
            F.getbit("bits", F.lit(1)).cast("long").alias("second_day"),
        )
    )


def active_user_bitmap(events: DataFrame) -> DataFrame:
    """Users per document counted from bitmaps of bounded size, one per id bucket."""
    return (
        events.groupBy("doc_id", F.bitmap_bucket_number("user_id").alias("bucket"))
        .agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("user_id"))).alias("users"))
    )
