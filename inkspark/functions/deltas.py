"""Column builders for deltas: decode, encode, apply, and the position check."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import OPS


def ops_decode(json_text: Column) -> Column:
    """JSON text to ARRAY<STRUCT>; missing count and text become 0 and ''."""
    return F.transform(
        F.from_json(json_text, OPS),
        lambda op: F.struct(
            F.coalesce(op["kind"], F.lit("")).alias("kind"),
            F.coalesce(op["count"], F.lit(0)).alias("count"),
            F.coalesce(op["text"], F.lit("")).alias("text"),
            op["attrs"].alias("attrs"),
        ),
    )


def ops_compact(ops: Column) -> Column:
    """The ops as they are written to JSON: zero counts, empty texts and null attrs become
    null, so that they are left out, and attrs become a JSON value again."""
    return F.transform(
        ops,
        lambda op: F.struct(
            op["kind"].alias("kind"),
            F.nullif(op["count"], F.lit(0)).alias("count"),
            F.nullif(op["text"], F.lit("")).alias("text"),
            F.try_parse_json(op["attrs"]).alias("attrs"),
        ),
    )


def ops_encode(ops: Column) -> Column:
    """ARRAY<STRUCT> to JSON text."""
    return F.to_json(ops_compact(ops))


def _moved(pos: Column, op: Column) -> Column:
    return (
        F.when(op["kind"] == "retain", pos + op["count"])
        .when(op["kind"] == "insert", pos + F.length(op["text"]))
        .otherwise(pos)
        .cast("long")
    )


def ops_valid(ops: Column) -> Column:
    """False when an insert or delete would act at a negative position."""
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.lit(True).alias("ok"))

    def step(acc: Column, op: Column) -> Column:
        edits = (op["kind"] == "insert") | ((op["kind"] == "delete") & (op["count"] > 0))
        return F.struct(
            _moved(acc["pos"], op).alias("pos"),
            (acc["ok"] & ~(edits & (acc["pos"] < 0))).alias("ok"),
        )

    return F.aggregate(ops, start, step, lambda acc: acc["ok"])


def apply_delta(text: Column, ops: Column) -> Column:
    """The text after the ops, in code points; null when `ops_valid` is false."""
    start = F.struct(F.lit(0).cast("long").alias("pos"), text.alias("txt"))

    def step(acc: Column, op: Column) -> Column:
        pos, txt = acc["pos"], acc["txt"]
        at = F.least(pos, F.length(txt)).cast("int")
        head = F.substring(txt, F.lit(1), at)
        size = F.length(txt)
        inserted = F.concat(head, op["text"], F.substring(txt, at + 1, size))
        deleted = F.concat(head, F.substring(txt, at + 1 + op["count"], size))
        return F.struct(
            _moved(pos, op).alias("pos"),
            F.when(op["kind"] == "insert", inserted)
            .when((op["kind"] == "delete") & (op["count"] > 0), deleted)
            .otherwise(txt)
            .alias("txt"),
        )

    return F.when(ops_valid(ops), F.aggregate(ops, start, step, lambda acc: acc["txt"]))
