"""Streaming toggles, with the members of each set in Spark's state store.

A set (kind, document) is dealt over sub-keys by its users, so a hot one spreads over tasks. A
sub-key keeps its members in a map, of which a request touches one entry, and how many there
are. The count of the whole set after a request is an ordered merge of its sub-keys' counts:
the running sum of their steps, which `merge_counts` takes over all rows or over a part.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from ..functions.scalars import epoch_micros
from ..operators.scan import running
from .feeds import RowProcessor

SUB_KEYS = 32
TOGGLED = (
    "event_id LONG, ts TIMESTAMP_NTZ, kind STRING, doc_id STRING, user_id LONG, sub INT, "
    "changed BOOLEAN, step LONG, sub_count LONG"
)


class _Toggles(RowProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.members = handle.getMapState("members", "user_id LONG", "since_us LONG")
        self.count = handle.getValueState("count", "cnt LONG")

    def on_rows(self, key, rows, timers) -> Iterator[tuple]:
        before: dict[int, bool] = {}
        now: dict[int, int | None] = {}
        (count,) = self.count.get() or (0,)
        for r in sorted(rows, key=lambda r: (r.us, r.event_id)):
            user = int(r.user_id)
            if user not in before:
                before[user] = self.members.containsKey((user,))
                now[user] = 0 if before[user] else None
            wanted = r.action == "add"
            changed = wanted != (now[user] is not None)
            step = (1 if wanted else -1) if changed else 0
            count += step
            if changed:
                now[user] = int(r.us) if wanted else None
            yield r.event_id, r.ts, key[0], key[1], user, key[2], changed, step, count
        for user, since in now.items():
            if since:
                self.members.updateValue((user,), (since,))
            elif since is None and before[user]:
                self.members.removeKey((user,))
        self.count.update((count,))


def toggle_stream(requests: DataFrame) -> DataFrame:
    """Per request: whether it changed its set, its step, and its sub-key's count after it.

    Input: event_id, ts, kind, doc_id, user_id, action. No watermark: a request is applied when
    it comes; inside a micro-batch, by time.
    """
    rows = requests.select(
        "kind", "doc_id", F.pmod(F.hash("user_id"), F.lit(SUB_KEYS)).alias("sub"), "user_id",
        "event_id", "ts", epoch_micros(F.col("ts")).alias("us"), "action",
    )
    return rows.groupBy("kind", "doc_id", "sub").transformWithStateInPandas(
        _Toggles(TOGGLED), TOGGLED, "append", "None"
    )


_SET = ["kind", "doc_id"]
_ORDER = ["ts", "event_id"]


def set_totals(toggled: DataFrame) -> DataFrame:
    """Members per set (kind, doc_id, cnt) after the rows of `toggle_stream`: the last count of
    every sub-key, summed."""
    last = F.max_by("sub_count", F.struct(*_ORDER))
    subs = toggled.groupBy(*_SET, "sub").agg(last.alias("cnt"))
    return subs.groupBy(*_SET).agg(F.sum("cnt").alias("cnt"))


def merge_counts(toggled: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Rows of `toggle_stream` with `value`, the count of the whole set after each.

    For a part of the rows, `before` has the totals (see `set_totals`) of the rows before it.
    """
    rows = running(toggled, _SET, _ORDER, {"value": ("sum", F.col("step"))})
    if before is not None:
        base = before.select(*_SET, F.col("cnt").alias("base"))
        rows = rows.join(base, _SET, "left").withColumn(
            "value", F.col("value") + F.coalesce("base", F.lit(0))
        )
    return rows.select("event_id", *_SET, "user_id", "changed", "value")
