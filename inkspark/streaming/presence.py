"""Streaming presence and cursors, with their state in Spark's state store.

Presence waits for the watermark: what a member sent is taken in order of event time once
nothing earlier can come, so rows may arrive in any order within the watermark's delay. Members
are dealt over parts by their hash, since a call costs far more than a row. A part has an entry
per open session, a list of what waits, and one timer, for whichever is due first; only sessions
that change are written. A later row than the watermark is left out, and an empty micro-batch
changes nothing.

Cursors are answered as they come. A document's cursors are dealt over sub-keys; each entry has
a time to live, after which the store itself drops it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from ..functions.scalars import epoch_micros
from .feeds import RowProcessor

JOIN, REFRESH, LEAVE = "join", "refresh", "leave"
SUB_KEYS = 64  # parts of a document whose members are kept apart
MEMBER_PARTS = 512  # parts that the members of all documents are dealt over
CURSOR_LAG = 86_400  # seconds that a stream may run behind before cursors go too early

PRESENCE_EVENT = (
    "doc_id STRING, user_id LONG, event STRING, sec LONG, expire_at LONG, session_start LONG, "
    "session_end LONG, heartbeats LONG"
)


class _Members(RowProcessor):
    """The sessions of the members of one part."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at LONG")
        self.open = handle.getMapState(
            "open", "doc_id STRING, user_id LONG", "started LONG, until LONG, beats LONG"
        )
        self.waiting = handle.getListState(
            "waiting",
            "doc_id ARRAY<STRING>, user_id ARRAY<LONG>, us ARRAY<LONG>, event_id ARRAY<LONG>, "
            "sec ARRAY<LONG>, until ARRAY<LONG>",
        )

    def on_rows(self, key, rows, timers) -> Iterator[tuple]:
        more = [
            (r.doc_id, None if r.member is None else int(r.member),
             int(r.us), int(r.event_id), int(r.sec), int(r.expire_at))
            for r in rows
        ]
        self._wait(more)
        self._wake(min(_first_ms(w[2]) for w in more))
        return iter(())

    def on_timer(self, key, timers) -> Iterator[tuple]:
        now_ms = timers.getCurrentWatermarkInMs()
        self.due.clear()  # Spark takes out the timer itself
        ready: dict[tuple, list[tuple]] = {}
        later = []
        for chunk in list(self.waiting.get()):
            for doc, user, *beat in zip(*chunk, strict=True):
                if beat[0] > now_ms * 1000:
                    later.append((doc, user, *beat))
                else:
                    ready.setdefault((doc, user), []).append(tuple(beat))
        held = {tuple(m): tuple(v) for m, v in self.open.iterator()}
        untils = []
        for member in held.keys() | ready.keys():
            before = held.get(member)
            after = yield from self._turns(member, before, sorted(ready.get(member, [])), now_ms)
            if after is not None:
                untils.append(after[1])
                if after != before:
                    self.open.updateValue(member, after)
            elif before is not None:
                self.open.removeKey(member)
        if ready:
            self.waiting.clear()
            if later:
                self._wait(later)
        times = [_first_ms(w[2]) for w in later] + [_after(u) for u in untils]
        if times:
            self._wake(min(times))

    @staticmethod
    def _turns(member, session, beats_, now_ms):
        """What a member's next heartbeats give, and the session that is open after them."""
        started, until, beats = session or (None, None, 0)
        for _, _, sec, expire_at in beats_:
            if until is not None and sec > until:
                yield (*member, LEAVE, until, until, started, until, beats)
                until = None
            event = JOIN if until is None else REFRESH
            if until is None:
                started, beats = sec, 0
            until, beats = expire_at, beats + 1
            yield (*member, event, sec, until, started, None, beats)
        if now_ms >= _after(until):
            yield (*member, LEAVE, until, until, started, until, beats)
            return None
        return started, until, beats

    def _wait(self, rows: list[tuple]) -> None:
        self.waiting.appendValue(tuple(map(list, zip(*rows, strict=True))))

    def _wake(self, first: int) -> None:
        """Have one timer, at the first time something is to be done."""
        (due,) = self.due.get() or (None,)
        if due is None or first < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(first)
            self.due.update((first,))


def _first_ms(us: int) -> int:
    """The first millisecond that is not before a time."""
    return -(-us // 1000)


def _after(second: int) -> int:
    """The first millisecond that is later than a whole second."""
    return (second + 1) * 1000


def presence_stream(heartbeats: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Join, refresh and leave rows of members, each once its time is sure.

    Input: event_id, ts (TIMESTAMP_NTZ, UTC), sec, doc_id, user_id, ttl; rows of no document
    are left out. A leave row closes a session, with its start, end and number of heartbeats.
    """
    us = epoch_micros(F.col("ts"))
    rows = heartbeats.filter("doc_id <> ''").select(
        F.pmod(F.hash("doc_id", "user_id"), F.lit(MEMBER_PARTS)).alias("part"),
        # As text, for pandas would make a number that may be missing a float.
        "doc_id", F.col("user_id").cast("string").alias("member"), "event_id", us.alias("us"), "sec",
        (F.col("sec") + F.col("ttl")).alias("expire_at"),
        F.timestamp_micros(us).alias("at"),
    )
    return (
        rows.withWatermark("at", delay)
        .groupBy("part")
        .transformWithStateInPandas(_Members(PRESENCE_EVENT), PRESENCE_EVENT, "append", "EventTime")
    )


CURSOR_ANSWER = "event_id LONG, doc_id STRING, user_id LONG, cursor_json STRING, found BOOLEAN"


class _Cursors(RowProcessor):
    """The cursors of some of a document's users."""

    def __init__(self, keep_ms: int):
        super().__init__(CURSOR_ANSWER)
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursors = handle.getMapState(
            "cursors", "user_id LONG", "cursor_json STRING, until LONG", self.keep_ms
        )

    def on_rows(self, key, rows, timers) -> Iterator[tuple]:
        held: dict[int, tuple | None] = {}
        fresh: set[int] = set()
        for r in sorted(rows, key=lambda r: (r.us, r.event_id)):
            user = int(r.user_id)
            if r.op == "set":
                held[user] = (r.cursor_json, int(r.until))
                fresh.add(user)
                continue
            if user not in held:
                held[user] = self.cursors.getValue((user,))
            text, until = held[user] or (None, None)
            found = until is not None and until > r.sec
            yield r.event_id, key[0], user, text if found else None, found
        for user in fresh:
            self.cursors.updateValue((user,), held[user])


def cursor_stream(cursors: DataFrame, longest_ttl: int, lag: int = CURSOR_LAG) -> DataFrame:
    """Answers to cursor reads, from the cursors set before them.

    Input: event_id, ts, sec, doc_id, user_id, op, cursor_json, ttl (`longest_ttl` at most).
    An entry goes from the store `longest_ttl` + `lag` seconds after it was set, by the clock
    of the cluster, so the state holds live cursors and those of the lag only.
    """
    rows = cursors.select(
        "doc_id", F.pmod(F.hash("user_id"), F.lit(SUB_KEYS)).alias("sub"), "user_id", "event_id",
        epoch_micros(F.col("ts")).alias("us"), "sec", "op", "cursor_json",
        (F.col("sec") + F.col("ttl")).alias("until"),
    )
    keep = _Cursors((longest_ttl + lag) * 1000)
    return rows.groupBy("doc_id", "sub").transformWithStateInPandas(
        keep, CURSOR_ANSWER, "append", "ProcessingTime"
    )
