"""Op-log replay: the text of a document at chosen revisions.

Each segment of a document's history (from a base text to the last revision asked for) is
streamed in revision order through one fold that keeps the current text in blocks (`Pieces`),
so an op costs the same in a long text as in a short one. No task ever holds a document's ops
as one row or list.

For documents with very long logs, runs of ops are first composed in parallel into one
delta each: a list of pieces, either ranges of the text before or inserted strings. The
serial fold then takes one step per run. A composed delta is exact only if the text before
is long enough that no position was cut off at its end. A lower bound of the length at each
run shows which runs might break that; those few keep their single ops. The others are merged
further, many at a time, until a segment has few steps left to fold in series.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import rows as rows_of_batch
from ..functions.deltas import ops_decode, ops_encode
from ..runtime import (
    MAX_REPLAY_OPS,
    REPLAY_CHUNK,
    hot_keys,
    largest_group,
    materialize,
    setting,
    shuffle_partitions,
)
from .pieces import Pieces
from .scan import numbered, running

# Order of rows at one revision: the base text, then ops, then the mark asking for text.
_BASE, _OPS, _COMPOSED, _MARK = 0, 1, 2, 3
_OPEN = 2**62  # end of the unknown text before a composed run
_BATCH_CHARS = 8_000_000
_MERGE = 64  # composed runs merged into one at a time
_ROW = ["doc_id", "segment", "revision", "phase", "mark", "body"]
_TEXT_SCHEMA = "doc_id STRING, revision LONG, content STRING, tag STRING"


def _apply_pieces(text: str, pieces: list) -> str:
    return "".join(p if isinstance(p, str) else text[p[0] : p[1]] for p in pieces)


def _fold(arriving: Iterator[pa.RecordBatch], at_end: bool) -> Iterator[pa.RecordBatch]:
    """Stream rows in order and yield the text after each marked row, with the body of marks.

    `at_end` yields the text after the last row of each segment instead.
    """
    key, text, reached, whole = None, Pieces(), 0, None
    out, chars = [], 0

    def pack():
        docs, revisions, texts, tags = zip(*out)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(docs, pa.string()), pa.array(revisions, pa.int64()),
                pa.array(texts, pa.string()), pa.array(tags, pa.string()),
            ],
            names=["doc_id", "revision", "content", "tag"],
        )

    for batch in arriving:
        for doc, segment, revision, phase, mark, body in rows_of_batch(batch):
            if key != (doc, segment):
                if at_end and key is not None:
                    out.append((key[0], reached, text.text(), None))
                    chars += text.length
                key, text, whole = (doc, segment), Pieces(), None
            if phase != _MARK:
                whole = None
            if phase == _BASE:
                text = Pieces(body)
            elif phase == _OPS:
                text.apply(json.loads(body))
            elif phase == _COMPOSED:
                text = Pieces(_apply_pieces(text.text(), json.loads(body)))
            reached = revision
            if mark and not at_end:
                # Marks of one revision share the text.
                whole = text.text() if whole is None else whole
                out.append((doc, revision, whole, body if phase == _MARK else None))
                chars += text.length
            if chars > _BATCH_CHARS:
                yield pack()
                out, chars = [], 0
    if at_end and key is not None:
        out.append((key[0], reached, text.text(), None))
    if out:
        yield pack()


class _Run:
    """Ops composed over an unknown text: pieces are [start, end) ranges of it or strings."""

    def __init__(self, key):
        self.key = key
        self.pieces: list = [(0, _OPEN)]
        self.need = 0  # shortest text before for which the pieces are exact
        self.last_revision = 0
        self.mark = False

    def _split(self, pos: int) -> int:
        """Index of the piece that starts at `pos`."""
        for i, piece in enumerate(self.pieces):
            size = len(piece) if isinstance(piece, str) else piece[1] - piece[0]
            if pos == 0:
                return i
            if pos < size:
                if isinstance(piece, str):
                    halves = [piece[:pos], piece[pos:]]
                else:
                    halves = [(piece[0], piece[0] + pos), (piece[0] + pos, piece[1])]
                    if piece[1] == _OPEN:
                        self.need = max(self.need, piece[0] + pos)
                self.pieces[i : i + 1] = halves
                return i + 1
            pos -= size
        return len(self.pieces)

    def apply(self, ops: list[dict]) -> None:
        pos = 0
        for op in ops:
            kind = op.get("kind")
            if kind == "retain":
                pos += op.get("count") or 0
            elif kind == "insert":
                new = op.get("text") or ""
                if new:
                    at = self._split(pos)
                    self.pieces.insert(at, new)
                    pos += len(new)
            elif kind == "delete":
                count = op.get("count") or 0
                if count > 0:
                    start = self._split(pos)
                    end = self._split(pos + count)
                    del self.pieces[start:end]


_RUN_SCHEMA = (
    "doc_id STRING, segment LONG, run_no LONG, revision LONG, mark BOOLEAN, need LONG, body STRING"
)


def _compose(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _RUN_SCHEMA.split(", ")]
    types = [pa.string()] + [pa.int64()] * 3 + [pa.bool_(), pa.int64(), pa.string()]

    def pack(runs):
        rows = [(*r.key, r.last_revision, r.mark, r.need, json.dumps(r.pieces)) for r in runs]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names
        )

    current = None
    for batch in arriving:
        done = []
        for doc, segment, run_no, revision, mark, body in rows_of_batch(batch):
            if current is None or current.key != (doc, segment, run_no):
                if current is not None:
                    done.append(current)
                current = _Run((doc, segment, run_no))
            current.apply(json.loads(body))
            current.last_revision, current.mark = revision, mark
        if done:
            yield pack(done)
    if current is not None:
        yield pack([current])


_MERGED_SCHEMA = (
    "doc_id STRING, segment LONG, group_no LONG, run_no LONG, revision LONG, mark BOOLEAN, body STRING"
)


def _cut(pieces: list, ends: list[int], start: int, end: int) -> list:
    """The pieces that make up [start, end) of a text; `ends` are the pieces' end positions."""
    out = []
    i = bisect_right(ends, start)
    while i < len(pieces) and start < end:
        piece, size = pieces[i], ends[i] - (ends[i - 1] if i else 0)
        low = start - (ends[i] - size)
        high = min(end, ends[i]) - (ends[i] - size)
        out.append(piece[low:high] if isinstance(piece, str) else [piece[0] + low, piece[0] + high])
        start = ends[i]
        i += 1
    return out


def _after(first: list, second: list) -> list:
    """One delta for `first` and then `second`: the ranges of `second` looked up in `first`."""
    ends = list(accumulate(len(p) if isinstance(p, str) else p[1] - p[0] for p in first))
    out: list = []
    for piece in second:
        for part in [piece] if isinstance(piece, str) else _cut(first, ends, *piece):
            if isinstance(part, str) and out and isinstance(out[-1], str):
                out[-1] += part
            else:
                out.append(part)
    return out


def _merge_all(deltas: list[list]) -> list:
    """One delta for a sequence of them, merged pairwise so that no part is copied often."""
    while len(deltas) > 1:
        pairs = [_after(a, b) for a, b in zip(deltas[::2], deltas[1::2])]
        deltas = pairs + deltas[len(pairs) * 2 :]
    return deltas[0]


def _merge(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _MERGED_SCHEMA.split(", ")]
    types = [pa.string()] + [pa.int64()] * 4 + [pa.bool_(), pa.string()]
    key, last, deltas = None, None, []

    def pack(done):
        rows = [(*k, *l, json.dumps(_merge_all(d))) for k, l, d in done]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names
        )

    for batch in arriving:
        done = []
        for doc, segment, group, run, revision, mark, body in rows_of_batch(batch):
            if key != (doc, segment, group):
                if key is not None:
                    done.append((key, last, deltas))
                key, deltas = (doc, segment, group), []
            last = (run, revision, mark)
            deltas.append(json.loads(body))
        if done:
            yield pack(done)
    if key is not None:
        yield pack([(key, last, deltas)])


def _merged(runs: DataFrame) -> DataFrame:
    """Merge runs, `_MERGE` at a time, until no segment has many left to fold in series.

    `runs`: doc_id, segment, block, run_no, revision, mark, body. Runs of one block follow
    each other without a mark or single ops between them.
    """
    spark = runs.sparkSession
    parts = shuffle_partitions(spark)
    while largest_group(runs, ["doc_id", "segment", "block"]) > _MERGE:
        ranked = numbered(
            runs.select("doc_id", "segment", "block", "run_no"),
            ["doc_id", "segment", "block"], ["run_no"],
        ).withColumn("chunk", F.floor((F.col("rn") - 1) / _MERGE))
        group = F.col("block") * F.lit(1 << 31) + F.col("chunk")
        merged = (
            runs.join(ranked, ["doc_id", "segment", "block", "run_no"])
            .select("doc_id", "segment", group.alias("group_no"), "run_no", "revision", "mark", "body")
            .repartition(parts, "doc_id", "segment", "group_no")
            .sortWithinPartitions("doc_id", "segment", "group_no", "run_no")
            .mapInArrow(_merge, _MERGED_SCHEMA)
            .withColumn("block", F.floor(F.col("group_no") / F.lit(1 << 31)))
        )
        runs = materialize(merged.drop("group_no"), "merged")
    return runs


def _composed_steps(ops: DataFrame) -> DataFrame:
    """Replace runs of ops by composed deltas wherever that is provably exact."""
    spark = ops.sparkSession
    chunk = setting(spark, REPLAY_CHUNK)
    # `stop_no` keeps a run from reaching past a mark, so only its last op can carry one.
    if "stop_no" not in ops.columns:
        one = F.col("mark").cast("long")
        ops = running(ops, ["doc_id", "segment"], ["revision"], {"marks": ("sum", one)})
        ops = ops.withColumn("stop_no", F.col("marks") - one)
    chunk_no = F.floor((F.col("revision") - 1) / F.lit(chunk))
    ops = ops.withColumn("run_no", chunk_no * F.lit(1 << 31) + F.col("stop_no"))
    keys = ["doc_id", "segment", "run_no"]
    runs = (
        ops.select(*keys, "revision", "mark", "body")
        .repartition(shuffle_partitions(spark), *keys)
        .sortWithinPartitions(*keys, "revision")
        .mapInArrow(_compose, _RUN_SCHEMA)
    )
    size = F.aggregate(
        ops_decode(F.col("body")),
        F.lit(0).cast("long"),
        lambda acc, op: (
            acc
            + F.when(op["kind"] == "insert", F.length(op["text"]))
            .when(op["kind"] == "delete", -F.greatest(op["count"], F.lit(0)))
            .otherwise(0)
        ).cast("long"),
    )
    totals = ops.groupBy(*keys).agg(F.sum(size).alias("growth"), F.max("stop_no").alias("stop_no"))
    runs = materialize(runs.join(totals, keys), "runs")
    # Real growth is never below `growth`, and a text is never shorter than empty, so the
    # running sum less its own minimum bounds the length from below.
    order, segment = ["run_no"], ["doc_id", "segment"]
    walk = runs.select(*keys, "stop_no", "need", "growth")
    hot = hot_keys(walk, segment)
    walk = running(walk, segment, order, {"total": ("sum", F.col("growth"))}, hot=hot)
    walk = walk.withColumn("start", F.col("total") - F.col("growth"))
    walk = running(walk, segment, order, {"lowest": ("min", F.col("start"))}, hot=hot)
    doubtful = F.col("need") > F.col("start") - F.least(F.col("lowest"), F.lit(0))
    walk = running(
        walk.withColumn("doubtful", doubtful), segment, order,
        {"doubts": ("sum", F.col("doubtful").cast("long"))}, hot=hot,
    )
    block = (F.col("stop_no") + F.col("doubts")).alias("block")
    walk = materialize(walk.select(*keys, "doubtful", block), "walk")
    single = (
        ops.join(walk.filter("doubtful"), keys, "left_semi")
        .withColumn("phase", F.lit(_OPS))
        .select(*_ROW)
    )
    exact = runs.join(walk.filter("NOT doubtful"), keys)
    merged = _merged(exact.select(*segment, "block", "run_no", "revision", "mark", "body"))
    return single.unionByName(merged.withColumn("phase", F.lit(_COMPOSED)).select(*_ROW))


def fold_text(
    ops: DataFrame,
    others: DataFrame | None = None,
    at_end: bool = False,
    longest: int | None = None,
) -> DataFrame:
    """(doc_id, revision, content, tag) after every marked row, or at the end of every segment;
    the tag is the body of a row that is nothing but a mark.

    `ops`: doc_id, segment, revision, body (JSON delta) and mark (ask for the text after this
    op). `others`: further rows with a phase: a base text to start a segment from, or a mark;
    `ops` then also has stop_no, a number that grows from each mark to the next op.
    `longest`: a bound of the ops of a segment where the caller has counted; else they are
    written and counted here.
    """
    spark = ops.sparkSession
    if longest is None:
        ops = materialize(ops, "ops")
        longest = largest_group(ops, ["doc_id", "segment"])
    if longest > setting(spark, MAX_REPLAY_OPS):
        rows = _composed_steps(ops)
    else:
        rows = ops.withColumn("phase", F.lit(_OPS)).select(*_ROW)
    if others is not None:
        rows = rows.unionByName(others.select(*_ROW))
    return (
        rows.repartition(shuffle_partitions(spark), "doc_id", "segment")
        .sortWithinPartitions("doc_id", "segment", "revision", "phase")
        .mapInArrow(partial(_fold, at_end=at_end), _TEXT_SCHEMA)
    )


def _body(ops: Column) -> Column:
    """The delta as Spark reads it, written as JSON again; a missing one is empty."""
    return F.coalesce(ops_encode(ops_decode(ops)), F.lit("[]"))


def latest_content(op_log: DataFrame, longest: int | None = None) -> DataFrame:
    """(doc_id, revision, content) after the last op of every document in the log.

    `longest`: a bound of the ops of a document, if known."""
    zero = F.lit(0).cast("long")
    ops = op_log.select(
        "doc_id", zero.alias("segment"), "revision", _body(F.col("ops")).alias("body"),
        F.lit(False).alias("mark"),
    )
    return fold_text(ops, at_end=True, longest=longest).drop("tag")


def content_where(op_log: DataFrame, wanted: Column) -> DataFrame:
    """(doc_id, revision, content) after every op for which `wanted` holds."""
    ops = op_log.select(
        "doc_id",
        F.lit(0).cast("long").alias("segment"),
        "revision",
        _body(F.col("ops")).alias("body"),
        wanted.alias("mark"),
    )
    return fold_text(ops).drop("tag")


def content_at(op_log: DataFrame, snapshots: DataFrame, points: DataFrame) -> DataFrame:
    """(doc_id, revision, content) at the asked (doc_id, revision) points."""
    marks = points.select("doc_id", "revision").distinct()
    return content_for(op_log, snapshots, marks.withColumn("tag", F.lit(None).cast("string"))).drop("tag")


def content_for(op_log: DataFrame, snapshots: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, revision, content, tag): for every mark (doc_id, revision, tag) the text there.

    Every mark and op is assigned to the latest snapshot below it by one ordered scan, so
    segments between snapshots replay side by side and no op is paired with a request.
    Segments without a mark are not replayed. Tags go along with the replay, so the texts need
    not be shuffled to meet what asked for them.
    """
    def rows_of(df: DataFrame, phase: int, body) -> DataFrame:
        return df.select("doc_id", "revision", F.lit(phase).alias("phase"), body.alias("body"))

    # Snapshots are often a replay of their own, and the rows are read twice: counted, then written.
    snapshots = materialize(snapshots.select("doc_id", "revision", "content"), "base-texts")
    rows = (
        rows_of(snapshots, _BASE, F.col("content"))
        .unionByName(rows_of(op_log, _OPS, _body(F.col("ops"))))
        .unionByName(rows_of(marks, _MARK, F.col("tag")))
    )
    # At one revision the op comes first, then the snapshot it led to, then the mark.
    rows = rows.withColumn("at", F.when(F.col("phase") == _OPS, 0).otherwise(F.col("phase") + 1))
    is_mark = F.col("phase") == _MARK
    order = ["revision", "at"]
    hot = hot_keys(rows, ["doc_id"])
    rows = running(
        rows,
        ["doc_id"],
        order,
        {
            "base": ("last", F.when(F.col("phase") == _BASE, F.col("revision"))),
            "stop_no": ("sum", F.when(is_mark, 1).otherwise(0).cast("long")),
        },
        hot=hot,
    ).withColumn("segment", F.coalesce("base", F.lit(0).cast("long")))
    # An op matters only if a mark of its own segment lies at or above it.
    rows = running(
        rows, ["doc_id"], order,
        {"asked_in": ("last", F.when(is_mark, F.col("segment")))}, True, hot,
    ).filter(F.col("asked_in") == F.col("segment"))
    rows = materialize(rows.withColumn("mark", is_mark), "history")
    ops = rows.filter(F.col("phase") == _OPS)
    # A mark costs a pass over the text, and so does a composed run. Where marks leave runs shorter
    # than asked for, the ops between them cost less one by one.
    sizes = rows.groupBy("doc_id", "segment").agg(
        F.count_if(F.col("phase") == _OPS).alias("n"), F.count_if(F.col("mark")).alias("marks")
    )
    chunk = setting(rows.sparkSession, REPLAY_CHUNK)
    sparse = sizes.filter(F.col("n") > chunk * F.col("marks"))
    longest = sparse.agg(F.max("n")).first()[0] or 0
    return fold_text(ops, rows.filter(F.col("phase") != _OPS), longest=longest)
