"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Vectors are sorted by label and place on a Hilbert curve and written as Parquet blocks of
neighbours, one row each, beside the least and greatest value of every dimension. Interval
arithmetic on those gives bounds for an anchor's inner product with any row of a block, so a
block is read for an anchor only if its bounds reach into one of the anchor's windows:

- positives: from the anchor's worst positive in its own block upwards, among its own label;
- negatives: between two shares of each positive's score, among the other labels.

Bounds are taken in tiles of (page of zone maps, slice of anchors). Anchors then travel to the
groups of blocks that they must read; a task holds one group of blocks and streams the anchors
past it, so neither side is ever whole in a task. All numbers are integers and exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import freeze

BLOCK_ROWS = 1024
GROUP_BLOCKS = 16  # a power of two; blocks that a task holds at once
PAGE_BLOCKS = 4096  # zone maps that a task holds at once
SLICE_ANCHORS = 65536  # anchors that pass one page in a task
SOME_ANCHORS = 256  # anchors whose products are taken at once
MOST = 1 << 26  # components beyond are left out: products could exceed a LONG
BITS = 8  # of a dimension on the curve
_NONE = np.iinfo(np.int64).min


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as LONG; null if the vector or a component is null,
    infinite or no number."""
    real = F.transform(vector, lambda x: x.cast("double"))
    odd = F.exists(
        real, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))
    )
    whole = F.transform(real, lambda x: F.floor(x * scale).cast("long"))
    return F.when(vector.isNotNull() & ~odd, whole)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Bytes per row that sort as the rows' places on the Hilbert curve; `cells` holds whole
    numbers below 2 ** `bits`, a column for each dimension."""
    rows, dims = cells.shape
    if not dims:
        return np.zeros((rows, 0), dtype=np.uint8)
    x = cells.astype(np.uint32).T.copy()
    bit = 1 << (bits - 1)
    while bit > 1:  # from coordinates to the curve's own axes, coarse to fine
        low = np.uint32(bit - 1)
        for i in range(dims):
            there = (x[i] & np.uint32(bit)) != 0
            swap = np.where(there, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(there, low, swap).astype(np.uint32)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):  # Gray code over the dimensions
        x[i] ^= x[i - 1]
    flip = np.zeros(rows, dtype=np.uint32)
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where(x[-1] & np.uint32(bit), np.uint32(bit - 1), np.uint32(0))
        bit >>= 1
    x ^= flip
    planes = [(x >> np.uint32(b) & np.uint32(1)).astype(np.uint8) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T, axis=1)


def _table(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of `dims` components from an array of little-endian int32 bytes."""
    values = b"".join(column.to_pylist())
    return np.frombuffer(values, dtype="<i4").reshape(len(column), dims)


def _spans(*columns: list) -> Iterator[tuple[int, int]]:
    """Runs of neighbours that are equal in all columns, as (from, to)."""
    rows = list(zip(*columns, strict=True))
    start = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i] != rows[start]:
            yield start, i
            start = i


_BLOCK = (
    "dims int, label string, n int, rows binary, ids binary, vecs binary, low binary, high binary, "
    "anchors binary"
)


def block_table(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of vectors that are near on the curve, written, with their zone maps and `block`,
    numbered within each file. `vectors` has row, id, label, vector (ARRAY of LONG), anchor."""
    (low, high) = vectors.agg(
        F.min(F.array_min("vector")), F.max(F.array_max("vector"))
    ).first()
    low, high = low or 0, high or 0
    cell = (high - low) / (1 << BITS) or 1.0

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            ends = np.cumsum(sizes)
            keys, vecs = np.empty(len(sizes), object), np.empty(len(sizes), object)
            for dims in np.unique(sizes):
                at = np.flatnonzero(sizes == dims)
                own = flat[(ends[at] - dims)[:, None] + np.arange(dims)]
                cells = np.clip((own - low) / cell, 0, (1 << BITS) - 1).astype(np.int64)
                keys[at] = [k.tobytes() for k in hilbert_keys(cells, BITS)]
                vecs[at] = [v.tobytes() for v in own.astype("<i4")]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("row", "id", "label", "anchor")),
                    pa.array(sizes, pa.int32()),
                    pa.array(keys, pa.binary()),
                    pa.array(vecs, pa.binary()),
                ],
                names=["row", "id", "label", "anchor", "dims", "key", "vec"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_kind, count = [], None, 0
        for batch in batches:
            kinds = batch.column("dims").to_pylist(), batch.column("label").to_pylist()
            for a, b in _spans(*kinds):
                kind = kinds[0][a], kinds[1][a]
                if kind != held_kind and count:
                    yield block(held, held_kind)
                    held, count = [], 0
                held_kind = kind
                while a < b:
                    take = min(b - a, block_rows - count)
                    held.append(batch.slice(a, take))
                    a, count = a + take, count + take
                    if count == block_rows:
                        yield block(held, kind)
                        held, count = [], 0
        if count:
            yield block(held, held_kind)

    def block(parts: list[pa.RecordBatch], kind: tuple[int, str]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        rows, ids = (whole.column(c).to_numpy().astype("<i8") for c in ("row", "id"))
        order = np.argsort(ids, kind="stable")  # ties of a score then stand in their order
        vecs = _table(whole.column("vec"), kind[0])[order]
        anchor = whole.column("anchor").to_numpy(zero_copy_only=False).astype(np.uint8)[order]
        values = [
            kind[0], kind[1], len(rows), rows[order].tobytes(), ids[order].tobytes(),
            vecs.tobytes(), vecs.min(axis=0).tobytes(), vecs.max(axis=0).tobytes(),
            anchor.tobytes(),
        ]
        return _one(values, _BLOCK)

    shape = "row long, id long, label string, anchor boolean, dims int, key binary, vec binary"
    order = ["dims", "label", "key", "row"]
    near = vectors.mapInArrow(placed, shape).repartitionByRange(*order)
    cut_ = near.sortWithinPartitions(*order).mapInArrow(cut, _BLOCK)
    return freeze(cut_.withColumn("block", F.monotonically_increasing_id()), "vector-blocks")


_TYPES = {
    "int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(),
}


def _one(values: list, schema: str) -> pa.RecordBatch:
    """A batch of one row."""
    fields = [x.split() for x in schema.split(", ")]
    arrays = [pa.array([v], _TYPES[t]) for v, (_, t) in zip(values, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of `a` with all rows of `b`."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 1 << 53:  # whole doubles, which are several times faster
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of `a` with any vector between `low` and
    `high`, for every pair of those."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return (
        products(up, low) + products(down, high),
        products(up, high) + products(down, low),
    )


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, column, score) of the best, second best ... of each row; of equal scores the first
    column. `k` passes."""
    left = np.where(allowed, scores, _NONE)
    rows = np.arange(len(left))
    for _ in range(k if left.shape[1] else 0):
        at = left.argmax(axis=1)
        value = left[rows, at]
        some = np.flatnonzero(value > _NONE)
        if not len(some):
            return
        yield some, at[some], value[some]
        left[rows, at] = _NONE


_ANCHOR = "row long, id long, dims int, label string, vec binary, low long"


def anchor_table(blocks: DataFrame, n_positives: int) -> DataFrame:
    """The anchors of all blocks, written, with `low`: the score of the last of the first
    `n_positives` of their label in their own block, which no positive falls below."""

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = np.flatnonzero(np.frombuffer(r["anchors"], dtype=np.uint8))
                if not len(at):
                    continue
                vecs = np.frombuffer(r["vecs"], dtype="<i4").reshape(r["n"], r["dims"])
                other = np.ones((len(at), r["n"]), dtype=bool)
                other[np.arange(len(at)), at] = False
                low = np.full(len(at), _NONE, dtype=np.int64)
                last = list(_best(products(vecs[at], vecs), other, n_positives))
                if len(last) == n_positives:
                    low[last[-1][0]] = last[-1][2]
                rows, ids = (np.frombuffer(r[c], dtype="<i8")[at] for c in ("rows", "ids"))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows), pa.array(ids),
                        pa.array(np.full(len(at), r["dims"], dtype=np.int32)),
                        pa.array([r["label"]] * len(at), pa.string()),
                        pa.array([v.tobytes() for v in vecs[at]], pa.binary()), pa.array(low),
                    ],
                    names=["row", "id", "dims", "label", "vec", "low"],
                )

    some = blocks.select("dims", "label", "n", "rows", "ids", "vecs", "anchors")
    return freeze(some.mapInArrow(taken, _ANCHOR), "anchors")


_REQUEST = (
    "group long, block long, dims int, label string, n int, rows binary, ids binary, vecs binary, "
    "lows binary, highs binary, wanted binary"
)


def requests(blocks: DataFrame, anchors: DataFrame, same: bool) -> DataFrame:
    """What each group of blocks is asked: anchors with their windows and the wanted blocks.

    `anchors` has row, id, dims, label, vec, and lows and highs (ARRAY of LONG, as many for each
    row of a table): a block is wanted if its bounds meet a window and its label is the anchor's
    (`same`) or another.
    """
    pages = max(1, math.ceil(blocks.count() / PAGE_BLOCKS))
    slices = max(1, math.ceil(anchors.count() / SLICE_ANCHORS))
    zones = blocks.select(
        F.pmod(F.hash(F.col("block").bitwiseAND(-GROUP_BLOCKS)), F.lit(pages)).alias("page"),
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
        F.lit(0).alias("kind"), "block", F.lit(None).cast("long").alias("row"),
        F.lit(None).cast("long").alias("id"), "dims", "label",
        F.col("low").alias("vec"), F.col("high").alias("vec2"),
        *(F.lit(None).cast("array<long>").alias(c) for c in ("lows", "highs")),
    )
    asked = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("page"),
        F.pmod(F.hash("row"), F.lit(slices)).alias("slice"),
        F.lit(1).alias("kind"), F.lit(None).cast("long").alias("block"), "row", "id", "dims",
        "label", "vec", F.lit(None).cast("binary").alias("vec2"), "lows", "highs",
    )

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, zones_of = None, {}
        for batch in batches:
            names = ("page", "slice", "kind", "dims", "label")
            keys = [batch.column(c).to_pylist() for c in names]
            for a, b in _spans(*keys):
                page, slice_, kind, dims, label = (k[a] for k in keys)
                if tile != (page, slice_):
                    tile, zones_of = (page, slice_), {}
                part = batch.slice(a, b - a)
                if kind == 0:
                    zones_of.setdefault(dims, []).append(
                        (
                            part.column("block").to_numpy(),
                            np.full(b - a, label, dtype=object),
                            _table(part.column("vec"), dims),
                            _table(part.column("vec2"), dims),
                        )
                    )
                elif dims in zones_of:
                    if len(zones_of[dims]) > 1:
                        joined = [np.concatenate(x) for x in zip(*zones_of[dims], strict=True)]
                        zones_of[dims] = [tuple(joined)]
                    for i in range(0, b - a, SOME_ANCHORS):
                        yield from wanted(part.slice(i, SOME_ANCHORS), dims, label, *zones_of[dims][0])

    def wanted(part, dims, label, block, labels, low, high) -> Iterator[pa.RecordBatch]:
        fits = np.flatnonzero((labels == label) == same)
        if not len(fits):
            return
        vecs = _table(part.column("vec"), dims)
        lows, highs = (
            part.column(c).flatten().to_numpy().reshape(len(vecs), -1) for c in ("lows", "highs")
        )
        least, most = bounds(vecs, low[fits], high[fits])
        meets = np.zeros(least.shape, dtype=bool)
        for w in range(lows.shape[1]):
            meets |= (most >= lows[:, w, None]) & (least <= highs[:, w, None])
        rows, ids = (part.column(c).to_numpy() for c in ("row", "id"))
        groups = block[fits] & -GROUP_BLOCKS
        for group in np.unique(groups):
            of = np.flatnonzero(groups == group)
            at = np.flatnonzero(meets[:, of].any(axis=1))
            if len(at):
                names = block[fits[of[meets[:, of].any(axis=0)]]]
                data = [rows[at], ids[at], vecs[at], lows[at], highs[at], names]
                values = [int(group), None, dims, label, len(at), *(x.tobytes() for x in data)]
                yield _one(values, _REQUEST)

    tiles = zones.unionByName(asked).repartition("page", "slice")
    order = ["page", "slice", "kind", "dims", "label"]
    return tiles.sortWithinPartitions(*order).mapInArrow(choose, _REQUEST)


_FOUND = "row long, id long, window int, score long, other long"


def search(blocks: DataFrame, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """The first `k` rows by score, then id, for every window of every anchor (see `requests`):
    row and id of the anchor, window, score, other (the id found), place (from 1)."""
    empty = F.lit(b"")
    payload = blocks.select(
        F.col("block").bitwiseAND(-GROUP_BLOCKS).alias("group"), "block", "dims", "label", "n",
        "rows", "ids", "vecs", empty.alias("lows"), empty.alias("highs"), empty.alias("wanted"),
    )
    asked = requests(blocks, anchors, same)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["group"] != group:
                    group, held = r["group"], {}
                dims = r["dims"]
                rows, ids = (np.frombuffer(r[c], dtype="<i8") for c in ("rows", "ids"))
                vecs = np.frombuffer(r["vecs"], dtype="<i4").reshape(r["n"], dims)
                if r["block"] is not None:
                    held[r["block"]] = rows, ids, vecs
                    continue
                parts = [held[b] for b in np.frombuffer(r["wanted"], dtype="<i8").tolist()]
                their = [np.concatenate(x) for x in zip(*parts, strict=True)]
                order = np.argsort(their[1], kind="stable")
                yield from matches(r, rows, ids, vecs, *(x[order] for x in their))

    def matches(r, rows, ids, vecs, other_rows, other_ids, other) -> Iterator[pa.RecordBatch]:
        scores = products(vecs, other)
        lows, highs = (
            np.frombuffer(r[c], dtype="<i8").reshape(len(rows), -1) for c in ("lows", "highs")
        )
        new = rows[:, None] != other_rows if same else True
        for w in range(lows.shape[1]):
            inside = (scores >= lows[:, w, None]) & (scores <= highs[:, w, None]) & new
            for a, b, s in _best(scores, inside, k):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[a]), pa.array(ids[a]),
                        pa.array(np.full(len(a), w, dtype=np.int32)),
                        pa.array(s), pa.array(other_ids[b]),
                    ],
                    names=["row", "id", "window", "score", "other"],
                )

    both = payload.unionByName(asked).repartition("group")
    # Blocks come before the anchors that read them: their number is known.
    both = both.sortWithinPartitions("group", F.col("block").asc_nulls_last())
    best = Window.partitionBy("row", "window").orderBy(F.desc("score"), "other")
    found = both.mapInArrow(score, _FOUND).withColumn("place", F.row_number().over(best))
    return found.filter(F.col("place") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "vector",
    label_col: str = "label",
    n_positives: int = 5,
    n_negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For every row where `anchor` holds, and each of its first `n_positives` other rows of the
    same label by inner product: the first `n_negatives` rows of other labels whose product lies
    between `low_percent` and `high_percent` of the positive's (both included).

    `vector_col` is an ARRAY of whole numbers (see `scaled`). Returns anchor_id, positive_id,
    rank (INT, from 1), negative_id, positive_score, negative_score. Higher products come first,
    ties by smaller id. Rows with a null id, label, vector or component take no part, nor do
    components beyond `MOST` (a product could exceed a LONG). Vectors of different lengths have
    no product and never meet; empty ones have product 0. Repeated ids are rows of their own; an
    anchor is not its own positive, its equal rows are. A positive with a negative product has
    an empty window. An empty table gives an empty one. Other columns are not read.
    """
    vector = F.col(vector_col).cast("array<long>")
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("string").alias("label"),
        vector.alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    odd = F.exists("vector", lambda x: x.isNull() | (F.abs(x) > MOST))
    rows = rows.filter(~odd).withColumn("row", F.monotonically_increasing_id())
    blocks = block_table(rows, block_rows)
    anchors = anchor_table(blocks, n_positives)

    open_end = F.array(F.lit(np.iinfo(np.int64).max))
    upwards = anchors.withColumns({"lows": F.array("low"), "highs": open_end}).drop("low")
    positives = freeze(search(blocks, upwards, True, n_positives).drop("window"), "positives")

    # At most `n_positives` rows each; windows that are missing stay empty.
    places = [F.max(F.when(F.col("place") == p, F.col("score"))) for p in range(1, n_positives + 1)]
    windows = positives.groupBy("row").agg(F.array(*places).alias("scores"))
    # Hundredths rounded up and down, without doubles.
    least = F.expr(
        f"transform(scores, s -> coalesce(-({_down(f'-s * {low_percent}')}), 1L))"
    )
    most = F.expr(f"transform(scores, s -> coalesce({_down(f's * {high_percent}')}, 0L))")
    ranges = anchors.drop("low").join(windows.select(
        F.col("row").alias("of"), least.alias("lows"), most.alias("highs")
    ), F.col("row") == F.col("of")).drop("of")
    ranges = freeze(ranges, "windows")
    negatives = search(blocks, ranges, False, n_negatives).select(
        F.col("row").alias("of"), (F.col("window") + 1).alias("nth"),
        F.col("place").alias("rank"), F.col("other").alias("negative_id"),
        F.col("score").alias("negative_score"),
    )
    pairs = (F.col("row") == F.col("of")) & (F.col("place") == F.col("nth"))
    return positives.join(negatives, pairs).select(
        F.col("id").alias("anchor_id"), F.col("other").alias("positive_id"), "rank",
        "negative_id", F.col("score").alias("positive_score"), "negative_score",
    )


def _down(value: str) -> str:
    """SQL for a hundredth of a LONG, rounded down."""
    return f"({value} - pmod({value}, 100L)) div 100L"
