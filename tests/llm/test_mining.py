"""Hard negatives against brute force and SQL."""

from __future__ import annotations

import math
import random

import numpy as np
from compare import connect, duck_rows, spark_rows
from fixtures import SF
from pyspark.sql import functions as F

from inkspark.llm import hard_negatives as mining
from inkspark.llm.queries import ORACLE, QUERIES

SCHEMA = "vec_id long, label string, vector array<long>, anchor boolean, low string, row int"


def brute(rows, n_positives=5, n_negatives=3):
    """Counted result rows; `rows` are (id, label, vector, anchor)."""
    held = [
        r for r in rows
        if None not in r[:3] and None not in r[2] and all(abs(x) <= mining.MOST for x in r[2])
    ]
    out = []
    for i, (a, label, v, anchor, *_) in enumerate(held):
        if not anchor:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(v, w, strict=True)), b, other)
            for j, (b, other, w, *_) in enumerate(held) if j != i and len(w) == len(v)
        )
        for s, p in [(-s, b) for s, b, x in scored if x == label][:n_positives]:
            fits = [
                (-t, b) for t, b, x in scored if x != label and 50 * s <= -100 * t <= 95 * s
            ]
            out += [(a, p, k, b, s, t) for k, (t, b) in enumerate(fits[:n_negatives], 1)]
    return sorted(out)


def result(df, block_rows=mining.BLOCK_ROWS):
    found = mining.hard_negatives(df, F.col("anchor"), block_rows=block_rows)
    return sorted(tuple(r) for r in found.collect())


def test_query_matches_sql(spark):
    out = QUERIES["op12_hard_negatives"](spark, SF)
    columns, expected = duck_rows(connect(SF), ORACLE["op12_hard_negatives"])
    assert sorted(out.columns) == sorted(columns)
    assert spark_rows(out) == expected and expected


def test_curve_steps_to_neighbours():
    for dims, bits in ((2, 4), (3, 2), (4, 2)):
        axes = np.meshgrid(*[np.arange(1 << bits)] * dims)
        cells = np.stack([a.ravel() for a in axes], axis=1)
        keys = [bytes(k) for k in mining.hilbert_keys(cells, bits)]
        walk = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_products_are_exact():
    rng = np.random.default_rng(5)
    for size in (100, 1 << 26):
        a, b = (rng.integers(-size, size, (n, 7)) for n in (9, 30))
        least, most = mining.bounds(a, b.min(axis=0)[None], b.max(axis=0)[None])
        exact = np.array([[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a])
        assert (mining.products(a, b) == exact).all()
        assert (least <= exact).all() and (exact <= most).all()


def test_odd_rows_ties_and_repeats(spark):
    rng = random.Random(4)
    rows = [
        (i, rng.choice("abc"), [rng.randint(-9, 30) for _ in range(3)], i % 4 == 0, "x", 1)
        for i in range(120)
    ]
    same = [(200 + i, "a" if i % 3 else "b", [7, 7, 7], i % 5 == 0, "x", 1) for i in range(60)]
    odd = [
        (None, "a", [1, 2, 3], True, "x", 1), (300, None, [1, 2, 3], True, "x", 1),
        (301, "a", None, True, "x", 1), (302, "a", [1, None, 3], True, "x", 1),
        (303, "a", [1, 2, 3], None, "x", 1), (304, "a", [], True, "x", 1),
        (305, "a", [], False, "x", 1), (306, "b", [], False, "x", 1),
        (307, "b", [1, 2], True, "x", 1), (308, "lonely", [1, 2, 3], True, "x", 1),
        (309, "a", [0, 0, 0], True, "x", 1), (310, "a", [-5, -5, -5], True, "x", 1),
        (311, "a", [1 << 40, 0, 0], True, "x", 1),
        (8, "a", [9, 9, 9], True, "x", 1), (8, "b", [9, 9, 9], False, "x", 1),
    ]
    rows += same + odd
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    expected = brute(rows)
    assert result(df) == expected and expected
    assert result(df, block_rows=3) == expected
    assert result(spark.createDataFrame([], SCHEMA)) == []
    assert result(df.withColumn("anchor", F.lit(False))) == []


def test_tiles_of_pages_and_slices(spark, monkeypatch):
    for name, value in (("PAGE_BLOCKS", 3), ("SLICE_ANCHORS", 10), ("SOME_ANCHORS", 2), ("GROUP_BLOCKS", 2)):
        monkeypatch.setattr(mining, name, value)
    rng = random.Random(6)
    rows = [
        (i, rng.choice("aab"), [rng.randint(0, 40) for _ in range(5)], i % 6 == 0, "x", 1)
        for i in range(150)
    ]
    assert result(spark.createDataFrame(rows, SCHEMA), block_rows=8) == brute(rows)


def test_zone_maps_spare_far_blocks(spark):
    """Vectors in clusters: an anchor reads its own cluster's blocks and few others."""
    rng = random.Random(9)
    rows = []
    for i in range(1200):
        axis = i % 12
        v = [rng.randint(-2, 2) for _ in range(12)]
        v[axis] += 100
        rows.append((i, "ab"[rng.randrange(2)], v, i % 50 == 0, "x", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(df, block_rows=32) == brute(rows)
    held = df.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").alias("id"), "label",
        "vector", "anchor",
    )
    blocks = mining.block_table(held, 32)
    anchors = mining.anchor_table(blocks, 5)
    asked = anchors.withColumns(
        {"lows": F.array("low"), "highs": F.array(F.lit(1 << 60))}
    )
    read = sum(len(r.wanted) // 8 * r.n for r in mining.requests(blocks, asked, True).collect())
    assert read * 3 < blocks.count() * anchors.count()


def test_scaled_components(spark):
    vectors = [[0.5, -0.001], [1.0, math.nan], [math.inf, 0.0], [None, 1.0], None, []]
    df = spark.createDataFrame([(v,) for v in vectors], "v array<float>")
    got = [r[0] for r in df.select(mining.scaled(F.col("v"), 256)).collect()]
    assert got == [[128, -1], None, None, None, None, []]
