"""Mixing, packing, sharding and the pipeline."""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import SF, empty, odd, odd_rows, words
from pyspark.sql import functions as F
from test_text import TOKENIZER

import corpus_pipeline
from inkspark.llm import mixing, packing, sharding
from inkspark.llm.common import n_words
from inkspark.llm.encode import Encoder
from inkspark.llm.queries import QUERIES


def brute_targets(sizes: dict) -> dict:
    """Share by weight, cut at the cap, share the excess anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    out, left = {}, mixing.SHARE * sum(sizes.values())
    while True:
        free = [s for s in order if s not in out]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total >= 2 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        left = mixing.SHARE * sum(sizes.values()) - sum(out.values())


def test_mix_of_documents(spark):
    texts = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op3_mix_sources"](spark, SF).collect()
    sizes = Counter()
    for r in texts.values():
        sizes[r.source] += len(words(r.text))
    targets, taken = brute_targets(sizes), Counter()
    for r in rows:
        assert r.size == len(words(texts[r.doc_id].text))
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        assert abs(r.copies - r.rate) < 1 + 1e-9 or r.size == 0
        taken[r.source] += r.taken
    assert len(rows) == len(texts)
    largest = max(r.size for r in rows)
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(0.02 * t, largest / 2)
    # The rates solve the dual: they meet the target and are tilted by size alone.
    by = defaultdict(list)
    for r in rows:
        if r.size:
            by[r.source].append(r)
    for s, group in by.items():
        assert sum(r.rate * r.size for r in group) == pytest.approx(targets[s], rel=1e-5)
        tilts = [math.log(r.rate) / r.size for r in group if 0 < r.rate < 2]
        assert not tilts or max(tilts) == pytest.approx(min(tilts), rel=1e-6, abs=1e-12)
    again = QUERIES["op3_mix_sources"](spark, SF).repartition(5).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_mix_of_odd_rows(spark):
    docs = odd(spark).withColumn("words_n", n_words(F.col("text")))
    rows = mixing.mix(docs, size_col="words_n").collect()
    assert len(rows) == len(odd_rows())
    assert {r.copies for r in rows if not words(r.text)} == {1}
    assert set(docs.columns) - {"rate"} < set(rows[0].asDict())
    sizes = Counter()
    for _, t, s, *_ in odd_rows():
        sizes[s] += len(words(t))
    targets = brute_targets(sizes)
    assert all(r.target == pytest.approx(targets[r.source]) for r in rows)
    none = empty(spark).withColumn("words_n", F.lit(0))
    assert mixing.mix(none, size_col="words_n").count() == 0


def test_fullest_bin_matches_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(200):
        items = rng.integers(1, 12, rng.integers(0, 9)).tolist()
        room = int(rng.integers(0, 25))
        counts = np.bincount(items, minlength=30) if items else np.zeros(30, dtype=int)
        chosen = packing.fullest(counts, room)
        sums = {
            sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k)
        }
        assert sum(chosen) == max(s for s in sums if s <= room)
        assert not Counter(chosen) - Counter(items)


def check_packed(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_packing_of_documents(spark):
    encode = Encoder(TOKENIZER)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = QUERIES["op7_best_fit_packing"](spark, SF).collect()
    used = check_packed(rows, 2048)
    assert used <= math.ceil(sum(r.length for r in rows) / 2048) + 1
    pieces = {(r.doc_id, r.piece): r for r in rows}
    assert len(pieces) == len(rows)
    for d in docs:
        ids = encode.batch([d.text])[0] + b"\0\0\0\0"
        at, piece = 0, 0
        while at < len(ids) // 4:
            r = pieces.pop((d.doc_id, piece))
            part = ids[4 * at : 4 * (at + r.length)]
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(part))
            assert r.length == 2048 or piece == 0
            at, piece = at + r.length, piece + 1
    assert not pieces


def test_packing_of_odd_rows(spark):
    docs = odd(spark)
    pieces = packing.pieces_of(docs, TOKENIZER, capacity=100)
    rows = packing.pack(pieces, capacity=100).collect()
    check_packed(rows, 100)
    assert len({(r.doc_id, r.start, r.ids_crc32) for r in rows}) <= len(rows)
    assert sum(r.length == 1 for r in rows) == 3  # null and empty texts hold their end only
    lengths = spark.createDataFrame(
        [(5, "a"), (None, "b"), (0, "c"), (5, "a"), (10, "d")], "length int, number string"
    )
    got = packing.pack(lengths, capacity=10).collect()
    assert [r.sequence_id for r in got if not r.length] == [None, None]
    assert check_packed([r for r in got if r.length], 10) == 2
    assert packing.pack(lengths.limit(0)).count() == 0
    assert packing.pieces_of(empty(spark), TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        packing.pack(lengths, capacity=9)


def check_shards(rows, shards):
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts[i] for i in range(shards)) <= 1
    for i in range(shards):
        assert sorted(r.slot for r in rows if r.shard == i) == list(range(counts[i]))


def test_shards_of_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op10_shards"](spark, SF).collect()
    check_shards(rows, 24)
    assert len(rows) == len(docs)
    for r in rows:
        text = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32) == (len(text) + 8, zlib.crc32(text))


def test_shards_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 2)
    rows = sharding.shard(odd(spark), shards=3).collect()
    check_shards(rows, 3)
    expected = Counter((d, t) for d, t, *_ in odd_rows())
    assert Counter((r.doc_id, r.text) for r in rows) == expected
    assert sharding.shard(empty(spark)).count() == 0


def test_matrix_sums_and_distribution(spark):
    sizes = [(i, n) for i, n in enumerate([5, 0, 40, 7, 300, 1, 1, 90])]
    table = spark.createDataFrame(sizes, "block long, size long")
    total, firsts = sum(n for _, n in sizes), []
    for seed in range(12):
        rows = dict(
            (r.block, r.counts) for r in sharding.communication_matrix(table, 5, seed).collect()
        )
        assert {b: sum(c) for b, c in rows.items()} == dict(sizes)
        even = [total // 5 + (i < total % 5) for i in range(5)]
        assert [sum(c[i] for c in rows.values()) for i in range(5)] == even
        firsts.append(rows[4])
    assert len({tuple(c) for c in firsts}) > 6
    assert abs(np.mean(firsts) - 60) < 4


@pytest.mark.parametrize("good,bad,drawn", [(300, 700, 120), (5, 4000, 900), (12, 9, 15), (3, 3, 4)])
def test_hypergeometric_draws(spark, good, bad, drawn):
    args = [F.lit(x).cast("long") for x in (good, bad, drawn)]
    draw = sharding._hypergeometric(*args, F.col("id")).alias("z")
    z = np.array([r.z for r in spark.range(4000).select(draw).collect()])
    exact = {
        k: math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn)
        for k in range(max(0, drawn - bad), min(good, drawn) + 1)
    }
    below, gap = 0.0, 0.0
    for k, p in exact.items():
        below += p
        gap = max(gap, abs(below - float(np.mean(z <= k))))
    assert gap < 0.031  # Kolmogorov-Smirnov, far beyond the 0.1% point


def test_pipeline_stages(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.freeze(stage(spark, docs, SF), "test")
        assert docs.columns == columns, name
    mixed = docs.collect()
    assert {r.doc_id for r in mixed} <= set(before)
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_packed(packed, 2048)
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mixed)


def test_pipeline_of_odd_rows(spark):
    for docs in (odd(spark), empty(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.freeze(stage(spark, docs, SF), "test")
            assert docs.columns == columns, name
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def test_queries_pack_the_ids_themselves(spark, monkeypatch):
    """op7 and the pipeline's last stage take their digests from packed ids."""
    import corpus_pipeline
    from inkspark.llm.queries import QUERIES

    seen = []

    def pack(pieces):
        seen.append(pieces.columns)
        return real(pieces)

    real = packing.pack
    monkeypatch.setattr(packing, "pack", pack)
    monkeypatch.setattr(corpus_pipeline, "pack", pack)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    stage = corpus_pipeline.pack_sequences(spark, docs, SF)
    query = QUERIES["op7_best_fit_packing"](spark, SF)
    assert len(seen) == 2 and all("ids" in columns for columns in seen)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert stage.columns == query.columns == names
    pieces = packing.pieces_of(docs, TOKENIZER, with_ids=False)
    assert {tuple(r)[:5] for r in stage.collect()} == {tuple(r) for r in pieces.collect()}


def test_numbering_shuffles_what_the_rows_carry_once(spark):
    sizes = [5, None, 7, 5, None, 5, 7, 5, 0, None]
    rows = spark.createDataFrame([(n, "x") for n in sizes], "length LONG, ids STRING")
    numbered = packing.numbered_by(rows.repartition(3), "length", "no", "t")
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the rows, and the starts
    got = Counter((r.length, r.no) for r in numbered.collect())
    assert got == Counter((n, i) for n, c in Counter(sizes).items() for i in range(c))
