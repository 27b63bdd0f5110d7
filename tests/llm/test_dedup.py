"""Exact, near and line dedup against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest
from compare import connect, duck_rows, spark_rows
from fixtures import GAP, SF, empty, odd, odd_rows, prose, shingle_set, words

from inkspark.llm import exact_dedup, graph, line_dedup, near_dedup
from inkspark.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_near_dedup", "op9_exact_dedup"])
def test_dedup_matches_sql(spark, name):
    out = QUERIES[name](spark, SF)
    columns, expected = duck_rows(connect(SF), ORACLE[name])
    assert sorted(out.columns) == sorted(columns)
    assert spark_rows(out) == expected


@pytest.mark.parametrize("trie_bytes", [2_000, exact_dedup.TRIE_BYTES])
def test_exact_dedup_of_odd_rows(spark, trie_bytes):
    rows = exact_dedup.exact_dedup(odd(spark), trie_bytes=trie_bytes).collect()
    groups: dict[str, list] = {}
    for d, t, *_ in odd_rows():
        groups.setdefault(GAP.sub(" ", t or ""), []).append(d)
    assert len(rows) == len(odd_rows())
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in rows:
        ids = by_hash[r.text_sha256]
        known = [d for d in ids if d is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == (min(known) if known else None)
    kept = [r for r in rows if r.kept]
    assert len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in kept)


def test_trie_spills_and_keeps_every_text():
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(0, 6)).encode() for _ in range(3000)]
    texts += [b"", b"a", b"ab", b"abc" * 500, b"abc" * 501]
    trie, expected = exact_dedup.Trie(20_000), {}
    for i, t in enumerate(texts):
        who = None if i % 7 == 0 else i
        trie.add(t, (t, who, 1))
        known = expected.setdefault(t, [])
        known.append(who)
    found = list(trie.items())
    assert len(found) == len(expected)
    for key, first, n in found:
        ids = [x for x in expected[key] if x is not None]
        assert (first, n) == (min(ids) if ids else None, len(expected[key]))


def brute_components(rows, n, percent=80):
    """(set size, smallest linked id) per row of unique ids."""
    sets = {d: shingle_set(t, n) for d, t in rows}
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_dedup_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = brute_components([tuple(r) for r in rows], 4)
    got = QUERIES["op2_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(got) == len(rows)


@pytest.mark.parametrize("rounds,small", [(3, 16), (0, 2)])
def test_near_dedup_of_many_edits(spark, monkeypatch, rounds, small):
    """A large group whose members are linked in chains, and a passage that most share."""
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(near_dedup, "SMALL_LIST", small)
    rng = random.Random(5)
    base, passage = prose(rng, 120).split(), prose(rng, 60)
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(9)}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, passage + " " + prose(rng, 70)) for i in range(40)]
    rows += [(200 + i, prose(rng, i % 6)) for i in range(12)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = brute_components(rows, 5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == expected


def test_near_dedup_of_odd_rows(spark):
    rows = near_dedup.near_dedup(odd(spark)).collect()
    assert len(rows) == len(odd_rows())
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert {by_id[d].component_id for d in (1, 2, 3, 4)} == {1}
    alone = [r for r in rows if r.n_shingles == 0]
    assert len(alone) == 4 and all(r.kept for r in alone)
    assert sum(r.kept for r in rows if r.doc_id == 8) == 1
    assert near_dedup.near_dedup(empty(spark)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 103), (103, 101), (101, 101)]
    found = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    expected = {(i, 0) for i in range(51)} | {(100, 100), (101, 100), (103, 100)}
    assert {tuple(r) for r in found} == expected


def brute_lines(rows, min_words):
    """Texts without lines in later occurrences of any window with `min_words` words."""
    lines = {d: [x for x in enumerate((t or "").split("\n")) if words(x[1])] for d, t in rows}
    first: dict[tuple, tuple] = {}
    gone = {d: set() for d in lines}
    for d in sorted(lines):
        for i in range(len(lines[d])):
            for j in range(i + 1, len(lines[d]) + 1):
                window = lines[d][i:j]
                if sum(len(words(x)) for _, x in window) < min_words:
                    continue
                key = tuple(x for _, x in window)
                seen = first.setdefault(key, (d, i))
                if seen[0] != d or i >= seen[1] + (j - i):
                    gone[d].update(k for k, _ in window)
    return {
        d: None if t is None else "\n".join(
            x for k, x in enumerate(t.split("\n")) if k not in gone[d]
        )
        for d, t in rows
    }


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(11)
    pool = [prose(rng, rng.choice([1, 2, 3, 5, 9])) for _ in range(25)]
    rows = []
    for d in range(40):
        take = rng.sample(pool, rng.randint(0, 8))
        start = rng.randrange(len(pool))
        run = [x for x in pool[start : start + rng.randint(1, 6)] if x not in take]
        own = [prose(rng, rng.randint(1, 9)) for _ in range(3)]
        rows.append((d, "\n".join([*take[:4], "", *run, *own, *take[4:]])))
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == brute_lines(rows, line_dedup.MIN_WORDS)


def test_line_dedup_matches_brute_force_on_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.text for r in QUERIES["op1_line_dedup"](spark, SF).collect()}
    assert got == brute_lines([tuple(r) for r in rows], line_dedup.MIN_WORDS)


def test_line_dedup_of_odd_rows(spark):
    rows = line_dedup.line_dedup(odd(spark)).collect()
    assert len(rows) == len(odd_rows())
    assert set(odd(spark).columns) < set(rows[0].asDict())
    got = {r.doc_id: r for r in rows if r.doc_id not in (None, 8)}
    before = {d: t for d, t, *_ in odd_rows()}
    assert got[1].text == before[1] and got[2].text == ""
    assert got[5].text is None and got[6].text == "" and got[7].text == before[7]
    passage = before[10].split("\n")[:4]
    assert got[10].lines_removed == 0 and got[11].lines_removed == got[12].lines_removed == 4
    assert not set(passage) & set(got[12].text.split("\n")) and got[12].text.endswith("end")
    twice = "a b c d e f g h i\nz"
    one = spark.createDataFrame([(1, f"{twice}\n{twice}\nq")], "doc_id long, text string")
    assert line_dedup.line_dedup(one).first().text == f"{twice}\nq"
    assert line_dedup.line_dedup(empty(spark)).count() == 0
