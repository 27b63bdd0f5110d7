"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from fixtures import SF, empty, odd, odd_rows, words

from inkspark.llm import periodic
from inkspark.llm.queries import QUERIES


def brute_runs(w: list, min_length: int = 6, min_repeats: int = 4) -> list[tuple[int, int, int]]:
    """Every maximal stretch of every period, without those that have a smaller period."""
    out = set()
    for q in range(1, len(w) // min_repeats + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            part = w[i : j + q]
            if j - i + q >= max(min_length, min_repeats * q) and not any(
                part[d:] == part[:-d] for d in range(1, q)
            ):
                out.add((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w: list, runs: list) -> list:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def some_words(rng: random.Random) -> list[int]:
    n, kinds = rng.randint(0, 70), rng.randint(1, 4)
    w = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n:
            a, p = rng.randrange(n), rng.randint(1, 9)
            end = min(n, a + rng.randint(3, 7) * p)
            w[a:end] = [w[min(n - 1, a + (i - a) % p)] for i in range(a, end)]
    return w


@pytest.mark.parametrize("limits", [(6, 4), (5, 3), (1, 5)])
def test_runs_match_brute_force(limits):
    rng = random.Random(11)
    for _ in range(600):
        w = some_words(rng)
        assert periodic.runs_of(np.array(w, dtype=np.int64), *limits) == brute_runs(w, *limits)


def test_windows_are_scanned_in_parts(monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", 40)
    rng = random.Random(12)
    for _ in range(300):
        w = some_words(rng)
        assert periodic.runs_of(np.array(w, dtype=np.int64)) == brute_runs(w)


def test_rare_words_split_texts_again_and_again():
    # "x" splits the text; then "b" is rare in each part; what is left has only frequent words.
    text = "a a a a a a a b b x a b b b c c c c c c".split()
    ids = np.array([ord(c) for c in text], dtype=np.int64)
    parts = periodic.surviving(ids, np.array([len(text)]), 4, 6)
    assert [text[a:b] for a, b in parts] == [["a"] * 7, ["c"] * 6]


def test_long_texts_take_little_time():
    rng = random.Random(13)
    part = [rng.randrange(40) for _ in range(30_000)]
    w = np.array(part * 5 + [99] * 50_000, dtype=np.int64)
    assert periodic.runs_of(w) == [(0, 150_000, 30_000), (150_000, 50_000, 1)]


def test_runs_of_odd_rows(spark):
    runs = " ".join(["to be or not"] * 5)
    more = [(50, runs), (50, runs), (None, "x " * 9), (51, f"a {runs} b\n{'y ' * 6}"), (52, "z " * 5)]
    extra = odd(spark).select("doc_id", "text", "row")
    docs = extra.unionByName(spark.createDataFrame([(*m, "x") for m in more], extra.schema))
    got = sorted(
        (str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed)
        for r in periodic.periodic_runs(docs).collect()
    )
    expected = []
    for d, text in [*((d, t) for d, t, *_ in odd_rows()), *more]:
        w = words(text)
        found = brute_runs(w) if len(w) < 2000 else []
        expected.append((str(d), len(w), found, " ".join(collapsed(w, found))))
    assert got == sorted(expected)
    assert periodic.periodic_runs(empty(spark)).collect() == []


def planted(doc_id: int, text: str | None) -> list[str]:
    w = words(text)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_query_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op11_periodic_runs"](spark, SF).collect()
    assert len(rows) == len(texts)
    assert sum(r.n_runs > 0 for r in rows) > 10

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    for r in rows:
        w = planted(r.doc_id, texts[r.doc_id])
        # Only texts of moderate length: brute force takes the square of it.
        if len(w) > 3000:
            continue
        runs = brute_runs(w)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(collapsed(w, runs)))
