"""Periodic runs of words, by recursive frequency splitting and a lag scan.

A run is a stretch of words with smallest period q, at least `min_repeats` periods and
`min_length` words long, that no neighbouring word extends with that period. Each of its words
stands in it at least `min_repeats` times, so a word that is rarer than that in a segment cannot
be part of a run there and splits it. The pieces are split anew until none has a rare word; most
texts are used up by then. What survives is scanned lag by lag at the multiples of the lag only:
a run that long covers whole windows there, whose hashes are equal. Candidates are then extended
word by word, so the hashes decide nothing alone. All texts of an Arrow batch are split together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words
from .encode import in_slices

MIN_LENGTH = 6  # words
MIN_REPEATS = 4  # periods
PAIRS = 1 << 20  # windows that the lag scan compares at once
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, of the rolling hash


def surviving(
    ids: np.ndarray, sizes: np.ndarray, least: int, min_length: int
) -> list[tuple[int, int]]:
    """Segments (from, to) of texts laid end to end, each word of which occurs in its segment
    at least `least` times. `sizes` are the words of the texts."""
    place = np.flatnonzero(np.repeat(sizes >= min_length, sizes))
    segment = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)[place]
    width = int(ids.max(initial=0)) + 1
    found = []
    while len(place):
        _, word, count = np.unique(
            segment * width + ids[place], return_inverse=True, return_counts=True
        )
        often = count[word] >= least
        split = np.zeros(int(segment[-1]) + 1, dtype=bool)
        split[segment[~often]] = True
        stable = ~split[segment]
        for part in (stable, often & ~stable):
            p, s = place[part], segment[part]
            new = np.ones(len(p), dtype=bool)
            new[1:] = (np.diff(p) != 1) | (np.diff(s) != 0)
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(p)))
            if part is stable:
                found += zip(p[first].tolist(), (p[first] + size).tolist(), strict=True)
            else:
                large = size >= min_length
                keep = np.repeat(large, size)
                place = p[keep]
                segment = np.repeat(np.arange(int(large.sum()), dtype=np.int64), size[large])
    return sorted(found)


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Scattered 64-bit values of word numbers."""
    x = ids.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + _BASE
    x ^= x >> np.uint64(31)
    return x * np.uint64(0x94D049BB133111EB)


def _candidates(w: np.ndarray, repeats: int) -> Iterator[tuple[int, np.ndarray]]:
    """(lag, multiples of the lag where `repeats` - 1 windows of its length seem equal)."""
    n = len(w)
    power = np.full(n + 1, _BASE, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_mixed(w) * power[:n], out=prefix[1:], dtype=np.uint64)
    lag, top = 1, n // repeats
    while lag <= top:
        last, pairs = lag, n // lag
        while last < top and pairs + n // (last + 1) <= PAIRS:
            last += 1
            pairs += n // last
        lags = np.arange(lag, last + 1)
        windows = n // lags
        ends = np.cumsum(windows)
        q = np.repeat(lags, windows)
        at = (np.arange(int(ends[-1])) - np.repeat(ends - windows, windows)) * q
        hashed = prefix[at + q] - prefix[at]
        # Equal to the next window, if that belongs to the same lag.
        same = hashed[:-1] * power[q[:-1]] == hashed[1:]
        same &= q[:-1] == q[1:]
        good = same
        for k in range(1, repeats - 2):
            good = good[:-1] & same[k:]
        hits = np.flatnonzero(good)
        hits = hits[q[hits] == q[hits + repeats - 2]]
        lag = last + 1
        if len(hits):
            lag_of, first = np.unique(q[hits], return_index=True)
            yield from zip(lag_of.tolist(), np.split(at[hits], first[1:]), strict=True)


def _reach(w: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from `at` on, forwards or backwards, equal the word one lag behind."""
    n, done, size = len(w), 0, 64
    while True:
        if step > 0:
            here = w[at + done : at + done + size]
            there = w[at + done - lag : at + done - lag + len(here)]
        else:
            low = max(0, at + 1 - done - size)
            here = w[low : at + 1 - done][::-1]
            there = w[low + lag : at + 1 - done + lag][::-1]
        if not len(here):
            return done
        odd = here != there
        if odd.any():
            return done + int(odd.argmax())
        done += len(here)
        size = min(size * 2, max(n, 64))


def runs_of(
    w: np.ndarray, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS
) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs among word numbers, by start and period."""
    if min_repeats < 3:
        raise ValueError("runs of fewer than three periods are not found by windows")
    n = len(w)
    period = np.ones(n, dtype=np.int64)  # of the longest run known at a word
    length, end = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    found: dict[tuple[int, int], int] = {}
    for lag, at in _candidates(w, min_repeats):
        span = (min_repeats - 1) * lag
        # Inside a run whose period divides the lag, the lag says nothing new.
        at = at[(end[at] < at + span) | (lag % period[at] != 0)]
        low, high = 0, 0
        for x in at.tolist():
            if low <= x and x + span <= high:
                continue
            low = x - _reach(w, x - 1, lag, -1)
            high = x + lag + _reach(w, x + lag, lag, 1)
            size = high - low
            if size >= max(min_length, min_repeats * lag) and (low, high) not in found:
                found[low, high] = lag
                longer = length[low:high] < size
                period[low:high][longer] = lag
                length[low:high][longer] = size
                end[low:high][longer] = high
    return sorted((low, high - low, q) for (low, high), q in found.items())


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_repeats: int = MIN_REPEATS,
) -> DataFrame:
    """Per row: the id, n_words, runs (ARRAY of STRUCT start, length, period, all LONG, in words
    from 0, by start and period) and collapsed, the words that stay joined by one space.

    A word goes if it stands in a run after that run's first period. Runs may overlap. A null,
    empty or blank text has no words and no runs, and is '' when collapsed; null and repeated
    ids and equal rows are rows of their own. Texts count whole, however long; a task holds one
    batch of texts. An empty table gives an empty one. Other columns of `docs` are not read.
    """
    kind = docs.schema[id_col].dataType
    id_type = kind.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in in_slices(texts):
                split = [_WORD.findall(t or "") for t in texts[a:b]]
                runs, collapsed = _collapse(split, min_length, min_repeats)
                sizes = pa.array([len(s) for s in split], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), sizes, runs, pa.array(collapsed, pa.string())],
                    names=["id", "n_words", "runs", "collapsed"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(
        scan,
        f"id {id_type}, n_words long, "
        "runs array<struct<start: long, length: long, period: long>>, collapsed string",
    )
    return found.withColumnRenamed("id", id_col)


def _collapse(
    split: list[list[str]], min_length: int, min_repeats: int
) -> tuple[pa.Array, list[str]]:
    """Runs per text, and the words left."""
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = [w for s in split for w in s]
    ids = pd.factorize(np.array(flat, dtype=object))[0].astype(np.int64)
    found: list[tuple[int, int, int]] = []
    for low, high in surviving(ids, sizes, min_repeats, min_length):
        found += [(low + s, n, q) for s, n, q in runs_of(ids[low:high], min_length, min_repeats)]
    table = np.array(sorted((s, q, n) for s, n, q in found), dtype=np.int64).reshape(-1, 3)
    text = np.searchsorted(starts, table[:, 0], side="right") - 1
    drop = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(drop, table[:, 0] + table[:, 1], 1)
    np.add.at(drop, table[:, 0] + table[:, 2], -1)
    gone = np.cumsum(drop)[:-1] > 0
    collapsed = [" ".join(s) for s in split]
    for i in np.unique(text).tolist():
        keep = ~gone[starts[i] : starts[i] + sizes[i]]
        collapsed[i] = " ".join([w for w, k in zip(split[i], keep.tolist(), strict=True) if k])
    edges = np.zeros(len(split) + 1, dtype=np.int32)
    np.cumsum(np.bincount(text, minlength=len(split)), out=edges[1:])
    columns = [table[:, 0] - starts[text] if len(table) else table[:, 0], table[:, 2], table[:, 1]]
    entries = pa.StructArray.from_arrays(
        [pa.array(c, pa.int64()) for c in columns], names=["start", "length", "period"]
    )
    return pa.ListArray.from_arrays(pa.array(edges), entries), collapsed


def strongest(runs: Column) -> Column:
    """The run with the greatest length per period, compared exactly; of equal ones the first."""
    kind = "struct<start: bigint, length: bigint, period: bigint>"
    return F.aggregate(
        runs,
        F.lit(None).cast(kind),
        lambda best, r: F.when(
            best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r
        ).otherwise(best),
    )


def repeated_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text, where every tenth text (by the checksum of its id) repeats a stretch of its
    words up to its end. Texts of null ids stay as they are."""
    checksum = F.crc32(F.col(id_col).cast("string").cast("binary"))
    chosen = docs.select(
        F.col(id_col),
        F.col(text_col),
        F.floor(checksum / 10).cast("long").alias("g"),
        F.when(checksum % 10 == 0, words(F.col(text_col))).alias("w"),
    )
    n = F.size("w").cast("long")
    first = chosen.withColumn("a", F.when(n > 0, F.col("g") % n))
    sized = first.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    a, p = F.col("a"), F.col("p")
    taken = F.transform(
        F.sequence(F.lit(0).cast("long"), n - 1),
        lambda i: F.element_at("w", (F.when(i >= a, a + (i - a) % p).otherwise(i) + 1).cast("int")),
    )
    text = F.when(a.isNotNull(), F.array_join(taken, " ")).otherwise(F.col(text_col))
    return sized.select(F.col(id_col), text.alias(text_col))
