"""Exact dedup with Patricia tries as owners of texts.

Every partition first folds its own texts into a trie, so a text with many copies leaves it
once. Those are dealt by length and content hash; each partition inserts the full byte strings
into a compressed radix trie whose terminal nodes hold the smallest identifier and the number
of rows. A trie that outgrows its memory spills its largest subtree to a file, and later texts
under that subtree follow it; spilled subtrees are read back one by one.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freeze

TRIE_BYTES = 96 << 20  # of one trie before it spills
_NODE = 220  # bytes of a node besides its label, about

# Runs of white space that are not a single space already.
_UNEVEN = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; a null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _UNEVEN, " ")


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class _Node:
    __slots__ = ("children", "label", "spilled", "value")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, _Node] = {}
        self.value = None  # (key, smallest id, rows) at the end of a text
        self.spilled = None  # file of the texts below


def _merged(a, b):
    return b if a is None else (a[0], _least(a[1], b[1]), a[2] + b[2])


def _least(a, b):
    """The smaller identifier; a missing one is larger than any."""
    return b if a is None else a if b is None else min(a, b)


class Trie:
    """Byte strings with a value each; `items` ends its use."""

    def __init__(self, most: int = TRIE_BYTES):
        self.most = most
        self.root = _Node(b"")
        self.held = 0

    def add(self, text: bytes, value: tuple) -> None:
        node, at = self.root, 0
        while True:
            if node.spilled is not None:
                pickle.dump((text[at:], value), node.spilled)
                return
            if at == len(text):
                node.value = _merged(node.value, value)
                return
            child = node.children.get(text[at])
            if child is None:
                leaf = _Node(text[at:])
                leaf.value = value
                node.children[text[at]] = leaf
                self.held += len(leaf.label) + _NODE
                break
            if text.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            same = _common(child.label, text[at : at + len(child.label)])
            middle = _Node(child.label[:same])
            child.label = child.label[same:]
            middle.children[child.label[0]] = child
            node.children[text[at]] = middle
            self.held += _NODE
            node, at = middle, at + same
        if self.held > self.most:
            self._spill()

    def _weight(self, top: _Node) -> int:
        total, stack = 0, [top]
        while stack:
            node = stack.pop()
            total += len(node.label) + _NODE
            stack.extend(node.children.values())
        return total

    def _spill(self) -> None:
        """Move the largest subtree below the first branching to a file."""
        node = self.root
        while len(node.children) == 1 and node.spilled is None:
            node = next(iter(node.children.values()))
        live = [c for c in node.children.values() if c.spilled is None]
        if len(node.children) < 2 or not live:
            return  # a single path of text can't be divided
        top = max(live, key=self._weight)
        self.held -= self._weight(top) - len(top.label) - _NODE
        out = tempfile.TemporaryFile()
        for rest, found in _walk(top, b""):
            if isinstance(found, tuple):
                pickle.dump((rest, found), out)
            else:
                for below, value in _read(found):
                    pickle.dump((rest + below, value), out)
                found.close()
        top.children, top.value, top.spilled = {}, None, out

    def items(self) -> Iterator[tuple]:
        """The value of every text."""
        files = []
        for _, found in _walk(self.root, b""):
            if isinstance(found, tuple):
                yield found
            else:
                files.append(found)
        self.root = _Node(b"")
        for file in files:
            part = Trie(self.most)
            for text, value in _read(file):
                part.add(text, value)
            file.close()
            yield from part.items()


def _walk(top: _Node, path: bytes) -> Iterator[tuple]:
    """Values and spill files below `top`, with what their texts hold after its label."""
    stack = [(top, path)]
    while stack:
        node, path = stack.pop()
        if node.value is not None:
            yield path, node.value
        if node.spilled is not None:
            yield path, node.spilled
        stack.extend((c, path + c.label) for c in node.children.values())


def _read(file) -> Iterator[tuple]:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _folded(most: int, final: bool):
    """Fold texts of a partition; `final` leaves the texts out. Before that a full trie is
    passed on and begun anew, as its texts meet again later."""

    def out(values, texts):
        sha, ids, n = zip(*values, strict=True)
        cols = [pa.array(sha, pa.string()), pa.array(ids, pa.int64()), pa.array(n, pa.int64())]
        names = ["sha", "first_id", "n"]
        if not final:
            cols.append(pa.array(texts, pa.binary()))
            names.append("body")
        return pa.RecordBatch.from_arrays(cols, names=names)

    def owners(batches):
        trie = Trie(most)
        for b in batches:
            rows = zip(*[b.column(c).to_pylist() for c in ("body", "sha", "first_id", "n")], strict=True)
            for body, sha, first, n in rows:
                trie.add(body, (sha, first, n))
        values = []
        for value in trie.items():
            values.append(value)
            if len(values) == 10_000:
                yield out(values, None)
                values = []
        if values:
            yield out(values, None)

    def flush(trie):
        values, texts, held = [], [], 0
        for path, value in _walk(trie.root, b""):
            values.append(value)
            texts.append(path)
            held += len(path)
            if held > 8 << 20:
                yield out(values, texts)
                values, texts, held = [], [], 0
        if values:
            yield out(values, texts)

    def combine(batches):
        trie = Trie(1 << 62)
        for b in batches:
            rows = zip(*[b.column(c).to_pylist() for c in ("body", "sha", "first_id", "n")], strict=True)
            for body, sha, first, n in rows:
                trie.add(body, (sha, first, n))
                if trie.held > most:
                    yield from flush(trie)
                    trie = Trie(1 << 62)
        yield from flush(trie)

    return owners if final else combine


def owners(docs: DataFrame, id_col: str, text_col: str, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per different text: sha, keep_id (smallest id; null only if all are) and n."""
    body = normalised(F.col(text_col))
    rows = docs.select(
        F.col(id_col).cast("long").alias("first_id"), F.lit(1).cast("long").alias("n"),
        body.alias("body"),
    ).withColumn("sha", F.sha2(F.col("body"), 256)).withColumn("body", F.col("body").cast("binary"))
    folded = rows.mapInArrow(
        _folded(trie_bytes, False), "sha string, first_id long, n long, body binary"
    )
    dealt = folded.repartition(F.octet_length("body"), F.xxhash64("body"))
    out = dealt.mapInArrow(_folded(trie_bytes, True), "sha string, first_id long, n long")
    return out.withColumnRenamed("first_id", "keep_id")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    trie_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """One row per row of `docs`: its id, text_sha256 (of the normalised text), keep_id,
    group_size and kept.

    Null texts are empty, and empty texts are equal to each other. The smallest id of a group
    stays, null ids last; of rows that share that id one stays. Texts are compared byte by
    byte, whole. An empty table gives an empty one; other columns of `docs` are not read.
    """
    rows = freeze(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"),
            F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"),
        ),
        "text-hashes",
    )
    owned = owners(docs, id_col, text_col, trie_bytes)
    again = (
        rows.groupBy("text_sha256", "id")
        .agg(F.min("row").alias("row"), F.count("*").alias("times"))
        .filter("times > 1")
        .select("text_sha256", F.col("id").alias("id_"), F.col("row").alias("first_row"))
    )
    repeat = (F.col("r.text_sha256") == F.col("a.text_sha256")) & F.col("id").eqNullSafe(F.col("id_"))
    return (
        rows.alias("r")
        .join(owned, F.col("r.text_sha256") == F.col("sha"))
        .join(again.alias("a"), repeat, "left")
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            F.col("n").alias("group_size"),
            (
                F.col("id").eqNullSafe(F.col("keep_id"))
                & (F.col("first_row").isNull() | (F.col("first_row") == F.col("row")))
            ).alias("kept"),
            F.col("r.text_sha256").alias("text_sha256"),
        )
    )
