"""Texts in blocks against plain strings."""

from __future__ import annotations

import random
import time

import pytest

from inkspark.operators.pieces import Pieces


def plain(text: str, ops: list[dict]) -> str:
    pos = 0
    for op in ops:
        count = op.get("count") or 0
        if op.get("kind") == "retain":
            pos += count
        elif op.get("kind") == "insert":
            new = op.get("text") or ""
            text = text[:pos] + new + text[pos:]
            pos += len(new)
        elif op.get("kind") == "delete" and count > 0:
            text = text[:pos] + text[pos + count :]
    return text


def some_ops(rng: random.Random, size: int) -> list[dict]:
    ops = [{"kind": "retain", "count": rng.randint(0, size + 4)}]
    for _ in range(rng.randint(1, 3)):
        ops.append(rng.choice([
            {"kind": "insert", "text": rng.choice(["", "x", "é😀", "more than a block of text"])},
            {"kind": "delete", "count": rng.choice([-3, 0, 1, 5, 40, 10_000])},
            {"kind": "retain", "count": rng.randint(-0, 9)},
            {"kind": "bogus", "count": 3}, {"kind": "insert", "text": None}, {"kind": "delete"},
        ]))
    return ops


@pytest.mark.parametrize("block", [1, 4, 64])
def test_edits_match_a_plain_string(block):
    rng = random.Random(block)
    for _ in range(60):
        text = "".join(rng.choices("abcdef", k=rng.randint(0, 50)))
        pieces = Pieces(text, block=block)
        for _ in range(25):
            ops = some_ops(rng, len(text))
            text = plain(text, ops)
            pieces.apply(ops)
            assert pieces.text() == text and pieces.length == len(text)
        assert [n for _, n in pieces.layout()] == pieces.sizes and all(pieces.sizes)


def test_only_changed_blocks_are_stored_again():
    rng, store, text = random.Random(2), {}, ""
    layout, next_id, loaded = [], 0, []
    for _ in range(200):
        pieces = Pieces(layout=layout, load=lambda i: loaded.append(i) or store[i], block=16)
        pieces.next_id = next_id
        ops = some_ops(rng, len(text))
        text = plain(text, ops)
        pieces.apply(ops)
        for i, name in enumerate(pieces.ids):
            if name in pieces.changed:
                store[name] = pieces.texts[i]
        for name in pieces.dropped:
            store.pop(name, None)
        layout, next_id = pieces.layout(), pieces.next_id
        assert sorted(store) == sorted(i for i, _ in layout)
    assert "".join(store[i] for i, _ in layout) == text
    assert len(set(loaded)) < len(loaded) or loaded


def test_an_edit_costs_the_same_in_a_long_text():
    """A text of 8 MB takes edits about as fast as one of 100 kB."""

    def spent(size: int) -> float:
        pieces, rng = Pieces("x" * size), random.Random(1)
        begin = time.process_time()
        for _ in range(3000):
            pieces.apply([{"kind": "retain", "count": rng.randrange(size)}, {"kind": "insert", "text": "new"}])
        return time.process_time() - begin

    small = min(spent(100_000) for _ in range(3))
    large = min(spent(8_000_000) for _ in range(3))
    assert large < 6 * small + 0.05
