"""A text in blocks that can be edited anywhere without copying the whole of it.

Blocks hold about `BLOCK` characters; a binary indexed tree over their sizes finds the block of
a position. An edit costs a block's length and the logarithm of their number, however long the
text is. Blocks have ids and may be loaded on first use, so a state store can keep them one by
one and write back only those that changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

BLOCK = 2048


class Pieces:
    def __init__(
        self,
        text: str = "",
        layout: Iterable[tuple[int, int]] | None = None,
        load: Callable[[int], str] | None = None,
        block: int = BLOCK,
    ):
        """The text itself, or the (id, length) of its blocks in order and what gives their text."""
        self.block = block
        self.load = load
        self.changed: set[int] = set()
        self.dropped: set[int] = set()
        if layout is None:
            parts = [text[i : i + block] for i in range(0, len(text), block)]
            self.ids = list(range(len(parts)))
            self.texts: list[str | None] = list(parts)
            self.sizes = [len(p) for p in parts]
            self.changed.update(self.ids)
        else:
            layout = list(layout)
            self.ids = [i for i, _ in layout]
            self.sizes = [n for _, n in layout]
            self.texts = [None] * len(layout)
        self.next_id = max(self.ids, default=-1) + 1
        self.length = sum(self.sizes)
        self._index()

    def _index(self) -> None:
        """The tree over the sizes, anew; only when blocks come or go."""
        tree = [0, *self.sizes]
        for i in range(1, len(tree)):
            up = i + (i & -i)
            if up < len(tree):
                tree[up] += tree[i]
        self.tree = tree
        self.top = 1 << max(0, len(self.sizes).bit_length() - 1)

    def _find(self, at: int) -> tuple[int, int]:
        """Block that holds position `at` (below the length), and the place in it."""
        i, step = 0, self.top
        while step:
            if i + step < len(self.tree) and self.tree[i + step] <= at:
                i += step
                at -= self.tree[i]
            step >>= 1
        return i, at

    def _put(self, i: int, text: str) -> None:
        more = len(text) - self.sizes[i]
        self.texts[i] = text
        self.sizes[i] += more
        self.changed.add(self.ids[i])
        self.length += more
        i += 1
        while i < len(self.tree):
            self.tree[i] += more
            i += i & -i

    def _text(self, i: int) -> str:
        if self.texts[i] is None:
            self.texts[i] = self.load(self.ids[i])
        return self.texts[i]

    def _replace(self, i: int, j: int, parts: list[str]) -> None:
        """Put new blocks in the place of blocks `i` to `j`."""
        gone = self.ids[i:j]
        self.changed.difference_update(gone)
        self.dropped.update(gone)
        ids = list(range(self.next_id, self.next_id + len(parts)))
        self.next_id += len(parts)
        self.changed.update(ids)
        self.length += sum(map(len, parts)) - sum(self.sizes[i:j])
        self.ids[i:j] = ids
        self.texts[i:j] = parts
        self.sizes[i:j] = [len(p) for p in parts]
        self._index()

    def insert(self, at: int, new: str) -> None:
        """Put `new` before position `at`; beyond the end it is added there."""
        if not new:
            return
        if not self.ids:
            self._replace(0, 0, self._cut(new))
            return
        at = min(at, self.length)
        i, place = self._find(at - 1) if at else (0, -1)
        text = self._text(i)
        text = text[: place + 1] + new + text[place + 1 :]
        if len(text) > 2 * self.block:
            self._replace(i, i + 1, self._cut(text))
        else:
            self._put(i, text)

    def _cut(self, text: str) -> list[str]:
        return [text[i : i + self.block] for i in range(0, len(text), self.block)]

    def delete(self, at: int, count: int) -> None:
        """Take out what there is of `count` characters from position `at` on."""
        count = min(count, self.length - at)
        if count <= 0:
            return
        i, place = self._find(at)
        if place + count < self.sizes[i]:
            text = self._text(i)
            self._put(i, text[:place] + text[place + count :])
            return
        j, last = self._find(at + count - 1)
        rest = self._text(i)[:place] + self._text(j)[last + 1 :]
        # A neighbour takes what is left if that is little.
        if len(rest) < self.block // 2 and i:
            i -= 1
            rest = self._text(i) + rest
        self._replace(i, j + 1, [rest] if rest else [])

    def apply(self, ops: Iterable) -> None:
        """Apply a delta; its positions never fall below 0 (see `ops_valid`)."""
        pos = 0
        for op in ops:
            kind = op["kind"] if "kind" in op else None
            count = (op["count"] if "count" in op else 0) or 0
            if kind == "retain":
                pos += count
            elif kind == "insert":
                new = (op["text"] if "text" in op else "") or ""
                self.insert(pos, new)
                pos += len(new)
            elif kind == "delete":
                self.delete(pos, count)

    def layout(self) -> list[tuple[int, int]]:
        return list(zip(self.ids, self.sizes))

    def text(self) -> str:
        return "".join(self._text(i) for i in range(len(self.ids)))
