"""Token ids of whole texts with the tokenizers library, in Arrow batches."""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa

MAX_CACHED = 600_000  # pieces in each of the two halves of a Python worker's cache
_JOINED = 512  # new pieces that the library encodes as one text
# How a byte-level tokenizer splits a text before it merges, its rule in `_rule`.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}

# array("I") is written as it lies in memory.
assert sys.byteorder == "little" and array("I").itemsize == 4


@cache
def _rule() -> tuple[re.Pattern, re.Pattern]:
    """The byte-level splitting rule, and what finds a character for which it is not told here.

    The rule asks which characters are letters and which numbers. Told are those of 16 bits that
    were the same in Unicode 3.2 and are now, so no library's tables differ on them, and of
    white space the four that every library counts as such.
    """
    kinds: dict[str, list[list[int]]] = {"L": [], "N": [], "other": []}
    for code in range(0x10000):
        c = chr(code)
        kind = unicodedata.category(c)[0]
        same = unicodedata.ucd_3_2_0.category(c)[0] == kind
        if not same or kind == "C" or c.isspace() or code == 0x180E:
            continue
        runs = kinds[kind if kind in "LN" else "other"]
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    letter, number, other = (
        "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs) for runs in kinds.values()
    )
    white = r" \n\t\r"
    rule = (
        f" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[{other}]+"
        f"|[{white}]+(?![^{white}])|[{white}]+"
    )
    return re.compile(rule), re.compile(f"[^{white}{letter}{number}{other}]")


def _byte_names() -> np.ndarray:
    """The 16-bit character that stands for each byte in a byte-level vocabulary; for byte 0,
    which no piece has, a space, as it separates them."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = np.zeros(256, dtype="<u2")
    names[shown] = shown
    hidden = np.setdiff1d(np.arange(256), shown)
    names[hidden] = 256 + np.arange(len(hidden))
    names[0] = ord(" ")
    return names


class Encoder:
    """Texts to little-endian uint32 ids.

    Byte-level BPE splits a text before it merges, and never merges over a split. So a text is
    split by the same rule and encoded piece by piece through a bounded cache; the library
    encodes the new pieces, many in one text. A text with a character that the rule is not told
    is encoded whole, also one that holds the string of a special token, which the library gives
    that token's id, and any text where the vocabulary's own rule is another one. The ids are
    the same (tests/llm compares them). When the cache is full its older half goes, but for the
    pieces that were used since.
    """

    def __init__(self, path: str, max_cached: int = MAX_CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_file(path)
        # Strings that the library takes out of a text before it splits the rest.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Only new pieces reach the library, so its own cache would never be hit.
        self.tokenizer.model._resize_cache(0)
        split = self.tokenizer.pre_tokenizer
        split = {} if split is None else json.loads(split.__getstate__())
        self.by_piece = self.tokenizer.normalizer is None and split.items() >= _BYTE_LEVEL.items()
        # The same merges on pieces that are split and named by byte already.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = Split(" ", "removed")
        vocab = self.merges.get_vocab()
        self.lengths = np.zeros(max(vocab.values(), default=0) + 1, dtype=np.int64)
        self.lengths[list(vocab.values())] = list(map(len, vocab))
        self.names = _byte_names()
        self.max_cached = max_cached
        self.known: dict[str, bytes] = {}  # piece -> ids
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def forget(self) -> None:
        """Empty the cache."""
        self.known, self.older = {}, {}

    def _merged(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces."""
        texts, ends = [], []
        for i in range(0, len(pieces), _JOINED):
            held = np.frombuffer("\0".join(pieces[i : i + _JOINED]).encode(), dtype=np.uint8)
            texts.append(self.names[held].tobytes().decode("utf-16-le"))
            cuts = np.append(np.flatnonzero(held == 0), len(held))
            ends.append(cuts - np.arange(len(cuts)))  # bytes up to a piece's end
        out: list[bytes] = []
        found = self.merges.encode_batch_fast(texts, add_special_tokens=False)
        for e, end in zip(found, ends, strict=True):
            ids = np.array(e.ids, dtype="<u4")
            reached = np.cumsum(self.lengths[ids])  # bytes up to a token's end
            at = np.searchsorted(reached, end)
            if at[-1] + 1 != len(ids) or (reached[at] != end).any():
                raise ValueError("the tokens of a piece are not its bytes")
            held, at = ids.tobytes(), ((at + 1) * 4).tolist()
            out += map(held.__getitem__, map(slice, [0, *at], at))
        return out

    def _found(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces, from the cache and into it."""
        if len(self.known) > self.max_cached:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = list(map(known.get, pieces))
        lacking = [i for i, ids in enumerate(out) if ids is None]
        new = []
        for i in lacking:
            ids = older.get(pieces[i])
            if ids is None:
                new.append(pieces[i])
            else:
                known[pieces[i]] = ids
        if new:
            known.update(zip(new, self._merged(new), strict=True))
        for i in lacking:
            out[i] = known[pieces[i]]
        return out

    def _pieced(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that the rule splits."""
        split = list(map(_rule()[0].findall, texts))
        parts = pa.array(chain.from_iterable(split), pa.large_string()).dictionary_encode()
        ids = self._found(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat, start = np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(size) - size
        # Every piece's ids in order of the texts: its first id's place in `flat`, counted on.
        at = parts.indices.to_numpy()
        n = size[at]
        end = np.cumsum(n)
        held = flat[np.repeat(start[at] - end + n, n) + np.arange(n.sum())].tobytes()
        end = np.append(0, end * 4)
        cuts = end[np.cumsum([0, *map(len, split)])].tolist()
        return list(map(held.__getitem__, map(slice, cuts, cuts[1:])))

    def batch(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        untold = _rule()[1].search
        whole = [
            not self.by_piece or untold(t) is not None or any(a in t for a in self.added)
            for t in texts
        ]
        rest = iter(self._whole([t for t, w in zip(texts, whole, strict=True) if w]))
        pieced = iter(self._pieced([t for t, w in zip(texts, whole, strict=True) if not w]))
        return [next(rest if w else pieced) for w in whole]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


@contextmanager
def encoding(path: str) -> Iterator[Encoder]:
    """The worker's encoder for one task. Workers outlive their tasks, so the cache goes with
    the task: what later stages have of the executor's memory is not held by idle workers."""
    encode = encoder(path)
    try:
        yield encode
    finally:
        encode.forget()


def in_slices(values: list, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of neighbours whose texts hold about `most` characters, as (from, to)."""
    start, held = 0, 0
    for i, v in enumerate(values):
        held += len(v or "")
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(values):
        yield start, len(values)
