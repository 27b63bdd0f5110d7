"""Small tables with every odd case, and brute-force helpers."""

from __future__ import annotations

import random
import re

from conftest import DATA

SF = f"{DATA}/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
GAP = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Names that the operators use inside; an input may have them too.
CLASHES = "row kept size n block place shard slot length rate sequence_id value tie words_ of c"
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(
    f"`{c}` string" for c in CLASHES.split()
)


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 5))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, empty and blank texts, ties, equal rows, a long text, copies and near copies."""
    rng = random.Random(7)
    base = "\n".join(prose(rng, 12) for _ in range(6))
    near = base.replace(base.split(" ")[3], "changed", 1)
    passage = "\n".join(prose(rng, 15) for _ in range(4))
    texts = [
        (1, base), (2, base), (3, base.replace(" ", "\t ", 5)), (4, near), (5, None), (6, ""),
        (7, " \n\t "), (None, None), (None, base), (8, "one two"), (8, "one two"), (8, "ONE two"),
        (9, prose(rng, 30_000)), (10, passage + "\n" + prose(rng, 40)),
        (11, prose(rng, 30) + "\n" + passage), (12, prose(rng, 25) + "\n\n" + passage + "\nend"),
        (13, "x" * 5000), (14, "## | ## | ## $$ %% && ** " * 30), (15, "Ünï çödé   word s"),
        (16, "<|endoftext|> is text"),
    ]
    sources = ["b", "a", None, "é", "b"]
    return [
        (d, t, sources[i % 5], None if i % 4 == 0 else "en", None if t is None else len(t),
         *["x"] * len(CLASHES.split()))
        for i, (d, t) in enumerate(texts)
    ]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingle_set(text: str | None, n: int) -> frozenset:
    w = words((text or "").translate(LOWER))
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
