"""Mixing sources to target weights by entropy balancing.

Every document has a rate, the expected number of times it is taken. Of all rates that give
each source its target of tokens, those closest to one each (in relative entropy, at most
`max_copies`) are exponentially tilted by the document's size: exp(l * size), one l per source.
The l solve the convex dual; Newton's method finds them, with gradient and curvature summed by
Spark over (source, size) cells in each step. Rates are then rounded to copies, largest
documents first, carrying the error on.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dense_ranks, freeze, spare

WEIGHTS = (5.0, 2.0, 1.0)  # of the sources in code-point order, null last, repeating
SHARE = 1.5  # of all tokens
MAX_COPIES = 2
TOLERANCE = 1e-6  # relative gap between tokens and target
MAX_STEPS = 80
BLOCK_DOCS = 20_000  # documents rounded together


def source_targets(
    sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES
) -> DataFrame:
    """Per source of `sizes` (source, size): n, source_size, weight and target.

    Targets share `share` of all tokens by weight, and stop at `max_copies` times the source;
    what is over goes to the others by weight until none is above.
    """
    totals = sizes.groupBy("source").agg(
        F.count("*").alias("n"), F.sum("size").cast("long").alias("source_size")
    )
    keyed = totals.withColumn("no_source", F.col("source").isNull())
    ranks = dense_ranks(keyed, ["no_source", "source"], "place").select(
        F.col("source").alias("ranked"), "place"
    )
    pick = F.array(*[F.lit(float(w)) for w in weights])
    sources = freeze(
        totals.join(ranks, F.col("source").eqNullSafe(F.col("ranked")))
        .withColumn("weight", F.get(pick, (F.col("place") % len(weights)).cast("int")))
        .select("source", "n", "source_size", "weight"),
        "sources",
    )
    cap = F.col("source_size") * float(max_copies)
    goal = share * float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:  # the capped set only grows, so this ends
        full = cap <= F.col("weight") * level
        taken, rest, count = sources.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)),
            F.sum(F.when(~full, F.col("weight"))),
            F.count(F.when(full, 1)),
        ).first()
        if count == capped or not rest:
            break
        level, capped = (goal - taken) / rest, count
    return sources.withColumn("target", F.least(cap, F.col("weight") * level))


def balance(
    sizes: DataFrame,
    targets: DataFrame,
    max_copies: int = MAX_COPIES,
    tolerance: float = TOLERANCE,
    max_steps: int = MAX_STEPS,
) -> DataFrame:
    """`targets` with `tilt`: rates are least(max_copies, exp(tilt * size / mean size)).

    The dual of a source is sum(psi(tilt * x)) - tilt * target / mean, psi' being the rate.
    Newton steps that leave the bracket known so far are replaced by halving or doubling.
    Sources at the cap get an infinite tilt, sources without tokens a tilt of 0.
    """
    keyed = targets.withColumn("mean", F.col("source_size") / F.col("n"))
    at_cap = F.col("target") >= F.col("source_size") * float(max_copies) * (1 - 1e-12)
    infinite = F.lit(float("inf"))
    state = freeze(
        keyed.withColumns(
            {
                "tilt": F.when(F.col("source_size") <= 0, 0.0).when(at_cap, infinite).otherwise(0.0),
                "low": -infinite,
                "high": infinite,
                "done": (F.col("source_size") <= 0) | at_cap,
            }
        ),
        "balance",
    )
    cells = freeze(
        sizes.filter("size > 0")
        .groupBy("source", "size")
        .count()
        .withColumnsRenamed({"source": "of", "count": "docs"}),
        "cells",
    )
    same = F.col("of").eqNullSafe(F.col("source"))
    for _ in range(max_steps):
        if state.filter("not done").isEmpty():
            break
        x = F.col("size") / F.col("mean")
        plain = F.exp(F.least(F.col("tilt") * x, F.lit(700.0)))
        mass = F.col("docs") * F.col("size")
        sums = (
            cells.join(state.filter("not done").select("source", "mean", "tilt"), same)
            .groupBy("source")
            .agg(
                F.sum(mass * F.least(plain, F.lit(float(max_copies)))).alias("tokens"),
                F.sum(F.when(plain < max_copies, mass * x * plain)).alias("slope"),
            )
            .withColumnRenamed("source", "of")
        )
        gap = F.col("tokens") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - gap / F.col("slope")
        inside = step.isNotNull() & (step > F.col("low_")) & (step < F.col("high_"))
        other = (
            F.when(F.col("high_") == infinite, 2 * F.col("tilt") + 1)
            .when(F.col("low_") == -infinite, 2 * F.col("tilt") - 1)
            .otherwise((F.col("low_") + F.col("high_")) / 2)
        )
        near = F.abs(gap) <= tolerance * F.col("target")
        state = freeze(
            state.join(sums, same, "left")
            .withColumns({"low_": low, "high_": high, "near": F.col("done") | near})
            .select(
                *[c for c in state.columns if c not in ("tilt", "low", "high", "done")],
                F.when(F.col("near"), F.col("tilt"))
                .when(inside, step)
                .otherwise(other)
                .alias("tilt"),
                F.when(F.col("done"), F.col("low")).otherwise(F.col("low_")).alias("low"),
                F.when(F.col("done"), F.col("high")).otherwise(F.col("high_")).alias("high"),
                F.col("near").alias("done"),
            ),
            "balance",
        )
    return state.drop("low", "high", "done")


def _round(rows: pd.DataFrame, max_copies: int) -> pd.DataFrame:
    """Copies of the documents of a block: each rate's floor or ceiling, whichever keeps the
    tokens taken so far nearer to the tokens wanted."""
    rows = rows.sort_values(["size", "doc", "tie", "row"], ascending=[False, True, True, True])
    error, copies = 0.0, []
    for size, rate in zip(rows["size"].tolist(), rows["rate"].tolist(), strict=True):
        c = int(rate)
        if c < max_copies and size and error + (rate - c) * size > size / 2:
            c += 1
        elif not size:
            c = 1
        error += (rate - c) * size
        copies.append(c)
    return pd.DataFrame({"row": rows["row"].to_numpy(), "copies": copies})


def mix(
    docs: DataFrame,
    size_col: str = "size",
    id_col: str = "doc_id",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    max_copies: int = MAX_COPIES,
) -> DataFrame:
    """`docs` with source_size, target, rate and copies (INT, 0 to `max_copies`).

    A null source is a source of its own. Rows without tokens (size 0 or null) are taken once,
    whatever the rate. The result depends on the rows alone, not on their partitions; repeated
    rows are rounded one by one. Input columns with the new names give way. An empty table
    gives an empty one. Blocks of a source are rounded side by side, so a large source needs no
    task of its own.
    """
    new = {"source_size", "target", "rate", "copies"}
    docs = docs.select(*[F.col(c) for c in docs.columns if c.lower() not in new])
    (row,) = spare(docs, "mix_row")
    held = freeze(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    narrow = held.select(
        F.col(row).alias("row"),
        F.col(id_col).cast("string").alias("doc"),
        F.col(source_col).alias("source"),
        F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(*[F.col(c) for c in docs.columns]).alias("tie"),
    )
    tilted = balance(
        narrow.select("source", "size"),
        source_targets(narrow.select("source", "size"), weights, share, max_copies),
        max_copies,
    )
    about = tilted.select(
        F.col("source").alias("of"), "n", "mean", "tilt", "source_size", "target"
    )
    flat = F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(700.0)))
    rate = F.when(F.col("size") <= 0, 1.0).otherwise(F.least(flat, F.lit(float(max_copies))))
    rated = narrow.join(about, F.col("source").eqNullSafe(F.col("of"))).withColumns(
        {
            "rate": rate,
            "block": F.pmod("tie", F.ceil(F.col("n") / BLOCK_DOCS).cast("long")),
        }
    )
    rounded = (
        rated.select("source", "block", "row", "doc", "size", "tie", "rate")
        .groupBy("source", "block")
        .applyInPandas(lambda pdf: _round(pdf, max_copies), "row long, copies int")
    )
    out = rated.select("row", "source_size", "target", "rate").join(rounded, "row")
    return held.join(out.withColumnRenamed("row", row), row).drop(row)
