"""Sharding by a uniform shuffle with exact shard sizes.

How many rows of each input block go to each shard is drawn first, from the distribution that
a uniformly random permutation of all rows would give: a matrix of hypergeometric counts whose
rows sum to the blocks and whose columns sum to the shards. Then each block is permuted on its
own and cut by its counts, rows are exchanged, and each shard is permuted again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import freeze, spare

SHARDS = 24
SEED = 20_240_817
SLOT_ROWS = 100_000  # rows of a shard that one task puts in order, about
_TRIES = 256
# Constants of the ratio-of-uniforms rejection sampler.
_D1, _D2 = 1.7155277699214135, 0.8989161620588988


def _bind(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _uniform(*key: Column) -> Column:
    """A number in (0, 1) that depends on `key` alone."""
    bits = F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double")
    return (bits + 0.5) * F.lit(2.0**-53)


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 9, brought back with the product of the steps."""
    n = n.cast("double")

    def series(z: Column) -> Column:
        square = z * z
        tail = (F.lit(1 / 12) - (F.lit(1 / 360) - F.lit(1 / 1260) / square) / square) / z
        return (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + tail

    steps = n + 1.0
    for k in range(2, 9):
        steps = steps * (n + float(k))
    return series(n + 9.0) - F.log(steps)


def _hypergeometric(good: Column, bad: Column, drawn: Column, *key: Column) -> Column:
    """How many of `drawn` rows, taken without return, are among the `good` ones."""

    def urn(x: Column) -> Column:
        """One row at a time; for few rows."""
        start = F.struct(x["g"].alias("g"), F.lit(0).cast("long").alias("hit"))

        def take(acc: Column, k: Column) -> Column:
            rest = x["g"] + x["b"] - k + 1
            hit = _uniform(F.lit("urn"), k, *key) * rest < acc["g"]
            one = F.when(hit, F.lit(1)).otherwise(F.lit(0)).cast("long")
            return F.struct((acc["g"] - one).alias("g"), (acc["hit"] + one).alias("hit"))

        turns = F.sequence(F.lit(1).cast("long"), x["m"])
        return F.when(x["m"] < 1, F.lit(0).cast("long")).otherwise(
            F.aggregate(turns, start, take, lambda acc: acc["hit"])
        )

    def rejection(x: Column) -> Column:
        """Ratio of uniforms; the first accepted of the tries."""
        total = (x["g"] + x["b"]).cast("double")
        less = F.least(x["g"], x["b"]).cast("double")
        share = less / total
        middle = x["m"] * share + 0.5
        spread = F.sqrt((total - x["m"]) * x["n"] * share * (1.0 - share) / (total - 1) + 0.5)
        mode = F.floor((x["m"] + 1) * (less + 1) / (total + 2))
        setup = F.struct(
            x["m"].alias("m"),
            less.cast("long").alias("less"),
            F.greatest(x["g"], x["b"]).alias("more"),
            middle.alias("middle"),
            (_D1 * spread + _D2).alias("width"),
            F.least(F.least(x["m"], less) + 1, F.floor(middle + 16 * spread)).alias("end"),
            mode.alias("mode"),
        )

        def weight(s: Column, z: Column) -> Column:
            return (
                _log_factorial(z)
                + _log_factorial(s["less"] - z)
                + _log_factorial(s["m"] - z)
                + _log_factorial(s["more"] - s["m"] + z)
            )

        def search(s: Column) -> Column:
            def turn(acc: Column, k: Column) -> Column:
                u = _uniform(F.lit("u"), k, *key)
                w = s["middle"] + s["width"] * (_uniform(F.lit("v"), k, *key) - 0.5) / u
                inside = (w >= 0) & (w < s["end"])
                z = F.floor(w)
                ok = F.when(inside, 2 * F.log(u) <= weight(s, s["mode"]) - weight(s, z))
                return F.when(acc >= 0, acc).otherwise(F.when(ok, z).otherwise(acc))

            none = F.lit(-1).cast("long")
            tries = F.sequence(F.lit(1), F.lit(_TRIES))
            return F.aggregate(
                tries, none, turn, lambda z: F.when(z < 0, s["mode"]).otherwise(z)
            )

        return _bind(
            _bind(setup, search),
            lambda z: F.when(x["g"] > x["b"], x["m"] - z).otherwise(z),
        )

    def draw(x: Column) -> Column:
        few = F.when(x["m"] < 10, urn(x)).otherwise(rejection(x))
        return _bind(few, lambda z: F.when(x["m"] < x["n"], x["g"] - z).otherwise(z))

    # Drawing m of the rows or leaving m of them is the same; the fewer are drawn.
    rest = good + bad - drawn
    case = F.struct(
        good.alias("g"), bad.alias("b"), drawn.alias("n"), F.least(drawn, rest).alias("m")
    )
    simple = F.when((drawn <= 0) | (good <= 0), F.lit(0).cast("long")).when(
        bad <= 0, drawn.cast("long")
    )
    return simple.otherwise(_bind(case, draw))


def _split(columns: Column, size: Column, *key: Column) -> Column:
    """How `size` rows spread over shards with `columns` free places, a multivariate draw."""
    start = F.struct(
        F.aggregate(columns, F.lit(0).cast("long"), lambda a, c: a + c).alias("places"),
        size.cast("long").alias("left"),
        F.array().cast("array<bigint>").alias("out"),
    )

    def one(acc: Column, x: Column) -> Column:
        hit = _hypergeometric(x["c"], acc["places"] - x["c"], acc["left"], x["i"], *key)
        return _bind(
            hit,
            lambda h: F.struct(
                (acc["places"] - x["c"]).alias("places"),
                (acc["left"] - h).alias("left"),
                F.concat(acc["out"], F.array(h)).alias("out"),
            ),
        )

    numbered = F.transform(columns, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.aggregate(numbered, start, one, lambda acc: acc["out"])


def _rows_of_matrix(blocks: Column, columns: Column, label: str, seed: int) -> Column:
    """Counts per shard for each of `blocks` (structs block, size), whose sizes sum to the
    sum of `columns`; each block draws from the places that the ones before it left."""
    start = F.struct(
        columns.alias("free"),
        F.array().cast("array<struct<block:bigint,counts:array<bigint>>>").alias("out"),
    )

    def one(acc: Column, b: Column) -> Column:
        return _bind(
            _split(acc["free"], b["size"], b["block"], F.lit(label), F.lit(seed)),
            lambda counts: F.struct(
                F.zip_with(acc["free"], counts, lambda f, c: f - c).alias("free"),
                F.concat(
                    acc["out"],
                    F.array(F.struct(b["block"].alias("block"), counts.alias("counts"))),
                ).alias("out"),
            ),
        )

    return F.aggregate(blocks, start, one, lambda acc: acc["out"])


def communication_matrix(sizes: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(block, counts): for `sizes` (block, size), rows of each block for each shard.

    Shards get the total divided evenly, the first ones one more. Blocks are drawn in two
    steps, groups of about the square root of their number first, then the blocks of every
    group on their own; the joint distribution is the same as in one step.
    """
    n_blocks, total = sizes.agg(F.count("*"), F.sum("size")).first()
    total = int(total or 0)
    per_group = max(1, math.isqrt(max(n_blocks, 1)))
    grouped = sizes.select(
        F.floor(F.col("block") / per_group).alias("grp"), F.struct("block", "size").alias("b")
    )
    groups = grouped.groupBy("grp").agg(
        F.sum("b.size").alias("size"), F.sort_array(F.collect_list("b")).alias("blocks")
    )
    even = [total // shards + (i < total % shards) for i in range(shards)]
    whole = F.array(*[F.lit(c).cast("long") for c in even])
    top = groups.agg(
        F.sort_array(F.collect_list(F.struct(F.col("grp").alias("block"), "size"))).alias("b")
    ).select(F.explode(_rows_of_matrix(F.col("b"), whole, "groups", seed)).alias("x"))
    top = freeze(top.select(F.col("x.block").alias("grp"), "x.counts"), "matrix-groups")
    each = groups.join(top, "grp").select(
        F.explode(_rows_of_matrix(F.col("blocks"), F.col("counts"), "blocks", seed)).alias("x")
    )
    return freeze(each.select("x.block", "x.counts"), "matrix")


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """`docs` with shard (INT from 0) and slot (LONG, from 0 without gaps in each shard).

    Row counts of shards differ by one at most, and every order of the rows is equally likely,
    up to the hash that stands for chance. Nulls, repeated rows and extra columns do not
    matter; every row, also an equal one, is placed on its own. An empty table gives an empty
    one. Input columns named shard or slot give way to the new ones.
    """
    docs = docs.select(*[F.col(c) for c in docs.columns if c.lower() not in ("shard", "slot")])
    block, at, place, order, piece, first, counts, shard_ = spare(
        docs, "block", "at", "place", "order", "piece", "first_slot", "counts", "shard_no"
    )
    rows = freeze(
        docs.withColumns(
            {
                block: F.spark_partition_id().cast("long"),
                at: F.monotonically_increasing_id(),
            }
        ),
        "blocks",
    )
    sizes = rows.groupBy(block).agg(F.count("*").alias("size")).withColumnRenamed(block, "block")
    matrix = communication_matrix(sizes, shards, seed)
    # Permute each block and cut it by its counts.
    mixed = Window.partitionBy(block).orderBy(F.xxhash64(F.lit(seed), F.lit("first"), at), at)
    ends = F.aggregate(
        F.col(counts),
        F.array().cast("array<bigint>"),
        lambda acc, c: F.concat(
            acc, F.array(c + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("long")))
        ),
    )
    cuts = (
        matrix.withColumnRenamed("counts", counts)
        .withColumn(counts, ends)
        .withColumnRenamed("block", block)
    )
    placed = (
        rows.withColumn(place, F.row_number().over(mixed))
        .join(cuts, block)
        .withColumn(
            shard_, F.size(F.filter(F.col(counts), lambda e: e < F.col(place))).cast("int")
        )
        .withColumn(order, F.xxhash64(F.lit(seed), F.lit("second"), block, place))
    )
    # Exchange, and permute each shard: ranges of the random order are numbered on their own.
    pieces = max(1, math.ceil(rows.count() / shards / SLOT_ROWS))
    ranged = placed.withColumn(
        piece, F.floor((F.col(order).cast("double") / 2.0**64 + 0.5) * pieces)
    ).drop(counts)
    before = Window.partitionBy(shard_).orderBy(piece).rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = ranged.groupBy(shard_, piece).count().select(
        shard_, piece, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(first)
    )
    inside = Window.partitionBy(shard_, piece).orderBy(order, block, place)
    return (
        ranged.withColumn(place, F.row_number().over(inside) - 1)
        .join(starts, [shard_, piece])
        .select(
            *docs.columns,
            F.col(shard_).alias("shard"),
            (F.col(first) + F.col(place)).cast("long").alias("slot"),
        )
    )
