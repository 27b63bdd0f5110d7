"""Near-duplicate documents by bottom-k sketches.

One hash function gives every word shingle a value; the k smallest values of a document are its
sketch. Documents that retain the same value meet in that value's inverted list. Two documents
of Jaccard similarity 0.8 share about 80% of the k smallest values of their union, so pairs are
only looked for among documents that share `min_shared` retained values or more with others,
and only in the lists of their rarest values. The union's sketch estimates the similarity and
filters pairs; the full shingle sets, as sets of 64-bit hashes, confirm the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import freeze, words
from .graph import components

SHINGLE = 5
PERCENT = 80  # smallest similarity of a link
K = 64  # retained values
MISS = 1e-7  # chance that the sketches of a pair at `PERCENT` share fewer values than asked for
CHUNK = 256  # partners of a document whose sets one task reads against its set
SMALL_LIST = 16  # members of a list, or classes with a shingle, that are compared directly
STAR_ROUNDS = 3  # rounds of links to one member of a list before the rest is compared
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bind(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """Sorted distinct 64-bit hashes of the runs of `n` words, A-Z in lower case; of all words
    together where there are fewer; none without words."""

    def runs(h: Column) -> Column:
        each = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, n)]))
        return F.when(F.size(h) >= n, F.slice(each, F.lit(1), F.size(h) - n + 1)).otherwise(
            F.slice(F.array(F.xxhash64(F.size(h), h)), F.lit(1), F.least(F.size(h), F.lit(1)))
        )

    hashed = F.transform(words(F.translate(text, _UPPER, _LOWER)), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_distinct(_bind(hashed, runs)))


def _sketched(docs: DataFrame, n: int, k: int) -> DataFrame:
    """Per row: row, id, tie (hash of the text), n_shingles, two hashes of the set, sketch."""
    return docs.select(
        "row",
        "id",
        F.xxhash64("text").alias("tie"),
        _bind(
            shingles(F.col("text"), n),
            lambda s: F.struct(
                F.size(s).cast("long").alias("n_shingles"),
                F.xxhash64(s).alias("h1"),
                F.xxhash64(F.lit("set"), s).alias("h2"),
                F.slice(s, F.lit(1), F.lit(k)).alias("sketch"),
            ),
        ).alias("x"),
    ).select("row", "id", "tie", "x.*")


def _surely_shared(k: int, percent: int) -> int:
    """The largest count that a binomial of k draws at `percent` stays below with chance
    `MISS` at most."""
    p, below, count = percent / 100, 0.0, 0
    while count < k:
        below += math.comb(k, count) * p**count * (1 - p) ** (k - count)
        if below > MISS:
            break
        count += 1
    return max(1, count)


def min_shared(n_shingles: Column, k: int, percent: int) -> Column:
    """Retained values that linked documents share. Sets of up to k values are retained whole
    and must share their part exactly; of larger ones the k smallest values of the union are a
    sample, so their number is binomial."""
    exact = F.ceil(n_shingles * percent / 100)
    sure = F.lit(_surely_shared(k, percent))
    return F.when(n_shingles <= k, F.least(exact, sure)).otherwise(sure).cast("int")


def _lists(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(value, c): classes in the inverted lists of their rarest shared values.

    If a class shares m values with others and a partner must share s of them, one of any
    m - s + 1 values is shared with that partner; the rarest are taken. Values of common
    passages are left out that way, unless they are most of a sketch.
    """
    held = classes.select("c", "n_shingles", F.explode("sketch").alias("value"))
    often = held.groupBy("value").agg(F.count("*").alias("times")).filter("times > 1")
    mine = held.join(often, "value").groupBy("c").agg(
        F.first("n_shingles").alias("n_shingles"),
        F.sort_array(F.collect_list(F.struct("times", "value"))).alias("shared"),
    )
    need = min_shared(F.col("n_shingles"), k, percent)
    few = F.slice("shared", F.lit(1), F.greatest(F.size("shared") - need + 1, F.lit(0)))
    return freeze(mine.select("c", F.explode(few).alias("x")).select("x.value", "c"), "lists")


def _estimated(pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches allow the similarity: sizes, then the union's sketch."""
    side = classes.select("c", "n_shingles", "sketch")
    left = side.toDF("a", "na", "sa")
    right = side.toDF("b", "nb", "sb")
    both = pairs.join(right, "b").join(left, "a")
    size_ok = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), F.lit(1), F.lit(k))
    shared = F.size(F.array_intersect(F.array_intersect(union, F.col("sa")), F.col("sb")))
    need = F.least(min_shared(F.col("na"), k, percent), min_shared(F.col("nb"), k, percent))
    return both.filter(size_ok & (shared >= need)).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have the similarity.

    A class with many partners is read once for every `CHUNK` of them, so no task holds all.
    """
    count = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    cut = pairs.join(count, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), "chunks").cast("int"))
    left = (
        count.join(sets, count["a"] == sets["c"])
        .select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "s")
        .withColumnRenamed("s", "sa")
    )
    right = sets.select(F.col("c").alias("b"), F.col("s").alias("sb"))
    both = cut.join(right, "b").join(left, ["a", "chunk"])
    inter = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - inter
    return both.filter(100 * inter >= percent * union).select("a", "b")


def _may_link(x: Column, y: Column, percent: int) -> Column:
    """For structs c, own (what a class holds alone) and common (the rest of its set): the
    intersection is no larger than either common part, and the union holds what both hold
    alone and the larger common part."""
    union = x["own"] + y["own"] + F.greatest(x["common"], y["common"])
    return 100 * F.least(x["common"], y["common"]) >= percent * union


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x["c"], y["c"]).alias("a"), F.greatest(x["c"], y["c"]).alias("b")]


def _rest(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that meet in a list and may still be linked.

    `members`: value, m and root of the lists that hold several components. In lists of up to
    `SMALL_LIST` members all such pairs are taken. Members of longer ones meet through a finer
    index: their shingles in order of how many of them hold each, rarest first. Linked sets share
    `percent` percent of either, so they share one of the first shingles, those that are more
    than the rest can make up for; what a class holds alone takes places there and meets nobody.
    One side of each pair lies outside the component of a list's hub.
    """
    sizes = members.groupBy("value").agg(F.count("*").alias("n"))
    sized = freeze(members.join(sizes, "value"), "open-lists")
    short = sized.filter(F.col("n") <= SMALL_LIST).select("value", "m", "root")
    other = short.select("value", F.col("m").alias("o"), F.col("root").alias("root_o"))
    differ = F.col("root") != F.col("root_o")
    pairs = short.join(other, "value").filter(
        (F.col("m.c") < F.col("o.c")) & differ & _may_link(F.col("m"), F.col("o"), percent)
    )
    pairs = pairs.select(*_ordered(F.col("m"), F.col("o")))

    long = sized.filter(F.col("n") > SMALL_LIST).select("value", F.col("m.c").alias("c"), "root")
    if long.isEmpty():
        return pairs
    of = long.select("c", "root").distinct()
    each = sets.join(of, "c").select("c", "root", F.size("s").alias("size"), F.explode("s").alias("v"))
    often = each.groupBy("v").agg(F.count("*").alias("n")).filter("n > 1")
    turn = Window.partitionBy("c").orderBy("n", "v")
    # Shingles held alone come first in the order; they are counted, not kept.
    shared = each.join(often, "v").withColumns(
        {"place": F.row_number().over(turn), "held": F.count("*").over(Window.partitionBy("c"))}
    )
    alone = F.col("size") - F.col("held")
    first = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    rare = freeze(
        shared.filter(alone + F.col("place") <= first).select(
            "v", "root",
            F.struct("c", "size", (F.col("size") - alone - F.col("place") + 1).alias("left")).alias("m"),
        ),
        "rare-shingles",
    )
    hubs = long.groupBy("value").agg(F.min_by("root", F.struct("c")).alias("hub_root"))
    apart = long.join(hubs, "value").filter("root != hub_root").select("c").distinct()
    mine = rare.join(apart, F.col("m.c") == F.col("c"), "left_semi")
    other = rare.select("v", F.col("m").alias("o"), F.col("root").alias("root_o"))
    # The first shingle that two sets share has all that they share behind it, on both sides.
    alike = (100 + percent) * F.least("m.left", "o.left") >= percent * (
        F.col("m.size") + F.col("o.size")
    )
    met = mine.join(other, "v").filter(differ & alike)
    return pairs.unionByName(met.select(*_ordered(F.col("m"), F.col("o"))))


def linked_classes(
    classes: DataFrame, docs: DataFrame, n: int, k: int, percent: int
) -> DataFrame:
    """(node, root) of the classes that are linked with others."""
    spark = classes.sparkSession
    lists = _lists(classes, k, percent)
    part = lists.select("c").distinct()
    wanted = classes.join(part, "c", "left_semi").select("c", "id", "tie")
    # The sets of the classes in some list, from one document of each.
    again = docs.select("id", F.xxhash64("text").alias("tie"), "text")
    sets = freeze(
        again.join(
            wanted.withColumnsRenamed({"id": "id_", "tie": "tie_"}),
            F.col("id").eqNullSafe(F.col("id_")) & (F.col("tie") == F.col("tie_")),
        )
        .select("c", shingles(F.col("text"), n).alias("s"))
        .dropDuplicates(["c"]),
        "sets",
    )
    # What a class holds alone among them bounds its similarity to any other.
    alone = (
        sets.select("c", F.explode("s").alias("v"))
        .groupBy("v")
        .agg(F.count("*").alias("n"), F.first("c").alias("c"))
        .filter("n = 1")
        .groupBy("c")
        .agg(F.count("*").alias("own"))
    )
    held = sets.select("c", F.size("s").cast("long").alias("size")).join(alone, "c", "left")
    held = held.withColumn("own", F.coalesce("own", F.lit(0).cast("long")))
    held = held.withColumn("common", F.col("size") - F.col("own"))
    lists = freeze(
        lists.join(held.filter(100 * F.col("common") >= percent * F.col("size")), "c").select(
            "value", F.struct("c", "own", "common").alias("m")
        ),
        "lists",
    )

    links = spark.createDataFrame([], "a long, b long")
    tried = roots = None
    for turn in range(STAR_ROUNDS + 1):
        if roots is None:
            members = lists.withColumn("root", F.col("m.c"))
        else:
            members = (
                lists.withColumn("node", F.col("m.c"))
                .join(roots, "node", "left")
                .select("value", "m", F.coalesce("root", "node").alias("root"))
            )
        open_ = members.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        open_ = open_.filter("lo != hi").select("value")
        if open_.isEmpty():
            break
        members = members.join(open_, "value")
        if turn < STAR_ROUNDS:
            # One member of every list against those of other components. The choice is the
            # same in all lists that a group of copies shares: first the member with the least
            # of its own, which is nearest to the others, then any.
            first = F.col("m.own") if turn == 0 else F.xxhash64("m.c", F.lit(turn))
            hub = F.min_by(F.struct("m", "root"), F.struct(first, "m.c")).alias("hub")
            hubs = members.groupBy("value").agg(hub)
            pairs = members.join(hubs, "value").filter(
                (F.col("root") != F.col("hub.root")) & _may_link(F.col("m"), F.col("hub.m"), percent)
            )
            pairs = pairs.select(*_ordered(F.col("m"), F.col("hub.m")))
        else:
            pairs = _rest(members, sets, percent)
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = freeze(_estimated(pairs, classes, k, percent), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = freeze(links.unionByName(_confirmed(pairs, sets, percent)), "confirmed")
        roots = components(links)
    return components(links) if roots is None else roots


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    k: int = K,
    tie_col: str | None = None,
) -> DataFrame:
    """One row per row of `docs`: its id, n_shingles (LONG), component_id, kept; and `tie_col`
    where it is given, a LONG column that numbers the rows.

    Documents are linked when their shingle sets have a Jaccard similarity of `percent` or more
    percent; a component holds all that are connected. component_id is its smallest id, null
    ids last; kept marks the one row with that id that stays (of equal rows, one). Null and
    empty texts have no shingles and are linked with nothing, each on its own. An empty table
    gives an empty one. Other columns are not read.
    """
    number = F.monotonically_increasing_id() if tie_col is None else F.col(tie_col)
    docs = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), number.alias("row")
    )
    rows = freeze(_sketched(docs, shingle, k), "sketches")
    # Documents of equal sets are one class.
    place = F.struct(F.col("id").isNull(), "id", "row")
    classes = freeze(
        rows.filter("n_shingles > 0")
        .groupBy("h1", "h2", "n_shingles")
        .agg(
            F.min(place).alias("first"),
            F.min_by(F.struct("tie", "sketch"), place).alias("x"),
        )
        .select(
            "h1", "h2", "n_shingles", F.col("first.row").alias("c"), F.col("first.id").alias("id"),
            "x.tie", "x.sketch",
        ),
        "classes",
    )
    roots = linked_classes(classes, docs, shingle, k, percent)
    rooted = classes.join(roots.withColumnRenamed("node", "c"), "c", "left").select(
        "h1", "h2", "id", "c", F.coalesce("root", "c").alias("root")
    )
    best = rooted.groupBy("root").agg(
        F.min(F.struct(F.col("id").isNull(), "id", F.col("c").alias("row"))).alias("m")
    )
    named = rooted.join(best, "root").select(
        "h1", "h2", F.col("m.id").alias("component_id"), F.col("m.row").alias("keep_row")
    )
    full = rows.filter("n_shingles > 0").join(named, ["h1", "h2"])
    out = [F.col("id").alias(id_col), "n_shingles"]
    if tie_col is not None:
        out.append(F.col("row").alias(tie_col))
    return full.select(
        *out, "component_id", (F.col("row") == F.col("keep_row")).alias("kept")
    ).unionByName(
        rows.filter("n_shingles = 0").select(
            *out, F.col("id").alias("component_id"), F.lit(True).alias("kept")
        )
    )
