"""Line dedup: repeated runs of lines, found with a suffix array over line ids.

Lines become ids, documents become id sequences. Prefix doubling ranks every position by its
first 1, 2, 4, ... lines; positions that are alone at a level leave, since nothing that starts
there repeats. Suffixes that share their first d lines are one interval of the suffix array
with common prefixes of d or more; two ranks of the largest power of two within d name that
interval. In each interval the earliest position is the original and the others are copies.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, dense_ranks, freeze, spare

MIN_WORDS = 8  # a repeated run of fewer words stays


def _lines(rows: DataFrame) -> DataFrame:
    """Lines with a word: row, doc, seq (place among them), line_no, words, two hashes."""
    each = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            i.alias("line_no"),
            F.regexp_count(line, F.lit(WORD)).alias("words"),
            F.xxhash64(line).alias("h1"),
            F.xxhash64(F.lit("line"), line).alias("h2"),
        ),
    )
    full = F.filter(each, lambda x: x["words"] > 0)
    return rows.select("row", "doc", F.posexplode(full).alias("seq", "x")).select(
        "row", "doc", "seq", "x.*"
    )


def _stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Lines that occur twice or more, in stretches of neighbours that hold `min_words`.

    `at` counts the words of the stretch before the line, `upto` with it.
    """
    shared = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1")
    ids = dense_ranks(shared, ["h1", "h2"], "rank")
    here = Window.partitionBy("row").orderBy("seq")
    known = lines.join(ids, ["h1", "h2"]).withColumn(
        "stretch", F.col("seq") - F.row_number().over(here)
    )
    in_stretch = Window.partitionBy("row", "stretch").orderBy("seq")
    known = known.withColumns(
        {
            "upto": F.sum("words").over(in_stretch),
            "total": F.sum("words").over(Window.partitionBy("row", "stretch")),
        }
    ).filter(F.col("total") >= min_words)
    return freeze(
        known.select(
            "row", "doc", "stretch", "seq", "line_no", "rank",
            (F.col("upto") - F.col("words")).alias("at"), "upto",
        ),
        "stretches",
    )


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """The shortest windows that reach `min_words`, from each line on and up to each line.

    A repeated run with `min_words` words is the union of such windows within it.
    """
    stretch = Window.partitionBy("row", "stretch")
    ahead = stretch.orderBy("at").rangeBetween(Window.currentRow, min_words - 1)
    back = stretch.orderBy("upto").rangeBetween(-(min_words - 1), Window.currentRow)
    both = lines.select(
        "row", "doc", "seq",
        F.array(
            F.struct(
                F.col("seq").alias("start"),
                F.count("*").over(ahead).cast("int").alias("d"),
                (F.max("upto").over(ahead) - F.col("at")).alias("held"),
            ),
            F.struct(
                (F.col("seq") - F.count("*").over(back) + 1).cast("int").alias("start"),
                F.count("*").over(back).cast("int").alias("d"),
                (F.col("upto") - F.min("at").over(back)).alias("held"),
            ),
        ).alias("pair"),
    )
    return (
        both.select("row", "doc", F.explode("pair").alias("w"))
        .filter(F.col("w.held") >= min_words)
        .select("row", "doc", "w.start", "w.d")
        .distinct()
    )


def _copies(ranks: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """Windows (row, start, d) that repeat an earlier one; `ranks` are those of `span` lines."""
    head = ranks.select("row", F.col("seq").alias("start"), F.col("rank").alias("a"))
    tail = ranks.select("row", F.col("seq").alias("tail_seq"), F.col("rank").alias("b"))
    named = (
        wanted.join(head, ["row", "start"])
        .withColumn("tail_seq", F.col("start") + F.col("d") - span)
        .join(tail, ["row", "tail_seq"])
        .select("row", "doc", "start", "d", "a", "b")
    )
    place = F.struct(F.col("doc").isNull(), "doc", "row", "start")
    first = (
        named.groupBy("d", "a", "b")
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("d", "a", "b", "first.row", "first.start")
        .toDF("d", "a", "b", "first_row", "first_start")
    )
    apart = (F.col("row") != F.col("first_row")) | (
        F.col("start") >= F.col("first_start") + F.col("d")
    )
    return named.join(first, ["d", "a", "b"]).filter(apart).select("row", "start", "d")


def _doubled(ranks: DataFrame, span: int) -> DataFrame:
    """Ranks of 2 * `span` lines from those of `span` lines, of positions that repeat."""
    ahead = Window.partitionBy("row", "stretch").orderBy("seq").rangeBetween(span, span)
    pairs = ranks.withColumn("next", F.first("rank").over(ahead)).filter("next is not null")
    shared = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).filter("n > 1")
    names = dense_ranks(shared, ["rank", "next"], "new_rank")
    return freeze(
        pairs.join(names, ["rank", "next"]).select(
            "row", "stretch", "seq", F.col("new_rank").alias("rank")
        ),
        "suffixes",
    )


def repeated_lines(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, line_no) of every line inside a later copy of a repeated run.

    `rows` has row (unique LONG), doc (order of the documents) and text.
    """
    lines = _stretches(_lines(rows), min_words)
    wanted = freeze(_windows(lines, min_words), "windows")
    ranks = lines.select("row", "stretch", "seq", "rank")
    marks, span = None, 1
    for _ in range(int(math.log2(min_words)) + 1):
        level = wanted.filter((F.col("d") >= span) & (F.col("d") < 2 * span))
        found = _copies(ranks, level, span)
        marks = found if marks is None else marks.unionByName(found)
        if 2 * span > min_words:
            break
        ranks = _doubled(ranks, span)
        span *= 2
    reach = marks.groupBy("row", F.col("start").alias("seq")).agg(
        F.max(F.col("start") + F.col("d") - 1).alias("reach")
    )
    so_far = Window.partitionBy("row").orderBy("seq")
    return (
        lines.select("row", "seq", "line_no")
        .join(reach, ["row", "seq"], "left")
        .withColumn("reach", F.max("reach").over(so_far))
        .filter("reach >= seq")
        .select("row", "line_no")
    )


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """`docs` with the later copies of repeated line runs deleted, and two added columns.

    A run is one or more neighbouring lines (blank ones between them do not count) with at
    least `min_words` words that occurs twice or more in the corpus. The occurrence with the
    smallest id stays (null ids last); within a document the first one. An occurrence that
    overlaps the original in its own document is no copy. Lines are equal when all their
    characters are. Added: `lines_removed` (LONG) and `text_before` (the input's text); clashing
    names get a trailing underscore.

    Null texts stay null and empty ones empty. Repeated rows count as documents of their own:
    the first keeps its lines. An empty table gives an empty one. Any length of text works;
    lines of one document are handled in one task.
    """
    row, doc, text, gone, kept = spare(docs, "row", "doc", "text_", "gone", "kept_lines")
    removed, before = spare(docs, "lines_removed", "text_before")
    numbered = freeze(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    rows = numbered.select(
        F.col(row).alias("row"), F.col(id_col).alias("doc"), F.col(text_col).alias("text")
    )
    cuts = (
        repeated_lines(rows, min_words)
        .groupBy("row")
        .agg(F.collect_list("line_no").alias(gone))
        .withColumnRenamed("row", row)
    )
    joined = numbered.join(cuts, row, "left")
    lines = F.split(F.col(text_col), "\n")
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    cleaned = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n")
    )
    return joined.select(
        *[(cleaned if c == text_col else F.col(c)).alias(c) for c in docs.columns],
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(removed),
        F.col(text_col).alias(before),
    )
