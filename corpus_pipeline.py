"""A training-data pipeline over `documents`: a stage reads what the one before it kept.

All stages but the last return the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from inkspark import runtime
from inkspark.llm.common import freeze, n_words, spare, table
from inkspark.llm.line_dedup import line_dedup
from inkspark.llm.mixing import mix
from inkspark.llm.near_dedup import near_dedup
from inkspark.llm.packing import digests, pack, pieces_of
from inkspark.llm.quality import quality_rules
from inkspark.llm.queries import tokenizer_file


_work: list[str] = []  # tables that the stage before wrote on its way


def stage(fn):
    """A stage whose work tables go when the next one starts: by then its rows are written."""

    @wraps(fn)
    def run_stage(spark, docs, sf_dir):
        runtime.drop_paths(spark, _work)
        with runtime.recorded_paths() as mine:
            out = fn(spark, docs, sf_dir)
        _work[:] = mine
        return out

    return run_stage


# All columns of a document as one, out of the way of what a stage adds.
WHOLE = "stage_columns"


def _whole(docs):
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(WHOLE)


@stage
def filter_quality(spark, docs, sf_dir):
    """Documents that pass the quality rules. Null and empty texts fail them; repeated rows are
    judged alike; columns keep their values, whatever they are called."""
    judged = quality_rules(
        docs.select(_whole(docs), "doc_id", "text"), table(spark, sf_dir, "labels")
    )
    return judged.filter("kept").select(f"{WHOLE}.*")


@stage
def dedup_lines(spark, docs, sf_dir):
    """Documents without the later copies of repeated line runs; n_chars follows the text.

    A document that loses all its words is nothing but copies and goes.
    """
    out = line_dedup(docs)
    emptied = (F.col("lines_removed") > 0) & (n_words(F.col("text")) == 0)
    changed = F.when(F.col("lines_removed") > 0, F.length("text").cast("long"))
    out = out.filter(~emptied)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return out.select(*docs.columns)


@stage
def dedup_near(spark, docs, sf_dir):
    """One document of each group of near copies (five words, similarity 0.8). Documents without
    words are copies of nothing and stay; of equal rows one stays."""
    row, kept = spare(docs, "near_row", "near_kept")
    held = freeze(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    found = near_dedup(held, tie_col=row)
    stay = found.filter("kept").select(F.col(row).alias(kept))
    return held.join(stay, F.col(row) == F.col(kept), "left_semi").select(*docs.columns)


@stage
def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix takes them; those taken twice are two rows. A null source is
    a source, the last one; documents without words take nothing of the mix. Columns keep their
    values, whatever they are called."""
    sized = docs.select(_whole(docs), "doc_id", "source", n_words(F.col("text")).alias("size"))
    again = F.explode(F.array_repeat(F.lit(1), F.col("copies")))
    return mix(sized).withColumn("again", again).select(f"{WHOLE}.*")


@stage
def pack_sequences(spark, docs, sf_dir):
    """Pieces of the token ids of all documents with their places in sequences. A null text has
    its end id only; repeated rows are documents of their own."""
    return digests(pack(pieces_of(docs, tokenizer_file())))


STAGES = [
    ("quality rules", filter_quality),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("mix sources", mix_sources),
    ("best-fit packing", pack_sequences),
]
# Hashed weights, rounded rates and token ids have no SQL form; tests/llm compare the stages
# with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = freeze(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
