"""Quality rules: fixed rules, then a hashed n-gram log-likelihood ratio.

Tokens (runs of letters and digits, runs of other signs) and pairs of neighbouring tokens are
hashed into buckets. A bucket weighs log(share among trusted documents / share in the corpus);
a document scores the mean weight of its n-grams and is kept from a threshold on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, freeze, spare, words

BUCKETS = 1 << 14
MILLI = 1000
SMOOTHING = 1.0  # added to every bucket's count, in both multinomials
THRESHOLD = -0.1  # nats per n-gram; see the calibration in tests/llm
MAX_TRUSTED = 20_000  # bound of the trusted sample of labelled documents
# Fixed values of the base rules.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"


def _bind(value: Column, body) -> Column:
    """body(value), with `value` computed once; inside a lambda it would be computed again
    for every element."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(tokens: Column) -> Column:
    """Words inside windows of 8 words that occur twice or more in the text."""

    def windows(hashed: Column) -> Column:
        ahead = F.transform(
            hashed,
            lambda h, i: F.xxhash64(h, *[F.get(hashed, i + k) for k in range(1, WINDOW)]),
        )
        return F.slice(ahead, F.lit(1), F.size(hashed) - WINDOW + 1)

    def repeated(ranked: Column) -> Column:
        """Places of the windows that stand beside an equal one when sorted."""
        marked = F.transform(
            ranked,
            lambda x, j: F.when(
                (F.get(ranked, j - 1)["h"] == x["h"]) | (F.get(ranked, j + 1)["h"] == x["h"]),
                x["i"],
            ),
        )
        return F.sort_array(F.array_compact(marked))

    def covered(at: Column) -> Column:
        steps = F.transform(
            at,
            lambda p, j: F.least(F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)),
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)

    def count(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        slow = _bind(F.sort_array(pairs), lambda r: _bind(repeated(r), covered))
        some = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(some, slow).otherwise(F.lit(0).cast("long"))

    def of(hashed: Column) -> Column:
        return F.when(F.size(hashed) >= WINDOW, _bind(windows(hashed), count)).otherwise(
            F.lit(0).cast("long")
        )

    return _bind(F.transform(tokens, lambda w: F.xxhash64(w)), of)


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    full = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    (held,) = spare(docs, "words_")
    return (
        docs.withColumn(held, words(F.col(text_col)))
        .withColumns(
            {
                "n_words": F.size(held).cast("long"),
                "word_chars": F.length(F.array_join(held, "")).cast("long"),
                "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
                "n_dup_lines": (F.size(full) - F.size(F.array_distinct(full))).cast("long"),
                "n_repeat_words": _repeat_words(F.col(held)),
            }
        )
        .drop(held)
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        )
    )


def ngram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Buckets (INT from 0) of all tokens and pairs of tokens of a text."""
    tokens = F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))),
        F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}\s]+)"),
        F.lit(1),
    )

    def both(h: Column) -> Column:
        ones = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
        twos = F.transform(
            h, lambda x, i: F.pmod(F.xxhash64(F.get(h, i - 1), x), F.lit(buckets)).cast("int")
        )
        return F.concat(ones, F.slice(twos, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0))))

    return _bind(F.transform(tokens, lambda t: F.xxhash64(t)), both)


def _counts(docs: DataFrame, text_col: str, buckets: int, name: str) -> DataFrame:
    grams = docs.select(F.explode(ngram_buckets(F.col(text_col), buckets)).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count("*").alias(name))


def fit_weights(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    max_trusted: int = MAX_TRUSTED,
) -> DataFrame:
    """One row per bucket: (bucket, weight). The corpus multinomial counts every document;
    the trusted one counts up to `max_trusted` documents labelled quality 1 and toxic 0, those
    with the smallest hash of their id."""
    spark = docs.sparkSession
    (held,) = spare(docs, "trusted_id")
    trusted = (
        labels.filter("quality = 1 and toxic = 0 and doc_id is not null")
        .select(F.col("doc_id").alias(held))
        .distinct()
        .orderBy(F.xxhash64(held), held)
        .limit(max_trusted)
    )
    # The trusted ids are bounded by max_trusted, so they may be broadcast.
    target = docs.join(F.broadcast(trusted), F.col(id_col) == F.col(held), "left_semi")
    counts = freeze(
        spark.range(buckets)
        .select(F.col("id").cast("int").alias("bucket"))
        .join(_counts(docs, text_col, buckets, "raw"), "bucket", "left")
        .join(_counts(target, text_col, buckets, "good"), "bucket", "left")
        .select(
            "bucket",
            (F.coalesce("good", F.lit(0)) + SMOOTHING).alias("good"),
            (F.coalesce("raw", F.lit(0)) + SMOOTHING).alias("raw"),
        ),
        "ngram-counts",
    )
    totals = counts.agg(F.sum("good").alias("good"), F.sum("raw").alias("raw")).first()
    ratio = F.col("good") / F.lit(totals["good"]) / (F.col("raw") / F.lit(totals["raw"]))
    return counts.select("bucket", F.log(ratio).alias("weight"))


def quality_scores(
    docs: DataFrame, weights: DataFrame, text_col: str = "text", buckets: int = BUCKETS
) -> DataFrame:
    """Add `llr`, the mean weight of a document's n-grams; null without any.

    The weights, one number per bucket whatever the corpus holds, pass through the driver and
    enter the plan as one array constant, in thousandths of a nat.
    """
    rows = weights.select("bucket", F.round(F.col("weight") * MILLI).cast("int")).collect()
    every = [str(w) for _, w in sorted(rows)]
    every = F.split(F.lit(",".join(every)), ",").cast("array<int>")
    mean = _bind(
        ngram_buckets(F.col(text_col), buckets),
        lambda grams: F.when(
            F.size(grams) > 0,
            F.aggregate(grams, F.lit(0).cast("long"), lambda acc, b: acc + F.get(every, b))
            / F.size(grams)
            / MILLI,
        ),
    )
    return docs.withColumn("llr", mean)


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
    max_trusted: int = MAX_TRUSTED,
) -> DataFrame:
    """`docs` with the base features, base_failed, llr and kept.

    kept is false where a base rule fails (under 20 words, or over 30% of the words inside
    repeated windows of 8 words), else it tells whether llr reaches `threshold`. Input columns
    of these names give way to the new ones. Null and empty texts have no words and fail. Null
    ids are never trusted. Repeated rows are judged alike. Without trusted labels both
    multinomials are smoothed counts, the target being uniform. Empty tables give empty ones.
    """
    new = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"}
    new |= {"base_failed", "llr", "kept"}
    docs = docs.select(*[F.col(c) for c in docs.columns if c.lower() not in new])
    weights = fit_weights(docs, labels, id_col, text_col, buckets, max_trusted)
    scored = quality_scores(base_rules(docs, text_col), weights, text_col, buckets)
    good = F.coalesce(F.col("llr") >= threshold, F.lit(False))
    return scored.withColumn("kept", ~F.col("base_failed") & good)
