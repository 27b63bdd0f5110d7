"""Columns and steps that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import new_path, shuffle_partitions

# White space and words are told apart by these ASCII characters only.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names that `df` does not use yet, one for each of `names`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def freeze(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and fixes values
    such as row or partition numbers, so tasks that run again see the same ones."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dense_ranks(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct `keys` in sorted order with their LONG rank from 0.

    Rows are cut into ranges of the keys; a rank is its place in the range plus the rows of
    the ranges before, of which there is one count each.
    """
    spark = df.sparkSession
    cut = freeze(
        df.select(*keys)
        .distinct()
        .repartitionByRange(shuffle_partitions(spark), *keys)
        .withColumn("range_no", F.spark_partition_id()),
        "ranges",
    )
    before = Window.partitionBy(F.lit(0)).orderBy("range_no").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = cut.groupBy("range_no").count().select(
        "range_no", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first_rank")
    )
    place = F.row_number().over(Window.partitionBy("range_no").orderBy(*keys)) - 1
    return (
        cut.withColumn("place", place)
        .join(starts, "range_no")
        .select(*keys, (F.col("first_rank") + F.col("place")).alias(name))
    )
