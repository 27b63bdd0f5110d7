"""Session-level helpers: shared folder for written tables, hot keys, partition counts."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings (session conf keys) with their defaults.
MAX_GROUP_ROWS = "spark.inkspark.maxGroupRows"  # a key with more rows is split over tasks
MAX_REPLAY_OPS = "spark.inkspark.maxReplayOps"  # longer histories are composed before the fold
REPLAY_CHUNK = "spark.inkspark.replayChunk"  # ops composed into one delta when a log is split
DEFAULTS = {
    MAX_GROUP_ROWS: 10_000_000,
    MAX_REPLAY_OPS: 20_000,
    REPLAY_CHUNK: 1024,
}
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORK_DIR = "spark.inkspark.workDir"  # folder for written tables where no checkpoint folder is set


def setting(spark: SparkSession, key: str) -> int:
    return int(spark.conf.get(key, str(DEFAULTS[key])))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application for written tables: below the checkpoint folder that the
    cluster names, else below `WORK_DIR`, else below the warehouse on the default file system."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    base = base or spark.conf.get(WORK_DIR, None)
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_inkspark"
    return f"{base.rstrip('/')}/inkspark-{context.applicationId}"


def drop_work(spark: SparkSession) -> None:
    """Delete the tables that this application wrote on the way."""
    path = _path(spark, shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_recorders: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in _recorders:
        paths.append(path)
    return path


@contextmanager
def recorded_paths() -> Iterator[list[str]]:
    """The paths that `new_path` gives inside, for `drop_paths` once nothing reads them."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders.remove(paths)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables of this application; those of another one are left alone."""
    own = shared_dir(spark)
    for name in paths:
        if name.startswith(f"{own}/"):
            path = _path(spark, name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts lineage, and freezes values such as a partition id that must not change
    when a lost executor makes Spark run a stage again.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the job that wrote them, for jobs that end in a written table; else
    they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest key: a count that reads the key columns only, combines on the
    map side and returns a single row."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys with more rows than a task should sort on its own, as a written table; None
    if there are none. Always counts; pass the answer on instead of asking again."""
    limit = setting(df.sparkSession, MAX_GROUP_ROWS)
    if largest_group(df, keys) <= limit:
        return None
    counts = df.groupBy(*keys).count()
    return materialize(counts.filter(F.col("count") > limit).select(*keys), "hot-keys")


def hot_within(hot: DataFrame | None, df: DataFrame, keys: list[str]) -> DataFrame | None:
    """`hot_keys` for finer keys, given those of coarser ones: no key is larger than the key
    that holds it, so nothing is counted where none of those is hot."""
    return None if hot is None else hot_keys(df, keys)


def range_slices(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Cut the table into contiguous ranges of (keys, order), numbered in `slice_no`.

    A key that holds much of the table spans many slices, in order. The numbers are
    written with the rows, so later reads all see the same cut.
    """
    spark = df.sparkSession
    parts = max(shuffle_partitions(spark), math.ceil(df.count() / setting(spark, MAX_GROUP_ROWS)))
    cut = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    return materialize(cut.withColumn("slice_no", F.spark_partition_id()), "slices")
