"""Readers and writers of the collaboration tables and of message files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.documents import new_snapshots


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read
    return (reader.schema(schema) if schema else reader).parquet(path)


def append_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a relational store; needs that store's JDBC jar on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def append_snapshots(batch: DataFrame, path: str, stored: DataFrame) -> None:
    """Append the snapshots whose (document_id, revision) is not stored yet."""
    new_snapshots(batch, stored).write.mode("append").parquet(path)


def read_message_lines(spark: SparkSession, path: str) -> DataFrame:
    """Inbound messages, one JSON text per line, undecoded in column `json`."""
    return spark.read.text(path).withColumnRenamed("value", "json")


def stream_message_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path).withColumnRenamed("value", "json")
