"""The applied-op event log: keyed JSON records, batch files and Kafka."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.deltas import ops_compact, ops_decode
from ..functions.scalars import utc_time
from ..schemas import DOC_OP_EVENT, EVENT_TYPE

TOPIC = "doc-ops"
_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def encode(op_log: DataFrame) -> DataFrame:
    """Op-log rows to (key, value): key is the document, value the JSON event."""
    event = F.struct(
        F.lit(EVENT_TYPE).alias("eventType"),
        F.col("doc_id").alias("docId"),
        F.col("operation_id").alias("operationId"),
        "revision",
        F.col("author_id").alias("authorId"),
        F.col("client_id").alias("clientId"),
        F.col("client_seq").alias("clientSeq"),
        F.col("base_revision").alias("baseRevision"),
        ops_compact(ops_decode(F.col("ops"))).alias("ops"),
        F.date_format("ts", _STAMP).alias("appliedAt"),
    )
    return op_log.select(F.col("doc_id").alias("key"), F.to_json(event).alias("value"))


def decode(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Records to typed rows; `corrupt` is true where the value is not a whole event: not JSON,
    a field of another type, or no document, revision, time or known type. `keep` names other
    columns of the records to carry along."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    event = F.from_json("value", f"{DOC_OP_EVENT}, _corrupt STRING", options)
    rows = records.withColumn("event", event)
    whole = (
        F.col("event._corrupt").isNull()
        & F.col("event.docId").isNotNull()
        & F.col("event.revision").isNotNull()
        & utc_time(F.col("event.appliedAt")).isNotNull()
        & (F.col("event.eventType") == EVENT_TYPE)
    )
    return rows.select(
        *(keep or []),
        "key",
        "value",
        F.col("event.docId").alias("doc_id"),
        F.col("event.revision").alias("revision"),
        F.col("event.operationId").alias("operation_id"),
        F.col("event.authorId").alias("author_id"),
        F.col("event.clientId").alias("client_id"),
        F.col("event.clientSeq").alias("client_seq"),
        F.col("event.baseRevision").alias("base_revision"),
        F.col("event.ops").alias("ops"),
        utc_time(F.col("event.appliedAt")).alias("applied_at"),
        (~F.coalesce(whole, F.lit(False))).alias("corrupt"),
    )


def split_corrupt(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined key and value)."""
    good = decoded.filter(~F.col("corrupt")).drop("corrupt", "value")
    return good, decoded.filter("corrupt").select("key", "value")


def write_files(op_log: DataFrame, path: str) -> None:
    """Write the encoded log ordered by document and revision.

    Range partitions keep a document's records in order across consecutive files, and let a
    very long document span several writers.
    """
    ordered = op_log.repartitionByRange("doc_id", "revision").sortWithinPartitions(
        "doc_id", "revision"
    )
    encode(ordered).write.mode("append").json(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return decode(spark.read.schema("key STRING, value STRING").json(path))


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """The decoded log with the number of each record's file and its place in the file."""
    files = spark.read.schema("key STRING, value STRING").json(path)
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    placed = files.select("key", "value", part.alias("file_no"), F.col("_metadata.file_block_start").alias("at"))
    # The ids grow along the lines of a block.
    numbered = placed.withColumn("line_no", F.struct("at", F.monotonically_increasing_id().alias("n")))
    where = numbered.select("file_no", "line_no", "key", "value")
    return decode(where, ["file_no", "line_no"])


def write_kafka(op_log: DataFrame, servers: str, topic: str = TOPIC) -> None:
    """Publish the encoded log, each document in revision order through one writer.

    Needs the Spark Kafka package on the class path.
    """
    ordered = op_log.repartition("doc_id").sortWithinPartitions("doc_id", "revision")
    encode(ordered).write.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "topic", topic
    ).save()


def stream_kafka(spark: SparkSession, servers: str, topic: str = TOPIC) -> DataFrame:
    records = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
    )
    return decode(records.selectExpr("CAST(key AS STRING) AS key", "CAST(value AS STRING) AS value"))
