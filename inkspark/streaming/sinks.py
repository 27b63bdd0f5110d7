"""Sinks of micro-batches that leave one copy however often a batch is run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import messages
from ..operators.documents import new_snapshots
from ..schemas import CLIENT_MESSAGE


class MessageSink:
    """Routes undecoded lines (column `json`) and keeps good and torn ones apart, in one pass and one write.

    A micro-batch is a folder that a repeated batch overwrites, with a sub-folder for the messages
    and one for the quarantine, so a run that was killed leaves nothing beside the next one's rows.
    """

    GOOD, TORN = "messages", "quarantine"

    FIELDS = CLIENT_MESSAGE.removesuffix(", _corrupt STRING")
    SCHEMA = (
        f"{FIELDS}, route STRING, older_route STRING, reply STRING, line STRING, "
        "batch LONG, kept_in STRING"
    )

    def __init__(self, path: str):
        self.path = path

    def __call__(self, lines: DataFrame, batch_id: int) -> None:
        routed = messages.route(messages.decode(lines))
        torn = F.col("broken")
        rows = routed.select(
            "message.*",
            F.when(~torn, F.col("route")).alias("route"),
            F.when(~torn, F.col("older_route")).alias("older_route"),
            "reply",
            F.when(torn, F.col("json")).alias("line"),
            F.when(torn, self.TORN).otherwise(self.GOOD).alias("kept_in"),
        ).drop("_corrupt")
        target = f"{self.path}/batch={batch_id}"
        rows.write.mode("overwrite").partitionBy("kept_in").parquet(target)

    def _read(self, spark: SparkSession, part: str) -> DataFrame:
        rows = spark.read.schema(self.SCHEMA).parquet(self.path)
        return rows.filter(F.col("kept_in") == part).drop("kept_in")

    def good(self, spark: SparkSession) -> DataFrame:
        """Decoded messages with their routes and `batch`."""
        return self._read(spark, self.GOOD).drop("line")

    def quarantine(self, spark: SparkSession) -> DataFrame:
        """Lines that are no JSON, with `batch`."""
        return self._read(spark, self.TORN).select("line", "batch")


class PartedSnapshots:
    """Insert-ignore of each micro-batch into a snapshot table in `parts` parts by document.

    The stored keys are read in the parts that the batch touches only. Rows lie in a folder per
    part and batch; a repeated batch leaves its own earlier rows out of account and overwrites
    them, so one that was killed while it wrote leaves one copy.
    """

    SCHEMA = "document_id STRING, revision LONG, content STRING, part INT, batch LONG"

    def __init__(self, path: str, parts: int = 64):
        self.path = path
        self.parts = parts

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("document_id"), F.lit(self.parts)).cast("int")

    def _write(self, rows: DataFrame, batch_id: int) -> None:
        placed = rows.select("document_id", "revision", "content").withColumns(
            {"part": self._part(), "batch": F.lit(batch_id).cast("long")}
        )
        (
            # One file per part and batch, unless a part is large enough for several.
            placed.repartition("part")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("part", "batch")
            .parquet(self.path)
        )

    def load(self, rows: DataFrame) -> None:
        """The snapshots there are before the first batch."""
        self._write(rows, -1)

    def read(self, spark: SparkSession) -> DataFrame:
        table = spark.read.schema(self.SCHEMA).parquet(self.path)
        return table.select("document_id", "revision", "content")

    def stored_keys(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Keys that other batches stored in the parts of `rows`; the list of parts has at most
        `parts` numbers, and the scan is pruned to their folders."""
        touched = [r.part for r in rows.select(self._part().alias("part")).distinct().collect()]
        table = rows.sparkSession.read.schema(self.SCHEMA).parquet(self.path)
        others = F.col("part").isin(touched) & (F.col("batch") != batch_id)
        return table.filter(others).select("document_id", "revision")

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        self._write(new_snapshots(rows, self.stored_keys(rows, batch_id)), batch_id)
