"""Streams beyond the batch operators: inventory files as they arrive, and log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import tables
from ..sources import inventory, logs


def ingest_stream(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the new paths of each arriving inventory file to a table in partitions by the path's hash. A batch that runs again finds its own rows there, and adds none."""
    rows = spark.readStream.schema(inventory.SCHEMA).option("header", True).option("escape", '"').csv(folder)

    def put(batch: DataFrame, _: int) -> None:
        files = inventory.transform(batch.withColumn("pos", F.monotonically_increasing_id()))
        tables.append_new(inventory.first_of_path(files).drop("pos"), target, "path")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of log files as they grow, with their level."""
    return logs.stream(spark, folder).select("line", "level")
