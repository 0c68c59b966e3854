"""Streams: verdict lines folded into a last-wins table, and windowed counts of late events (beyond the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verilane.operators.relational import last_wins


def verdict_stream(spark: SparkSession, path: str) -> DataFrame:
    schema = "claim_id string, prompt_version string, support string, line long"
    return spark.readStream.schema(schema).json(path)


def last_verdicts(stream: DataFrame, checkpoint: str, target: str):
    """A query that appends each batch's last verdict per key, with the batch as version. current() reads the table.

    A batch that is run again after a failure overwrites its own folder, so nothing counts twice.
    """

    def fold(batch: DataFrame, number: int) -> None:
        last_wins(batch, ["claim_id", "prompt_version"], ["line"]).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The last verdict of each claim and prompt version."""
    return last_wins(spark.read.parquet(target), ["claim_id", "prompt_version"], ["line", "batch"])


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window; rows later than the watermark are left out when events is a stream."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
