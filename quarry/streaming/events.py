"""Structured Streaming operators over the event log, and foreachBatch upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream over a folder of event Parquet files."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 4).parquet(folder)


def idempotent(events: DataFrame, key: str = "event_id", delay: str = "10 minutes") -> DataFrame:
    """Append with an idempotency key: repeats within the watermark are dropped; state is bounded by the delay."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def tumbling(events: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Session windows of each user."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))


def upsert_sink(path: str, key: str, version: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the newest row of each key in snapshots path/v=<batch>; a batch that runs again writes the same snapshot."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch
        if batch_id > 0:
            new = spark.read.parquet(f"{path}/v={batch_id - 1}").unionByName(batch)
        newest = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), F.col(version)).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return write


def sync(seen: DataFrame, known: DataFrame, key: str, digest: str) -> DataFrame:
    """Incremental sync of one run against what is known: (key, action) with insert, update, delete or keep."""
    j = seen.select(key, F.col(digest).alias("new"), F.lit(True).alias("is_new")).join(known.select(key, F.col(digest).alias("old"), F.lit(True).alias("is_old")), key, "full_outer")
    same = F.col("new").eqNullSafe(F.col("old"))
    action = F.when(F.col("is_old").isNull(), "insert").when(F.col("is_new").isNull(), "delete").when(~same, "update").otherwise("keep")
    return j.select(key, action.alias("action"))
