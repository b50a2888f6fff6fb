"""Event streams: files as they come, windowed sums that bear late rows, and sinks that resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream; a trigger takes so many files at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Count and sum per event type and tumbling (or sliding) window; works on tables and streams."""
    at = F.window("ts", every, slide) if slide else F.window("ts", every)
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Count per user and session of events no more than ``gap`` apart."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def drained(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what has come since the checkpoint to ``path`` as Parquet, and returns when that is done."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
