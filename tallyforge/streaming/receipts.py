"""Streaming extension: the same transforms over a stream of documents. The batch functions are reused as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def documents(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of JSON documents as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def keep_first(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first event of each key; state older than the delay is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def signals(stream: DataFrame, time: str = "ts", window: str = "1 day", delay: str | None = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window and event type; late events within the delay still count."""
    if stream.isStreaming and delay:
        stream = stream.withWatermark(time, delay)
    out = stream.groupBy(F.window(time, window).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"), F.max("value").alias("greatest"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "events", "total", "greatest")


def run_available(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes all that is there and stops; the checkpoint makes a restart go on where it ended."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
