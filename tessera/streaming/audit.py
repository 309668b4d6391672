"""The audit log as a stream: append, and windowed counts with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def entry(question: Column, answer: Column) -> list[Column]:
    """A log entry's texts, 500 characters of the question and 200 of the answer."""
    return [F.substring(question, 1, 500).alias("question"), F.substring(answer, 1, 200).alias("answer")]


def source(spark: SparkSession, path: str, schema: str = EVENTS, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Entries of each type and window of ``size``; works on a stream and on a table alike."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    counts = timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def append(events: DataFrame, path: str, checkpoint: str):
    """Appends what has come to JSON files, once, with exactly-once progress in ``checkpoint``."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def last_state(events: DataFrame, keep: str = "15 minutes") -> DataFrame:
    """Latest entry of each user within ``keep`` of the newest of all: a cache with a time to live, over a table."""
    newest = events.agg((F.max("ts") - F.expr(f"INTERVAL {keep}")).alias("since"))
    fresh = events.join(F.broadcast(newest), F.col("ts") >= F.col("since"))  # one row
    return fresh.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("ts"))
