"""Watch folders and event windows with Structured Streaming: the batch operators over unbounded inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watch_pages(spark: SparkSession, folder: str, schema: str = "file_id long, client_code string, received_at timestamp, pages array<struct<page:int,text:string>>", max_files: int = 100) -> DataFrame:
    """New page-list files of a folder as a stream; late rows keep their own ``received_at``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def first_deliveries(stream: DataFrame, keys: list[str], time_col: str = "received_at", lateness: str = "2 days") -> DataFrame:
    """Each key once while its watermark lives."""
    return stream.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, every: str = "1 hour", time_col: str = "ts", lateness: str | None = None) -> DataFrame:
    """``(window_start, event_type, n, total)``; with ``lateness``, windows close behind the watermark."""
    d = events.withWatermark(time_col, lateness) if lateness else events
    return d.groupBy(F.window(time_col, every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, every: str = "1 hour", step: str = "15 minutes", time_col: str = "ts") -> DataFrame:
    return events.groupBy(F.window(time_col, every, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", time_col: str = "ts", lateness: str | None = None) -> DataFrame:
    """``(user_id, session_start, session_end, n)``: runs of a user's events with less than ``gap`` between."""
    d = events.withWatermark(time_col, lateness) if lateness else events
    return d.groupBy("user_id", F.session_window(time_col, gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def write_batches(stream: DataFrame, checkpoint: str, handle, trigger: dict | None = None):
    """``handle(batch, batch_id)`` for every micro-batch, by the same plan as a batch job."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle).trigger(**(trigger or {"availableNow": True})).start()
