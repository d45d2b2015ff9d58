"""Streaming ingestion: hash deduplication and daily usage windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_documents(uploads: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Uploads (dossier_id, contenu binary, ts) with their digest, each content once a file within the watermark."""
    hashed = uploads.withColumn("hash", F.sha2("contenu", 256)).withWatermark("ts", watermark)
    return hashed.dropDuplicatesWithinWatermark(["dossier_id", "hash"])


def daily_usage(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Calls and errors by day, for batches and streams alike."""
    timed = events.withWatermark("ts", watermark) if events.isStreaming else events
    days = timed.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return days.select(F.to_date("w.start").alias("day"), "calls", "errors")
