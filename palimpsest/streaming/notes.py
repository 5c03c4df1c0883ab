"""Streams of notes and of message counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.fixed_values import REPEAT_WINDOW_HOURS
from palimpsest.operators.capture import prepared_notes


def new_notes(notes: DataFrame, hours: int = REPEAT_WINDOW_HOURS) -> DataFrame:
    """A stream of notes, prepared, without repeats of the last 24 hours.

    State is one digest per text and ends with the watermark, so it is bounded by
    a day of notes.
    """
    return (
        prepared_notes(notes)
        .withColumns({"_digest": F.sha2("content", 256), "created_at": F.col("created_at").cast("timestamp")})
        .withWatermark("created_at", f"{hours} hours")
        .dropDuplicatesWithinWatermark(["_digest"])
        .drop("_digest")
    )


def recent_counts(messages: DataFrame, span: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Messages per session and time window of a stream."""
    return (
        messages.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        .withWatermark("timestamp", late)
        .groupBy(F.window("timestamp", span).alias("span"), "session_id")
        .agg(F.count(F.lit(1)).alias("messages"), F.max("timestamp").alias("latest"))
    )
