"""Progress logs as a stream: windowed counts of events with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def progress_stream(events: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, stage, events, processed) of a stream with at (timestamp), stage, processed."""
    by = events.withWatermark("at", late).groupBy(F.window("at", window), "stage")
    return by.agg(F.count("*").alias("events"), F.max("processed").alias("processed")).select(F.col("window.start").alias("start"), "stage", "events", "processed")


def observed_counts(df: DataFrame, name: str = "coverage"):
    """The table with live counts (processed, selected, embedded) as an observation."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("processed"), F.count_if("selected").alias("selected"), F.count_if("embedded").alias("embedded")), seen
