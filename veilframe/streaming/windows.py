"""Contribution limits over a stream: at most k rows of a unit in each window count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_units(events: DataFrame, time: str, unit: str, keys: list[str], window: str = "1 hour", late: str = "10 minutes", most: int = 5) -> DataFrame:
    """Per window and key the number of rows, with no unit counted more than `most` times.

    Works on streams (first append mode, with the watermark) and on batches.
    """
    stamped = events.withWatermark(time, late) if events.isStreaming else events
    per = stamped.groupBy(F.window(time, window).alias("window"), *keys, unit).agg(F.count("*").alias("n"))
    return per.withColumn("n", F.least("n", F.lit(most)))
