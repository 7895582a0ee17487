"""Stream forms of the statistics: running counters, page dedup and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counters(stream: DataFrame, how: str = "sum") -> DataFrame:
    """(name, value) merged over all batches so far; write in complete mode."""
    return stream.groupBy("name").agg(getattr(F, how)("value").alias("value"))


def once(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Rows whose key was not seen within the watermark; state is bounded by it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, key: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    df = stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), key).agg(F.count("*").alias("n"))
    return df.select(F.col("w.start").alias("start"), key, "n")
