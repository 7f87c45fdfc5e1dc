"""Clusters of events by gaps, in batch and as a stream, and duplicates dropped within a watermark.

These extend the engine: the gap rule is that of read clusters, with time for position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_clusters(events: DataFrame, gap: str = "1 hour", late: str | None = None, least: int = 2) -> DataFrame:
    """(user_id, first, last, n): runs of a user's events less than ``gap`` apart, of ``least`` or more.

    On a stream give ``late``: a session is emitted once the watermark has passed its end.
    """
    source = events.withColumn("ts", F.date_trunc("second", "ts"))
    source = source.withWatermark("ts", late) if late else source
    # session windows that only touch become one, so events exactly ``gap`` apart need a window of a microsecond less
    found = source.groupBy("user_id", F.session_window("ts", f"{gap} -1 microseconds").alias("_w")).agg(F.min(F.unix_timestamp("ts")).alias("first"), F.max(F.unix_timestamp("ts")).alias("last"), F.count("*").alias("n"))
    return found.where(F.col("n") >= least).select("user_id", "first", "last", "n")


def distinct_within(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """A stream's rows without repeats of ``keys`` that come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
