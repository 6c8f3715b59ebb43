"""Streaming: pages of records with repeats suppressed, windowed counts, and delivery in chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def without_repeats(stream: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """Records whose key came before within the watermark are dropped; state is bounded by it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def chunks(df: DataFrame, rows: int = 50_000):
    """A bounded table in order of arrival as lists of rows, one chunk in memory at a time."""
    held = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == rows:
            yield held
            held = []
    if held:
        yield held
