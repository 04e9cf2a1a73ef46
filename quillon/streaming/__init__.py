"""The narrow operations on streams: a Dataset over a streaming DataFrame plans as any other.

An extension: keyed sums with a watermark, for late data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str, length: str, late: str, *keys: str) -> DataFrame:
    """(window, keys, n) of a stream; rows later than ``late`` are dropped with their windows' state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"))
