"""First sighting by key, for tables and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(rows: DataFrame, keys: list[str], at: str, late: str | None = None) -> DataFrame:
    """keys and first_seen. For a stream give the lateness to allow; state older than it goes once the watermark has passed."""
    rows = rows.withWatermark(at, late) if late and rows.isStreaming else rows
    return rows.groupBy(*keys).agg(F.min(at).alias("first_seen"))


def once(rows: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """The rows of a stream without repeats that arrive within the lateness; of a table, one row for each key."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)
