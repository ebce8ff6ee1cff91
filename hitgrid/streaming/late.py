"""Late data in a stream: windowed counts behind a watermark, and how many rows came too late for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(stream: DataFrame, time: str, delay: str, width: str, keys: list[str]) -> DataFrame:
    """(window, keys, n): each window comes once the watermark, the latest time less `delay`, has passed it; rows behind that no longer count."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that a query's stateful operators have left out as too late, over its recent progress."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
