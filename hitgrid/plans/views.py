"""The driver's tables as the canonical tables of list-mode analysis, for Spark and for DuckDB.

detections: a run is an event type, a channel one of 15 by user, time in microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR
#: Gate widths and the window and step that slide over the run, in microseconds.
LADDER = [h * HOUR for h in (1, 2, 4, 8, 16, 32, 64)]
WINDOW, STEP = 5 * DAY, DAY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(name: str):
    """Microseconds of a time stamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {name})")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, ts_us, channel, event_id, value)"""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("run_id"), micros("ts").alias("ts_us"), (F.col("user_id") % 15 + 1).alias("channel"), "event_id", "value")


DETECTIONS = "det AS (SELECT event_type AS run_id, epoch_us(ts) AS ts_us, user_id % 15 + 1 AS channel, event_id, value FROM events)"
