"""Writers of runs, logs and reports as files, and their readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranges


def write_lines(df: DataFrame, path: str, line: Column, by: list[str] | None = None) -> None:
    """A text file line for each row; with by, in a folder for each value of these columns."""
    keys = by or []
    df.select(*keys, line.alias("value")).write.partitionBy(*keys).text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the columns of their folders."""
    return spark.read.text(path)


def event_log(events: DataFrame, keys: list[str], time: str, ties: list[str], columns: list[str]) -> DataFrame:
    """(keys, index, line, content_hash): a JSON line for each event with its index in the run, and the hash of the line."""
    rows = ranges.places(events, time, ties, keys=keys).withColumn("index", (F.col("place") + 1).cast("int"))
    line = F.to_json(F.struct(*keys, "index", *columns))
    return rows.select(*keys, "index", line.alias("line"), F.sha2(line.cast("binary"), 256).alias("content_hash"))


def listmode_rows(detections: DataFrame) -> DataFrame:
    """(run_id, line_no, t_us, channel0): times from each run's first event, channels from 0, lines in the order of time."""
    first = detections.groupBy("run_id").agg(F.min("ts_us").alias("t0"))
    rows = ranges.places(detections, "ts_us", ["event_id"], keys=["run_id"]).join(first, "run_id")
    return rows.select("run_id", (F.col("place") + 1).alias("line_no"), (F.col("ts_us") - F.col("t0")).alias("t_us"), (F.col("channel") - 1).alias("channel0"))


#: Events in a megabyte of an acquisition file, about.
EVENTS_PER_MB = 128_000


def rollover(detections: DataFrame, target_mb: float = 500.0) -> DataFrame:
    """detections with file_no: a run's events in the order of time, as many to a file as reach its target size."""
    per_file = max(1, int(target_mb * EVENTS_PER_MB))
    return ranges.places(detections, "ts_us", ["event_id"], keys=["run_id"]).withColumn("file_no", F.expr(f"place div {per_file}")).drop("place")
