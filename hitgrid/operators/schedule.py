"""Schedules as tables: rows with a start, an end and what holds in between, and the rows of another table that they cover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import before, greatest_before


def faults(schedule: DataFrame, start: str, end: str) -> DataFrame:
    """(start, end, fault) of rows that make a schedule unusable: `empty` (no time between start and end) or `overlap` (it starts before the one before it ends)."""
    rows = before(schedule.select(start, end), [], start, {"_before": end}, [end])
    fault = F.when(F.col(start).isNull() | F.col(end).isNull() | (F.col(start) >= F.col(end)), "empty").when(F.col(start) < F.col("_before"), "overlap")
    return rows.select(start, end, fault.alias("fault")).filter("fault is not null")


def check(schedule: DataFrame, start: str, end: str) -> None:
    """Fails with the first faulty row, or where the schedule has none."""
    if schedule.isEmpty():
        raise ValueError("the schedule has no rows")
    if first := faults(schedule, start, end).orderBy(start, end).first():
        raise ValueError(f"schedule row from {first[start]} to {first[end]}: {first['fault']}")


def covering(rows: DataFrame, at: str, schedule: DataFrame, start: str, end: str, columns: Sequence[str], row: Sequence[str]) -> DataFrame:
    """rows with the columns of the schedule's row that covers `at`, and `covered`. Before the first row the first one counts, from the last one's end on the last; in a gap covered is false and the columns are null.

    row: columns that tell the rows apart. Both tables are laid out by value ranges of one line: a row's schedule row has the
    greatest start at or before it, and they meet by that start. Schedules may be of any length.
    """
    marks = schedule.select(F.col(start).cast("double").alias("_t"), F.lit(0).alias("_kind"), F.col(start).cast("double").alias("_start"), *[F.lit(None).cast(kind).alias(c) for c, kind in rows.dtypes if c in row])
    asked = rows.select(F.col(at).cast("double").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_start"), *row)
    found = greatest_before(marks.unionByName(asked), [], "_t", "_start", "_found", ["_kind", *row]).filter("_kind = 1").select(*row, "_found")
    ends = schedule.agg(F.min(F.col(start).cast("double")).alias("_first"), F.max(F.struct(F.col(end).cast("double").alias("e"))).alias("_last"), F.max(F.col(start).cast("double")).alias("_final"))
    keyed = found.join(F.broadcast(ends)).withColumn("_start", F.coalesce("_found", "_first"))  # one row
    planned = schedule.select(F.col(start).cast("double").alias("_start"), F.col(end).cast("double").alias("_end"), *columns)
    met = keyed.join(planned, "_start")
    met = rows.join(met, list(row))
    covered = F.col("_found").isNull() | (F.col(at) < F.col("_end")) | (F.col("_start") == F.col("_final"))
    return met.select(*[rows[c] for c in rows.columns], *[F.when(covered, F.col(c)).alias(c) for c in columns], covered.alias("covered"))
