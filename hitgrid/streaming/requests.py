"""Pending requests of runs: the newest probe wins, and a final request outranks every probe.

What is pending is a maximum, of (final or not, sequence): a micro-batch needs its own one alone, and the state carries one request a run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank(request: Column, sequence: Column) -> Column:
    """What the greatest of stays pending."""
    return F.struct((request == "final").alias("final"), sequence.alias("seq"))


def latest_wins(requests: DataFrame, keys: Sequence[str], trigger: str, request: str = "request", sequence: str = "idx") -> DataFrame:
    """(keys, trigger, request, sequence): what is pending after each trigger that brought requests.

    Every trigger is reduced to its winner first; the running winner goes over these, a row for each run and trigger. Other
    values than `final` are probes; null requests count for nothing.
    """
    some = requests.filter(F.col(request).isNotNull())
    won = some.groupBy(*keys, trigger).agg(F.max_by(F.struct(request, sequence), rank(F.col(request), F.col(sequence))).alias("_r"))
    upto = Window.partitionBy(*keys).orderBy(trigger).rowsBetween(Window.unboundedPreceding, 0)
    return won.withColumn("_r", F.max_by("_r", rank(F.col(f"_r.{request}"), F.col(f"_r.{sequence}"))).over(upto)).select(*keys, trigger, f"_r.{request}", f"_r.{sequence}")


def stream_latest_wins(requests: DataFrame, keys: Sequence[str], request: str = "request", sequence: str = "idx") -> DataFrame:
    """The same over a stream, a trigger being a micro-batch: in update mode, a row for each run whose pending request a batch may have changed."""
    won = requests.filter(F.col(request).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(request, sequence), rank(F.col(request), F.col(sequence))).alias("_r"))
    return won.select(*keys, f"_r.{request}", f"_r.{sequence}")
