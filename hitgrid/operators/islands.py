"""Gaps and islands: segments, streaks and as-of values over ordered rows of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(keys: Sequence[str], *order: str | Column):
    return Window.partitionBy(*keys).orderBy(*order)


def island_ids(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, name: str = "island") -> DataFrame:
    """Adds a number that grows with each change of state in a run; nulls are a state."""
    w = over(keys, *order)
    changed = F.when(F.row_number().over(w) == 1, 0).otherwise((~F.col(state).eqNullSafe(F.lag(state).over(w))).cast("int"))
    return df.withColumn("_changed", changed).withColumn(name, F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def segments(df: DataFrame, keys: Sequence[str], time: str, state: str) -> DataFrame:
    """(keys, island, state, start, end, n): each run of equal states; it ends where the next one starts, the last at its last time."""
    rows = island_ids(df, keys, [time], state)
    spans = rows.groupBy(*keys, "island").agg(F.first(state).alias(state), F.min(time).alias("start"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"))
    return spans.withColumn("end", F.coalesce(F.lead("start").over(over(keys, "island")), F.col("last"))).drop("last")


def streak_lengths(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, name: str = "streak") -> DataFrame:
    """Adds the number of rows up to this one for which flag has held without a break; 0 where it doesn't hold."""
    rows = island_ids(df, keys, order, flag, "_island")
    return rows.withColumn(name, F.when(F.col(flag), F.row_number().over(over([*keys, "_island"], *order))).otherwise(0)).drop("_island")


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, columns: Sequence[str]) -> DataFrame:
    """left with the columns of the last right row of its key at or before its time (null if there is none).

    One shuffle on the keys: both sides are put in one order, and the last right row is carried on. Of right rows at
    equal times the one with the greatest values counts.
    """
    carried = F.struct(*columns)
    a = left.select("*", F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType).alias("_row"))
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), carried.alias("_row"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = over(keys, "_t", "_side", "_row").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_row", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select(*left.columns, *[F.col("_last")[c].alias(c) for c in columns])


def page_hinkley(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, delta: float, threshold: float) -> DataFrame:
    """Adds ph_mean, ph_stat and ph_alarm: the cumulative form, with the running mean up to each row."""
    w = over(keys, *order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("ph_mean", F.avg(x).over(w)).withColumn("_d", F.col(x) - F.col("ph_mean") - delta)
    rows = rows.withColumn("_c", F.sum("_d").over(w))
    return rows.withColumn("ph_stat", F.col("_c") - F.least(F.lit(0.0), F.min("_c").over(w))).withColumn("ph_alarm", F.col("ph_stat") > threshold).drop("_d", "_c")


def clamped_cusum(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Column, name: str = "cusum") -> DataFrame:
    """Adds max(0, previous + step): the running sum less its running minimum, no fold needed."""
    w = over(keys, *order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_s", F.sum(step).over(w))
    return rows.withColumn(name, F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(w))).drop("_s")
