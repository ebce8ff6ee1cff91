"""Ranks, running totals, neighbours and percentiles, over a whole table or within groups, without ordering a group in one task.

A row's part follows from its value alone: it counts the approximate quantiles at or below it. So the part is the
same in every scan and on every retry, whatever the partitioning; the parts of a group are ordered within, and a table of
a row for each group and part carries what a part needs of the parts before it. A single value isn't taken apart:
rows that share one are ordered in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

#: Rows of a part, about: from there on the number of parts follows the rows.
PART_ROWS = 1_000_000
#: Parts at most: the bounds are one literal of 8 bytes each, and the table of offsets of a whole table is broadcast.
MAX_PARTS = 1 << 15
#: Bounds compared at each step of the lookup.
FANOUT = 32


def _quantiles(df: DataFrame, at: Column, n: int) -> tuple[int, list[float]]:
    """The number of values, and bounds between n parts of about as many."""
    size, found = df.agg(F.count(at), F.percentile_approx(at, [k / n for k in range(1, n)], max(10_000, 10 * n))).first()
    return size, sorted(set(found or []))


def part_of(df: DataFrame, key: str) -> Column:
    """The number of the value range that a row's numeric key falls in, ascending; nulls come first.

    There are as many parts as shuffle partitions, or more where these would hold over PART_ROWS rows each. The bounds are looked
    up from coarse to fine: the first one of every block, then those of the block that the key is in. Keys are compared as doubles,
    which keeps their order; keys that are one double are in one part.
    """
    at = F.col(key).cast("double")
    n = min(MAX_PARTS, max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    size, bounds = _quantiles(df, at, n)
    if size > n * PART_ROWS and n < MAX_PARTS:
        bounds = _quantiles(df, at, min(MAX_PARTS, -(-size // PART_ROWS)))[1]
    if not bounds:
        return F.lit(0)
    stride = 1
    while stride * FANOUT < len(bounds):
        stride *= FANOUT
    start, passed = F.lit(0), F.lit(0)
    while stride:
        block = F.slice(F.lit(np.array(bounds[::stride], dtype=np.float64)), start + 1, FANOUT)
        passed = F.size(F.filter(block, lambda bound: bound <= at))
        if stride > 1:
            start = (start + F.greatest(passed, F.lit(1)) - 1) * FANOUT
        stride //= FANOUT
    return F.when(at.isNull(), 0).otherwise(start + passed)


def _with_part_table(parts: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """parts with the columns of a row for each (keys, _part). Without keys these are MAX_PARTS rows at most."""
    if not keys:
        return parts.join(F.broadcast(table), "_part")
    names = [*keys, "_part"]
    other = table.withColumnsRenamed({c: f"_k_{c}" for c in names})
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return parts.join(other, on).drop(*[f"_k_{c}" for c in names])


def running_totals(df: DataFrame, key: str, values: Sequence[str], descending: bool = False, ties: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Adds cum_<value>, the sum of value over all rows of the group (of the table without keys) up to this one in the order of key, then ties."""
    order = [F.desc(c) if descending else F.asc(c) for c in (key, *ties)]
    parts = df.withColumn("_part", -part_of(df, key) if descending else part_of(df, key))
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*keys, "_part").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    sums = sums.select(*keys, "_part", *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values])
    out = _with_part_table(parts.withColumns({f"cum_{v}": F.sum(v).over(within) for v in values}), sums, keys)
    return out.withColumns({f"cum_{v}": F.col(f"cum_{v}") + F.col(f"_o_{v}") for v in values}).drop("_part", *[f"_o_{v}" for v in values])


def places(df: DataFrame, key: str, ties: Sequence[str] = (), name: str = "place", keys: Sequence[str] = ()) -> DataFrame:
    """Adds each row's place in its group in the order of key, then ties, from 0."""
    rows = running_totals(df.withColumn("_one", F.lit(1).cast("long")), key, ["_one"], ties=ties, keys=keys)
    return rows.withColumn(name, F.col("cum__one") - 1).drop("_one", "cum__one")


def before(df: DataFrame, keys: Sequence[str], key: str, columns: dict[str, str], ties: Sequence[str] = ()) -> DataFrame:
    """Adds, under the names in columns, values of the row before this one in its group, by key, then ties (which tell all rows apart); nulls for the first."""
    parts = df.withColumn("_part", part_of(df, key))
    w = Window.partitionBy(*keys, "_part").orderBy(key, *ties)
    taken = F.struct(*columns.values())
    last = parts.groupBy(*keys, "_part").agg(F.max(F.struct(key, *ties, taken.alias("_v")))["_v"].alias("_last"))
    last = last.select(*keys, "_part", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_part")).alias("_last"))
    out = _with_part_table(parts.withColumn("_v", F.lag(taken).over(w)), last, keys)
    held = F.coalesce("_v", "_last")
    return out.select(*df.columns, *[held[c].alias(n) for n, c in columns.items()])


def greatest_before(df: DataFrame, keys: Sequence[str], key: str, value: str, name: str, ties: Sequence[str] = ()) -> DataFrame:
    """Adds the greatest value of all rows before this one in its group; null for the first."""
    parts = df.withColumn("_part", part_of(df, key))
    w = Window.partitionBy(*keys, "_part").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    tops = parts.groupBy(*keys, "_part").agg(F.max(value).alias("_top"))
    tops = tops.select(*keys, "_part", F.max("_top").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_top"))
    out = _with_part_table(parts.withColumn("_own", F.max(value).over(w)), tops, keys)
    return out.select(*df.columns, F.greatest("_own", "_top").alias(name))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], weight: str | None = None) -> DataFrame:
    """(keys, one column for each wanted share): exact percentiles with linear interpolation, nulls aside; groups of nulls alone have none.

    Equal values are counted within the range of their values first, and written down once: counts are what ranges are sized by, what
    totals and places come from, and what is read at the wanted places. With a weight, a row stands for so many.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x"), *([F.col(weight).alias("_w")] if weight else []))
    table = written(rows.groupBy(*keys, "_x").agg((F.sum("_w") if weight else F.count(F.lit(1))).alias("_n")), "counts")
    counts = table.withColumn("_part", part_of(table, "_x"))
    sums = counts.groupBy(*keys, "_part").agg(F.sum("_n").alias("_s"))
    whole = Window.partitionBy(*keys)
    sums = sums.select(*keys, "_part", (F.sum("_s").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_before"), F.col("_s"), F.sum("_s").over(whole).alias("_total"))
    at = {n: q * (F.col("_total") - 1) for n, q in wanted.items()}

    def holds(rank: Column, first: Column, n: Column) -> Column:
        return (rank >= first) & (rank < first + n)

    def near(first: Column, n: Column) -> Column:
        out = F.lit(False)
        for a in at.values():
            out = out | holds(F.floor(a), first, n) | holds(F.ceil(a), first, n)
        return out

    # Only ranges that hold a wanted place are put in order.
    sums = sums.filter(near(F.col("_before"), F.col("_s"))).drop("_s")
    within = Window.partitionBy(*keys, "_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    found = _with_part_table(counts, sums, keys).withColumn("_first", F.col("_before") + F.sum("_n").over(within) - F.col("_n"))
    first, n = F.col("_first"), F.col("_n")
    low = {k: F.max(F.when(holds(F.floor(a), first, n), F.col("_x"))) for k, a in at.items()}
    high = {k: F.max(F.when(holds(F.ceil(a), first, n), F.col("_x"))) for k, a in at.items()}
    share = {k: F.max(a - F.floor(a)) for k, a in at.items()}
    return found.filter(near(first, n)).groupBy(*keys).agg(*[(low[k] + (high[k] - low[k]) * share[k]).alias(k) for k in wanted])


def trailing_counts(df: DataFrame, keys: Sequence[str], key: str, width: Column, row: Sequence[str], name: str = "trailing") -> DataFrame:
    """(keys, row, name): for each row, which the columns `row` tell apart within its group, how many rows of the group lie in [t - width, t); a width for each row.

    The difference of two cumulative counts: every row asks at t and at t - width, and counts once behind all questions at its
    own t. Rows without a time or width ask for nothing and get 0.
    """
    one = lambda kind, at, weight: F.struct(F.lit(kind).alias("_kind"), at.cast("double").alias("_at"), F.lit(weight).cast("long").alias("_one"))
    t = F.col(key)
    asked = df.select(*keys, *row, F.explode(F.array(one(1, t, 0), one(-1, t - width, 0), one(2, t, 1))).alias("_q")).select(*keys, *row, "_q.*")
    asked = asked.withColumn("_order", (F.col("_kind") == 2).cast("int"))
    counted = running_totals(asked.filter(F.col("_at").isNotNull()), "_at", ["_one"], ties=["_order"], keys=keys).filter("_kind < 2")
    sums = counted.groupBy(*keys, *row).agg(F.sum(F.col("_kind") * F.col("cum__one")).alias(name), F.count(F.lit(1)).alias("_both"))
    return sums.withColumn(name, F.when(F.col("_both") == 2, F.greatest(name, F.lit(0))).otherwise(0)).drop("_both")


def exponential_mean(df: DataFrame, keys: Sequence[str], order: str, value: Column, keep: float = 0.99, ties: Sequence[str] = (), name: str = "ewma") -> DataFrame:
    """Adds mean_k = keep * mean_(k-1) + (1 - keep) * value_k in the order of a group, from 0.

    A decayed prefix sum: stretches of rows are summed in their tasks, each as at its end, and a stretch's sum goes on to the
    next ones, decayed by their lengths, until nothing of it is left in double precision. No group is folded in one task.
    """
    stretch = max(1, min(256, int(5 / -math.log(keep))))  # within one, keep ** -stretch is at most e ** 5
    reach = math.ceil(math.log(1e-20) / (stretch * math.log(keep)))
    rows = places(df.withColumn("_v", value.cast("double") * (1 - keep)), order, ties, "_place", keys)
    rows = rows.withColumns({"_s": F.expr(f"_place div {stretch}"), "_j": F.col("_place") % stretch})
    w = Window.partitionBy(*keys, "_s").orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", F.pow(F.lit(keep), F.col("_j")) * F.sum(F.col("_v") * F.pow(F.lit(1 / keep), F.col("_j"))).over(w))
    ends = rows.groupBy(*keys, "_s").agg(F.sum(F.col("_v") * F.pow(F.lit(keep), stretch - 1 - F.col("_j"))).alias("_end"))
    ahead = ends.select(*keys, F.col("_s").alias("_from"), "_end", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("_d"))
    carried = ahead.groupBy(*keys, (F.col("_from") + F.col("_d")).alias("_part")).agg(F.sum(F.col("_end") * F.pow(F.lit(keep), (F.col("_d") - 1) * stretch)).alias("_carry"))
    names = [*keys, "_part"]
    other = carried.withColumnsRenamed({c: f"_k_{c}" for c in names})
    on = F.col("_s") == F.col("_k__part")
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    out = rows.join(other, on, "left")
    mean = F.col("_own") + F.coalesce("_carry", F.lit(0.0)) * F.pow(F.lit(keep), F.col("_j") + 1)
    return out.select(*df.columns, mean.alias(name))
