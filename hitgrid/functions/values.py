"""Values with uncertainties as STRUCT<value, stdev>, and small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value(v: Column, s: Column) -> Column:
    return F.struct(v.alias("value"), s.alias("stdev"))


def add(a: Column, b: Column) -> Column:
    return value(a["value"] + b["value"], F.sqrt(a["stdev"] * a["stdev"] + b["stdev"] * b["stdev"]))


def subtract(a: Column, b: Column) -> Column:
    return value(a["value"] - b["value"], F.sqrt(a["stdev"] * a["stdev"] + b["stdev"] * b["stdev"]))


def multiply(a: Column, b: Column) -> Column:
    s, t = a["value"] * b["stdev"], b["value"] * a["stdev"]
    return value(a["value"] * b["value"], F.sqrt(s * s + t * t))


def fractional(a: Column) -> Column:
    """stdev / value, 0 for a zero value."""
    return F.when(a["value"] == 0, 0.0).otherwise(a["stdev"] / a["value"])


def divide(a: Column, b: Column) -> Column:
    """Null for a zero divisor."""
    q = F.when(b["value"] != 0, a["value"] / b["value"])
    fa, fb = fractional(a), fractional(b)
    return value(q, F.abs(q) * F.sqrt(fa * fa + fb * fb))


def inverse(a: Column) -> Column:
    return divide(value(F.lit(1.0), F.lit(0.0)), a)


def clamp_logit(p: Column, low: float = 1e-9) -> Column:
    """Logit of a probability kept inside [low, 1 - low]; NaN and null count as 0.5."""
    p = F.when(p.isNull() | F.isnan(p), 0.5).otherwise(F.least(F.greatest(p, F.lit(low)), F.lit(1 - low)))
    return F.log(p / (1 - p))


def rate_from_gate(mean: Column, gate_ns: Column) -> Column:
    """Counts per second from the mean count of a gate."""
    return 1e9 * mean / gate_ns


def distance3(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of three."""
    d = [F.element_at(a, k) - F.element_at(b, k) for k in (1, 2, 3)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def centroid3(a: Column, b: Column) -> Column:
    """The point halfway between two arrays of three."""
    return F.array(*[(F.element_at(a, k) + F.element_at(b, k)) / 2 for k in (1, 2, 3)])


def bias3(predicted: Column, true: Column) -> Column:
    """How far a predicted point lies from a true one, along each axis."""
    return F.array(*[F.element_at(predicted, k) - F.element_at(true, k) for k in (1, 2, 3)])
