"""The Feynman family from reduced factorial moments m1 .. m8 of a gate, with errors by the delta method.

Every member is written once, as an expression of m1 .. m4; its derivatives and errors follow from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .delta import Jet

#: The members in the order of reports.
MEMBERS = ["y1", "y2", "y3", "y4", "ym", "y2f", "y3f", "y4f", "ysm2", "ysm3", "ysm4", "ybeta"]


def _m(k: int) -> Jet:
    return Jet(F.col(f"m{k}"), {k: F.lit(1.0)})


def cumulants() -> dict[str, Jet]:
    """y1 .. y4 of a gate, before the scale of its width."""
    m1, m2, m3, m4 = map(_m, (1, 2, 3, 4))
    return {"y1": m1, "y2": m2 - m1**2 / 2, "y3": m3 - m2 * m1 + m1**3 / 3, "y4": m4 - m3 * m1 + m2 * m1**2 - m2**2 / 2 - m1**4 / 4}


def members() -> dict[str, Jet]:
    """All members, of a gate of one second."""
    y, m1, m2, m3 = cumulants(), *map(_m, (1, 2, 3))
    out = dict(y) | {"ym": m2 * 2 / m1 - m1} | {f"y{k}f": y[f"y{k}"] / m1 for k in (2, 3, 4)} | {f"ysm{k}": y[f"y{k}"] / m1**k for k in (2, 3, 4)}
    return out | {"ybeta": (m1**2 - m2 * 2) ** 2 * 3 / ((m1**3 - m1 * m2 * 3 + m3 * 3) * m1 * 4)}


def _seconds(name: str, gate_ns: Column) -> Column:
    """The factor of the gate's width: y1 .. y4 are per second, ysm-k goes with the power of k - 1 of the width, others have none."""
    second = gate_ns / 1e9
    if name in ("y1", "y2", "y3", "y4"):
        return 1 / second
    out = F.lit(1.0)
    for _ in range(int(name[-1]) - 1 if name.startswith("ysm") else 0):
        out = out * second
    return out


def _is_zero(name: str, gate_ns: Column) -> Column:
    """Where a member is 0 by rule."""
    m1, m2, m3 = (F.col(f"m{k}") for k in (1, 2, 3))
    if name in ("y1", "y2", "y3", "y4"):
        return gate_ns <= 0
    if name.startswith("ysm"):
        return (gate_ns <= 0) | (m1 == 0)
    if name == "ybeta":
        return (m1 <= 0) | (m2 <= 0) | (m3 <= 0) | ((m1 * m1 * m1 - 3 * m1 * m2 + 3 * m3) * m1 == 0)
    return m1 <= 0


def y_family(gate_ns: Column) -> dict[str, Column]:
    """Y1..Y4 per second, Ym, Y2f..Y4f, the ratios Ysm2..4 of Y2..4 to powers of Y1, and Ybeta; 0 where a guard says so."""
    return {name: F.when(_is_zero(name, gate_ns), F.lit(0.0)).otherwise(y.value * _seconds(name, gate_ns)) for name, y in members().items()}


def moment_sigmas() -> dict[str, Column]:
    """Variances and covariances of single-gate reduced moments, not divided by cycles."""
    m = {k: F.col(f"m{k}") for k in range(1, 9)}
    return {
        "s11": 2 * m[2] + m[1] - m[1] * m[1],
        "s22": 6 * m[4] + 6 * m[3] + m[2] - m[2] * m[2],
        "s33": 20 * m[6] + 30 * m[5] + 12 * m[4] + m[3] - m[3] * m[3],
        "s44": 70 * m[8] + 140 * m[7] + 90 * m[6] + 20 * m[5] + m[4] - m[4] * m[4],
        "s12": 3 * m[3] + 2 * m[2] - m[1] * m[2],
        "s13": 4 * m[4] + 3 * m[3] - m[1] * m[3],
        "s14": 5 * m[5] + 4 * m[4] - m[1] * m[4],
        "s23": 10 * m[5] + 12 * m[4] + 3 * m[3] - m[2] * m[3],
        "s24": 15 * m[6] + 20 * m[5] + 6 * m[4] - m[2] * m[4],
        "s34": 35 * m[7] + 60 * m[6] + 30 * m[5] + 4 * m[4] - m[3] * m[4],
    }


def y_gradients() -> dict[str, dict[int, Column]]:
    """Partial derivatives of all members (of a gate of one second) by m1 .. m4; infinite or NaN where a divisor is 0."""
    return {name: y.slopes for name, y in members().items()}


def with_variances(moments: DataFrame) -> DataFrame:
    """Adds, for every member of a gate of one second, d{k}_{member} (partial derivatives), v_{member} (the single-gate variance, not
    divided by cycles) and size_{member} (the sum of its terms' sizes: below some 1e-9 of it nothing is left of a variance but rounding)."""
    slopes = moments.withColumns({f"d{k}_{name}": slope for name, own in y_gradients().items() for k, slope in own.items()})
    cov = moment_sigmas()
    jets = {name: Jet(F.lit(0.0), {k: F.col(f"d{k}_{name}") for k in y.slopes}) for name, y in members().items()}
    return slopes.withColumns({f"{c}_{name}": y.variance(lambda i, j: cov[f"s{i}{j}"], c == "size") for name, y in jets.items() for c in ("v", "size")})


def y_sigma(gate_ns: Column, cycles: Column, by_root: bool = True) -> dict[str, Column]:
    """Standard errors of all members, from the columns of `with_variances`: the root of the variance over the root of cycles - 1, or over cycles - 1 itself.

    -1 for fewer than two cycles (times the gate's factor for ysm; also for a gate below 1 ns for y1 .. y4), 0 for a negative variance.
    """
    out = {}
    for name in MEMBERS:
        var, few, scale = F.col(f"v_{name}"), cycles < 2, _seconds(name, gate_ns)
        if name in ("y1", "y2", "y3", "y4"):
            few = few | (gate_ns < 1)
        none = F.lit(-1.0) * scale if name.startswith("ysm") else F.lit(-1.0)
        per = F.sqrt(cycles - 1.0) if by_root else cycles - 1.0
        out[f"sigma_{name}"] = F.when(few, none).when(var < 0, F.lit(0.0)).otherwise(F.sqrt(var) / per * scale)
    return out
