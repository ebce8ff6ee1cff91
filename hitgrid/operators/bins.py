"""Layer A: events to bins, bins to gates, gates to moments. All of it is associative grouped aggregation.

Events are counted per base bin first, so windows and gate ladders multiply bins, not events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def base_bins(detections: DataFrame, delta_us: int, by_channel: bool = True) -> DataFrame:
    """(run_id, bin, [channel], n): events of each bin of delta_us."""
    keys = ["run_id", F.expr(f"ts_us div {delta_us}").alias("bin"), *(["channel"] if by_channel else [])]
    return detections.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def sliding_windows(bins: DataFrame, delta_us: int, window_us: int, step_us: int) -> DataFrame:
    """bins with win, the index of every window [win * step, win * step + window) that holds the bin."""
    if window_us // step_us > 100:
        raise ValueError("more than 100 windows for each bin: take wider steps")
    start = F.col("bin") * delta_us
    first = F.floor((start - window_us) / step_us) + 1
    last = F.floor(start / step_us)
    return bins.withColumn("win", F.explode(F.sequence(first, last)))


def gate_counts(windowed: DataFrame, delta_us: int, window_us: int, step_us: int, gates_us: Sequence[int]) -> DataFrame:
    """(run_id, win, gate_us, gate_idx, n) of non-empty gates, aligned to the window's left edge; a partial last gate is ignored."""
    gates = F.explode(F.array(*[F.lit(g).cast("long") for g in gates_us]))
    offset = F.col("bin") * delta_us - F.col("win") * step_us
    rows = windowed.withColumn("gate_us", gates).withColumn("gate_idx", F.floor(offset / F.col("gate_us")))
    rows = rows.filter(F.col("gate_idx") < F.floor(F.lit(window_us) / F.col("gate_us")))
    return rows.groupBy("run_id", "win", "gate_us", "gate_idx").agg(F.sum("n").alias("n"))


def moment_sums(gates: DataFrame, window_us: int, keys: Sequence[str] = ("run_id", "win", "gate_us")) -> DataFrame:
    """Power sums of the gate counts and their falling factorials; n_gates counts empty gates, too."""
    n = F.col("n").cast("double")  # the squares of the third order leave a long from some 1,450 events in a gate on
    f2, f3 = n * (n - 1), n * (n - 1) * (n - 2)
    sums = {"s1": n, "s2": f2, "s3": f3, "q11": n * n, "q22": f2 * f2, "q33": f3 * f3, "q12": n * f2, "q13": n * f3, "q23": f2 * f3}
    return gates.groupBy(*keys).agg(*[F.sum(v).alias(k) for k, v in sums.items()]).withColumn("n_gates", F.greatest(F.floor(F.lit(window_us) / F.col("gate_us")), F.lit(1)))


def factorial_moments(sums: DataFrame) -> DataFrame:
    """Adds m1, m2, m3."""
    return sums.withColumns({f"m{k}": F.col(f"s{k}") / F.col("n_gates") for k in (1, 2, 3)})


def moment_covariance(moments: DataFrame) -> DataFrame:
    """Adds the covariance of the means, v11 .. v33: sample covariance over the number of gates, variances not negative."""
    n, free = F.col("n_gates"), F.greatest(F.col("n_gates") - 1, F.lit(1))

    def cov(i: int, j: int) -> Column:
        c = (F.col(f"q{i}{j}") - n * F.col(f"m{i}") * F.col(f"m{j}")) / free
        return (F.greatest(c, F.lit(0.0)) if i == j else c) / n

    return moments.withColumns({f"v{i}{j}": cov(i, j) for i in (1, 2, 3) for j in range(i, 4)})


def ridge(moments: DataFrame, epsilon: float = 1e-3) -> DataFrame:
    """Adds r11, r22, r33, the variances with a ridge of epsilon * max(1, the largest), and ridge_ok: the largest is positive."""
    most = F.greatest("v11", "v22", "v33")
    more = epsilon * F.greatest(F.lit(1.0), most)
    return moments.withColumns({**{f"r{k}{k}": F.col(f"v{k}{k}") + more for k in (1, 2, 3)}, "ridge_ok": most > 0})


def feynman_y(moments: DataFrame) -> DataFrame:
    """Adds y, sigma_y (null without a value), z and valid, by the delta method on ridged variances."""
    m1, m2 = F.col("m1"), F.col("m2")
    y = F.when(m1 > 0, (m2 - m1 * m1) / m1).otherwise(0.0)
    a, b = -m2 / (m1 * m1) - 1, 1 / m1
    var = F.greatest(F.lit(0.0), a * a * F.col("r11") + b * b * F.col("r22") + 2 * a * b * F.col("v12"))
    sigma = F.when((F.col("n_gates") > 1) & F.col("ridge_ok") & (m1 > 0) & (var > 0), F.sqrt(var))
    return moments.withColumn("y", y).withColumn("sigma_y", sigma).withColumn("valid", F.col("sigma_y").isNotNull()).withColumn("z", F.col("y") / F.col("sigma_y"))


def ladder(detections: DataFrame, delta_us: int, window_us: int, step_us: int, gates_us: Sequence[int]) -> DataFrame:
    """Moments, covariances and Feynman-Y for every run, window and gate width."""
    bins = base_bins(detections, delta_us, by_channel=False)
    counts = gate_counts(sliding_windows(bins, delta_us, window_us, step_us), delta_us, window_us, step_us, gates_us)
    return feynman_y(ridge(moment_covariance(factorial_moments(moment_sums(counts, window_us)))))


def multiplicity_histogram(gates: DataFrame, n_gates: Column, keys: Sequence[str]) -> DataFrame:
    """(keys, n, freq) with the row of empty gates, of which there are n_gates less the others."""
    full = gates.groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("freq"))
    zero = full.groupBy(*keys).agg(F.sum("freq").alias("seen")).withColumn("n", F.lit(0).cast("long")).withColumn("freq", n_gates - F.col("seen"))
    return full.unionByName(zero.select(*keys, "n", "freq").filter("freq > 0"))


def binomial(n: Column, k: int) -> Column:
    """C(n, k) as a double."""
    out = F.lit(1.0)
    for i in range(k):
        out = out * (n - i) / (i + 1)
    return F.when(n >= k, out).otherwise(0.0)


def histogram_moments(histogram: DataFrame, keys: Sequence[str], order: int = 8) -> DataFrame:
    """(keys, m0 .. m_order): m0 the total, m_k = sum C(n, k) freq / sum freq."""
    total = F.sum("freq").cast("double")
    return histogram.groupBy(*keys).agg(total.alias("m0"), *[(F.sum(binomial(F.col("n"), k) * F.col("freq")) / total).alias(f"m{k}") for k in range(1, order + 1)])
