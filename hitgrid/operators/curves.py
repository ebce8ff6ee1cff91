"""Score curves and calibration: one grouping by score, then cumulative sums over value ranges; nothing is quadratic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import running_totals


def curve(scored: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """(score, tp, fp, tpr, fpr, precision): a point for each distinct score, scores at or above it counting as positive."""
    by_score = scored.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum((1 - F.col(label)).cast("long")).alias("neg"))
    totals = by_score.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    rows = running_totals(by_score, score, ["pos", "neg"], descending=True).join(F.broadcast(totals))  # one row
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return rows.select(score, tp.alias("tp"), fp.alias("fp"), F.when(F.col("all_pos") > 0, tp / F.col("all_pos")).alias("tpr"), F.when(F.col("all_neg") > 0, fp / F.col("all_neg")).alias("fpr"), (tp / (tp + fp)).alias("precision"), "pos", "neg", "all_pos", "all_neg")


def areas(points: DataFrame) -> DataFrame:
    """roc_auc and pr_auc by trapezoids: each point's step comes from its own counts, so no lag over the whole curve is needed for ROC;
    for PR the point before is the totals less the own counts (the first starts at recall 0, precision 1)."""
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    roc = (F.col("neg") / F.col("all_neg")) * (tp0 + F.col("tp")) / (2 * F.col("all_pos"))
    before = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(1.0)
    pr = (F.col("pos") / F.col("all_pos")) * (before + F.col("precision")) / 2
    return points.agg(F.sum(roc).alias("roc_auc"), F.sum(pr).alias("pr_auc"))


def platt(scored: DataFrame, score: str = "x", label: str = "y", rounds: int = 25, tolerance: float = 1e-9) -> tuple[float, float]:
    """(a, b) of sigma(a x + b) by Newton steps: each is one aggregation to five sums, solved on the driver."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.lit(a) * F.col(score) + F.lit(b))))
        w, d, x = p * (1 - p), p - F.col(label), F.col(score)
        s = scored.agg(F.sum(d * x).alias("ga"), F.sum(d).alias("gb"), F.sum(w * x * x).alias("haa"), F.sum(w * x).alias("hab"), F.sum(w).alias("hbb")).first()
        if s["hbb"] is None:
            return a, b
        haa, hbb = s["haa"] + 1e-12, s["hbb"] + 1e-12
        det = haa * hbb - s["hab"] ** 2
        if abs(det) < 1e-18:
            return a, b
        da, db = (s["ga"] * hbb - s["gb"] * s["hab"]) / det, (s["gb"] * haa - s["ga"] * s["hab"]) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < tolerance:
            break
    return a, b


def isotonic(scored: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """(x, y, n): blocks of the monotone fit, x and y their means, in the order of x.

    Pooling adjacent violators is associative over neighbouring blocks: each range of scores is pooled in its task,
    and the blocks that survive are pooled again in one. Their means are fractions that rise from 0 to 1, so n scores
    leave some n ** (2 / 3) blocks at most; they stream through that task.
    """
    import pandas as pd

    def pool(rows: list[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
        """(least score, sum of scores, sum of labels, weight) blocks."""
        out: list[tuple[float, float, float, float]] = []
        for row in rows:
            out.append(row)
            while len(out) > 1 and out[-2][2] / out[-2][3] >= out[-1][2] / out[-1][3]:
                b, a = out.pop(), out.pop()
                out.append((a[0], a[1] + b[1], a[2] + b[2], a[3] + b[3]))
        return out

    def run(batches):
        held: list[tuple[float, float, float, float]] = []
        for pdf in batches:
            held = pool(held + list(pdf[["lo", "sx", "sy", "w"]].itertuples(index=False, name=None)))
        if held:
            yield pd.DataFrame(held, columns=["lo", "sx", "sy", "w"])

    sums = scored.groupBy(score).agg(F.sum(F.col(label).cast("double")).alias("sy"), F.count(F.lit(1)).cast("double").alias("w"))
    sums = sums.select(F.col(score).cast("double").alias("lo"), (F.col(score) * F.col("w")).alias("sx"), "sy", "w")
    schema = "lo double, sx double, sy double, w double"
    local = sums.repartitionByRange("lo").sortWithinPartitions("lo").mapInPandas(run, schema)
    whole = local.coalesce(1).sortWithinPartitions("lo").mapInPandas(run, schema)
    return whole.select((F.col("sx") / F.col("w")).alias("x"), (F.col("sy") / F.col("w")).alias("y"), F.col("w").cast("long").alias("n"))


def knots(blocks: DataFrame) -> DataFrame:
    """One row (xs, ys): the blocks of `isotonic` as knots in ascending order, with the first value from 0 and the last one to 1. No blocks: null arrays.

    Blocks are few (see there), and each is a fact of its own: the arrays are no group of rows.
    """
    sorted_ = blocks.agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("k"))
    first, last = F.element_at("k", 1), F.element_at("k", -1)
    whole = F.concat(F.when(first["x"] > 0, F.array(F.struct(F.lit(0.0).alias("x"), first["y"].alias("y")))).otherwise(F.slice("k", 1, 0)), F.col("k"), F.when(last["x"] < 1, F.array(F.struct(F.lit(1.0).alias("x"), last["y"].alias("y")))).otherwise(F.slice("k", 1, 0)))
    return sorted_.filter(F.size("k") > 0).select(whole.alias("k")).select(F.transform("k", lambda r: r["x"]).alias("xs"), F.transform("k", lambda r: r["y"]).alias("ys"))


def interpolated(p: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """The value at p on the line through sorted knots, clamped to both ends and to [0, 1]; p itself where there are none. Found by halving: 20 comparisons for a million knots."""
    if not len(xs):
        return p
    xs_, ys_ = F.array(*[F.lit(float(v)) for v in xs]), F.array(*[F.lit(float(v)) for v in ys])
    steps = max(1, (len(xs) - 1).bit_length() + 1)
    at = lambda values, k: F.element_at(values, k.cast("int"))
    # (low, high): the first knot at or above p lies in (low, high], counted from 1.
    halve = lambda s, _: F.when(s["high"] - s["low"] <= 1, s).when(at(xs_, F.floor((s["low"] + s["high"]) / 2)) >= p, F.struct(s["low"].alias("low"), F.floor((s["low"] + s["high"]) / 2).cast("int").alias("high"))).otherwise(F.struct(F.floor((s["low"] + s["high"]) / 2).cast("int").alias("low"), s["high"].alias("high")))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(1).alias("low"), F.lit(len(xs)).alias("high")), halve)
    k = found["high"]
    x0, x1, y0, y1 = at(xs_, F.greatest(k - 1, F.lit(1))), at(xs_, k), at(ys_, F.greatest(k - 1, F.lit(1))), at(ys_, k)
    line = F.when(x1 > x0, y0 + (p - x0) / F.nullif(x1 - x0, F.lit(0.0)) * (y1 - y0)).otherwise(y1)
    return F.when(p <= float(xs[0]), F.lit(float(ys[0]))).when(p >= float(xs[-1]), F.lit(float(ys[-1]))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), line)))
