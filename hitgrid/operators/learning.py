"""Distributed model and statistics jobs: splits, forests, importance, Mahalanobis distances, fault injection."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .curves import platt
from ..tables import discard, written
from .forest import Forest, binned, grow, grown, mean_by
from .ranges import part_of, places


def share(key: Column, seed: int) -> Column:
    """A number in [0, 1) for a row, from a hash of its key: the same on every run and any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / 1_000_000.0


def stratified_split(df: DataFrame, key: str, label: str, fraction: float, seed: int = 7) -> DataFrame:
    """Adds holdout: round(n * fraction) rows of every label, the first in the order of a hash.

    The cut is a quantile of the hash, found by counting its buckets, so no label is ordered in one task.
    """
    h = F.xxhash64(F.lit(seed), key)
    bucket = F.shiftrightunsigned(h, 52)  # 4096 buckets
    rows = df.withColumns({"_h": h, "_b": bucket})
    counts = rows.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"upto": F.sum("n").over(w), "want": F.round(F.sum("n").over(Window.partitionBy(label)) * fraction)})
    counts = counts.withColumn("_take", F.when(F.col("upto") <= F.col("want"), F.col("n")).otherwise(F.greatest(F.lit(0), F.col("want") - F.col("upto") + F.col("n")))).select(label, "_b", "_take")
    edge = Window.partitionBy(label, "_b").orderBy("_h", key)
    return rows.join(counts, [label, "_b"]).withColumn("holdout", F.row_number().over(edge) <= F.col("_take")).drop("_h", "_b", "_take")


def group_split(df: DataFrame, group: str, fraction: float, seed: int = 7) -> DataFrame:
    """Adds holdout: whole groups, max(1, round(g * fraction)) of them, the first in the order of a hash."""
    groups = df.select(group).distinct()
    n = groups.count()
    held = groups.orderBy(F.xxhash64(F.lit(seed), group), group).limit(max(1, round(n * fraction))).withColumn("holdout", F.lit(True))
    return df.join(held, group, "left").withColumn("holdout", F.coalesce("holdout", F.lit(False)))


def classifier(train: DataFrame, features: Sequence[str], label: str, trees: int = 200, depth: int = 6, seed: int = 7) -> Forest:
    """A forest of 64 leaves at most a tree, by its depth; labels are 0 and 1. A node looks at the square root of the features' number."""
    return grow(train, features, {"p": label}, _root(features), trees, depth, seed)[0]


def _root(features: Sequence[str]) -> int:
    return math.ceil(math.sqrt(len(features)))


def _third(features: Sequence[str]) -> int:
    return max(1, math.ceil(len(features) / 3))


def fold_classifiers(rows: DataFrame, features: Sequence[str], label: str, fold: str, folds: int, trees: int = 200, depth: int = 6, seed: int = 7) -> list[Forest]:
    """For each fold the `classifier` of all rows but its own. Rows are binned once, at each fold's own bounds, and all forests grow together."""
    names = [f"p{k}" for k in range(folds)]
    table = binned(rows, features, [(F.col(fold) != k, {name: label}) for k, name in enumerate(names)], seed)
    found = grown(table, names, _root(features), trees, depth, seed, alike=True)
    discard(table.table)
    return found


def fold_probabilities(models: Sequence[Forest], rows: DataFrame, fold: str, name: str = "p") -> DataFrame:
    """rows with the share of votes of their own fold's forest, which has not seen them; all folds in one look at the rows."""
    return rows.withColumn(name, mean_by(F.col(fold), models))


def regressors(train: DataFrame, features: Sequence[str], targets: Sequence[str], trees: int = 200, depth: int = 7, seed: int = 7) -> list[Forest]:
    """A forest for each target, of 128 leaves at most a tree, by its depth. A node looks at a third of the features."""
    return grow(train, features, {f"pred_{t}": t for t in targets}, _third(features), trees, depth, seed)


def classifier_and_regressors(train: DataFrame, features: Sequence[str], label: str, kinds: dict[str, tuple[int, Sequence[str]]], trees: int = 200, depths: tuple[int, int] = (6, 7), seed: int = 7) -> tuple[Forest, list[Forest]]:
    """The `classifier`, and for each prefix of `kinds` the `regressors` of its targets over the rows with its label, named <prefix><target>. Rows are binned once."""
    sets = [(F.col(label) == value, {prefix + t: t for t in targets}) for prefix, (value, targets) in kinds.items()]
    table = binned(train, features, [(None, {"p": label}), *sets], seed)
    model = grown(table, ["p"], _root(features), trees, depths[0], seed)[0]
    found = [f for _, labels in sets for f in grown(table, list(labels), _third(features), trees, depths[1], seed)]
    discard(table.table)
    return model, found


def probabilities(model: Forest, df: DataFrame, name: str = "p", calibration: tuple[float, float] | None = None) -> DataFrame:
    """The forest's share of votes for label 1; with a calibration, its sigmoid of that share's logit."""
    share_of_votes = model.mean()
    if calibration is None:
        return df.withColumn(name, share_of_votes)
    a, b = calibration
    scored = df.withColumn("_votes", share_of_votes)
    return scored.withColumn(name, 1 / (1 + F.exp(-(F.lit(a) * _logit(F.col("_votes")) + F.lit(b))))).drop("_votes")


def _logit(p: Column, margin: float = 1e-9) -> Column:
    q = F.greatest(F.lit(margin), F.least(F.lit(1 - margin), p))
    return F.log(q / (1 - q))


def calibration(model: Forest, train: DataFrame, label: str) -> tuple[float, float]:
    """Platt's sigmoid over the forest's scores of the training rows."""
    scored = probabilities(model, train).select(_logit(F.col("p")).alias("x"), F.col(label).cast("double").alias("y")).persist()
    try:
        return platt(scored)
    finally:
        scored.unpersist()


def grouped_auc(scored: DataFrame, keys: Sequence[str], score: str = "p", label: str = "y", part: Column | None = None) -> DataFrame:
    """(keys, roc_auc) of every group at once: the share of pairs in the right order, ties counting half.

    The pairs within a range of scores are counted where it lies, those across ranges from the ranges' totals, so scores are made and dealt
    out once. `part` numbers the ranges; the bounds of other scores than these do as well, and save a look at these.
    """
    at = [*keys, "_part"]
    rows = scored.select(*keys, score, F.col(label).cast("long").alias("_pos"), (part_of(scored, score) if part is None else part).alias("_part")).repartition(*at)
    counts = rows.groupBy(*at, score).agg(F.sum("_pos").alias("pos"), F.sum(1 - F.col("_pos")).alias("neg"))
    below = F.sum("neg").over(Window.partitionBy(*at).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)) - F.col("neg") / 2
    parts = counts.withColumn("right", F.col("pos") * below).groupBy(*at).agg(*[F.sum(c).alias(c) for c in ("right", "pos", "neg")])
    before = F.sum("neg").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("neg")
    right = F.sum(F.col("right") + F.col("pos") * F.col("before"))
    return parts.withColumn("before", before).groupBy(*keys).agg((right / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))


def permutation_importance(model: Forest, test: DataFrame, features: Sequence[str], key: str, label: str, shuffles: int = 5, seed: int = 5) -> DataFrame:
    """(feature, drop): the mean loss of area under the curve over `shuffles` dealings of one feature's values.

    A dealing pairs each row with another one by their places in two orders by hash, and only these pairs are shuffled, `shuffles`
    times the rows. Where they meet, a pair makes a row for each feature, with that feature's value from the
    other one, and is scored once: ranges of scores go by the scores of the rows as they are.
    """
    dealings = F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))).alias("_round")
    dealt = test.select(key, label, F.array(*[F.col(f).cast("double") for f in features]).alias("_x"), dealings)
    dealt = dealt.withColumns({"_h": F.xxhash64(F.lit(seed), "_round", key), "_g": F.xxhash64(F.lit(seed + 1), "_round", key)})
    rows = places(dealt.drop("_g"), "_h", [key], keys=["_round"])
    others = places(dealt.select("_round", "_g", key, F.col("_x").alias("_y")), "_g", [key], keys=["_round"]).select("_round", "place", "_y")
    pairs = rows.join(others, ["_round", "place"]).select("_round", label, "_x", "_y", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))).alias("_f"))
    moved = [F.when(F.col("_f") == k, F.element_at("_y", k + 1)).otherwise(F.element_at("_x", k + 1)).alias(f) for k, f in enumerate(features)]
    mixed = pairs.select((F.col("_f") * shuffles + F.col("_round")).alias("deal"), label, *moved)
    feature = F.expr(f"deal div {shuffles}").cast("int")
    plain = written(probabilities(model, test).select(F.lit(-1).alias("deal"), label, "p"), "scores")
    part = part_of(plain, "p")
    areas = grouped_auc(probabilities(model, mixed), ["deal"], label=label, part=part)
    base = grouped_auc(plain, ["deal"], label=label, part=part).select(F.col("roc_auc").alias("base"))
    named = F.element_at(F.array(*map(F.lit, features)), feature + 1)
    return areas.crossJoin(F.broadcast(base)).groupBy(named.alias("feature")).agg(F.avg(F.col("base") - F.col("roc_auc")).alias("drop"))  # base is one row


def shuffled(df: DataFrame, key: str, column: str, seed: int) -> DataFrame:
    """df with one column's values dealt out anew: rows and values pair up by their places in two hash orders."""
    a = places(df.drop(column).withColumn("_h", F.xxhash64(F.lit(seed), key)), "_h")
    b = places(df.select(F.col(column), F.xxhash64(F.lit(seed + 1), key).alias("_g")), "_g").drop("_g")
    return a.join(b, "place").drop("place", "_h")


def mahalanobis_fit(df: DataFrame, columns: Sequence[str], ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(mean, inverse covariance) from one aggregation; the small matrix is inverted on the driver."""
    n = len(columns)
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]).first()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    return np.array([row[f"m{i}"] or 0.0 for i in range(n)]), np.linalg.inv(cov + ridge * np.eye(n))


def mahalanobis(columns: Sequence[str], mean: np.ndarray, inverse: np.ndarray) -> Column:
    d = [F.col(c) - float(m) for c, m in zip(columns, mean, strict=True)]
    total = F.lit(0.0)
    for i in range(len(d)):
        for j in range(len(d)):
            total = total + d[i] * d[j] * float(inverse[i, j])
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def inject_faults(df: DataFrame, columns: Sequence[str], key: str, seed: int = 11) -> DataFrame:
    """Four faulty variants of each row: a dead channel, drifting gains, flattened counts, a wrong duration. Random by hash, so repeatable."""
    dead = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(len(columns)))
    mean = sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)
    variants = {
        "dead_tube": [F.when(dead == k, 0.0).otherwise(F.col(c)) for k, c in enumerate(columns)],
        "gain_drift": [F.col(c) * (1 + 0.3 * (share(F.concat_ws(":", F.col(key).cast("string"), F.lit(c)), seed) - 0.5)) for c in columns],
        "flattening": [(F.col(c) + mean) / 2 for c in columns],
        "duration": [F.col(c) * 0.5 for c in columns],
    }
    made = F.array(*[F.struct(F.lit(name).alias("fault"), *[v.cast("double").alias(c) for v, c in zip(values, columns, strict=True)]) for name, values in variants.items()])
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.explode(made).alias("_v")).select(*others, "_v.*")
