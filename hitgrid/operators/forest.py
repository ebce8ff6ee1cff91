"""Forests of decision trees for tables of many rows, grown level by level as Spark jobs.

Features are cut into at most 32 bins by quantiles and written down once, a byte each. For every level each task sums up weight and label
of its rows by tree, node, feature and bin; the tasks' sums meet by tree, where each node gets its best cut. Rows
never move after they are binned: what is shuffled are sums, as many for any number of rows in a task. Cuts lose as much variance as they can, which for
labels 0 and 1 is half the Gini impurity. How often a row is in a tree follows a Poisson distribution of mean 1 by a hash of the row,
so a forest doesn't depend on the partitioning of its rows. Forests over several sets of the same rows (folds, classes) share one table:
its bins are cut at the bounds of all sets, and each set has its own bins made from them where they are summed up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import discard, written

BINS = 32
#: Quantiles that bounds are chosen from, so that a frequent value takes one bin and leaves the others to the rest.
QUANTILES = 1024
#: Rows that a task looks at together, so few that the bins of several sets stay in a core's cache from tree to tree.
SLICE_ROWS = 1 << 13
#: Rows of a task: from the least on there are as many tasks as cores, and twice or more times as many where these would hold over the most.
TASK_ROWS = 1 << 13, 1 << 20
#: Bytes of sums that a task holds: trees of a level take several passes where they need more.
SUM_BYTES = 96 << 20
#: Bytes of sums in a row batch on their way to where they meet.
BATCH_BYTES = 4 << 20
#: How often a row is in a tree, by 16 bits of its hash.
_TIMES = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(10)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


@dataclass(frozen=True)
class Forest:
    """Complete binary trees: node k has the children 2k + 1 (bin at most `cut`) and 2k + 2; nodes that aren't cut send all rows to the first one."""

    features: tuple[str, ...]
    bounds: tuple[np.ndarray, ...]
    feature: np.ndarray
    cut: np.ndarray
    leaves: np.ndarray
    name: str

    def scores(self, columns: Sequence) -> np.ndarray:
        """The mean of the trees' leaves for the rows of a batch, from their features' values."""
        depth = self.leaves.shape[1].bit_length() - 1
        bins = _bins(columns, self.bounds)
        start = np.arange(len(bins)) * bins.shape[1]
        total = np.zeros(len(bins))
        for feature, cut, leaves in zip(self.feature, self.cut, self.leaves, strict=True):
            total += leaves.take(_node(bins.ravel(), start, feature, cut, depth))
        return total / len(self.leaves)

    def mean(self) -> Column:
        """The mean of the trees' leaves for a row."""
        return F.pandas_udf(lambda *columns: pd.Series(self.scores(columns)), "double")(*[F.col(c).cast("double") for c in self.features])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.name, self.mean())


def mean_by(number: Column, forests: Sequence[Forest]) -> Column:
    """For each row the mean of the forest of its number, from 0; null for other numbers. All have the same features."""

    def score(numbers: pd.Series, *columns: pd.Series) -> pd.Series:
        of, values, out = numbers.to_numpy(), [np.asarray(x, dtype=np.float64) for x in columns], np.full(len(numbers), np.nan)
        for k, forest in enumerate(forests):
            if len(rows := np.flatnonzero(of == k)):
                out[rows] = forest.scores([x.take(rows) for x in values])
        return pd.Series(out)

    return F.pandas_udf(score, "double")(number, *[F.col(c).cast("double") for c in forests[0].features])


def _kind(bounds: Sequence[np.ndarray]) -> type:
    return np.uint8 if max(map(len, bounds)) < 256 else np.uint16


def _bins(columns: Sequence, bounds: Sequence[np.ndarray]) -> np.ndarray:
    """(rows, features): how many of its feature's bounds lie below a value; no value is behind all."""
    out = np.empty((len(columns[0]), len(bounds)), _kind(bounds))
    for k, (x, found) in enumerate(zip(columns, bounds, strict=True)):
        out[:, k] = np.searchsorted(found, np.asarray(x, dtype=np.float64))
    return out


def _node(bins: np.ndarray, start: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node of a tree that each row is in after so many levels, by its place in that level."""
    node, feature = np.zeros(len(start), np.intp), feature.astype(np.intp)
    at = np.empty(len(start), np.intp)
    for level in range(levels):
        own = slice((1 << level) - 1, (2 << level) - 1)
        feature[own].take(node, out=at, mode="clip")  # unlike "raise", it writes to `out` at once
        at += start
        right = bins.take(at) > cut[own].take(node)
        node += node
        node += right
    return node


def _times(key: np.ndarray, tree: int) -> np.ndarray:
    h = (key + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return _TIMES.take((h >> np.uint64(48)).astype(np.intp))


def _bounds(df: DataFrame, features: Sequence[str], sets: Sequence[Column | None]) -> list[tuple[np.ndarray, ...]]:
    """For each set of rows its bounds of every feature.

    Rows that are in the same sets make one group, whose quantiles are found once, and a set's follow from those of its groups: folds and
    classes overlap in few ways, so a row is looked at once however many sets it is in. The whole table is a group of its own, since
    its quantiles needn't be merged. All quantiles of a group come in one
    row: approxQuantile has each number fetched by itself.
    """
    at = np.arange(QUANTILES + 1) / QUANTILES
    numbers = [F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features]
    within = F.array(*[F.coalesce(s, F.lit(False)) for s in sets if s is not None]).alias("within")
    found = [f(k, x) for k, x in enumerate(numbers) for f in (lambda k, x: F.count(x).alias(f"n{k}"), lambda k, x: F.percentile_approx(x, F.lit(at), 2 * QUANTILES).alias(f"q{k}"))]
    some = [i for i, s in enumerate(sets) if s is not None]
    grouped = df.groupBy(F.lit(None).cast("array<boolean>").alias("within")) if not some else df.groupBy(within) if len(some) == len(sets) else df.rollup(within)
    groups = sorted(grouped.agg(*found).collect(), key=lambda r: r.within or [])
    of = {i: [r for r in groups if (r.within is None if i not in some else r.within and r.within[some.index(i)])] for i in range(len(sets))}
    out = []
    for i in range(len(sets)):
        for k in range(len(features)):
            values = np.unique(_merged([(r[f"n{k}"], r[f"q{k}"]) for r in of[i] if r[f"n{k}"]], at))
            values = values[np.isfinite(values)]
            between = (values[1:] + values[:-1]) / 2
            if len(between) >= BINS:
                between = between[np.linspace(0, len(between) - 1, BINS + 1).round().astype(int)[1:-1]]
            out.append(between)
    return [tuple(out[k : k + len(features)]) for k in range(0, len(out), len(features))]


def _merged(parts: Sequence[tuple[int, Sequence[float]]], at: np.ndarray) -> np.ndarray:
    """The quantiles of groups together, from each one's number of rows and quantiles."""
    if len(parts) < 2:
        return np.array(parts[0][1] if parts else [], dtype=np.float64)
    values, weight = np.concatenate([q for _, q in parts]), np.concatenate([np.full(len(q), n / len(q)) for n, q in parts])
    order = values.argsort(kind="stable")
    upto = weight[order].cumsum()
    return values[order].take(np.searchsorted(upto, at * upto[-1]), mode="clip")


def _codes(bounds: Sequence[np.ndarray], fine: Sequence[np.ndarray]) -> list[np.ndarray]:
    """For each feature the bin by `bounds` of every bin by `fine`, which holds all of them."""
    return [np.concatenate([[0], np.searchsorted(own, every, side="right")]).astype(np.uint8) for own, every in zip(bounds, fine, strict=True)]


def _slices(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(keys, bins, labels) of SLICE_ROWS rows or a batch more."""
    held: list[pa.RecordBatch] = []

    def together():
        t = pa.Table.from_batches(held).combine_chunks()
        bins = np.frombuffer(b"".join(t.column("_bins").to_pylist()), kind)
        return t.column("_key").to_numpy().view(np.uint64), bins, [y.to_numpy() for y in t.columns[2:]]

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= SLICE_ROWS:
            yield together()
            held = []
    if sum(b.num_rows for b in held):
        yield together()


def _recoded(bins: np.ndarray, codes: list[np.ndarray] | None) -> np.ndarray:
    if codes is None:
        return bins
    fine = bins.reshape(-1, len(codes))
    out = np.empty(fine.shape, np.uint8)
    for k, code in enumerate(codes):
        out[:, k] = code.take(fine[:, k])
    return out.ravel()


def _sums(batches: Iterator[pa.RecordBatch], level: int, width: int, kind: type, labels: list[tuple], codes: list, block: list[tuple], live: int) -> Iterator[pa.RecordBatch]:
    """A row for each tree of the block: the task's weights and weighted labels by feature of the node, node and bin.

    `labels` says of each label which of the `codes` it takes, and its two values if it has no more: these are counted together.
    """
    size = (1 << level) * BINS
    sums = None
    for key, fine, ys in _slices(batches, kind):
        if sums is None:
            sums = np.zeros((len(block), live, 2, size))
        start = np.arange(len(key)) * width
        recoded = [_recoded(fine, c) for c in codes]
        known = [np.isfinite(y) for y in ys]
        partial = [not k.all() for k in known]
        upper = [None if pair is None else np.where(y > sum(pair) / 2, size, 0) for y, (_, pair) in zip(ys, labels, strict=True)]
        last, drawn = None, None
        for out, (_, label, tree, feature, cut, taken) in zip(sums, block, strict=True):
            if tree != last:  # the forests of all labels draw alike
                times = _times(key, tree)
                drawn = np.flatnonzero(times)
                last, weights, starts = tree, times.take(drawn).astype(np.float64), start.take(drawn)
            rows, weight, at = drawn, weights, starts
            if partial[label]:
                some = np.flatnonzero(known[label].take(drawn))
                rows, weight, at = rows.take(some), weight.take(some), at.take(some)
            of, pair = labels[label]
            bins = recoded[of]
            node = _node(bins, at, feature, cut, level)
            first, taken, place = node * BINS, taken.astype(np.intp), np.empty(len(at), np.intp)
            if pair is None:
                weighted = weight * ys[label].take(rows)
            else:
                first += upper[label].take(rows)
            for k in range(live):
                taken[k].take(node, out=place, mode="clip")
                place += at
                np.add(first, bins.take(place), out=place)
                if pair is None:
                    out[k, 0] += np.bincount(place, weight, size)
                    out[k, 1] += np.bincount(place, weighted, size)
                else:
                    out[k] += np.bincount(place, weight, 2 * size).reshape(2, size)
    if sums is None:
        return
    for out, (_, label, *_) in zip(sums, block, strict=True):
        if pair := labels[label][1]:  # so far the weights of either value
            lower, upper = out[:, 0].copy(), out[:, 1].copy()
            out[:, 0], out[:, 1] = lower + upper, pair[0] * lower + pair[1] * upper
    part, step = TaskContext.get().partitionId(), max(1, BATCH_BYTES // sums[0].nbytes)
    for k in range(0, len(block), step):
        some = [b[0] for b in block[k : k + step]]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([part] * len(some), pa.int32()), pa.array([s.tobytes() for s in sums[k : k + step]], pa.binary())], ["number", "part", "sums"])


def _best(group: pa.Table, level: int, live: int) -> pa.Table:
    """For each node of a tree: weight, sum, place of the best feature, its bin, the gain, and the weight and sum of the first child."""
    order = np.argsort(group.column("part").to_numpy())
    total = np.zeros((live, 2, 1 << level, BINS))
    for k in order:
        total += np.frombuffer(group.column("sums")[int(k)].as_buffer(), np.float64).reshape(total.shape)
    total = total.swapaxes(0, 1)
    n, s = total[:, 0].sum(axis=-1)
    left_n, left_s = total.cumsum(axis=-1)[..., :-1]
    right_n, right_s = n[None, :, None] - left_n, s[None, :, None] - left_s
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_s**2 / left_n + right_s**2 / right_n - (s**2 / n)[None, :, None]
        gain = np.where((left_n > 0.5) & (right_n > 0.5), gain / n[None, :, None], -1.0)
    # Cuts that part the rows alike differ in the last digits only; the first one is taken.
    top = gain.max(axis=(0, 2))
    gain = (gain >= (top - 1e-9 * np.abs(top))[None, :, None]).transpose(1, 0, 2).reshape(1 << level, -1)
    k, b = np.divmod(gain.argmax(axis=1), BINS - 1)
    nodes = np.arange(1 << level)
    out = np.stack([n, s, k, b, top, left_n[k, nodes, b], left_s[k, nodes, b]])
    return pa.table({"number": group.column("number").slice(0, 1), "cuts": pa.array([out.tobytes()], pa.binary())})


def _steps(level: int, live: int, block: list[tuple], *how):
    """Both steps of a level for a block of trees."""
    return lambda batches: _sums(batches, level, *how, block, live), lambda group: _best(group, level, live)


@dataclass(frozen=True)
class Binned:
    """Rows in bins, for forests over one or several sets of them: for each label its set, mean, least gain and, if it has no more, both values less the mean."""

    features: tuple[str, ...]
    table: DataFrame
    fine: tuple[np.ndarray, ...]
    bounds: list[tuple[np.ndarray, ...]]
    names: list[str]
    sets: list[int]
    mean: np.ndarray
    least: np.ndarray
    pairs: list[tuple[float, float] | None]


def _tasks(rows: int, cores: int) -> int:
    """As many tasks as fill the cores evenly: with one task more than cores, a level would take twice its time."""
    return max(1, min(rows // TASK_ROWS[0], cores * math.ceil(rows / (cores * TASK_ROWS[1]))))


def binned(train: DataFrame, features: Sequence[str], sets: Sequence[tuple[Column | None, Mapping[str, str]]], seed: int) -> Binned:
    """Bins the rows once. A set is a condition on the rows (None: all) and (name, label column) of its forests; names differ."""
    width = len(features)
    names = [name for _, labels in sets for name in labels]
    which = [k for k, (_, labels) in enumerate(sets) for _ in labels]
    columns = [F.col(c).cast("double") if s is None else F.when(s, F.col(c).cast("double")) for s, labels in sets for c in labels.values()]
    told = (("m", F.avg), ("v", F.var_pop), ("o", lambda y: F.count_if(~y.isin(0.0, 1.0))))
    facts = train.agg(F.count(F.lit(1)).alias("n"), *[f(y).alias(f"{a}{i}") for i, y in enumerate(columns) for a, f in told]).first()
    if any(facts[f"m{i}"] is None for i in range(len(columns))):
        raise ValueError(f"no labelled rows for one of {names}")
    mean = np.array([facts[f"m{i}"] for i in range(len(columns))])
    least = np.array([facts[f"v{i}"] for i in range(len(columns))]) * 1e-12
    pairs = [None if facts[f"o{i}"] else (-float(m), 1 - float(m)) for i, m in enumerate(mean)]
    bounds = _bounds(train, features, [s for s, _ in sets])
    fine = tuple(np.unique(np.concatenate(own)) for own in zip(*bounds, strict=True))
    tasks = _tasks(facts.n, train.sparkSession.sparkContext.defaultParallelism)
    targets = [f"_y{i}" for i in range(len(columns))]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _bins([batch.column(f"_x{k}").to_numpy(zero_copy_only=False) for k in range(width)], fine)
            together = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width * bins.itemsize), len(bins), [None, pa.py_buffer(bins.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_key"), together, *[batch.column(y) for y in targets]], ["_key", "_bins", *targets])

    ys = [(y - float(mean[i])).alias(targets[i]) for i, y in enumerate(columns)]
    rows = train.select(F.xxhash64(F.lit(seed), *train.columns).alias("_key"), *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(features)], *ys)
    schema = ", ".join(["_key long", "_bins binary", *[f"{y} double" for y in targets]])
    table = written(rows.mapInArrow(packed, schema).repartition(tasks, "_key"), "bins")
    return Binned(tuple(features), table, fine, bounds, names, which, mean, least, pairs)


def grow(train: DataFrame, features: Sequence[str], labels: dict[str, str], per_node: int, trees: int, depth: int, seed: int) -> list[Forest]:
    """A forest for each (name of its mean, label column), all over the same rows; each node looks at `per_node` features of its own.

    Rows without a label are left out of its forest. A node is cut as long as that gains anything.
    """
    rows = binned(train, features, [(None, labels)], seed)
    found = grown(rows, list(labels), per_node, trees, depth, seed)
    discard(rows.table)
    return found


def grown(rows: Binned, names: Sequence[str], per_node: int, trees: int, depth: int, seed: int, alike: bool = False) -> list[Forest]:
    """The forests of some labels of binned rows. Each has features of its own drawn for its nodes; with `alike` all have those that one alone would have."""
    chosen, width = [rows.names.index(name) for name in names], len(rows.features)
    used = sorted({rows.sets[i] for i in chosen})
    mean, least = rows.mean[chosen], rows.least[chosen]
    table = rows.table.select("_key", "_bins", *[f"_y{i}" for i in chosen])
    if len(rows.bounds) > 1 and len(used) == 1:
        table = table.filter(F.coalesce(*[f"_y{i}" for i in chosen]).isNotNull())
    codes = [None if len(rows.bounds) == 1 else _codes(rows.bounds[s], rows.fine) for s in used]
    how = width, _kind(rows.fine), [(used.index(rows.sets[i]), rows.pairs[i]) for i in chosen], codes
    forests, live = len(chosen), min(per_node, width)
    count = forests * trees
    feature, cut = np.zeros((count, (1 << depth) - 1), np.int16), np.full((count, (1 << depth) - 1), 255, np.uint8)
    value, alive = np.zeros((count, (2 << depth) - 1)), np.zeros((count, (2 << depth) - 1), bool)
    alive[:, 0] = True
    draw = np.random.default_rng(seed)
    for level in range(depth):
        lo, hi = (1 << level) - 1, (2 << level) - 1
        taken = draw.random((trees if alike else count, hi - lo, width)).argsort(axis=2)[..., :live].transpose(0, 2, 1).astype(np.int16)
        if alike:
            taken = taken.repeat(forests, axis=0)
        step = max(1, SUM_BYTES // (2 * live * (hi - lo) * BINS * 8))
        for at in range(0, count, step):
            block = [(g, g % forests, g // forests, feature[g, :lo], cut[g, :lo], taken[g]) for g in range(at, min(at + step, count))]
            summed, best = _steps(level, live, block, *how)
            sums = table.mapInArrow(summed, "number int, part int, sums binary")
            for r in sums.groupBy("number").applyInArrow(best, "number int, cuts binary").collect():
                _place(r.number, np.frombuffer(r.cuts).reshape(7, -1), lo, hi, least[r.number % forests], taken[r.number], feature, cut, value, alive)
        # Whatever isn't cut sends its rows, and its mean, to the first child.
        still = cut[:, lo:hi] == 255
        value[:, 2 * lo + 1 : 2 * hi + 1 : 2] = np.where(still, value[:, lo:hi], value[:, 2 * lo + 1 : 2 * hi + 1 : 2])
    leaves = value[:, (1 << depth) - 1 :]
    return [Forest(rows.features, rows.bounds[rows.sets[k]], feature[i::forests], cut[i::forests], leaves[i::forests] + mean[i], rows.names[k]) for i, k in enumerate(chosen)]


def _place(g: int, found: np.ndarray, lo: int, hi: int, least: float, taken: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, alive: np.ndarray) -> None:
    """Writes the cuts of one tree's level, and the means of its nodes and of their children."""
    n, s, k, b, gain, left_n, left_s = found
    nodes = np.arange(hi - lo)
    if lo == 0:
        value[g, 0] = s[0] / n[0] if n[0] else 0.0
    on = nodes[alive[g, lo:hi] & (n > 0) & (gain > least)]
    k = k[on].astype(int)
    feature[g, lo + on], cut[g, lo + on] = taken[k, on], b[on].astype(np.uint8)
    first, second = 2 * (lo + on) + 1, 2 * (lo + on) + 2
    alive[g, first] = alive[g, second] = True
    value[g, first] = left_s[on] / left_n[on]
    value[g, second] = (s[on] - left_s[on]) / (n[on] - left_n[on])
