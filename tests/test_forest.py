"""Forests against brute force, and what they must not depend on."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hitgrid.operators import forest, learning


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(k, rng.choice([0.0, 0.0, 0.0, rng.random()]), rng.gauss(0, 1), rng.random()) for k in range(400)]
    return spark.createDataFrame([(k, a, b, 1e3 + 5 * a - 2 * b * b + e, 1.0 + (b > 0.2), int(b + e > 0.5)) for k, a, b, e in data], "id long, a double, b double, s double, t double, y int").cache()


def by_hand(x, y, times, bounds, depth, path=()):
    """(mean, split) of the rows of one tree, by trying every cut."""
    mean = np.average(y, weights=times)
    best, tried = None, 1e-9
    if len(path) < depth:
        for f in range(x.shape[1]):
            for cut in bounds[f]:
                left = x[:, f] <= cut
                if times[left].sum() and times[~left].sum():
                    gain = sum(times[p].sum() * (np.average(y[p], weights=times[p]) - mean) ** 2 for p in (left, ~left))
                    if gain > tried * (1 + 1e-9):
                        best, tried = (f, cut), gain
    if best is None:
        return lambda row: mean
    left = x[:, best[0]] <= best[1]
    one, two = (by_hand(x[p], y[p], times[p], bounds, depth, (*path, p)) for p in (left, ~left))
    return lambda row: one(row) if row[best[0]] <= best[1] else two(row)


def test_trees_are_those_of_brute_force(spark, rows):
    found = forest.grow(rows, ["a", "b"], {"ps": "s", "pt": "t"}, 2, trees=4, depth=3, seed=9)
    data = rows.withColumn("key", F.xxhash64(F.lit(9), *rows.columns)).collect()
    x, key = np.array([[r.a, r.b] for r in data]), np.array([r.key for r in data]).view(np.uint64)
    for f, label in zip(found, "st", strict=True):
        y = np.array([r[label] for r in data])
        trees = []
        for t in range(4):
            times = forest._times(key, t).astype(float)
            trees.append(by_hand(x[times > 0], y[times > 0], times[times > 0], f.bounds, 3))
        want = {r.id: np.mean([tree((r.a, r.b)) for tree in trees]) for r in data}
        got = {r.id: r[f.name] for r in f.transform(rows).collect()}
        assert got == pytest.approx(want, rel=1e-9)


def test_draws_are_poisson():
    times = np.concatenate([forest._times(np.arange(50_000, dtype=np.uint64) * np.uint64(7), t) for t in range(4)])
    assert times.mean() == pytest.approx(1, abs=0.01) and times.var() == pytest.approx(1, abs=0.02) and (times == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)
    one, two = (forest._times(np.arange(50_000, dtype=np.uint64), t).astype(float) for t in (0, 1))
    assert abs(np.corrcoef(one, two)[0, 1]) < 0.02 and abs(np.corrcoef(one[1:], one[:-1])[0, 1]) < 0.02


def test_a_forest_does_not_depend_on_the_partitions(spark, rows):
    scores = [{r.id: r.p for r in learning.probabilities(learning.classifier(df, ["a", "b"], "y", trees=8, depth=4), rows).collect()} for df in (rows.coalesce(1), rows.repartition(7, "b"))]
    assert scores[0] == pytest.approx(scores[1], rel=1e-12)


def test_many_tasks_and_passes_give_the_same_forest(spark, rows, monkeypatch):
    grown = lambda: [r.pred_s for r in learning.regressors(rows, ["a", "b"], ["t", "s"], trees=6, depth=4)[1].transform(rows).orderBy("id").collect()]
    whole = grown()
    monkeypatch.setattr(forest, "TASK_ROWS", (50, 100))
    monkeypatch.setattr(forest, "SUM_BYTES", 10_000)
    assert grown() == pytest.approx(whole, rel=1e-12)


def test_all_targets_read_the_rows_together(spark, rows):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def looked(x):
        seen.add(1)
        return x

    source = rows.select("id", looked("a").alias("a"), "b", "s", "t", F.col("y").cast("double").alias("u"))
    learning.regressors(source, ["a", "b"], ["s", "t", "u"], trees=3, depth=3)
    assert seen.value <= 2 * 400


def test_missing_labels_and_values(spark, rows):
    some = rows.withColumn("s", F.when(F.col("id") % 3 > 0, F.col("s"))).withColumn("a", F.when(F.col("id") % 5 > 0, F.col("a")))
    both = forest.grow(some, ["a", "b"], {"ps": "s", "pt": "t"}, 2, trees=5, depth=3, seed=3)
    alone = forest.grow(some.filter("s is not null"), ["a", "b"], {"ps": "s"}, 2, trees=5, depth=3, seed=3)
    got = [r.ps for r in both[0].transform(rows).orderBy("id").collect()]
    assert all(map(np.isfinite, got)) and np.corrcoef(got, [r.ps for r in alone[0].transform(rows).orderBy("id").collect()])[0, 1] > 0.97
    assert {round(r.pt, 6) for r in forest.grow(rows.withColumn("t", F.lit(2.0)), ["a"], {"pt": "t"}, 1, trees=2, depth=3, seed=1)[0].transform(rows).collect()} == {2.0}
    with pytest.raises(ValueError):
        forest.grow(rows.filter("id < 0"), ["a"], {"ps": "s"}, 1, trees=2, depth=2, seed=1)


def test_labels_are_dealt_out_once(spark, rows):
    from hitgrid.plans.learning import shuffled_label_control

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def looked(x):
        seen.add(1)
        return x

    shuffled_label_control(rows.select("id", looked("a").alias("a"), "b", "y"), rows, ["a", "b"], "id", "y", 31, trees=2, depth=2)
    assert seen.value <= 400


@pytest.fixture
def counted(spark, rows):
    """(rows, how often one was looked at)"""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def looked(x):
        seen.add(1)
        return x

    return rows.select("id", looked("a").alias("a"), "b", "s", "t", "y", (F.col("id") % 5).cast("int").alias("fold")), seen


def test_folds_read_the_rows_together_and_are_as_each_alone(rows, counted):
    source, seen = counted
    found = learning.fold_classifiers(source, ["a", "b"], "y", "fold", 5, trees=6, depth=4)
    assert seen.value <= 3 * 400  # facts, bounds, bins
    plain = rows.select("id", "a", "b", "s", "t", "y", (F.col("id") % 5).cast("int").alias("fold"))
    scores = lambda model: [r.p for r in learning.probabilities(model, plain).orderBy("id").collect()]
    for k in (0, 3):
        assert scores(found[k]) == pytest.approx(scores(learning.classifier(plain.filter(F.col("fold") != k), ["a", "b"], "y", trees=6, depth=4)), rel=1e-9)


def test_class_and_places_read_the_rows_together_and_are_as_each_alone(rows, counted):
    source, seen = counted
    model, found = learning.classifier_and_regressors(source, ["a", "b"], "y", {"s_": (0, ["s"]), "d_": (1, ["s", "t"])}, trees=6, depths=(3, 4))
    assert seen.value <= 3 * 400
    assert [f.name for f in found] == ["s_s", "d_s", "d_t"]
    plain = rows.select("id", "a", "b", "s", "t", "y", (F.col("id") % 5).cast("int").alias("fold"))
    scores = lambda f: [r[f.name] for r in f.transform(plain).orderBy("id").collect()]
    assert scores(model) == pytest.approx(scores(learning.classifier(plain, ["a", "b"], "y", trees=6, depth=3)), rel=1e-9)
    alone = [*learning.regressors(plain.filter("y = 0"), ["a", "b"], ["s"], trees=6, depth=4), *learning.regressors(plain.filter("y = 1"), ["a", "b"], ["s", "t"], trees=6, depth=4)]
    for one, other in zip(found, alone, strict=True):
        assert scores(one) == pytest.approx(scores(other), rel=1e-9)


@pytest.mark.parametrize("sets", [3, 12])  # with twelve, a byte doesn't tell all bounds apart
def test_bins_of_a_set_follow_from_those_of_all(sets):
    rng = np.random.default_rng(2)
    bounds = [(np.unique(rng.normal(size=31)), np.unique(rng.integers(0, 9, 5) / 2.0), np.array([])) for _ in range(sets)]
    fine = tuple(np.unique(np.concatenate(own)) for own in zip(*bounds, strict=True))
    assert (len(fine[0]) > 255) == (forest._kind(fine) is np.uint16) == (sets == 12)
    x = [np.concatenate([rng.normal(size=500), fine[0], [np.nan, np.inf, -np.inf]]), None, None]
    x[1] = x[2] = np.round(np.resize(x[0], len(x[0])) * 2) / 2
    together = forest._bins(x, fine)
    for own in bounds:
        assert (forest._recoded(together.ravel(), forest._codes(own, fine)) == forest._bins(x, own).ravel()).all()


def test_scores_of_folds_come_in_one_look(rows, counted):
    source, seen = counted
    models = learning.fold_classifiers(rows.withColumn("fold", (F.col("id") % 5).cast("int")), ["a", "b"], "y", "fold", 4, trees=3, depth=3)
    got = {r.id: (r.fold, r.p) for r in learning.fold_probabilities(models, source, "fold").select("id", "fold", "p").collect()}
    assert seen.value == 400
    for k, model in enumerate(models):
        alone = {r.id: r.p for r in learning.probabilities(model, rows).collect()}
        assert all(p == pytest.approx(alone[i], rel=1e-12) for i, (fold, p) in got.items() if fold == k)
    assert sum(p is None for _, p in got.values()) == 80  # fold 4 has no forest


def test_bounds_of_many_sets_take_quantiles_of_a_row_once(spark, monkeypatch):
    taken, real = [], F.percentile_approx
    monkeypatch.setattr(forest.F, "percentile_approx", lambda *a: taken.append(a) or real(*a))
    rng = np.random.default_rng(5)
    fold = rng.choice(5, 20_000, p=[0.6, 0.2, 0.1, 0.09, 0.01])
    x = np.where(rng.random(20_000) < 0.4, 0.0, rng.normal(fold, 1.0 + fold))  # folds differ in size and values, and one value is frequent
    df = spark.createDataFrame(list(zip(fold.tolist(), x.tolist(), strict=True)), "fold int, x double").repartition(6)
    sets = [None, *[F.col("fold") != k for k in range(5)], F.when(F.col("fold") == 0, F.lit(None)).otherwise(F.col("fold") == 4), F.col("fold") > 9]
    found = forest._bounds(df, ["x"], sets)
    assert len(taken) == 1
    for own, within in zip(found, [fold >= 0, *[fold != k for k in range(5)], fold == 4], strict=False):
        values = np.sort(x[within])
        exact = np.unique(np.quantile(values, np.arange(forest.QUANTILES + 1) / forest.QUANTILES, method="inverted_cdf"))
        between = (exact[1:] + exact[:-1]) / 2
        exact = between[np.linspace(0, len(between) - 1, forest.BINS + 1).round().astype(int)[1:-1]]
        place = lambda bounds: np.searchsorted(values, bounds) / len(values)
        assert len(own[0]) == 31 and np.abs(place(own[0]) - place(exact)).max() < 0.005
    assert len(found[-1][0]) == 0


@pytest.mark.parametrize(("rows", "cores", "tasks"), [(100, 12, 1), (30_000, 12, 3), (1_200_000, 8, 8), (7_200_000, 12, 12), (13_000_000, 12, 24), (7_200_000, 2, 8)])
def test_tasks_fill_the_cores_evenly(rows, cores, tasks):
    assert forest._tasks(rows, cores) == tasks


def test_sums_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(3)
    bins, key = rng.integers(0, 32, (900, 3)).astype(np.uint8), rng.integers(0, 1 << 62, 900)
    ys = [np.where(rng.random(900) < 0.2, np.nan, rng.integers(0, 2, 900) - 0.25), rng.normal(size=900)]
    batches = [pa.RecordBatch.from_arrays([pa.array(key[k : k + 90]), pa.array([r.tobytes() for r in bins[k : k + 90]]), *[pa.array(y[k : k + 90]) for y in ys]], ["_key", "_bins", "_y0", "_y1"]) for k in range(0, 900, 90)]
    cut, feature, taken = np.array([9, 20, 15], np.uint8), np.array([0, 2, 1], np.int16), np.array([[0, 1, 2, 0], [1, 2, 0, 2]], np.int16)
    block = [(g, g % 2, g // 2, feature, cut, taken) for g in range(6)]
    monkeypatch.setattr(forest.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))

    def summed(size):
        monkeypatch.setattr(forest, "SLICE_ROWS", size)
        out = [np.frombuffer(s, np.float64) for b in forest._sums(iter(batches), 2, 3, np.uint8, [(0, (-0.25, 0.75)), (0, None)], [None], block, 2) for s in b.column("sums").to_pylist()]
        return [s.reshape(2, 2, 4, 32) for s in out]  # feature of the node, weights or weighted labels, node, bin

    whole = summed(1000)
    for s, (_, label, tree, *_) in zip(whole, block, strict=True):
        times = forest._times(key.view(np.uint64), tree).astype(float)
        some = np.isfinite(ys[label])
        node = np.array([2 * (b[0] > 9) + (b[2] > 20 if b[0] <= 9 else b[1] > 15) for b in bins])
        for k in range(2):
            at = node, bins[np.arange(900), taken[k][node]]
            want = np.zeros((2, 4, 32))
            np.add.at(want[0], tuple(a[some] for a in at), times[some])
            np.add.at(want[1], tuple(a[some] for a in at), (times * ys[label])[some])
            assert s[k] == pytest.approx(want, abs=1e-9)
    for s, other in zip(whole, summed(200), strict=True):
        assert s == pytest.approx(other, abs=1e-9)
