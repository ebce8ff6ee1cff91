"""Model and statistics jobs on the driver's tables: embeddings as vectors, line items as labelled measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import distance3
from ..operators import curves, ranges
from ..operators import learning as L
from ..registry import query
from .channels import _C15, count_vectors, features
from .joins import _PAIRS as _ASSIGNED
from .joins import _PTS, _sql_dist
from .scoring import _ERR, errors, r6
from ..tables import discard, written
from .views import table

X4 = ["x1", "x2", "x3", "x4"]
_V = "v AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x1, CAST(embedding[2] AS DOUBLE) AS x2, CAST(embedding[3] AS DOUBLE) AS x3, CAST(embedding[4] AS DOUBLE) AS x4 FROM embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, x1 .. x4)"""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.element_at("embedding", k).cast("double").alias(f"x{k}") for k in range(1, 5)])


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, group, features, y): is the price per piece above its usual value."""
    rows = table(spark, sf_dir, "lineitem").select(F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("id"), F.col("l_suppkey").alias("grp"), *FEATURES)
    return rows.withColumn("y", (F.col("l_extendedprice") > 1400 * F.col("l_quantity")).cast("int"))


@query()
def ml_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.stratified_split(measurements(spark, sf_dir), "id", "y", 0.2)
    return rows.groupBy("y", "holdout").agg(F.count(F.lit(1)).alias("n"))


@query()
def ml_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.group_split(measurements(spark, sf_dir), "grp", 0.2)
    return rows.groupBy("grp").agg(F.max("holdout").alias("holdout"), F.count(F.lit(1)).alias("n"))


#: The 36 features of a count vector, in order: counts, total, fractions, entropy, Gini, anisotropy, dipole, duration.
F36 = [f"c{k}" for k in range(1, 16)] + ["total"] + [f"f{k}" for k in range(1, 16)] + ["entropy", "gini", "anisotropy", "dipole", "duration"]
SINGLE, DUAL = ["x1", "y1", "z1"], ["x1", "y1", "z1", "x2", "y2", "z2"]


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, grp, F36, y, x1 .. z2): a vector of 15 counts for each part (its suppliers stand for channels), whether two places are behind it, and both places."""
    channel = F.col("l_suppkey") % 15 + 1
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(*[F.coalesce(F.sum(F.when(channel == k, F.col("l_quantity").cast("double"))), F.lit(0.0)).alias(f"c{k}") for k in range(1, 16)])
    rows = features(rows, F.lit(60.0)).withColumns({f"f{k}": F.element_at("p", k) for k in range(1, 16)})
    mean = F.aggregate(F.zip_with("p", F.array(*[F.lit(float(k)) for k in range(1, 16)]), lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    left = sum((F.col(f"f{k}") for k in range(1, 8)), F.lit(0.0))
    places = {"x1": mean, "y1": 10 * F.col("gini"), "z1": F.col("id") % 7 * 1.0, "x2": 16 - mean, "y2": F.col("f1") * 10, "z2": F.col("id") % 5 * 1.0}
    return rows.withColumns(places).select("id", (F.col("id") % 40).alias("grp"), *F36, (left >= 0.5).cast("int").alias("y"), *DUAL)


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = written(examples(spark, sf_dir).withColumn("u", L.share(F.col("id"), 3)), "examples")  # read by every forest
    return rows.filter("u >= 0.2"), rows.filter("u < 0.2")


@query()
def ml_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated probabilities of held-out rows: 200 trees, then Platt's sigmoid."""
    train, test = _split(spark, sf_dir)
    model = L.classifier(train, F36, "y")
    return L.probabilities(model, test, calibration=L.calibration(model, train, "y")).select("id", "y", F.round("p", 6).alias("p"))


def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(spark, sf_dir)
    return L.permutation_importance(L.classifier(train, F36, "y"), test, F36, "id", "y")


@query()
def srt_feature_importance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten features whose values matter most."""
    return importances(spark, sf_dir).withColumnRenamed("drop", "gain").orderBy(F.desc("gain"), "feature").limit(10)


@query()
def ml_permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss of area under the curve over five dealings of each of the 36 features."""
    return importances(spark, sf_dir)


def _folds(rows: DataFrame, label: str, folds: int = 5) -> DataFrame:
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(folds)))
    scored = L.fold_probabilities(L.fold_classifiers(rows, F36, label, "fold", folds), rows, "fold")
    return scored.groupBy("fold").agg(F.avg(((F.col("p") >= 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy"))


@query()
def ml_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folds(written(examples(spark, sf_dir), "examples"), "y").agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"))


@query()
def ml_random_label_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with labels at random: near one half, or the folds leak."""
    rows = written(examples(spark, sf_dir), "examples").withColumn("y", (L.share(F.col("id"), 99) >= 0.5).cast("int"))
    return _folds(rows, "y").agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"))


def coordinates(train: DataFrame, targets: list[str], rows: DataFrame) -> DataFrame:
    """rows with pred_<target> from a forest for each target."""
    for forest in L.regressors(train, F36, targets):
        rows = forest.transform(rows)
    return rows


@query()
def ml_multi_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest for each target, three for one place and six for two, and R2 on the held-out rows."""
    train, test = _split(spark, sf_dir)
    out = None
    for kind, y, targets in (("single", 0, SINGLE), ("dual", 1, DUAL)):
        rows = coordinates(train.filter(F.col("y") == y), targets, test.filter(F.col("y") == y))
        e2 = {t: (F.col(t) - F.col(f"pred_{t}")) ** 2 for t in targets}
        part = rows.agg(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(t).alias("target"), (1 - F.sum(e2[t]) / (F.var_pop(t) * F.count(F.lit(1)))).alias("r2")) for t in targets]).alias("r"))
        part = part.select(F.explode("r").alias("r")).select("r.*")
        out = part if out is None else out.unionByName(part)
    return out


@query("WITH p AS (SELECT l_returnflag, l_quantity * 1000 AS pred, l_extendedprice AS truth FROM lineitem), m AS (SELECT l_returnflag, avg(truth) AS mu FROM p GROUP BY 1) SELECT l_returnflag, round(1 - sum((truth-pred)*(truth-pred)) / sum((truth-mu)*(truth-mu)), 6) AS r2 FROM p JOIN m USING (l_returnflag) GROUP BY 1")
def ml_r2_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 of given predictions; the total sum of squares comes from the variance, so one pass is enough."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") * 1000).alias("pred"), F.col("l_extendedprice").alias("truth"))
    e = F.col("truth") - F.col("pred")
    return rows.groupBy("l_returnflag").agg(r6(1 - F.sum(e * e) / (F.var_pop("truth") * F.count(F.lit(1))), "r2"))


_PAIRS = [(i, j) for i in range(1, 5) for j in range(i, 5)]


@query(f"WITH {_V} SELECT {', '.join(f'round(avg(x{i}), 6) AS m{i}' for i in range(1, 5))}, {', '.join(f'round(covar_samp(x{i}, x{j}) + {1e-6 if i == j else 0}, 6) AS c{i}{j}' for i, j in _PAIRS)} FROM v")
def ml_mahalanobis_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).agg(*[r6(F.avg(f"x{i}"), f"m{i}") for i in range(1, 5)], *[r6(F.covar_samp(f"x{i}", f"x{j}") + (1e-6 if i == j else 0.0), f"c{i}{j}") for i, j in _PAIRS])


_STD = "s AS (SELECT avg(x1) AS a1, avg(x2) AS a2, var_samp(x1) + 1e-6 AS v1, var_samp(x2) + 1e-6 AS v2, covar_samp(x1, x2) AS c FROM v), d AS (SELECT vec_id, label, sqrt(((x1-a1)*(x1-a1)*v2 - 2*(x1-a1)*(x2-a2)*c + (x2-a2)*(x2-a2)*v1) / (v1*v2 - c*c)) AS dist FROM v, s)"


def distances2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    mean, inverse = L.mahalanobis_fit(rows, X4[:2])
    return rows.select("vec_id", "label", L.mahalanobis(X4[:2], mean, inverse).alias("dist"))


@query(f"WITH {_V}, {_STD} SELECT vec_id, round(dist, 5) AS dist FROM d")
def ml_mahalanobis_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances2(spark, sf_dir).select("vec_id", F.round("dist", 5).alias("dist"))


@query(f"WITH {_V}, {_STD} SELECT round(avg(dist) + 3 * stddev_pop(dist), 5) AS threshold FROM d")
def ml_ood_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances2(spark, sf_dir).agg(F.round(F.avg("dist") + 3 * F.stddev_pop("dist"), 5).alias("threshold"))


@query()
def prj_fault_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = count_vectors(spark, sf_dir).withColumn("id", F.xxhash64("run_id", "day"))
    rows = rows.select("id", "run_id", "day", *[F.col(c).cast("double").alias(c) for c in _C15])
    return L.inject_faults(rows, _C15, "id").drop("id")


@query()
def ml_ood_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean rows and faulty ones by their distance: area under the curve and rate of detection by fault."""
    rows = vectors(spark, sf_dir)
    mean, inverse = L.mahalanobis_fit(rows, X4)
    faulty = L.inject_faults(rows.withColumnRenamed("vec_id", "id"), X4, "id").withColumnRenamed("id", "vec_id")
    both = rows.withColumn("fault", F.lit("clean")).unionByName(faulty).withColumn("dist", L.mahalanobis(X4, mean, inverse)).withColumn("p", F.round("dist", 6)).withColumn("y", (F.col("fault") != "clean").cast("int"))
    threshold = both.filter("y = 0").agg((F.avg("dist") + 3 * F.stddev_pop("dist")).alias("t"))
    rates = both.join(F.broadcast(threshold)).groupBy("fault").agg(F.avg((F.col("dist") >= F.col("t")).cast("double")).alias("detected"), F.count(F.lit(1)).alias("n"))  # one row
    return rates.join(F.broadcast(curves.areas(curves.curve(both))))  # one row


def routed(rows: DataFrame, model, sigmoid: tuple[float, float], mean, inverse, threshold: float = 4.0, separation: float = 1.0, strict: float = 0.8) -> DataFrame:
    """Adds p, dist, label and coords to rows with predicted places (s_: of one, d_: of two).

    Two places that lie closer than `separation` without strict confidence become one; rows out of the distribution are unknown.
    """
    scored = L.probabilities(model, rows, calibration=sigmoid).withColumn("dist", L.mahalanobis(OOD4, mean, inverse))
    apart = F.sqrt(sum(((F.col(f"d_{c}1") - F.col(f"d_{c}2")) ** 2 for c in "xyz"), F.lit(0.0)))
    dual = F.col("p") >= 0.5
    centroid = dual & (apart < separation) & (F.col("p") < strict)
    one, two = F.array(*[F.col(f"s_{c}") for c in SINGLE]), F.array(*[F.col(f"d_{c}") for c in DUAL])
    label = F.when(F.col("dist") > threshold, "Unknown").when(centroid, "Single (centroid override)").when(dual, "Dual").otherwise("Single")
    return scored.withColumns({"label": label, "coords": F.when(dual & ~centroid, two).otherwise(one)})


#: The features that tell rows out of the distribution.
OOD4 = ["total", "entropy", "gini", "dipole"]


def _trained(train: DataFrame, rows: DataFrame) -> tuple[DataFrame, tuple]:
    """rows with all predicted places, and the rest of what `routed` takes."""
    model, forests = L.classifier_and_regressors(train, F36, "y", {"s_": (0, SINGLE), "d_": (1, DUAL)})
    for forest in forests:
        rows = forest.transform(rows)
    return rows, (model, L.calibration(model, train, "y"), *L.mahalanobis_fit(train, OOD4))


@query()
def ml_predict_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-distribution check, class, coordinates and route of held-out rows."""
    train, test = _split(spark, sf_dir)
    rows, given = _trained(train, test)
    return routed(rows, *given).select("id", F.round("p", 6).alias("p"), F.round("dist", 6).alias("dist"), "label", F.transform("coords", lambda x: F.round(x, 6)).alias("coords"))


@query(f"WITH {_ERR} SELECT CASE WHEN l_quantity > 40 THEN 'dual' ELSE 'single' END AS kind, count(*) AS n, round(avg(error), 6) AS mean, round(median(error), 6) AS median, round(avg(CASE WHEN (l_orderkey + l_linenumber) % 9 = 0 THEN 1.0 ELSE 0.0 END), 6) AS refused FROM err GROUP BY 1")
def ml_evaluate_localization(spark: SparkSession, sf_dir: str) -> DataFrame:
    refused = ((F.col("l_orderkey") + F.col("l_linenumber")) % 9 == 0).cast("double")
    rows = errors(spark, sf_dir).withColumn("kind", F.when(F.col("l_quantity") > 40, "dual").otherwise("single"))
    out = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("error"), "mean"), r6(F.avg(refused), "refused"))
    return out.join(ranges.percentiles(rows, ["kind"], "error", {"median": 0.5}), "kind").withColumn("median", F.round("median", 6))


def shuffled_label_control(train: DataFrame, test: DataFrame, features: list[str], key: str, label: str, seed: int, **forest: int) -> DataFrame:
    """test with p of a model that was trained on dealt-out training labels; test keeps its true ones. Far above chance, test rows have leaked."""
    dealt = written(L.shuffled(train, key, label, seed), "dealt")  # read for facts, bounds and bins
    model = L.classifier(dealt, features, label, **forest)
    discard(dealt)
    return L.probabilities(model, test)


def turned(rows: DataFrame) -> DataFrame:
    """rows with every channel's count and fraction in the next channel's place; the dipole follows, the other descriptors don't depend on the order."""
    turn = {f"{a}{k}": F.col(f"{a}{k % 15 + 1}") for a in "cf" for k in range(1, 16)}
    mean = sum((turn[f"f{k}"] * float(k - 1) for k in range(1, 16)), F.lit(0.0))
    return rows.withColumns({**turn, "dipole": F.abs(mean)})


@query()
def ml_negative_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows and held-out groups, as they are, with channels turned, and under models trained on dealt-out labels (true labels score them).

    By split and variant: accuracy of the class and that of always saying the more frequent one; for the first two also the
    mean distance of the predicted place (of the nearer of both assignments of two places), the share of unknown rows, and
    the shares of the routes single, dual and centroid.
    """
    whole = L.group_split(written(examples(spark, sf_dir), "examples"), "grp", 0.2).withColumn("u", L.share(F.col("id"), 3))
    train = whole.filter("u >= 0.2 and not holdout")
    held = whole.select("*", F.explode(F.array(F.when(F.col("u") < 0.2, "random"), F.when(F.col("holdout"), "grouped"))).alias("split")).filter("split is not null")
    variants = held.withColumn("variant", F.lit("baseline")).unionByName(turned(held).withColumn("variant", F.lit("permuted_channels")))
    rows, given = _trained(train, variants)
    judged = routed(rows, *given)
    place = lambda *cols: F.array(*[F.col(c) for c in cols])
    part = lambda k: F.slice("coords", 3 * k - 2, 3)
    first, second, t1, t2 = part(1), F.when(F.size("coords") == 6, part(2)), place("x1", "y1", "z1"), place("x2", "y2", "z2")
    straight, crossed = (distance3(first, t1) + distance3(second, t2)) / 2, (distance3(first, t2) + distance3(second, t1)) / 2
    error = F.when(F.col("y") == 0, distance3(first, t1)).when(F.size("coords") == 6, F.least(straight, crossed)).otherwise(F.least(distance3(first, t1), distance3(first, t2)))
    said = lambda *labels: F.avg(F.col("label").isin(*labels).cast("double"))
    right = F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")).alias("accuracy")
    majority = F.greatest(F.avg("y"), 1 - F.avg("y")).alias("majority")
    out = judged.withColumn("error", error).groupBy("split", "variant").agg(F.count(F.lit(1)).alias("n"), right, majority, F.avg("error").alias("mean_error"), said("Unknown").alias("unknown"), said("Single").alias("single"), said("Dual").alias("dual"), said("Single (centroid override)").alias("centroid"))
    none = {c: F.lit(None).cast("double") for c in ("mean_error", "unknown", "single", "dual", "centroid")}
    for split, own, seed in (("random", "u >= 0.2", 31), ("grouped", "not holdout", 32)):
        scored = shuffled_label_control(whole.filter(own), held.filter(F.col("split") == split), F36, "id", "y", seed)
        out = out.unionByName(scored.groupBy("split").agg(F.lit("shuffled_labels").alias("variant"), F.count(F.lit(1)).alias("n"), right, majority).withColumns(none))
    return out


@query("WITH g AS (SELECT CASE WHEN l_suppkey % 4 = 0 THEN 'shifted' ELSE 'baseline' END AS dataset, l_returnflag AS outcome, count(*) AS n FROM lineitem GROUP BY ALL) SELECT dataset, outcome, n, round(n / sum(n) OVER (PARTITION BY dataset), 9) AS fraction FROM g")
def ml_domain_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    dataset = F.when(F.col("l_suppkey") % 4 == 0, "shifted").otherwise("baseline")
    counts = table(spark, sf_dir, "lineitem").groupBy(dataset.alias("dataset"), F.col("l_returnflag").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("fraction", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("dataset")), 9))


_POINTS = "pt AS (SELECT axis, x, error FROM (SELECT unnest(['counts', 'distance']) AS axis, unnest([l_quantity::DOUBLE, far]) AS x, error FROM (SELECT *, least(d11+d22, d12+d21)/2 AS error FROM dist)))"


@query(f"""WITH dist AS (SELECT l_quantity, sqrt(CAST({' + '.join(f'{c}*{c}' for c in _PTS['t1'])} AS DOUBLE)) AS far, {', '.join(f'{_sql_dist(*v)} AS {k}' for k, v in _ASSIGNED.items())} FROM lineitem), {_POINTS},
  k AS (SELECT *, (20 * row_number() OVER (PARTITION BY axis ORDER BY x, error) + count(*) OVER (PARTITION BY axis) - 1) // count(*) OVER (PARTITION BY axis) - 1 AS bin FROM pt)
  SELECT axis, bin, count(*) AS n, round(median(x), 6) AS center, round(median(error), 6) AS median, round(quantile_cont(error, 0.25), 6) AS p25, round(quantile_cont(error, 0.75), 6) AS p75 FROM k GROUP BY ALL""")
def ml_error_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors against counts and against the distance of the true place, in twenty bins of equally many points each."""
    far = distance3(F.array(*[F.expr(c).cast("double") for c in _PTS["t1"]]), F.array(*[F.lit(0.0)] * 3))
    pairs = {k: distance3(*[F.array(*[F.expr(c).cast("double") for c in _PTS[n]]) for n in v]) for k, v in _ASSIGNED.items()}
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("counts"), far.alias("distance"), (F.least(pairs["d11"] + pairs["d22"], pairs["d12"] + pairs["d21"]) / 2).alias("error"))
    point = lambda axis: F.struct(F.lit(axis).alias("axis"), F.col(axis).alias("x"))
    rows = rows.select(F.explode(F.array(point("counts"), point("distance"))).alias("p"), "error").select("p.*", "error")
    sizes = rows.groupBy("axis").agg(F.count(F.lit(1)).alias("size"))
    rows = ranges.places(rows, "x", ["error"], keys=["axis"]).join(sizes, "axis").withColumn("bin", F.expr("(20 * (place + 1) + size - 1) div size - 1"))
    rows = written(rows.select("axis", "bin", "x", "error"), "points")  # places once, read for counts and both percentiles
    keys = ["axis", "bin"]
    center = ranges.percentiles(rows, keys, "x", {"center": 0.5})
    found = ranges.percentiles(rows, keys, "error", {"median": 0.5, "p25": 0.25, "p75": 0.75}).join(center, keys)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(found.select(*keys, *[r6(F.col(n), n) for n in ("center", "median", "p25", "p75")]), keys)


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def flt_descriptor_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
