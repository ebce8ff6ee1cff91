"""Error, coverage, stability and region reports of localisation results.

A prediction's error is the mean of its better pairing (see joins.distances); line items stand for predictions,
orders for runs, quantities for counts.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import bias3, centroid3, distance3
from ..operators import islands, ranges
from ..registry import query
from .joins import _DIST_SQL, _PAIRS, _PTS, _sql_dist, distances
from ..tables import written
from .views import table

_ERR = f"{_DIST_SQL}, err AS (SELECT *, least(d11+d22, d12+d21)/2 AS error FROM dist)"


_D = {k: _sql_dist(*v) for k, v in _PAIRS.items()}


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances(spark, sf_dir).withColumn("error", F.least(F.col("d11") + F.col("d22"), F.col("d12") + F.col("d21")) / 2)


def r6(c: Column | str, name: str) -> Column:
    return F.round(c, 6).alias(name)


@query(f"WITH {_ERR} SELECT l_returnflag AS kind, count(*) AS n, round(avg(error), 6) AS mean, round(median(error), 6) AS median, round(sqrt(avg(error*error)), 6) AS rmse FROM err GROUP BY 1")
def agg_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = errors(spark, sf_dir).withColumnRenamed("l_returnflag", "kind")
    out = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("error"), "mean"), r6(F.sqrt(F.avg(F.col("error") * F.col("error"))), "rmse"))
    return out.join(ranges.percentiles(rows, ["kind"], "error", {"median": 0.5}), "kind", "left").withColumn("median", F.round("median", 6))


@query(f"WITH {_ERR} SELECT l_returnflag AS kind, round(quantile_cont(error, 0.25), 6) AS p25, round(quantile_cont(error, 0.5), 6) AS p50, round(quantile_cont(error, 0.9), 6) AS p90 FROM err GROUP BY 1")
def fn_percentile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranges.percentiles(errors(spark, sf_dir).withColumnRenamed("l_returnflag", "kind"), ["kind"], "error", {"p25": 0.25, "p50": 0.5, "p90": 0.9})
    return found.select("kind", *[r6(F.col(n), n) for n in ("p25", "p50", "p90")])


@query("SELECT s_suppkey, s_nationkey, round(CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS DOUBLE) / count(*) OVER (PARTITION BY s_nationkey), 9) AS cdf FROM supplier")
def agg_error_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empirical distribution of each group; ties are separate points."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    sizes = rows.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    placed = ranges.places(rows, "s_acctbal", ["s_suppkey"], keys=["s_nationkey"])
    return placed.join(sizes, "s_nationkey").select("s_suppkey", "s_nationkey", F.round((F.col("place") + 1) / F.col("n"), 9).alias("cdf"))


@query("""WITH r AS (SELECT s_nationkey, s_acctbal AS x, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) - 1 AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
  b AS (SELECT *, (4*(k+1) + n - 1) // n - 1 AS bin FROM r) SELECT s_nationkey, bin, count(*) AS n, min(x) AS lower, max(x) AS upper, round(median(x), 6) AS center, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.75), 6) AS p75 FROM b GROUP BY ALL""")
def agg_equal_count_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four bins of equal counts by rank: a row of rank k is in the first bin b with k < floor((b + 1) n / 4)."""
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.col("s_acctbal").alias("x"))
    sizes = rows.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    rows = ranges.places(rows, "x", ["s_suppkey"], "k", ["s_nationkey"]).join(sizes, "s_nationkey").withColumn("bin", F.expr("(4 * (k + 1) + n - 1) div n - 1"))
    keys = ["s_nationkey", "bin"]
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lower"), F.max("x").alias("upper"))
    found = ranges.percentiles(rows, keys, "x", {"center": 0.5, "p25": 0.25, "p75": 0.75})
    return out.join(found.select(*keys, *[r6(F.col(n), n) for n in ("center", "p25", "p75")]), keys)


@query("""WITH t AS (SELECT DISTINCT l_returnflag, CAST(l_quantity AS DOUBLE) AS thr FROM lineitem WHERE l_quantity % 10 = 0), s AS (SELECT t.l_returnflag, thr, count(*) AS n, median(l_discount * l_quantity / 10) AS med FROM t JOIN lineitem l ON l.l_returnflag = t.l_returnflag AND l.l_quantity >= thr GROUP BY ALL)
  SELECT l_returnflag, max(thr) AS fallback, min(CASE WHEN med <= 0.3 AND n >= 50 THEN thr END) AS threshold FROM s GROUP BY 1""")
def agg_threshold_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least threshold whose tail has enough rows and a median error within the target.

    Whether a tail's median lies within the target follows from how many of its errors do, and where these are just
    half from the errors on both sides of it. So counts are grouped once and summed from the top; no row meets a threshold.
    """
    e, target = F.col("l_discount") * F.col("l_quantity") / 10, 0.3
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("q"), e.alias("e"))
    near = F.col("e") <= target
    by_count = rows.groupBy("l_returnflag", "q").agg(F.count(F.lit(1)).alias("n"), F.count_if(near).alias("near"), F.max(F.when(near, F.col("e"))).alias("below"), F.min(F.when(~near, F.col("e"))).alias("above"))
    w = Window.partitionBy("l_returnflag").orderBy(F.desc("q")).rowsBetween(Window.unboundedPreceding, 0)
    tails = by_count.select("l_returnflag", "q", F.sum("n").over(w).alias("n"), F.sum("near").over(w).alias("near"), F.max("below").over(w).alias("below"), F.min("above").over(w).alias("above")).filter("q % 10 = 0")
    twice = 2 * F.col("near")
    within = (twice > F.col("n")) | ((twice == F.col("n")) & ((F.col("below") + F.col("above")) / 2 <= target))
    return tails.groupBy("l_returnflag").agg(F.max("q").alias("fallback"), F.min(F.when(within & (F.col("n") >= 50), F.col("q"))).alias("threshold"))


_CUM = f"{_ERR}, cum AS (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS cum, (l_orderkey + l_linenumber) % 9 = 0 AS unknown FROM err)"


@query(f"WITH {_CUM}, t AS (SELECT unnest([10.0, 25.0, 50.0, 100.0, 150.0])::DOUBLE AS thr) SELECT thr, count(*) AS n, round(median(CASE WHEN NOT unknown THEN error END), 6) AS median, round(quantile_cont(CASE WHEN NOT unknown THEN error END, 0.9), 6) AS p90, round(avg(CASE WHEN unknown THEN 1.0 ELSE 0.0 END), 6) AS unknown_fraction FROM cum, t WHERE cum >= thr GROUP BY 1")
def agg_tail_error_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of all predictions made at or past each threshold of cumulative counts.

    A prediction counts once, for the greatest threshold that it reaches, among equal errors; only distinct errors go on to the thresholds below.
    """
    steps = (10.0, 25.0, 50.0, 100.0, 150.0)
    rows = errors(spark, sf_dir).withColumn("cum", F.sum("l_quantity").over(islands.over(["l_orderkey"], "l_linenumber"))).filter(F.col("cum") >= steps[0])
    bucket = sum(((F.col("cum") >= x).cast("int") for x in steps), F.lit(0))
    unknown = (F.col("l_orderkey") + F.col("l_linenumber")) % 9 == 0
    counts = rows.groupBy(bucket.alias("bucket"), "error").agg(F.count(F.lit(1)).alias("all"), F.count_if(~unknown).alias("known"))
    reached = F.explode(F.slice(F.array(*map(F.lit, steps)), F.lit(1), F.col("bucket")))
    by_value = counts.select(reached.alias("thr"), "error", "all", "known").groupBy("thr", "error").agg(F.sum("all").alias("all"), F.sum("known").alias("known"))
    out = by_value.groupBy("thr").agg(F.sum("all").alias("n"), r6(1 - F.sum("known") / F.sum("all"), "unknown_fraction"))
    found = ranges.percentiles(by_value.filter("known > 0"), ["thr"], "error", {"median": 0.5, "p90": 0.9}, weight="known")
    return out.join(found.select("thr", *[r6(F.col(n), n) for n in ("median", "p90")]), "thr", "left")


_RADIUS = "sqrt(CAST((l_orderkey % 11)*(l_orderkey % 11) + (l_partkey % 13)*(l_partkey % 13) AS DOUBLE))"
_REGION = f"CASE WHEN {_RADIUS} < 4 THEN '0-4' WHEN {_RADIUS} < 8 THEN '4-8' WHEN {_RADIUS} < 12 THEN '8-12' ELSE '12+' END"


def region_key(radius: Column) -> Column:
    return F.when(radius < 4, "0-4").when(radius < 8, "4-8").when(radius < 12, "8-12").otherwise("12+")


def _radius() -> Column:
    x, y = F.col("l_orderkey") % 11, F.col("l_partkey") % 13
    return F.sqrt((x * x + y * y).cast("double"))


@query(f"SELECT l_orderkey, l_linenumber, {_REGION} AS region, {_RADIUS} >= 12 AS edge FROM lineitem")
def fn_region_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", region_key(_radius()).alias("region"), (_radius() >= 12).alias("edge"))


@query(f"SELECT {_REGION} AS region, {_RADIUS} >= 12 AS edge, count(*) AS n, round(median(least({_D['d11']}+{_D['d22']}, {_D['d12']}+{_D['d21']})/2), 6) AS median_error, round(avg((l_orderkey * 2) % 11 - l_orderkey % 11), 6) AS bias_x, round(avg(CASE WHEN (l_orderkey + l_linenumber) % 9 = 0 THEN 1.0 ELSE 0.0 END), 6) AS unknown_fraction FROM lineitem GROUP BY ALL")
def agg_region_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region and bias are expressions of the row, no join; medians by value ranges."""
    from .joins import _PAIRS, _PTS

    def dist(a: str, b: str) -> Column:
        return F.sqrt(F.expr(" + ".join(f"({x}-{y})*({x}-{y})" for x, y in zip(_PTS[a], _PTS[b], strict=True))).cast("double"))

    d = {k: dist(*v) for k, v in _PAIRS.items()}
    rows = table(spark, sf_dir, "lineitem").withColumns({"error": F.least(d["d11"] + d["d22"], d["d12"] + d["d21"]) / 2, "region": region_key(_radius()), "edge": _radius() >= 12})
    bias, unknown = (F.col("l_orderkey") * 2) % 11 - F.col("l_orderkey") % 11, (F.col("l_orderkey") + F.col("l_linenumber")) % 9 == 0
    out = rows.groupBy("region", "edge").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(bias), "bias_x"), r6(F.avg(unknown.cast("double")), "unknown_fraction"))
    return out.join(ranges.percentiles(rows, ["region", "edge"], "error", {"median_error": 0.5}), ["region", "edge"], "left").withColumn("median_error", F.round("median_error", 6))


@query("SELECT l_orderkey, l_linenumber, lower(l_linestatus) = 'o' OR (l_orderkey + l_linenumber) % 9 = 0 AS unknown FROM lineitem")
def prj_unknown_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.lower("l_linestatus") == "o") | ((F.col("l_orderkey") + F.col("l_linenumber")) % 9 == 0)).alias("unknown"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN lower(l_returnflag) = 'a' THEN 'Dual' WHEN lower(l_returnflag) = 'r' THEN 'Single' WHEN l_partkey % 2 = 0 THEN 'Dual' ELSE 'Single' END AS label FROM lineitem")
def prj_label_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label by its text, else by whether a second place is given."""
    text = F.lower("l_returnflag")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(text == "a", "Dual").when(text == "r", "Single").when(F.col("l_partkey") % 2 == 0, "Dual").otherwise("Single").alias("label"))


@query(f"WITH {_CUM}, g AS (SELECT *, row_number() OVER w AS k, count(*) FILTER (unknown) OVER w AS misses FROM cum WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)), s AS (SELECT *, sum(CASE WHEN unknown THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS pair FROM g) SELECT l_orderkey, min(CASE WHEN NOT unknown THEN k END) AS first_output, min(CASE WHEN pair = 2 THEN k END) AS first_stable FROM s GROUP BY 1")
def agg_motion_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps until the first output and until two stable outputs in a row."""
    w = islands.over(["l_orderkey"], "l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_orderkey") + F.col("l_linenumber")) % 9 == 0).alias("unknown"))
    rows = rows.withColumns({"k": F.row_number().over(w).cast("long"), "pair": F.sum(F.when(F.col("unknown"), 0).otherwise(1)).over(w.rowsBetween(0, 1))})
    return rows.groupBy("l_orderkey").agg(F.min(F.when(~F.col("unknown"), F.col("k"))).alias("first_output"), F.min(F.when(F.col("pair") == 2, F.col("k"))).alias("first_stable"))


@query("WITH l AS (SELECT l_orderkey, l_returnflag, l_linenumber, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS before, (l_orderkey + l_linenumber) % 9 = 0 AS unknown FROM lineitem) SELECT l_orderkey, round(avg(CASE WHEN unknown THEN 1.0 ELSE 0.0 END), 6) AS unknown_fraction, round(count(*) FILTER (before <> l_returnflag) / (max(l_linenumber)::DOUBLE / 60), 6) AS transitions_per_minute FROM l GROUP BY 1")
def agg_static_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", F.lag("l_returnflag").over(islands.over(["l_orderkey"], "l_linenumber", "l_returnflag")).alias("before"))
    unknown = (F.col("l_orderkey") + F.col("l_linenumber")) % 9 == 0
    return rows.groupBy("l_orderkey").agg(r6(F.avg(unknown.cast("double")), "unknown_fraction"), r6(F.count_if(F.col("before") != F.col("l_returnflag")) / (F.max("l_linenumber").cast("double") / 60), "transitions_per_minute"))


_SPREAD = "s AS (SELECT l_suppkey, unnest(['source1', 'source2', 'centroid']) AS source, unnest([l_quantity::DOUBLE, l_tax * 100, (l_quantity + l_tax * 100) / 2]) AS x, unnest([l_discount * 100, l_quantity::DOUBLE, (l_discount * 100 + l_quantity) / 2]) AS y FROM lineitem)"


@query(f"""WITH {_SPREAD}, m AS (SELECT l_suppkey, source, median(x) AS mx, median(y) AS my FROM s GROUP BY ALL)
  SELECT l_suppkey, source, round(mx, 6) AS mx, round(my, 6) AS my, round(sqrt(avg((x-mx)*(x-mx) + (y-my)*(y-my))), 6) AS rms, round(stddev_pop(x), 6) AS sx, round(stddev_pop(y), 6) AS sy FROM s JOIN m USING (l_suppkey, source) GROUP BY l_suppkey, source, mx, my""")
def agg_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of both predicted places and of their centroid about the component-wise median, in two passes; medians by value ranges."""
    x1, y1, x2, y2 = F.col("l_quantity").cast("double"), F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_quantity").cast("double")
    place = lambda name, x, y: F.struct(F.lit(name).alias("source"), x.alias("x"), y.alias("y"))
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.explode(F.array(place("source1", x1, y1), place("source2", x2, y2), place("centroid", (x1 + x2) / 2, (y1 + y2) / 2))).alias("p")).select("l_suppkey", "p.*")
    keys = ["l_suppkey", "source"]
    mid = ranges.percentiles(rows, keys, "x", {"mx": 0.5}).join(ranges.percentiles(rows, keys, "y", {"my": 0.5}), keys)
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    return rows.join(mid, keys).groupBy(*keys).agg(r6(F.first("mx"), "mx"), r6(F.first("my"), "my"), r6(F.sqrt(F.avg(dx * dx + dy * dy)), "rms"), r6(F.stddev_pop("x"), "sx"), r6(F.stddev_pop("y"), "sy"))


@query("WITH l AS (SELECT l_suppkey % 7 AS mode, l_extendedprice FROM lineitem), m AS (SELECT mode, median(l_extendedprice) AS med FROM l GROUP BY 1) SELECT mode, round(avg(l_extendedprice), 4) AS mean, round(med, 6) AS median, round(stddev_pop(l_extendedprice), 4) AS stdev, round(median(abs(l_extendedprice - med)), 6) AS mad FROM l JOIN m USING (mode) GROUP BY mode, med")
def agg_metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).alias("mode"), "l_extendedprice")
    med = ranges.percentiles(rows, ["mode"], "l_extendedprice", {"med": 0.5})
    off = rows.join(med, "mode").select("mode", "med", "l_extendedprice", F.abs(F.col("l_extendedprice") - F.col("med")).alias("off"))
    out = off.groupBy("mode").agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"), r6(F.first("med"), "median"), F.round(F.stddev_pop("l_extendedprice"), 4).alias("stdev"))
    return out.join(ranges.percentiles(off, ["mode"], "off", {"mad": 0.5}), "mode").withColumn("mad", F.round("mad", 6))


#: Runs are orders with their line items as windows, groups are nations.
_RUNS = "w AS (SELECT c_nationkey AS grp, o_orderkey AS run, CAST(l_quantity AS DOUBLE)/10 AS m1, CAST(l_quantity AS DOUBLE)*l_quantity/150 AS m2, l_discount*10 AS m3 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey), runs AS (SELECT grp, run, avg(m1) AS m1, avg(m2) AS m2, avg(m3) AS m3, avg((m2-m1*m1)/m1) AS y, count(*) AS windows FROM w GROUP BY ALL)"


def run_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, run, m1, m2, m3): a window per row."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("grp"))
    q = F.col("l_quantity").cast("double")
    return table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("grp", F.col("o_orderkey").alias("run"), (q / 10).alias("m1"), (q * q / 150).alias("m2"), (F.col("l_discount") * 10).alias("m3"))


def run_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = (F.col("m2") - F.col("m1") * F.col("m1")) / F.col("m1")
    return run_windows(spark, sf_dir).groupBy("grp", "run").agg(*[F.avg(m).alias(m) for m in ("m1", "m2", "m3")], F.avg(y).alias("y"), F.count(F.lit(1)).alias("windows"))


@query(f"WITH {_RUNS} SELECT grp, run, round(m1, 6) AS m1, round(m2, 6) AS m2, round(m3, 6) AS m3, round(y, 6) AS y, windows FROM runs")
def agg_run_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_means(spark, sf_dir).select("grp", "run", *[r6(c, c) for c in ("m1", "m2", "m3", "y")], "windows")


_COVS = [(i, j) for i in (1, 2, 3) for j in range(i, 4)]


def empirical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_means(spark, sf_dir).groupBy("grp").agg(*[F.covar_samp(f"m{i}", f"m{j}").alias(f"e{i}{j}") for i, j in _COVS])


def system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over runs of the covariance of a run's mean, from its windows."""
    per_run = run_windows(spark, sf_dir).groupBy("grp", "run").agg(*[(F.covar_samp(f"m{i}", f"m{j}") / F.count(F.lit(1))).alias(f"s{i}{j}") for i, j in _COVS])
    return per_run.groupBy("grp").agg(*[F.avg(f"s{i}{j}").alias(f"s{i}{j}") for i, j in _COVS])


_EMP = "emp AS (SELECT grp, " + ", ".join(f"covar_samp(m{i}, m{j}) AS e{i}{j}" for i, j in _COVS) + " FROM runs GROUP BY 1)"
_SYS = "sys AS (SELECT grp, " + ", ".join(f"avg(s{i}{j}) AS s{i}{j}" for i, j in _COVS) + " FROM (SELECT grp, run, " + ", ".join(f"covar_samp(m{i}, m{j})/count(*) AS s{i}{j}" for i, j in _COVS) + " FROM w GROUP BY ALL) GROUP BY 1)"


@query(f"WITH {_RUNS}, {_EMP} SELECT grp, {', '.join(f'round(e{i}{j}, 6) AS e{i}{j}' for i, j in _COVS)} FROM emp")
def agg_empirical_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return empirical(spark, sf_dir).select("grp", *[r6(f"e{i}{j}", f"e{i}{j}") for i, j in _COVS])


@query(f"WITH {_RUNS}, {_SYS} SELECT grp, {', '.join(f'round(s{i}{j}, 6) AS s{i}{j}' for i, j in _COVS)} FROM sys")
def agg_system_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return system(spark, sf_dir).select("grp", *[r6(f"s{i}{j}", f"s{i}{j}") for i, j in _COVS])


def _det(p: str) -> str:
    return f"({p}11*({p}22*{p}33-{p}23*{p}23) - {p}12*({p}12*{p}33-{p}23*{p}13) + {p}13*({p}12*{p}23-{p}22*{p}13))"


_FROB = "sqrt(" + " + ".join(f"{1 if i == j else 2}*(s{i}{j}-e{i}{j})*(s{i}{j}-e{i}{j})" for i, j in _COVS) + ") / sqrt(" + " + ".join(f"{1 if i == j else 2}*e{i}{j}*e{i}{j}" for i, j in _COVS) + ")"
_LOGDET = f"CASE WHEN {_det('s')} > 0 AND {_det('e')} > 0 THEN ln({_det('s')}) - ln({_det('e')}) END"


@query(f"WITH {_RUNS}, {_EMP}, {_SYS} SELECT grp, round({_FROB}, 6) AS frobenius, round({_LOGDET}, 5) AS log_det, round(s12/sqrt(s11*s22) - e12/sqrt(e11*e22), 6) AS corr12 FROM emp JOIN sys USING (grp)")
def agg_cov_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = empirical(spark, sf_dir).join(system(spark, sf_dir), "grp")
    return both.select("grp", r6(F.expr(_FROB), "frobenius"), F.round(F.expr(_LOGDET), 5).alias("log_det"), r6(F.expr("s12/sqrt(s11*s22) - e12/sqrt(e11*e22)"), "corr12"))


@query(f"WITH {_RUNS}, {_EMP}, {_SYS} SELECT grp, i, j, round(e, 6) AS emp, round(s, 6) AS sys, round(CASE WHEN e <> 0 THEN s/e END, 5) AS ratio, round(s-e, 6) AS diff FROM (SELECT grp, unnest([{', '.join(str(i) for i, _ in _COVS)}]) AS i, unnest([{', '.join(str(j) for _, j in _COVS)}]) AS j, unnest([{', '.join(f'e{i}{j}' for i, j in _COVS)}]) AS e, unnest([{', '.join(f's{i}{j}' for i, j in _COVS)}]) AS s FROM emp JOIN sys USING (grp))")
def agg_cov_elementwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = empirical(spark, sf_dir).join(system(spark, sf_dir), "grp")
    stacked = both.selectExpr("grp", f"stack({len(_COVS)}, " + ", ".join(f"{i}, {j}, e{i}{j}, s{i}{j}" for i, j in _COVS) + ") AS (i, j, e, s)")
    return stacked.select("grp", "i", "j", r6("e", "emp"), r6("s", "sys"), F.round(F.when(F.col("e") != 0, F.col("s") / F.col("e")), 5).alias("ratio"), r6(F.col("s") - F.col("e"), "diff"))


Z95 = NormalDist().inv_cdf(0.975)


_A, _B = "(-m2/(m1*m1) - 1)", "(1/m1)"
_DIAG_Y = f"{_A}*{_A}*s11 + {_B}*{_B}*s22"
_FULL_Y = f"{_DIAG_Y} + 2*{_A}*{_B}*s12"


@query(f"""WITH {_RUNS}, {_SYS}, t AS (SELECT grp, unnest(['m1', 'm2', 'm3', 'Y']) AS target, unnest([m1, m2, m3, y]) AS v, unnest([s11, s22, s33, greatest({_FULL_Y}, 0)]) AS f, unnest([s11, s22, s33, greatest({_DIAG_Y}, 0)]) AS d FROM runs JOIN sys USING (grp)),
  g AS (SELECT grp, target, avg(v) AS mu FROM t GROUP BY ALL)
  SELECT grp, target, round(avg(CASE WHEN abs(v-mu) <= {Z95}*sqrt(f) THEN 1.0 ELSE 0.0 END), 6) AS coverage_full, round(avg(CASE WHEN abs(v-mu) <= {Z95}*sqrt(d) THEN 1.0 ELSE 0.0 END), 6) AS coverage_diag,
    round(avg(2*{Z95}*sqrt(f)), 6) AS width_full, round(avg(2*{Z95}*sqrt(d)), 6) AS width_diag, count(*) AS n FROM t JOIN g USING (grp, target) GROUP BY ALL""")
def agg_ci_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the normal intervals of the runs hold their group's mean, and how wide they are: for m1, m2, m3 and Y, with the whole covariance and its diagonal alone."""
    return coverage(run_windows(spark, sf_dir), ["grp"])


def coverage(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage and width by keys and target, from windows (keys, run, m1, m2, m3). One aggregation gives a run's means and the covariance of its mean.

    Runs are written once and read twice: for the means and covariances of their groups, and against these. A row for each group
    is broadcast by hand: groups are few, and joined by their key all runs would be dealt out to them.
    """
    y = (F.col("m2") - F.col("m1") * F.col("m1")) / F.col("m1")
    n = F.count(F.lit(1))
    runs = windows.groupBy(*keys, "run").agg(*[F.avg(m).alias(m) for m in ("m1", "m2", "m3")], F.avg(y).alias("y"), *[(F.covar_samp(f"m{i}", f"m{j}") / n).alias(f"r{i}{j}") for i, j in _COVS])
    runs = written(runs, "runs")
    groups = runs.groupBy(*keys).agg(*[F.avg(f"r{i}{j}").alias(f"s{i}{j}") for i, j in _COVS], *[F.avg(v).alias(f"mu_{v}") for v in ("m1", "m2", "m3", "y")])
    rows = runs.select(*keys, "m1", "m2", "m3", "y").join(F.broadcast(groups), keys)
    targets = [("m1", "m1", "s11", "s11"), ("m2", "m2", "s22", "s22"), ("m3", "m3", "s33", "s33"), ("Y", "y", f"greatest({_FULL_Y}, 0D)", f"greatest({_DIAG_Y}, 0D)")]
    long = rows.selectExpr(*keys, "stack(4, " + ", ".join(f"'{n}', {v}, mu_{v}, {f}, {d}" for n, v, f, d in targets) + ") AS (target, v, mu, f, d)")
    held = lambda c: F.avg((F.abs(F.col("v") - F.col("mu")) <= Z95 * F.sqrt(c)).cast("double"))
    width = lambda c: F.avg(2 * Z95 * F.sqrt(c))
    return long.groupBy(*keys, "target").agg(r6(held("f"), "coverage_full"), r6(held("d"), "coverage_diag"), r6(width("f"), "width_full"), r6(width("d"), "width_diag"), F.count(F.lit(1)).alias("n"))


_FACTORS = [1.0, 0.75, 0.5, 0.25, 0.1]
_KEPT = f"""w0 AS (SELECT c_nationkey AS grp, o_orderkey AS run, CAST(l_quantity AS DOUBLE)/10 AS m1, CAST(l_quantity AS DOUBLE)*l_quantity/150 AS m2, l_discount*10 AS m3 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
  dealt AS (SELECT *, unnest({_FACTORS}::DOUBLE[]) AS factor FROM w0),
  w AS (SELECT * FROM dealt QUALIFY row_number() OVER (PARTITION BY factor, grp, run ORDER BY md5(concat(CAST(factor * 100 AS INTEGER), '-', run, '-', CAST(round(m1 * 10) AS INTEGER), '-', CAST(round(m3 * 10) AS INTEGER)))) <= greatest(1, floor(factor * count(*) OVER (PARTITION BY factor, grp, run)))),
  runs AS (SELECT factor, grp, run, avg(m1) AS m1, avg(m2) AS m2, avg(m3) AS m3, avg((m2-m1*m1)/m1) AS y FROM w GROUP BY ALL),
  sys AS (SELECT factor, grp, {', '.join(f'avg(s{i}{j}) AS s{i}{j}' for i, j in _COVS)} FROM (SELECT factor, grp, run, {', '.join(f'covar_samp(m{i}, m{j})/count(*) AS s{i}{j}' for i, j in _COVS)} FROM w GROUP BY ALL) GROUP BY ALL)"""


@query(f"""WITH {_KEPT}, t AS (SELECT factor, grp, unnest(['m1', 'm2', 'm3', 'Y']) AS target, unnest([m1, m2, m3, y]) AS v, unnest([s11, s22, s33, greatest({_FULL_Y}, 0)]) AS f, unnest([s11, s22, s33, greatest({_DIAG_Y}, 0)]) AS d FROM runs JOIN sys USING (factor, grp)),
  g AS (SELECT factor, grp, target, avg(v) AS mu FROM t GROUP BY ALL)
  SELECT factor, grp, target, round(avg(CASE WHEN abs(v-mu) <= {Z95}*sqrt(f) THEN 1.0 WHEN f IS NOT NULL THEN 0.0 END), 6) AS coverage_full, round(avg(CASE WHEN abs(v-mu) <= {Z95}*sqrt(d) THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END), 6) AS coverage_diag,
    round(avg(2*{Z95}*sqrt(f)), 6) AS width_full, round(avg(2*{Z95}*sqrt(d)), 6) AS width_diag, count(*) AS n FROM t JOIN g USING (factor, grp, target) GROUP BY ALL""")
def agg_reduced_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same coverage from a share of each run's windows, chosen by a hash: one window at least, for m1, m2, m3 and Y, under both covariances. Where no run of a group keeps two windows there is no covariance, and coverage and width are null."""
    # Windows are dealt out by their run before they are repeated for each share; what follows keeps to that, in parts that a task can sort in memory.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, "lineitem").count() * len(_FACTORS) // ranges.PART_ROWS))
    rows = run_windows(spark, sf_dir).repartition(parts, "grp", "run").withColumn("factor", F.explode(F.array(*map(F.lit, _FACTORS))))
    whole = lambda c: F.round(c).cast("int").cast("string")
    drawn = F.md5(F.concat_ws("-", whole(F.col("factor") * 100), F.col("run").cast("string"), whole(F.col("m1") * 10), whole(F.col("m3") * 10)).cast("binary"))
    run = Window.partitionBy("factor", "grp", "run")
    kept = rows.withColumns({"k": F.row_number().over(run.orderBy(drawn)), "all": F.count(F.lit(1)).over(run)})
    return coverage(kept.filter(F.col("k") <= F.greatest(F.lit(1.0), F.floor(F.col("factor") * F.col("all")))), ["factor", "grp"])


@query("""WITH d AS (SELECT l_suppkey % 7 AS k, l_discount*100 - 5.0 AS r FROM lineitem), s AS (SELECT k, count(*)::DOUBLE AS n, avg(r) AS mu, var_samp(r) AS v FROM d GROUP BY 1), c AS (SELECT k, n, mu, v, avg((r-mu)*(r-mu)) AS u2, avg((r-mu)*(r-mu)*(r-mu)) AS u3, avg((r-mu)*(r-mu)*(r-mu)*(r-mu)) AS u4 FROM d JOIN s USING (k) GROUP BY ALL)
  SELECT k, round(mu, 6) AS mean, round(sqrt(v), 6) AS std, round(sqrt(n*(n-1))/(n-2)*u3/(u2*sqrt(u2)), 6) AS skew, round((n-1)/((n-2)*(n-3))*((n+1)*(u4/(u2*u2)-3)+6), 6) AS kurtosis FROM c""")
def agg_residual_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, ddof-1 deviation, and the bias-corrected skewness and excess kurtosis, from built-in biased ones."""
    r = F.col("l_discount") * 100 - 5.0
    s = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("k")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(r).alias("mu"), F.stddev_samp(r).alias("sd"), F.skewness(r).alias("g1"), F.kurtosis(r).alias("g2"))
    n = F.col("n")
    return s.select("k", r6("mu", "mean"), r6("sd", "std"), r6(F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1"), "skew"), r6((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6), "kurtosis"))


@query("WITH g AS (SELECT l_suppkey % 7 AS source, l_returnflag AS outcome, count(*) AS n FROM lineitem GROUP BY ALL) SELECT source, outcome, n, round(n / sum(n) OVER (PARTITION BY source), 9) AS fraction FROM g")
def agg_outcome_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("source"), F.col("l_returnflag").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("fraction", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 9))


@query("SELECT p_brand AS fault, count(*) AS n, round(avg(CASE WHEN p_retailprice >= 1000 THEN 1.0 ELSE 0.0 END), 6) AS detected FROM part GROUP BY 1")
def agg_detection_rate_by_fault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("fault")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("p_retailprice") >= 1000).cast("double")), "detected"))


@query("WITH g AS (SELECT o_custkey % 50 AS grp, count(*) AS runs, count(*) FILTER (o_totalprice < 50000) AS failed FROM orders GROUP BY 1) SELECT grp, runs, failed, failed > 0.1 * runs AS too_many_failed, runs < 20 AS too_few FROM g")
def agg_input_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("grp")).agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("o_totalprice") < 50000).alias("failed"))
    return g.withColumns({"too_many_failed": F.col("failed") > 0.1 * F.col("runs"), "too_few": F.col("runs") < 20})


@query("SELECT l_orderkey, l_linenumber, round(d11, 6) AS d11, round(d21, 6) AS d21, " + ", ".join(f"({_PTS['p1'][i]} + {_PTS['p2'][i]}) / 2.0::DOUBLE AS c{a}, {_PTS['p1'][i]} - {_PTS['t1'][i]} AS b{a}" for i, a in enumerate("xyz")) + f" FROM (SELECT *, {', '.join(f'{_sql_dist(*_PAIRS[k])} AS {k}' for k in ('d11', 'd21'))} FROM lineitem)")
def fn_distance3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of both predictions to a place, their centroid, and the first one's bias."""
    points = {n: F.array(*[F.expr(x).cast("double") for x in _PTS[n]]) for n in ("t1", "p1", "p2")}
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[v.alias(n) for n, v in points.items()])
    mid, off = centroid3(F.col("p1"), F.col("p2")), bias3(F.col("p1"), F.col("t1"))
    axes = [c for i, a in enumerate("xyz", 1) for c in (F.element_at(mid, i).alias(f"c{a}"), F.element_at(off, i).cast("long").alias(f"b{a}"))]
    return rows.select("l_orderkey", "l_linenumber", r6(distance3(F.col("p1"), F.col("t1")), "d11"), r6(distance3(F.col("p2"), F.col("t1")), "d21"), *axes)
