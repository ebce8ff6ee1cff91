"""Joins of windows, truth, manifests and predictions, and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import islands, pairs, schedule
from ..operators.ranges import places
from ..registry import query
from ..sources import files
from ..tables import new_path
from .views import DAY, DETECTIONS, HOUR, detections, table
from .windows import _W, STEP6, steps


@query("SELECT o_orderkey, c_mktsegment || '-' || CAST(c_custkey % 3 AS VARCHAR) AS segment, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 7 <> 0")
def join_pair_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their metadata, read from CSV files, by the first key that both have; of repeated keys the last row of the files counts, rows without metadata go.

    A key stands in one to three rows, under two spellings. The optimizer chooses to broadcast by the side's size.
    """
    folder = new_path(spark, "pairs")
    customer = table(spark, sf_dir, "customer").filter("c_custkey % 7 <> 0")
    rows = customer.select(F.explode(F.sequence(F.lit(0), F.col("c_custkey") % 3)).alias("version"), "*")
    key = F.concat(F.when(F.col("version") % 2 == 0, "k").otherwise("K"), F.col("c_custkey").cast("string"))
    rows = rows.select(key.alias("Pair"), F.concat("c_mktsegment", F.lit("-"), F.col("version").cast("string")).alias("segment"), "c_nationkey", F.lit(0).alias("row"), "c_custkey", "version")
    rows.orderBy("version", "c_custkey").drop("c_custkey", "version").write.option("header", "true").csv(folder)
    counts = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("pair"), F.lit(1).alias("ROW"))
    return pairs.with_metadata(counts, files.read_csv(spark, folder, order=True)).select("o_orderkey", "segment", F.col("c_nationkey").cast("int").alias("c_nationkey"))


@query("WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS k FROM part), b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier) SELECT p_partkey, s_suppkey FROM a JOIN b USING (k)")
def join_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables side by side by place, as long as the shorter one. Places come from value ranges and their sizes."""
    a = places(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    b = places(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")
    return a.join(b, "place").select("p_partkey", "s_suppkey")


_TRUTH = f"truth AS (SELECT run_id, ts_us AS change_us, channel AS place FROM det WHERE event_id % 50 = 0)"


def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).filter("event_id % 50 = 0").select("run_id", F.col("ts_us").alias("change_us"), F.col("channel").alias("place"))


@query(f"WITH {_W}, {_TRUTH} SELECT s.run_id, s.idx, t.place FROM (SELECT run_id, idx, idx * {STEP6} AS t_us FROM steps) s ASOF LEFT JOIN truth t ON s.run_id = t.run_id AND s.t_us >= t.change_us")
def join_asof_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truth that holds where a window starts: the last change point up to then."""
    windows = steps(spark, sf_dir).select("run_id", "idx", (F.col("idx") * STEP6).alias("t_us"))
    return islands.asof(windows, change_points(spark, sf_dir), ["run_id"], "t_us", "change_us", ["place"]).select("run_id", "idx", "place")


@query(f"WITH {DETECTIONS}, b AS (SELECT run_id, ts_us // {HOUR} AS bin, count(*) AS n FROM det GROUP BY ALL) SELECT run_id, win, CAST(sum(n) AS BIGINT) AS n, count(*) AS bins FROM (SELECT *, unnest(generate_series(CAST(floor((bin*{HOUR} - {2 * DAY}) / {DAY}) + 1 AS BIGINT), bin*{HOUR} // {DAY})) AS win FROM b) GROUP BY ALL")
def join_interval_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bin with each window of two days, a day apart, that holds it."""
    from ..operators import bins as B

    bins = B.base_bins(detections(spark, sf_dir), HOUR, by_channel=False)
    return B.sliding_windows(bins, HOUR, 2 * DAY, DAY).groupBy("run_id", "win").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("bins"))


# A part's row covers 50 to 100 units of the hundred behind its key, so there are gaps; times go beyond both ends.
_PLAN = "plan AS (SELECT p_partkey * 100 + 7 AS a, p_partkey * 100 + 57 + p_size AS b, p_brand AS planned, p_retailprice AS w_s FROM part)"
_ASKED = "asked AS (SELECT l_orderkey * 13 % ((SELECT max(p_partkey) FROM part) * 110) - 50 + l_linenumber AS t FROM lineitem)"


@query(f"""WITH {_PLAN}, {_ASKED}, edges AS (SELECT min(a) AS a0, max(a) AS a1 FROM plan), k AS (SELECT DISTINCT t FROM asked), f AS (SELECT t, greatest(coalesce((SELECT max(a) FROM plan WHERE a <= t), a0), a0) AS a FROM k, edges)
  SELECT t, planned, w_s, covered FROM (SELECT f.t, CASE WHEN f.t < a0 OR f.t < plan.b OR plan.a = a1 THEN planned END AS planned, CASE WHEN f.t < a0 OR f.t < plan.b OR plan.a = a1 THEN w_s END AS w_s, f.t < a0 OR f.t < plan.b OR plan.a = a1 AS covered FROM f JOIN plan USING (a), edges)""")
def join_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with the row of a schedule (a table, checked for empty rows and overlaps) that covers them; the first row counts before it, the last one behind it."""
    part = table(spark, sf_dir, "part")
    plan = part.select((F.col("p_partkey") * 100 + 7).alias("a"), (F.col("p_partkey") * 100 + 57 + F.col("p_size")).alias("b"), F.col("p_brand").alias("planned"), F.col("p_retailprice").alias("w_s"))
    schedule.check(plan, "a", "b")
    most = part.agg(F.max("p_partkey").alias("most"))
    asked = table(spark, sf_dir, "lineitem").join(F.broadcast(most)).select((F.col("l_orderkey") * 13 % (F.col("most") * 110) - 50 + F.col("l_linenumber")).alias("t")).distinct()  # one row
    return schedule.covering(asked, "t", plan, "a", "b", ["planned", "w_s"], ["t"])


@query("SELECT o_orderkey, n_name AS grp, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0")
def join_runs_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with their manifest's group, usable ones only."""
    manifest = table(spark, sf_dir, "nation").filter("n_regionkey <> 0").select("n_nationkey", F.col("n_name").alias("grp"))
    customers = table(spark, sf_dir, "customer").join(manifest, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "grp")
    return table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "grp", "o_totalprice")


@query(f"WITH {DETECTIONS} SELECT event_id, last_value(CASE WHEN channel <= 3 THEN event_id END IGNORE NULLS) OVER (PARTITION BY run_id, ts_us // {DAY} ORDER BY ts_us, event_id) AS request FROM det")
def join_last_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every decision with the latest request of its episode."""
    w = islands.over(["run_id", "day"], "ts_us", "event_id")
    rows = detections(spark, sf_dir).withColumn("day", F.expr(f"ts_us div {DAY}"))
    return rows.select("event_id", F.last(F.when(F.col("channel") <= 3, F.col("event_id")), ignorenulls=True).over(w).alias("request"))


@query("WITH g AS (SELECT c_nationkey, count(*) AS runs FROM customer GROUP BY 1), c AS (SELECT s_nationkey AS c_nationkey, round(avg(CASE WHEN s_acctbal BETWEEN 0 AND 5000 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM supplier GROUP BY 1) SELECT c_nationkey, runs, coverage FROM g LEFT JOIN c USING (c_nationkey)")
def join_group_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("runs"))
    coverage = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.round(F.avg(F.col("s_acctbal").between(0, 5000).cast("double")), 6).alias("coverage"))
    return groups.join(coverage, "c_nationkey", "left")


#: Two true and two predicted places of every line item, from its keys.
_PTS = {n: [f"((l_{c} * {m}) % {k})" for c, m, k in zip(("orderkey", "partkey", "suppkey"), ms, (11, 13, 7), strict=True)] for n, ms in {"t1": (1, 1, 1), "t2": (3, 5, 2), "p1": (2, 7, 3), "p2": (5, 3, 4)}.items()}


def _sql_dist(a: str, b: str) -> str:
    return "sqrt(CAST(" + " + ".join(f"({x}-{y})*({x}-{y})" for x, y in zip(_PTS[a], _PTS[b], strict=True)) + " AS DOUBLE))"


_PAIRS = {f"d{i}{j}": (f"p{i}", f"t{j}") for i in (1, 2) for j in (1, 2)}
_DIST_SQL = "dist AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_shipdate, " + ", ".join(f"{_sql_dist(*v)} AS {k}" for k, v in _PAIRS.items()) + " FROM lineitem)"


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(keys, d11, d12, d21, d22): distances of predicted to true places."""

    def dist(a: str, b: str) -> Column:
        return F.sqrt(F.expr(" + ".join(f"({x}-{y})*({x}-{y})" for x, y in zip(_PTS[a], _PTS[b], strict=True))).cast("double"))

    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate", *[dist(*v).alias(k) for k, v in _PAIRS.items()])


_AXES = "xyz"
_STRAIGHT = "d11+d22 <= d12+d21"
_BIAS_SQL = ", ".join(f"CASE WHEN {_STRAIGHT} THEN {_PTS[f'p{k}'][i]} - {_PTS[f't{k}'][i]} ELSE {_PTS[f'p{k}'][i]} - {_PTS[f't{3 - k}'][i]} END AS b{k}{c}" for k in (1, 2) for i, c in enumerate(_AXES))
_MID_SQL = [f"({_PTS['p1'][i]} + {_PTS['p2'][i]} - {_PTS['t1'][i]} - {_PTS['t2'][i]}) / 2.0::DOUBLE" for i in range(3)]


@query(f"""WITH dist AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {', '.join(f'{_sql_dist(*v)} AS {k}' for k, v in _PAIRS.items())} FROM lineitem)
  SELECT l_orderkey, l_linenumber, round(CASE WHEN {_STRAIGHT} THEN d11 ELSE d12 END, 6) AS e1, round(CASE WHEN {_STRAIGHT} THEN d22 ELSE d21 END, 6) AS e2, round(least(d11+d22, d12+d21)/2, 6) AS mean_error,
    round(sqrt({' + '.join(f'({m})*({m})' for m in _MID_SQL)}), 6) AS centroid_error, {', '.join(f'{m} AS c{c}' for m, c in zip(_MID_SQL, _AXES, strict=True))}, {_BIAS_SQL} FROM dist""")
def join_dual_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairing of two predictions with two truths that has the smaller sum: both errors and their mean, the error and bias of the centroid, and the bias of each prediction."""
    from ..functions import values as V

    at = {n: F.array(*[F.expr(x).cast("double") for x in xs]) for n, xs in _PTS.items()}
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[v.alias(n) for n, v in at.items()])
    rows = rows.withColumns({f"d{i}{j}": V.distance3(F.col(f"p{i}"), F.col(f"t{j}")) for i in (1, 2) for j in (1, 2)})
    straight = F.col("d11") + F.col("d22") <= F.col("d12") + F.col("d21")
    pick = lambda a, b: F.when(straight, a).otherwise(b)
    rows = rows.withColumns({"e1": pick(F.col("d11"), F.col("d12")), "e2": pick(F.col("d22"), F.col("d21")), "mid": V.bias3(V.centroid3(F.col("p1"), F.col("p2")), V.centroid3(F.col("t1"), F.col("t2")))})
    bias = {f"b{k}": V.bias3(F.col(f"p{k}"), pick(F.col(f"t{k}"), F.col(f"t{3 - k}"))) for k in (1, 2)}
    rows = rows.withColumns({**bias, "centroid_error": V.distance3(V.centroid3(F.col("p1"), F.col("p2")), V.centroid3(F.col("t1"), F.col("t2")))})
    parts = [F.element_at("mid", i).alias(f"c{c}") for i, c in enumerate(_AXES, 1)] + [F.element_at(f"b{k}", i).cast("long").alias(f"b{k}{c}") for k in (1, 2) for i, c in enumerate(_AXES, 1)]
    return rows.select("l_orderkey", "l_linenumber", F.round("e1", 6).alias("e1"), F.round("e2", 6).alias("e2"), F.round((F.col("e1") + F.col("e2")) / 2, 6).alias("mean_error"), F.round("centroid_error", 6).alias("centroid_error"), *parts)


@query(f"WITH {_DIST_SQL} SELECT l_orderkey, l_linenumber, round(least(greatest(d11, d22), greatest(d12, d21)), 6) AS worst FROM dist")
def join_dual_assignment_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(F.least(F.greatest("d11", "d22"), F.greatest("d12", "d21")), 6).alias("worst"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey % 5 = 0 AS holdout FROM lineitem")
def join_semi_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the held-out groups by a semi join, all others by an anti join."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    held = rows.select("l_suppkey").distinct().filter("l_suppkey % 5 = 0")
    out = rows.join(held, "l_suppkey", "left_semi").withColumn("holdout", F.lit(True)).unionByName(rows.join(held, "l_suppkey", "left_anti").withColumn("holdout", F.lit(False)))
    return out.select("l_orderkey", "l_linenumber", "holdout")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def join_baseline_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(base, "o_custkey", "left_anti").select("o_orderkey")


@query(f"WITH {_W}, p AS (SELECT run_id, ts_us // {STEP6} AS idx, avg(value) AS probability FROM det GROUP BY ALL) SELECT run_id, idx, n, state, round(probability, 6) AS probability FROM steps JOIN p USING (run_id, idx)")
def join_window_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = detections(spark, sf_dir).groupBy("run_id", F.expr(f"ts_us div {STEP6}").alias("idx")).agg(F.avg("value").alias("probability"))
    return steps(spark, sf_dir).join(predictions, ["run_id", "idx"]).select("run_id", "idx", "n", "state", F.round("probability", 6).alias("probability"))


@query("SELECT 'single' AS kind, l_orderkey, l_linenumber, CAST(NULL AS BIGINT) AS second FROM lineitem WHERE l_returnflag = 'N' UNION ALL SELECT 'dual', l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag <> 'N'")
def set_union_single_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    single = rows.filter("l_returnflag = 'N'").select(F.lit("single").alias("kind"), "l_orderkey", "l_linenumber")
    dual = rows.filter("l_returnflag <> 'N'").select(F.lit("dual").alias("kind"), "l_orderkey", "l_linenumber", F.col("l_partkey").alias("second"))
    return dual.unionByName(single, allowMissingColumns=True)


@query("WITH u AS (SELECT o_orderstatus AS outcome FROM orders UNION SELECT l_linestatus FROM lineitem) SELECT outcome, row_number() OVER (ORDER BY outcome) AS place FROM u")
def set_observed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All outcome labels in order; there are as many rows as labels."""
    both = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("outcome")).union(table(spark, sf_dir, "lineitem").select("l_linestatus")).distinct()
    from pyspark.sql import Window

    return both.select("outcome", F.row_number().over(Window.orderBy("outcome")).cast("long").alias("place"))


@query("SELECT count(*) AS shared FROM (SELECT l_suppkey FROM lineitem WHERE l_suppkey % 5 = 0 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_suppkey % 5 <> 0)")
def set_train_holdout_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey")
    return rows.filter("l_suppkey % 5 = 0").intersect(rows.filter("l_suppkey % 5 <> 0")).agg(F.count(F.lit(1)).alias("shared"))
