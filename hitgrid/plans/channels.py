"""Channel analytics: masks, ranges, rates, ratios, features and group ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import islands, ranges
from ..registry import query
from ..sources import listmode
from .views import DAY, DETECTIONS, HOUR, detections, table

_C15 = [f"c{c}" for c in range(1, 16)]
_VECTORS = f"vec AS (SELECT run_id, ts_us // {DAY} AS day, {', '.join(f'count(*) FILTER (channel = {c}) AS c{c}' for c in range(1, 16))} FROM det GROUP BY ALL)"


def count_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, day, c1 .. c15)"""
    det = detections(spark, sf_dir).withColumn("day", F.expr(f"ts_us div {DAY}"))
    return det.groupBy("run_id", "day").agg(*[F.count_if(F.col("channel") == c).alias(f"c{c}") for c in range(1, 16)])


def channels(df: DataFrame) -> DataFrame:
    return df.withColumn("channels", F.array(*[F.col(c).cast("double") for c in _C15]))


@query("SELECT l_orderkey, l_linenumber, b + 1 AS channel FROM lineitem, (SELECT unnest(range(15)) AS b) WHERE (((l_orderkey * 8 + l_linenumber) % 32768) >> b) & 1 = 1")
def flt_channel_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of the 15 channels whose bit is set in a hit's mask."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) % 32768).alias("mask"))
    hit = F.filter(F.sequence(F.lit(1), F.lit(15)), lambda c: F.getbit(F.col("mask"), c - 1) == 1)
    return rows.select("l_orderkey", "l_linenumber", F.explode(hit).alias("channel")).withColumn("channel", F.col("channel").cast("long"))


@query("SELECT event_type AS run_id, count(*) FILTER (user_id % 20 BETWEEN 1 AND 15) AS accepted, count(*) FILTER (NOT user_id % 20 BETWEEN 1 AND 15) AS ignored FROM events GROUP BY 1")
def flt_channel_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = (F.col("user_id") % 20).between(1, 15)
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run_id")).agg(F.count_if(inside).alias("accepted"), F.count_if(~inside).alias("ignored"))


@query(f"WITH {DETECTIONS} SELECT run_id, event_id, channel FROM det WHERE ts_us BETWEEN (SELECT min(ts_us) FROM det) + {2 * DAY} AND (SELECT min(ts_us) FROM det) + {5 * DAY}")
def flt_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = detections(spark, sf_dir)
    start = det.agg(F.min("ts_us").alias("t0"))
    rows = det.join(F.broadcast(start))  # one row
    return rows.filter(F.col("ts_us").between(F.col("t0") + 2 * DAY, F.col("t0") + 5 * DAY)).select("run_id", "event_id", "channel")


@query(f"WITH {DETECTIONS} SELECT event_id, ts_us - min(ts_us) OVER (PARTITION BY run_id) AS rel_us FROM det")
def prj_relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = detections(spark, sf_dir)
    starts = det.groupBy("run_id").agg(F.min("ts_us").alias("t0"))
    return det.join(starts, "run_id").select("event_id", (F.col("ts_us") - F.col("t0")).alias("rel_us"))


@query("SELECT p_partkey, round(p_retailprice * CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 100.0 ELSE 0.1 END, 6) AS cm FROM part")
def prj_scale_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths in cm, m or mm as cm."""
    unit = F.col("p_size") % 3
    scale = F.when(unit == 0, 1.0).when(unit == 1, 100.0).otherwise(0.1)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") * scale, 6).alias("cm"))


@query(f"WITH {DETECTIONS}, {_VECTORS} SELECT run_id, day, {', '.join(f'c{16 - c} AS c{c}' for c in range(1, 16))} FROM vec")
def prj_channel_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.array(*[F.lit(16 - c) for c in range(1, 16)])
    rows = count_vectors(spark, sf_dir).withColumn("channels", F.array(*_C15))
    rows = rows.withColumn("channels", F.transform(order, lambda i: F.element_at("channels", i)))
    return rows.select("run_id", "day", *[F.element_at("channels", c).alias(f"c{c}") for c in range(1, 16)])


def features(df: DataFrame, duration: Column, eps: float = 1e-9, positions: Sequence[float] = tuple(range(15))) -> DataFrame:
    """The descriptors of 15 counts: total, fractions (0 for no counts), entropy, Gini, anisotropy (the variance of the fractions), dipole (the size of their mean position), duration."""
    rows = channels(df).withColumn("total", F.aggregate("channels", F.lit(0.0), lambda a, x: a + x))
    p = F.transform("channels", lambda x: F.when(F.col("total") > 0, x / F.col("total")).otherwise(0.0))
    rows = rows.withColumn("p", p)
    places = F.array(*[F.lit(float(x)) for x in positions])
    add = lambda a, x: a + x
    rows = rows.withColumns({
        "entropy": -F.aggregate(F.transform("p", lambda x: x * F.log(x + eps)), F.lit(0.0), add),
        "gini": 1 - F.aggregate(F.transform("p", lambda x: x * x), F.lit(0.0), add),
        "dipole": F.abs(F.aggregate(F.zip_with("p", places, lambda x, y: x * y), F.lit(0.0), add)),
        "duration": duration,
    })
    rows = rows.withColumn("_mean", F.aggregate("p", F.lit(0.0), add) / 15)
    return rows.withColumn("anisotropy", F.aggregate(F.transform("p", lambda x: (x - F.col("_mean")) * (x - F.col("_mean"))), F.lit(0.0), add) / 15).drop("_mean")


_T = "CAST(" + "+".join(_C15) + " AS DOUBLE)"
_FEATURES = f"""{DETECTIONS}, {_VECTORS}, feat AS (SELECT run_id, day, total, list_transform(c, lambda x: x/total) AS p FROM (SELECT run_id, day, {_T} AS total, [{', '.join(_C15)}] AS c FROM vec)),
  described AS (SELECT run_id, day, total, -list_sum(list_transform(p, lambda x: x*ln(x+1e-9))) AS entropy, 1-list_sum(list_transform(p, lambda x: x*x)) AS gini, list_sum(list_transform(p, lambda x: (x-list_sum(p)/15)*(x-list_sum(p)/15)))/15 AS anisotropy, abs({'+'.join(f'p[{k}]*({k - 1})' for k in range(1, 16))}) AS dipole FROM feat)"""
_FSEL = "round(entropy, 6) AS entropy, round(gini, 6) AS gini, round(anisotropy, 9) AS anisotropy, round(dipole, 6) AS dipole"


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(count_vectors(spark, sf_dir), F.lit(86400.0))


@query(f"WITH {_FEATURES} SELECT run_id, day, total, {_FSEL} FROM described")
def fn_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir).select("run_id", "day", "total", F.round("entropy", 6).alias("entropy"), F.round("gini", 6).alias("gini"), F.round("anisotropy", 9).alias("anisotropy"), F.round("dipole", 6).alias("dipole"))


@query(f"""WITH {_FEATURES} SELECT run_id, day, {', '.join(f'CAST(c{k} AS DOUBLE) AS f{k}' for k in range(1, 16))}, total AS f16, {', '.join(f'round(p[{k}], 9) AS f{16 + k}' for k in range(1, 16))},
  round(entropy, 6) AS f32, round(gini, 6) AS f33, round(anisotropy, 9) AS f34, round(dipole, 6) AS f35, 86400.0::DOUBLE AS f36 FROM described JOIN feat USING (run_id, day, total) JOIN vec USING (run_id, day)""")
def prj_features36(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 36 features in order: counts, total, fractions, entropy, Gini, anisotropy, dipole, duration."""
    rows = described(spark, sf_dir)
    raw, fractions = [F.element_at("channels", k).cast("double") for k in range(1, 16)], [F.round(F.element_at("p", k), 9) for k in range(1, 16)]
    rest = [F.round(c, n) for c, n in (("entropy", 6), ("gini", 6), ("anisotropy", 9), ("dipole", 6))]
    return rows.select("run_id", "day", *[c.alias(f"f{k}") for k, c in enumerate([*raw, F.col("total"), *fractions, *rest, F.col("duration")], 1)])


@query(f"WITH {_FEATURES} SELECT run_id, count(*) AS vectors, count(*) FILTER (len(p) = 15 AND isfinite(entropy)) AS accepted FROM described JOIN feat USING (run_id, day, total) GROUP BY 1")
def fn_feature_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = (F.size("p") == 15) & ~F.isnan("entropy") & (F.abs("entropy") < float("inf"))
    return described(spark, sf_dir).groupBy("run_id").agg(F.count(F.lit(1)).alias("vectors"), F.count_if(fine).alias("accepted"))


@query(f"""WITH {_FEATURES} SELECT run_id, d AS descriptor, CAST(least(29, greatest(0, floor(v*30))) AS BIGINT) AS bucket, count(*) AS n FROM (
  SELECT run_id, unnest(['entropy','gini','anisotropy','dipole']) AS d, unnest([entropy/ln(15), gini, anisotropy*225/14, dipole/14]) AS v FROM described) GROUP BY ALL""")
def agg_descriptor_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of 30 bins of the descriptors, each scaled to its range."""
    import math

    rows = described(spark, sf_dir)
    long = rows.select("run_id", F.explode(F.create_map(F.lit("entropy"), F.col("entropy") / math.log(15), F.lit("gini"), F.col("gini"), F.lit("anisotropy"), F.col("anisotropy") * 225 / 14, F.lit("dipole"), F.col("dipole") / 14)).alias("descriptor", "v"))
    bucket = F.least(F.lit(29), F.greatest(F.lit(0), F.floor(F.col("v") * 30))).cast("long")
    return long.groupBy("run_id", "descriptor", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DETECTIONS} SELECT run_id, channel, count(*) AS n, round(count(*)/30.0, 9) AS mean_per_day FROM det GROUP BY ALL")
def agg_channel_moments_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).groupBy("run_id", "channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) / 30.0, 9).alias("mean_per_day"))


@query(f"WITH {DETECTIONS}, s AS (SELECT run_id, ts_us // {HOUR} AS sec, count(*) FILTER (channel <= 8) AS unit1, count(*) FILTER (channel > 8) AS unit2 FROM det GROUP BY ALL) SELECT *, CAST(sum(unit1 + unit2) OVER (PARTITION BY run_id ORDER BY sec) AS BIGINT) AS cumulative FROM s")
def agg_unit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each interval by unit and since the start of the run."""
    det = detections(spark, sf_dir).withColumn("sec", F.expr(f"ts_us div {HOUR}"))
    rows = det.groupBy("run_id", "sec").agg(F.count_if(F.col("channel") <= 8).alias("unit1"), F.count_if(F.col("channel") > 8).alias("unit2"))
    return rows.withColumn("cumulative", F.sum(F.col("unit1") + F.col("unit2")).over(islands.over(["run_id"], "sec")))


@query(f"WITH {DETECTIONS}, last AS (SELECT run_id, max(ts_us // {DAY}) AS d FROM det GROUP BY 1) SELECT run_id, channel, count(*) AS cumulative, count(*) FILTER (ts_us // {DAY} = d) AS rolling FROM det JOIN last USING (run_id) GROUP BY ALL")
def agg_tube_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by channel over the run and over its last interval."""
    det = detections(spark, sf_dir).withColumn("day", F.expr(f"ts_us div {DAY}"))
    daily = det.groupBy("run_id", "channel", "day").agg(F.count(F.lit(1)).alias("n"))
    last = daily.groupBy("run_id").agg(F.max("day").alias("last"))
    return daily.join(last, "run_id").groupBy("run_id", "channel").agg(F.sum("n").alias("cumulative"), F.sum(F.when(F.col("day") == F.col("last"), F.col("n")).otherwise(0)).alias("rolling"))


@query(f"""WITH {DETECTIONS}, r AS (SELECT run_id, (channel - 1) // 3 AS row, count(*) AS n FROM det GROUP BY ALL)
  SELECT a.run_id, a.row AS upper, b.row AS lower, CASE WHEN b.n = 0 THEN 0 ELSE round(a.n / b.n, 6) END AS ratio, round(CAST(a.n AS DOUBLE)/b.n*sqrt(1.0/a.n + 1.0/b.n), 6) AS ratio_stdev FROM r a JOIN r b ON a.run_id = b.run_id AND a.row < b.row""")
def agg_row_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of the five row sums of a run, above the diagonal: the rows of a run pair up as arrays of five."""
    rows = detections(spark, sf_dir).groupBy("run_id", F.floor((F.col("channel") - 1) / 3).alias("row")).agg(F.count(F.lit(1)).alias("n"))
    held = rows.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("row", "n"))).alias("rows"))
    pairs = held.select("run_id", F.explode("rows").alias("a"), "rows").select("run_id", "a", F.explode("rows").alias("b")).filter("a.row < b.row")
    a, b = F.col("a.n").cast("double"), F.col("b.n").cast("double")
    return pairs.select("run_id", F.col("a.row").alias("upper"), F.col("b.row").alias("lower"), F.round(a / b, 6).alias("ratio"), F.round(a / b * F.sqrt(1 / a + 1 / b), 6).alias("ratio_stdev"))


@query(f"WITH {DETECTIONS} SELECT run_id, ts_us // {HOUR} AS hour, round(count(*) FILTER (channel IN (1, 9)) / 243000.0, 12) AS dose_all, round(count(*) FILTER (channel = 1) / 243000.0, 12) AS dose_primary, round(count(*) FILTER (channel = 9) / 243000.0, 12) AS dose_secondary FROM det GROUP BY ALL")
def agg_dose_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = detections(spark, sf_dir)
    of = lambda *c: F.round(F.count_if(F.col("channel").isin(*c)) / 243000.0, 12)
    return det.groupBy("run_id", F.expr(f"ts_us div {HOUR}").alias("hour")).agg(of(1, 9).alias("dose_all"), of(1).alias("dose_primary"), of(9).alias("dose_secondary"))


@query(f"WITH {DETECTIONS}, c AS (SELECT run_id, channel, count(*) AS n FROM det GROUP BY ALL) SELECT run_id, min(n) AS lo, max(n) AS hi, median(n) AS mid, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS spread FROM c GROUP BY 1")
def agg_counts_center_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = detections(spark, sf_dir).groupBy("run_id", "channel").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("run_id").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.median("n").alias("mid"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("spread"))


@query(f"""WITH {DETECTIONS}, b AS (SELECT run_id, ts_us // {HOUR} AS bin, count(*) AS n FROM det GROUP BY ALL), span AS (SELECT run_id, min(bin) AS lo, max(bin) AS hi FROM b GROUP BY 1),
  grid AS (SELECT run_id, unnest(generate_series(lo, hi)) AS bin FROM span) SELECT run_id, bin, coalesce(n, 0) AS n, round(coalesce(n, 0)/3600.0, 9) AS rate FROM grid LEFT JOIN b USING (run_id, bin)""")
def agg_rate_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and rates of every bin between a run's first and last, empty ones included."""
    bins = detections(spark, sf_dir).groupBy("run_id", F.expr(f"ts_us div {HOUR}").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = bins.groupBy("run_id").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).select("run_id", F.explode(F.sequence("lo", "hi")).alias("bin"))
    out = grid.join(bins, ["run_id", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("rate", F.round(F.col("n") / 3600.0, 9))


@query(f"""WITH {DETECTIONS}, o AS (SELECT run_id, ts_us, ts_us - lag(ts_us) OVER (PARTITION BY run_id ORDER BY ts_us, event_id) AS dt FROM det)
  SELECT run_id, count(*) AS events, min(ts_us) AS first_us, max(ts_us) AS last_us, min(dt) AS min_dt, max(dt) AS max_dt, coalesce(bool_and(dt >= 0), true) AS monotonic, count(*) % 13 AS fifo_lost FROM o GROUP BY 1""")
def agg_lmx_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, times and gaps of each run, and the lost counts of its file's header."""
    det = detections(spark, sf_dir)
    rows = ranges.before(det, ["run_id"], "ts_us", {"last_us": "ts_us"}, ties=["event_id"]).withColumn("dt", F.col("ts_us") - F.col("last_us"))
    out = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("events"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.min("dt").alias("min_dt"), F.max("dt").alias("max_dt"), F.coalesce(F.every(F.col("dt") >= 0), F.lit(True)).alias("monotonic"))
    text = F.format_string("BinaryDataClockTickLength 1000\nInternalScaler %d\nFifoLostCounts %d\nBinaryDataFollows\n", "events", F.col("events") % 13)
    heads = listmode.lmx_headers(out.select(F.col("run_id").alias("path"), text.cast("binary").alias("content")))
    return out.join(heads.select(F.col("path").alias("run_id"), "fifo_lost"), "run_id")


def group_id(x: Column, y: Column, z: Column, other: tuple[Column, Column, Column] | None = None) -> Column:
    """`S:x:y:z`, or `D:` and both places in order, to two decimals, halves to even."""
    text = lambda c: F.format_string("%.2f", F.bround(c, 2))
    one = F.concat_ws(":", text(x), text(y), text(z))
    if other is None:
        return F.concat(F.lit("S:"), one)
    return F.concat(F.lit("D:"), F.array_join(F.array_sort(F.array(one, F.concat_ws(":", *map(text, other)))), "|"))


_FMT = "printf('%.2f', {0})"
_P1, _P2 = [f"((l_{c} % 7) * 1.25)" for c in ("orderkey", "partkey", "suppkey")], [f"((l_{c} % 5) * 2.5)" for c in ("orderkey", "partkey", "suppkey")]


@query(f"SELECT l_orderkey, l_linenumber, 'D:' || least(a, b) || '|' || greatest(a, b) AS dual, 'S:' || a AS single FROM (SELECT *, {(chr(32) + '||' + repr(':') + '||').join(_FMT.format(c) for c in _P1)} AS a, {(chr(32) + '||' + repr(':') + '||').join(_FMT.format(c) for c in _P2)} AS b FROM lineitem)")
def fn_group_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.col(f"l_{c}") for c in ("orderkey", "partkey", "suppkey")]
    one, two = [(k % 7) * 1.25 for k in keys], [(k % 5) * 2.5 for k in keys]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", group_id(*one, tuple(two)).alias("dual"), group_id(*one).alias("single"))


@query("""WITH g AS (SELECT round(l_quantity/5)*5 AS pos, l_extendedprice AS t, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem),
  e AS (SELECT pos, min(t) AS lowest, max(t) AS highest, round(max(t)/min(t), 6) AS ratio FROM g GROUP BY pos HAVING max(t)/min(t) >= 1.5 ORDER BY pos LIMIT 1),
  r AS (SELECT pos, l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY pos ORDER BY t, l_orderkey, l_partkey, l_suppkey, l_linenumber) AS up, row_number() OVER (PARTITION BY pos ORDER BY t DESC, l_orderkey DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC) AS down FROM g)
  SELECT e.*, a.l_orderkey AS low_order, a.l_linenumber AS low_line, b.l_orderkey AS high_order, b.l_linenumber AS high_line FROM e JOIN r a ON a.pos = e.pos AND a.up = 1 JOIN r b ON b.pos = e.pos AND b.down = 1""")
def agg_normalization_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rounded position whose highest total is at least 1.5 times its lowest, with the rows of both."""
    row = F.struct("l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    rows = table(spark, sf_dir, "lineitem").groupBy((F.round(F.col("l_quantity") / 5) * 5).alias("pos")).agg(F.min(row).alias("a"), F.max(row).alias("b"))
    low, high = F.col("a.l_extendedprice"), F.col("b.l_extendedprice")
    first = rows.filter(high / low >= 1.5).orderBy("pos").limit(1)
    return first.select("pos", low.alias("lowest"), high.alias("highest"), F.round(high / low, 6).alias("ratio"), F.col("a.l_orderkey").alias("low_order"), F.col("a.l_linenumber").alias("low_line"), F.col("b.l_orderkey").alias("high_order"), F.col("b.l_linenumber").alias("high_line"))


@query("SELECT l_suppkey, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest, arg_min(l_orderkey, l_extendedprice * 1e7 + l_orderkey) AS low_row, arg_max(l_orderkey, l_extendedprice * 1e7 + l_orderkey) AS high_row FROM lineitem GROUP BY 1")
def srt_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_extendedprice") * 1e7 + F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min("l_extendedprice").alias("lowest"), F.max("l_extendedprice").alias("highest"), F.min_by("l_orderkey", key).alias("low_row"), F.max_by("l_orderkey", key).alias("high_row"))
