"""Analytic windows: running counts, streaks, segments, change detection, episodes.

A window row is a (run, day) of the event stream; its state comes from its count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import islands, ranges
from ..registry import query
from ..streaming import fixed
from .views import DAY, DETECTIONS, HOUR, detections

#: Windows of six hours and their labels: LowRate, Track or Hold by count, Single or Dual by the lead channel.
STEP6 = 6 * HOUR
_W = f"""{DETECTIONS}, win AS (SELECT run_id, ts_us // {STEP6} AS idx, count(*) AS n, count(*) FILTER (channel <= 7) AS left_n, avg(channel) AS center FROM det GROUP BY ALL),
  steps AS (SELECT *, CASE WHEN n < 12 THEN 'LowRate' WHEN n < 20 THEN 'Track' ELSE 'Hold' END AS state, CASE WHEN 2*left_n >= n THEN 'Dual' ELSE 'Single' END AS label, n < 12 OR n >= 20 AS confused FROM win)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, idx, n, center, state, label, confused): window records of six hours."""
    rows = detections(spark, sf_dir).groupBy("run_id", F.expr(f"ts_us div {STEP6}").alias("idx")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("channel") <= 7).alias("left_n"), F.avg("channel").alias("center"))
    state = F.when(F.col("n") < 12, "LowRate").when(F.col("n") < 20, "Track").otherwise("Hold")
    label = F.when(2 * F.col("left_n") >= F.col("n"), "Dual").otherwise("Single")
    return rows.withColumns({"state": state, "label": label, "confused": (F.col("n") < 12) | (F.col("n") >= 20)})


RUN = Window.partitionBy
_R = "(PARTITION BY run_id ORDER BY idx)"


@query(f"WITH {_W} SELECT run_id, idx, CAST(sum(n) OVER {_R} AS BIGINT) AS cum_counts, (idx - min(idx) OVER (PARTITION BY run_id)) * 6.0::DOUBLE AS elapsed_h FROM steps")
def win_cumulative_counts_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = islands.over(["run_id"], "idx").rowsBetween(Window.unboundedPreceding, 0)
    return steps(spark, sf_dir).select("run_id", "idx", F.sum("n").over(w).alias("cum_counts"), ((F.col("idx") - F.min("idx").over(w)) * 6.0).alias("elapsed_h"))


@query(f"""WITH {DETECTIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts_us, event_id) AS k, ts_us - min(ts_us) OVER (PARTITION BY run_id) AS since FROM det),
  e AS (SELECT run_id, count(*) FILTER (since <= {9 * DAY}) AS within FROM n GROUP BY 1)
  SELECT run_id, event_id, k, since AS since_us, CASE WHEN within > 500 THEN 'count' ELSE 'duration' END AS stopped_by FROM n JOIN e USING (run_id) WHERE k <= 500 AND since <= {9 * DAY}""")
def win_cumulative_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a run until its 500th, or until nine days are over, whichever comes first, and which of both it was."""
    det = detections(spark, sf_dir)
    starts = det.groupBy("run_id").agg(F.min("ts_us").alias("t0"))
    rows = det.join(starts, "run_id").withColumn("since_us", F.col("ts_us") - F.col("t0")).filter(F.col("since_us") <= 9 * DAY)
    within = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("within"))
    rows = rows.withColumn("k", F.row_number().over(islands.over(["run_id"], "ts_us", "event_id"))).filter("k <= 500")  # each task keeps 500 of a run before the shuffle
    return rows.join(within, "run_id").select("run_id", "event_id", F.col("k").cast("long").alias("k"), "since_us", F.when(F.col("within") > 500, "count").otherwise("duration").alias("stopped_by"))


@query(f"WITH {_W}, l AS (SELECT *, lag(label) OVER {_R} AS before FROM steps) SELECT run_id, count(*) FILTER (before <> label) AS transitions FROM l GROUP BY 1")
def win_label_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir).withColumn("before", F.lag("label").over(islands.over(["run_id"], "idx")))
    return rows.groupBy("run_id").agg(F.count_if(F.col("before") != F.col("label")).alias("transitions"))


@query(f"WITH {_W}, l AS (SELECT *, CASE WHEN lag(state) OVER {_R} <> state THEN 1 ELSE 0 END AS changed FROM steps) SELECT run_id, idx, sum(changed) OVER (PARTITION BY run_id ORDER BY idx ROWS 4 PRECEDING) >= 3 AS thrash FROM l")
def win_state_thrash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At least three state changes within the last six windows."""
    w = islands.over(["run_id"], "idx")
    rows = steps(spark, sf_dir).withColumn("changed", F.when(F.lag("state").over(w) != F.col("state"), 1).otherwise(0))
    return rows.select("run_id", "idx", (F.sum("changed").over(w.rowsBetween(-4, 0)) >= 3).alias("thrash"))


_ISL = f"isl AS (SELECT *, row_number() OVER {_R} - row_number() OVER (PARTITION BY run_id, confused ORDER BY idx) AS g FROM steps)"


@query(f"WITH {_W}, {_ISL}, s AS (SELECT run_id, idx, CASE WHEN confused THEN row_number() OVER (PARTITION BY run_id, confused, g ORDER BY idx) ELSE 0 END AS streak FROM isl) SELECT run_id, idx, CAST(streak AS INTEGER) AS streak, streak >= 2 AS debounced FROM s")
def win_confused_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = islands.streak_lengths(steps(spark, sf_dir), ["run_id"], ["idx"], "confused")
    return rows.select("run_id", "idx", "streak", (F.col("streak") >= 2).alias("debounced"))


@query(f"WITH {_W}, s AS (SELECT run_id, idx, sum(CASE WHEN confused THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS k FROM steps) SELECT run_id, min(idx) AS first_stable FROM s WHERE k = 3 GROUP BY 1")
def win_stable_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first window that starts three stable ones in a row."""
    w = islands.over(["run_id"], "idx").rowsBetween(0, 2)
    rows = steps(spark, sf_dir).withColumn("k", F.sum(F.when(F.col("confused"), 0).otherwise(1)).over(w))
    return rows.filter("k = 3").groupBy("run_id").agg(F.min("idx").alias("first_stable"))


@query(f"""WITH {_W}, d AS (SELECT *, abs(center - lag(center) OVER {_R}) AS delta, lag(label) OVER {_R} = label AS same FROM steps), f AS (SELECT *, coalesce(same AND delta < 1.0, false) AS stable FROM d),
  g AS (SELECT *, row_number() OVER {_R} - row_number() OVER (PARTITION BY run_id, stable ORDER BY idx) AS g FROM f)
  SELECT run_id, idx, round(CASE WHEN same THEN delta END, 6) AS delta, CAST(CASE WHEN stable THEN row_number() OVER (PARTITION BY run_id, stable, g ORDER BY idx) ELSE 0 END AS INTEGER) AS stable_count FROM g""")
def win_prediction_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the prediction before, and how many in a row stayed within the tolerance; a new label starts over."""
    w = islands.over(["run_id"], "idx")
    rows = steps(spark, sf_dir).withColumns({"delta": F.abs(F.col("center") - F.lag("center").over(w)), "same": F.lag("label").over(w) == F.col("label")})
    rows = rows.withColumn("stable", F.coalesce(F.col("same") & (F.col("delta") < 1.0), F.lit(False)))
    rows = islands.streak_lengths(rows, ["run_id"], ["idx"], "stable", "stable_count")
    return rows.select("run_id", "idx", F.round(F.when(F.col("same"), F.col("delta")), 6).alias("delta"), "stable_count")


_SEG = f"c AS (SELECT *, CASE WHEN lag(state) OVER {_R} = state THEN 0 ELSE 1 END AS ch FROM steps), gi AS (SELECT *, sum(ch) OVER {_R} AS island FROM c), seg AS (SELECT run_id, island, min(state) AS state, min(idx) AS start, max(idx) AS last FROM gi GROUP BY ALL), segs AS (SELECT run_id, state, start, coalesce(lead(start) OVER (PARTITION BY run_id ORDER BY island), last) AS \"end\" FROM seg)"


@query(f"WITH {_W}, {_SEG} SELECT * FROM segs")
def win_state_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.segments(steps(spark, sf_dir), ["run_id"], "idx", "state").select("run_id", "state", "start", "end")


@query(f"WITH {_W}, {_SEG} SELECT run_id, start, \"end\" FROM segs WHERE state = 'Hold'")
def win_hold_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.segments(steps(spark, sf_dir), ["run_id"], "idx", "state").filter("state = 'Hold'").select("run_id", "start", "end")


@query(f"""WITH {_W}, c AS (SELECT *, CASE WHEN lag(confused) OVER {_R} = confused THEN 0 ELSE 1 END AS ch FROM steps), gi AS (SELECT *, sum(ch) OVER {_R} AS island FROM c), seg AS (SELECT run_id, island, bool_or(confused) AS flag, min(idx) AS start, max(idx) AS last FROM gi GROUP BY ALL),
  s AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY run_id ORDER BY island), last) AS stop FROM seg) SELECT run_id, start AS on_idx, stop AS off_idx FROM s WHERE flag""")
def win_flag_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = islands.segments(steps(spark, sf_dir), ["run_id"], "idx", "confused").filter("confused")
    return rows.select("run_id", F.col("start").alias("on_idx"), F.col("end").alias("off_idx"))


@query(f"""WITH {DETECTIONS}, s AS (SELECT run_id, min(ts_us) AS t0, max(ts_us) - min(ts_us) AS span FROM det GROUP BY 1), o AS (SELECT *, coalesce(sum(span + {DAY}) OVER (ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s)
  SELECT event_id, CAST(ts_us - t0 + off AS BIGINT) AS stitched_us FROM det JOIN o USING (run_id)""")
def win_session_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions one after the other with a gap, each from 0. Only the table of sessions is ordered as a whole."""
    det = detections(spark, sf_dir)
    spans = det.groupBy("run_id").agg(F.min("ts_us").alias("t0"), (F.max("ts_us") - F.min("ts_us")).alias("span"))
    before = Window.orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select("run_id", "t0", F.coalesce(F.sum(F.col("span") + DAY).over(before), F.lit(0)).alias("off"))
    return det.join(offsets, "run_id").select("event_id", (F.col("ts_us") - F.col("t0") + F.col("off")).alias("stitched_us"))


@query("SELECT event_type AS run_id, count(*) AS violations, min(event_id) AS first_event FROM (SELECT *, lag(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events) WHERE user_id < before GROUP BY 1")
def win_monotonic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose clock (here the user's number) runs backwards, and the first of them."""
    from .views import table

    rows = ranges.before(table(spark, sf_dir, "events"), ["event_type"], "event_id", {"before": "user_id"})
    return rows.filter("user_id < before").groupBy(F.col("event_type").alias("run_id")).agg(F.count(F.lit(1)).alias("violations"), F.min("event_id").alias("first_event"))


_U = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_PH = f"""m AS (SELECT run_id, idx, n, avg(n) OVER (PARTITION BY run_id ORDER BY idx {_U}) AS mean FROM steps), c AS (SELECT *, sum(n - mean - 0.5) OVER (PARTITION BY run_id ORDER BY idx {_U}) AS cum FROM m),
  ph AS (SELECT *, cum - least(0, min(cum) OVER (PARTITION BY run_id ORDER BY idx {_U})) AS stat FROM c)"""


@query(f"WITH {_W}, {_PH} SELECT run_id, idx, round(mean, 6) AS ph_mean, round(stat, 6) AS ph_stat, stat > 10.00001 AS ph_alarm FROM ph")
def win_page_hinkley(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = islands.page_hinkley(steps(spark, sf_dir), ["run_id"], ["idx"], "n", 0.5, 10.00001)
    return rows.select("run_id", "idx", F.round("ph_mean", 6).alias("ph_mean"), F.round("ph_stat", 6).alias("ph_stat"), "ph_alarm")


@query(f"WITH {_W}, c AS (SELECT *, sum(n - 16) OVER (PARTITION BY run_id ORDER BY idx {_U}) AS s FROM steps) SELECT run_id, idx, CAST(s - least(0, min(s) OVER (PARTITION BY run_id ORDER BY idx {_U})) AS BIGINT) AS cusum FROM c")
def win_cusum_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.clamped_cusum(steps(spark, sf_dir), ["run_id"], ["idx"], F.col("n") - 16).select("run_id", "idx", F.col("cusum").cast("long").alias("cusum"))


@query(f"""WITH {_W}, c AS (SELECT *, CASE WHEN lag(confused) OVER {_R} = confused THEN 0 ELSE 1 END AS ch FROM steps), gi AS (SELECT *, sum(ch) OVER {_R} AS island FROM c)
  SELECT run_id, idx, confused AND idx - min(idx) OVER (PARTITION BY run_id, island) >= 2 AS sustained, NOT confused AND idx - min(idx) OVER (PARTITION BY run_id, island) >= 2 AS cleared FROM gi""")
def win_alarm_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alarm is sustained (or cleared) once its state has lasted for two windows."""
    rows = islands.island_ids(steps(spark, sf_dir), ["run_id"], ["idx"], "confused")
    since = F.col("idx") - F.min("idx").over(Window.partitionBy("run_id", "island"))
    return rows.select("run_id", "idx", (F.col("confused") & (since >= 2)).alias("sustained"), (~F.col("confused") & (since >= 2)).alias("cleared"))


@query(f"WITH {DETECTIONS} SELECT event_id, count(*) OVER (PARTITION BY run_id ORDER BY ts_us RANGE BETWEEN (event_id % 5 + 1) * {HOUR} PRECEDING AND 1 PRECEDING) AS trailing FROM det")
def win_trailing_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the run in [t - W, t), with a width of its own for each event."""
    rows = detections(spark, sf_dir)
    return ranges.trailing_counts(rows, ["run_id"], "ts_us", (F.col("event_id") % 5 + 1) * HOUR, ["event_id"]).select("event_id", "trailing")


@query(f"""WITH {DETECTIONS}, h AS (SELECT run_id, hr, count(*) AS n FROM (SELECT run_id, ts_us // {HOUR} AS hr, channel FROM det) GROUP BY ALL), f AS (SELECT run_id, n, count(*) AS freq FROM h GROUP BY ALL),
  mode AS (SELECT run_id, arg_max(n, freq * 1000000 - n) AS mode, max(n) AS top FROM f GROUP BY 1), grid AS (SELECT run_id, mode, top, unnest(generate_series(CAST(0 AS BIGINT), top + 3)) AS n FROM mode),
  d AS (SELECT g.run_id, g.n, mode, coalesce(freq, 0) AS freq FROM grid g LEFT JOIN f ON f.run_id = g.run_id AND f.n = g.n), z AS (SELECT *, sum(CASE WHEN freq = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS zeros FROM d)
  SELECT run_id, min(n) AS hist_end FROM z WHERE n > mode AND zeros = 3 GROUP BY 1""")
def win_histogram_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first three empty bins after the mode of a run's histogram begin."""
    rows = histogram_with_gaps(spark, sf_dir)
    return rows.filter("n > mode and zeros = 3").groupBy("run_id").agg(F.min("n").alias("hist_end"))


def histogram_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = detections(spark, sf_dir).groupBy("run_id", F.expr(f"ts_us div {HOUR}").alias("hr")).agg(F.count(F.lit(1)).alias("n"))
    freq = hourly.groupBy("run_id", "n").agg(F.count(F.lit(1)).alias("freq"))
    mode = freq.groupBy("run_id").agg(F.max_by("n", F.col("freq") * 1000000 - F.col("n")).alias("mode"), F.max("n").alias("top"))
    grid = mode.select("run_id", "mode", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top") + 3)).alias("n"))
    dense = grid.join(freq, ["run_id", "n"], "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    w = islands.over(["run_id"], "n").rowsBetween(0, 2)
    return dense.withColumn("zeros", F.sum(F.when(F.col("freq") == 0, 1).otherwise(0)).over(w))


@query(f"""WITH {DETECTIONS}, h AS (SELECT run_id, ts_us // {HOUR} AS hr, count(*) AS n FROM det GROUP BY ALL), f AS (SELECT run_id, n, count(*) AS freq FROM h GROUP BY ALL),
  mode AS (SELECT run_id, arg_max(n, freq * 1000000 - n) AS mode, max(n) AS top FROM f GROUP BY 1), grid AS (SELECT run_id, mode, top, unnest(generate_series(CAST(0 AS BIGINT), top + 3)) AS n FROM mode),
  d AS (SELECT g.run_id, g.n, mode, coalesce(freq, 0) AS freq FROM grid g LEFT JOIN f ON f.run_id = g.run_id AND f.n = g.n), z AS (SELECT *, sum(CASE WHEN freq = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS zeros FROM d),
  e AS (SELECT run_id, min(n) AS hist_end FROM z WHERE n > mode AND zeros = 3 GROUP BY 1)
  SELECT run_id, CAST(sum(freq) AS BIGINT) AS cycles, CAST(sum(n * freq) AS BIGINT) AS counts FROM z JOIN e USING (run_id) WHERE n < hist_end GROUP BY 1""")
def agg_histogram_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles and counts of a run's histogram up to its end."""
    rows = histogram_with_gaps(spark, sf_dir)
    ends = rows.filter("n > mode and zeros = 3").groupBy("run_id").agg(F.min("n").alias("hist_end"))
    return rows.join(ends, "run_id").filter("n < hist_end").groupBy("run_id").agg(F.sum("freq").alias("cycles"), F.sum(F.col("n") * F.col("freq")).alias("counts"))


@query(f"WITH {DETECTIONS} SELECT run_id, hr, event_id FROM (SELECT run_id, ts_us // {HOUR} AS hr, event_id, row_number() OVER (PARTITION BY run_id, ts_us // {HOUR} ORDER BY ts_us, event_id) AS k FROM det) WHERE k = 1")
def win_second_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of each interval, the first: a grouped minimum, no window needed."""
    det = detections(spark, sf_dir).withColumn("hr", F.expr(f"ts_us div {HOUR}"))
    return det.groupBy("run_id", "hr").agg(F.min(F.struct("ts_us", "event_id"))["event_id"].alias("event_id"))


#: Gate markers among the events of some runs: the others have none.
_MARKS = f"""marks AS (SELECT run_id, ts_us, event_id % 97 = 0 AS s, event_id % 89 = 0 AS e FROM det WHERE length(run_id) % 2 = 0), opened AS (SELECT run_id, min(ts_us) AS t0 FROM marks WHERE s GROUP BY 1),
  gate AS (SELECT run_id, t0 // {STEP6} AS start, min(ts_us) // {STEP6} AS "end" FROM marks JOIN opened USING (run_id) WHERE e AND ts_us > t0 GROUP BY run_id, t0)"""


@query(f"""WITH {_W}, {_SEG}, {_MARKS}, long AS (SELECT run_id, start, "end", "end" - start AS len FROM segs WHERE state <> 'LowRate'), chosen AS (SELECT run_id, min(start) AS start, min(start) + 3 AS "end" FROM long WHERE len >= 3 GROUP BY 1)
  SELECT run_id, start, "end", 'gate markers' AS reason FROM gate UNION ALL SELECT run_id, start, "end", 'segment' FROM chosen WHERE run_id NOT IN (SELECT run_id FROM gate)""")
def win_episode_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's first start marker and the first end marker behind it; without such a pair the first three windows of the first segment that isn't low-rate and lasts as long."""
    marks = detections(spark, sf_dir).filter(F.length("run_id") % 2 == 0)
    opened = marks.filter("event_id % 97 = 0").groupBy("run_id").agg(F.min("ts_us").alias("t0"))
    closed = marks.filter("event_id % 89 = 0").join(opened, "run_id").filter("ts_us > t0").groupBy("run_id", "t0").agg(F.min("ts_us").alias("t1"))
    gate = closed.select("run_id", F.expr(f"t0 div {STEP6}").alias("start"), F.expr(f"t1 div {STEP6}").alias("end"), F.lit("gate markers").alias("reason"))
    seg = islands.segments(steps(spark, sf_dir), ["run_id"], "idx", "state").filter("state <> 'LowRate'").filter(F.col("end") - F.col("start") >= 3)
    seg = seg.groupBy("run_id").agg(F.min("start").alias("start")).select("run_id", "start", (F.col("start") + 3).alias("end"), F.lit("segment").alias("reason"))
    return gate.unionByName(seg.join(gate, "run_id", "left_anti"))


@query(f"WITH {DETECTIONS} SELECT event_id, row_number() OVER (PARTITION BY run_id ORDER BY ts_us, event_id) AS seq FROM det")
def win_event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranges.places(detections(spark, sf_dir), "ts_us", ["event_id"], keys=["run_id"])
    return rows.select("event_id", (F.col("place") + 1).alias("seq"))


@query(f"WITH {_W} SELECT run_id, idx, n FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY idx) AS k FROM steps) WHERE k > 5")
def flt_warmup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir).withColumn("k", F.row_number().over(islands.over(["run_id"], "idx")))
    return rows.filter("k > 5").select("run_id", "idx", "n")


@query(f"WITH {_W} SELECT run_id, count(*) AS windows, count(*) >= 20 AS kept FROM steps WHERE n >= 12 GROUP BY 1")
def flt_min_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with enough windows after the filter; the others are told, too."""
    return steps(spark, sf_dir).filter("n >= 12").groupBy("run_id").agg(F.count(F.lit(1)).alias("windows"), (F.count(F.lit(1)) >= 20).alias("kept"))


@query(f"WITH {_W} SELECT run_id, state, count(*) AS steps FROM steps GROUP BY ALL")
def agg_state_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).groupBy("run_id", "state").agg(F.count(F.lit(1)).alias("steps"))


@query(f"WITH {_W} SELECT run_id, idx, row_number() OVER {_R} AS place FROM steps")
def srt_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).select("run_id", "idx", F.row_number().over(islands.over(["run_id"], "idx")).cast("long").alias("place"))


@query(f"WITH {_W} SELECT run_id, idx, n FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY idx DESC) AS k FROM steps) WHERE k <= 10")
def srt_history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten windows of every run (the operator is the tail)."""
    rows = steps(spark, sf_dir).withColumn("k", F.row_number().over(islands.over(["run_id"], F.desc("idx"))))
    return rows.filter("k <= 10").select("run_id", "idx", "n")


@query("WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey, o_totalprice FROM o WHERE k % CAST(ceil(n / 100.0) AS BIGINT) = 0")
def srt_deterministic_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ceil(n / 100)th row in the order of the value (the operator is the sample).

    The rank comes from value ranges and their sizes, so no task sorts all rows.
    """
    from ..operators.ranges import places
    from .views import table

    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    step = max(1, -(-rows.count() // 100))
    return places(rows, "o_totalprice", ["o_orderkey"]).filter(F.col("place") % step == 0).select("o_orderkey", "o_totalprice")


@query(f"WITH {DETECTIONS} SELECT DISTINCT run_id, ts_us // 1000000 AS t FROM det")
def set_distinct_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("run_id", F.expr("ts_us div 1000000").alias("t")).distinct()


@query(f"WITH {_W} SELECT run_id, idx, state IN ('Hold', 'LowRate') OR n < 10 AS confused FROM steps")
def fn_confused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).select("run_id", "idx", (F.col("state").isin("Hold", "LowRate") | (F.col("n") < 10)).alias("confused"))


@query(f"""WITH {DETECTIONS}, f AS (SELECT run_id, min(ts_us) AS t0, max(ts_us) + 1 AS t1 FROM det GROUP BY 1),
  spans AS (SELECT run_id, win, t0 + win * {DAY} AS start_us, least(t0 + (win + 1) * {DAY}, t1) AS end_us, win = (t1 - t0 - 1) // {DAY} AS forced FROM (SELECT *, unnest(range((t1 - t0 - 1) // {DAY} + 1)) AS win FROM f)),
  g AS (SELECT run_id, (ts_us - t0) // {DAY} AS win, count(*) AS n FROM det JOIN f USING (run_id) WHERE channel <= 13 GROUP BY run_id, win, (ts_us - t0) % {DAY} // {HOUR}),
  s AS (SELECT run_id, win, sum(n) AS n, sum(n * (n - 1)) AS f2 FROM g GROUP BY ALL), i AS (SELECT run_id, (ts_us - t0) // {DAY} AS win, count(*) AS ignored FROM det JOIN f USING (run_id) WHERE channel > 13 GROUP BY ALL),
  m AS (SELECT spans.*, coalesce(n, 0) AS n, coalesce(ignored, 0) AS ignored, coalesce(n, 0)::DOUBLE / ((end_us - start_us + {HOUR} - 1) // {HOUR}) AS mean, coalesce(f2, 0)::DOUBLE / ((end_us - start_us + {HOUR} - 1) // {HOUR}) AS m2 FROM spans LEFT JOIN s USING (run_id, win) LEFT JOIN i USING (run_id, win))
  SELECT run_id, win, start_us, end_us, forced, CAST(n AS BIGINT) AS n, ignored, round(mean, 9) AS mean, round(CASE WHEN mean > 0 THEN (m2 - mean * mean) / mean ELSE 0 END, 9) AS y FROM m""")
def str_fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows from each run's first event: passed ones without events, too, and a last one that is forced behind the last event; the batch twin of `streaming.fixed`."""
    out = fixed.fixed_windows(detections(spark, sf_dir), DAY, HOUR, channels=13)
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "y")})


@query(f"""WITH {DETECTIONS}, b AS (SELECT run_id, ts_us // {HOUR} AS bin, count(*) AS n FROM det GROUP BY ALL)
  SELECT run_id, win, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, unnest(generate_series(CAST(floor((bin*{HOUR} - {DAY}) / {6 * HOUR}) + 1 AS BIGINT), bin*{HOUR} // {6 * HOUR})) AS win FROM b) GROUP BY ALL""")
def str_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import bins as B

    bins = B.base_bins(detections(spark, sf_dir), HOUR, by_channel=False)
    return B.sliding_windows(bins, HOUR, DAY, 6 * HOUR).groupBy("run_id", "win").agg(F.sum("n").alias("n"))


@query(f"""WITH {_W}, {_ISL}, s AS (SELECT *, row_number() OVER (PARTITION BY run_id, confused, g ORDER BY idx) AS k FROM isl),
  m AS (SELECT run_id, idx, confused, n, last_value(CASE WHEN confused AND k >= 2 THEN 1 WHEN NOT confused AND k >= 2 THEN 0 END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY idx) AS active FROM s)
  SELECT run_id, idx, coalesce(active, 0) = 1 AS active FROM m""")
def str_episode_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an episode is active: two confused windows in a row start it, two clear ones end it, and the state holds in between."""
    rows = islands.streak_lengths(steps(spark, sf_dir).withColumn("clear", ~F.col("confused")), ["run_id"], ["idx"], "confused", "on")
    rows = islands.streak_lengths(rows, ["run_id"], ["idx"], "clear", "off")
    latch = F.when(F.col("on") >= 2, 1).when(F.col("off") >= 2, 0)
    w = islands.over(["run_id"], "idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("latch", latch).select("run_id", "idx", (F.coalesce(F.last("latch", ignorenulls=True).over(w), F.lit(0)) == 1).alias("active"))


@query(f"WITH {DETECTIONS} SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY run_id, ts_us // {DAY} ORDER BY ts_us, event_id) <= 3 THEN 'request' ELSE 'deferred' END AS outcome FROM det WHERE channel = 3")
def str_request_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three requests an episode (here a run's day); the others are deferred, not dropped."""
    rows = detections(spark, sf_dir).filter("channel = 3").withColumn("day", F.expr(f"ts_us div {DAY}"))
    k = F.row_number().over(islands.over(["run_id", "day"], "ts_us", "event_id"))
    return rows.select("event_id", F.when(k <= 3, "request").otherwise("deferred").alias("outcome"))


@query(f"""WITH {_W}, p AS (SELECT *, count(*) FILTER (state = 'Track') OVER {_R} AS publishes FROM steps), r AS (SELECT *, count(*) FILTER (state <> 'Track') OVER (PARTITION BY run_id, publishes ORDER BY idx) AS refusals FROM p)
  SELECT run_id, idx, CASE WHEN refusals < 2 THEN 'Healthy' WHEN refusals < 5 THEN 'Degraded' ELSE 'Unavailable' END AS health FROM r""")
def str_health_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health by the refusals since the last publish."""
    w = islands.over(["run_id"], "idx")
    rows = steps(spark, sf_dir).withColumn("publishes", F.count_if(F.col("state") == "Track").over(w))
    refusals = F.count_if(F.col("state") != "Track").over(islands.over(["run_id", "publishes"], "idx"))
    return rows.withColumn("r", refusals).select("run_id", "idx", F.when(F.col("r") < 2, "Healthy").when(F.col("r") < 5, "Degraded").otherwise("Unavailable").alias("health"))


@query(f"""WITH {_W}, f AS (SELECT *, max(CASE WHEN state = 'LowRate' THEN idx END) OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS failed FROM steps)
  SELECT run_id, idx, failed IS NOT NULL AND idx - failed < 3 AND n % 5 <> 0 AS suppressed FROM f""")
def str_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic requests within three windows after a failure are suppressed; manual ones (here every fifth count) pass."""
    w = islands.over(["run_id"], "idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = steps(spark, sf_dir).withColumn("failed", F.max(F.when(F.col("state") == "LowRate", F.col("idx"))).over(w))
    return rows.select("run_id", "idx", (F.col("failed").isNotNull() & (F.col("idx") - F.col("failed") < 3) & (F.col("n") % 5 != 0)).alias("suppressed"))


@query(f"""WITH {_W}, c AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY idx) AS rn, n < 12 AS bad FROM steps), g AS (SELECT *, rn - row_number() OVER (PARTITION BY run_id, bad ORDER BY idx) AS g FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY run_id, bad, g ORDER BY idx) AS k FROM g)
  SELECT run_id, idx, coalesce(last_value(CASE WHEN bad AND k >= 3 THEN 1 WHEN NOT bad AND k >= 6 THEN 0 END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY idx), 0) = 1 AS degraded FROM k""")
def str_mismatch_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three mismatches in a row degrade, six clean windows in a row restore."""
    rows = steps(spark, sf_dir).withColumn("bad", F.col("n") < 12).withColumn("good", F.col("n") >= 12)
    rows = islands.streak_lengths(rows, ["run_id"], ["idx"], "bad", "on")
    rows = islands.streak_lengths(rows, ["run_id"], ["idx"], "good", "off")
    latch = F.when(F.col("on") >= 3, 1).when(F.col("off") >= 6, 0)
    w = islands.over(["run_id"], "idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("latch", latch).select("run_id", "idx", (F.coalesce(F.last("latch", ignorenulls=True).over(w), F.lit(0)) == 1).alias("degraded"))
