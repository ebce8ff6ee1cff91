"""Controllers with feedback, folded over pre-counted bins of each run, and the relational correlation-time fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bins as B
from ..operators import islands, ranges
from ..registry import query
from ..streaming import adaptive, episodes, rate, requests
from .moments import LADDER_SQL, ladder
from .views import DAY, DETECTIONS, HOUR, detections
from .windows import _W, steps


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.base_bins(detections(spark, sf_dir), HOUR, by_channel=False)


@query()
def str_rate_controller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate.control_runs(hourly(spark, sf_dir))


@query()
def str_adaptive_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine as in a replay, with a fixed cadence, and live, where the next step follows beta and the window."""
    runs = hourly(spark, sf_dir)
    live = adaptive.run_engine(runs, adaptive.AdaptiveConfig(cadence=None)).withColumn("mode", F.lit("live"))
    return adaptive.run_engine(runs).withColumn("mode", F.lit("replay")).unionByName(live)


@query()
def str_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State segments of the engine's run."""
    return islands.segments(adaptive.run_engine(hourly(spark, sf_dir)), ["run_id"], "t", "state").select("run_id", "state", "start", "end")


@query()
def str_gate_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate that each step wanted, its votes so far, the gate in use, and whether that has changed."""
    rows = adaptive.run_engine(hourly(spark, sf_dir)).withColumn("before", F.lag("gate").over(islands.over(["run_id"], "step")))
    return rows.select("run_id", "step", "wanted", "votes", "gate", "state", (F.col("before").isNotNull() & (F.col("before") != F.col("gate"))).alias("changed"))


@query()
def str_window_adaptation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive.run_engine(hourly(spark, sf_dir)).select("run_id", "step", "state", "w")


def policy_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir)
    return rows.select("run_id", "idx", F.col("n").cast("double").alias("n"), F.lit(6.0).alias("seconds"), "confused", "label", "center", (F.least(F.col("n"), F.lit(30)) / 30).alias("p"), (F.col("n") >= 28).alias("ood"))


@query()
def str_episode_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.run_policy(policy_windows(spark, sf_dir))


@query()
def str_decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every decision with its index in the run and a hash of its content."""
    rows = episodes.run_policy(policy_windows(spark, sf_dir))
    line = F.to_json(F.struct(*rows.columns))
    return rows.withColumn("seq", F.row_number().over(islands.over(["run_id"], "idx"))).withColumn("content_hash", F.sha2(line.cast("binary"), 256))


@query(f"""WITH {_W}, r AS (SELECT run_id, idx // 4 AS trigger, idx, CASE WHEN idx % 11 = 0 THEN 'final' ELSE 'probe' END AS request FROM steps WHERE confused),
  w AS (SELECT DISTINCT run_id, trigger FROM r) SELECT w.run_id, w.trigger, arg_max(request, CASE WHEN request = 'final' THEN 1000000000 ELSE 0 END + idx) AS request, arg_max(idx, CASE WHEN request = 'final' THEN 1000000000 ELSE 0 END + idx) AS idx
  FROM w JOIN r ON r.run_id = w.run_id AND r.trigger <= w.trigger GROUP BY ALL""")
def str_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of confused windows, a trigger for each day: what is pending after it. The newest probe wins, a final request outranks all."""
    rows = steps(spark, sf_dir).filter("confused").select("run_id", F.expr("idx div 4").alias("trigger"), "idx", F.when(F.col("idx") % 11 == 0, "final").otherwise("probe").alias("request"))
    return requests.latest_wins(rows, ["run_id"], "trigger")


@query(f"WITH {_W}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY idx) AS k FROM steps) SELECT run_id, idx, round(pow(0.99, k) * sum(0.01 * n * pow(0.99, -k)) OVER (PARTITION BY run_id ORDER BY k), 6) AS ewma FROM k")
def win_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential mean 0.99 / 0.01 from 0 over the ordered windows of a run, as a decayed prefix sum."""
    rows = ranges.exponential_mean(steps(spark, sf_dir).select("run_id", "idx", "n"), ["run_id"], "idx", F.col("n"))
    return rows.select("run_id", "idx", F.round("ewma", 6).alias("ewma"))


_FIT = f"""{LADDER_SQL}, g AS (SELECT run_id, win, gate_us/{HOUR}.0 AS t, y, sigma_y AS s FROM ys WHERE y > 0), m AS (SELECT run_id, win, median(y) AS med, count(*) AS n0 FROM g GROUP BY ALL),
  d AS (SELECT run_id, win, median(abs(y-med)) AS mad FROM g JOIN m USING (run_id, win) GROUP BY ALL),
  k AS (SELECT g.*, CASE WHEN mad > 0 THEN abs(y-med) <= 6*mad ELSE abs(y-med) <= 0.25*greatest(1e-6, med) END AS near FROM g JOIN m USING (run_id, win) JOIN d USING (run_id, win) WHERE n0 >= 2),
  u AS (SELECT * FROM k WHERE near), c AS (SELECT run_id, win, min(t) AS t0, max(t) AS t1, (max(y)-min(y))/(abs(avg(y))+1e-12) AS spread, count(s) >= greatest(2, count(*)//2) AND max(s)/greatest(min(s), 1e-12) < 1e6 AS weigh, count(*) AS n FROM u GROUP BY ALL),
  x AS (SELECT u.run_id, u.win, t, y, CASE WHEN weigh THEN coalesce(1/(s*s), 1) ELSE 1 END AS w, j, 0.05*t0*pow(400*t1/t0, j/79.0) AS tau FROM u JOIN c USING (run_id, win), (SELECT unnest(range(80)) AS j) WHERE n >= 2 AND spread >= 0.02),
  f AS (SELECT *, 1-exp(-t/tau) AS f FROM x), p AS (SELECT run_id, win, j, any_value(tau) AS tau, sum(w*y*f)/sum(w*f*f) AS top, (sum(w*y*y) - sum(w*y*f)*sum(w*y*f)/sum(w*f*f))/sum(w) AS err, sum(y*y) AS yy, sum(y*f) AS yf, sum(f*f) AS ff, count(*) AS n FROM f GROUP BY run_id, win, j),
  e AS (SELECT *, sqrt(greatest(yy - 2*top*yf + top*top*ff, 0)/n) AS rms FROM p QUALIFY row_number() OVER (PARTITION BY run_id, win ORDER BY err, j) = 1),
  l AS (SELECT DISTINCT run_id, win FROM ys)"""


@query(f"""{_FIT} SELECT l.run_id, l.win, round(tau, 6) AS tau, round(top, 6) AS top, round(err, 5) AS err, round(CASE WHEN c.n >= 2 AND spread < 0.02 THEN 0.5 ELSE rms END, 6) AS rms, coalesce(rms > 0.2, false) AS mismatch
  FROM l LEFT JOIN c USING (run_id, win) LEFT JOIN e USING (run_id, win)""")
def str_tau_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tau and top of Y = top (1 - exp(-t / tau)) with the least weighted error over 80 values of tau, for every window: gate rows meet a fixed grid, the rest is grouping.

    Windows with fewer than two usable gates have no fit at all; flat ones have none either, but an rms of 0.5.
    """
    every = ladder(spark, sf_dir)
    g = every.filter("y > 0").select("run_id", "win", (F.col("gate_us") / float(HOUR)).alias("t"), "y", F.col("sigma_y").alias("s"))
    keys = ["run_id", "win"]
    m = g.groupBy(*keys).agg(F.median("y").alias("med"), F.count(F.lit(1)).alias("n0"))
    d = g.join(m, keys).groupBy(*keys).agg(F.median(F.abs(F.col("y") - F.col("med"))).alias("mad"), F.first("med").alias("med"), F.first("n0").alias("n0"))
    off = F.abs(F.col("y") - F.col("med"))
    u = g.join(d, keys).filter("n0 >= 2").filter(F.when(F.col("mad") > 0, off <= 6 * F.col("mad")).otherwise(off <= 0.25 * F.greatest(F.lit(1e-6), F.col("med"))))
    w = Window.partitionBy(*keys)
    known, n = F.count("s").over(w), F.count(F.lit(1)).over(w)
    u = u.withColumns({"t0": F.min("t").over(w), "t1": F.max("t").over(w), "n": n, "spread": (F.max("y").over(w) - F.min("y").over(w)) / (F.abs(F.avg("y").over(w)) + 1e-12), "weigh": (known >= F.greatest(F.lit(2), F.floor(n / 2))) & (F.max("s").over(w) / F.greatest(F.min("s").over(w), F.lit(1e-12)) < 1e6)})
    flat = u.filter("n >= 2 and spread < 0.02").select(*keys).distinct().withColumn("flat", F.lit(True))
    u = u.filter("n >= 2 and spread >= 0.02").withColumn("wt", F.when(F.col("weigh"), F.coalesce(1 / (F.col("s") * F.col("s")), F.lit(1.0))).otherwise(1.0))
    x = u.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(79)))).withColumn("tau", 0.05 * F.col("t0") * F.pow(400 * F.col("t1") / F.col("t0"), F.col("j") / 79.0)).withColumn("f", 1 - F.exp(-F.col("t") / F.col("tau")))
    y, f, wt = F.col("y"), F.col("f"), F.col("wt")
    p = x.groupBy(*keys, "j").agg(F.first("tau").alias("tau"), (F.sum(wt * y * f) / F.sum(wt * f * f)).alias("top"), ((F.sum(wt * y * y) - F.sum(wt * y * f) * F.sum(wt * y * f) / F.sum(wt * f * f)) / F.sum(wt)).alias("err"), F.sum(y * y).alias("yy"), F.sum(y * f).alias("yf"), F.sum(f * f).alias("ff"), F.count(F.lit(1)).alias("n"))
    top = F.col("top")
    p = p.withColumn("rms", F.sqrt(F.greatest(F.col("yy") - 2 * top * F.col("yf") + top * top * F.col("ff"), F.lit(0.0)) / F.col("n")))
    best = p.groupBy(*keys).agg(F.min(F.struct("err", "j", "tau", "top", "rms")).alias("b")).select(*keys, "b.*")
    out = every.select(*keys).distinct().join(best, keys, "left").join(flat, keys, "left")
    r = lambda c, n: F.round(c, n).alias(c)
    return out.select(*keys, r("tau", 6), r("top", 6), r("err", 5), F.round(F.when(F.col("flat"), 0.5).otherwise(F.col("rms")), 6).alias("rms"), F.coalesce(F.col("rms") > 0.2, F.lit(False)).alias("mismatch"))


@query()
def str_hold_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each Hold of the engine: from when, until when it is to be quiet (five strides of the window or four bounds of the correlation time, whichever is later), and how long it lasted, in bins."""
    rows = adaptive.run_engine(hourly(spark, sf_dir))
    held = islands.segments(rows, ["run_id"], "t", "state").filter("state = 'Hold'")
    return held.join(rows.select("run_id", F.col("t").alias("start"), "quiet_until"), ["run_id", "start"]).select("run_id", "start", "quiet_until", (F.col("quiet_until") - F.col("start")).alias("horizon"), (F.col("end") - F.col("start")).alias("held"))


@query(f"""WITH {DETECTIONS}, o AS (SELECT run_id, event_id, ts_us - (event_id % 7) * {HOUR} AS t, max(ts_us - (event_id % 7) * {HOUR}) OVER (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM det)
  SELECT run_id, count(*) FILTER (t < top) AS out_of_order, count(*) FILTER (t < top - {4 * HOUR}) AS dropped FROM o GROUP BY 1""")
def str_late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals behind the latest time so far, and those behind the watermark (four hours): the batch twin of the drop metric."""
    rows = detections(spark, sf_dir).withColumn("t", F.col("ts_us") - (F.col("event_id") % 7) * HOUR)
    rows = ranges.greatest_before(rows, ["run_id"], "event_id", "t", "top")
    return rows.groupBy("run_id").agg(F.count_if(F.col("t") < F.col("top")).alias("out_of_order"), F.count_if(F.col("t") < F.col("top") - 4 * HOUR).alias("dropped"))


@query(f"WITH {DETECTIONS} SELECT event_id, row_number() OVER (PARTITION BY run_id, ts_us // {7 * DAY} ORDER BY ts_us, event_id) AS n FROM det")
def str_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts that start anew with each session: the session is part of the key."""
    rows = detections(spark, sf_dir).withColumn("session", F.expr(f"ts_us div {7 * DAY}"))
    return ranges.places(rows, "ts_us", ["event_id"], keys=["run_id", "session"]).select("event_id", (F.col("place") + 1).alias("n"))
