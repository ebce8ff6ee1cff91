"""Moments, covariances and Feynman-Y of gate ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import feynman, values
from ..operators import bins as B
from ..operators import ranges
from ..registry import query
from ..tables import written
from .views import DAY, DETECTIONS, HOUR, LADDER, STEP, WINDOW, detections

ROUND = 6


def rounded(df: DataFrame, *columns: str, digits: int = ROUND) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_BINS = f"bins AS (SELECT run_id, ts_us // {HOUR} AS bin, count(*) AS n FROM det GROUP BY ALL)"
_GATES = f"""gates AS (
  SELECT run_id, win, gate_us, (bin * {HOUR} - win * {STEP}) // gate_us AS gate_idx, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT *, unnest(generate_series(CAST(floor((bin * {HOUR} - {WINDOW}) / {STEP}) + 1 AS BIGINT), bin * {HOUR} // {STEP})) AS win FROM bins), (SELECT unnest({LADDER}) AS gate_us)
  WHERE (bin * {HOUR} - win * {STEP}) // gate_us < {WINDOW} // gate_us GROUP BY ALL)"""
_SUMS = f"""sums AS (
  SELECT run_id, win, gate_us, CAST(greatest({WINDOW} // gate_us, 1) AS BIGINT) AS n_gates, CAST(sum(n) AS DOUBLE) AS s1, CAST(sum(n*(n-1)) AS DOUBLE) AS s2, CAST(sum(n*(n-1)*(n-2)) AS DOUBLE) AS s3,
    CAST(sum(n*n) AS DOUBLE) AS q11, sum(CAST(n*(n-1) AS DOUBLE)*(n*(n-1))) AS q22, sum(CAST(n*(n-1)*(n-2) AS DOUBLE)*(n*(n-1)*(n-2))) AS q33,
    sum(CAST(n AS DOUBLE)*(n*(n-1))) AS q12, sum(CAST(n AS DOUBLE)*(n*(n-1)*(n-2))) AS q13, sum(CAST(n*(n-1) AS DOUBLE)*(n*(n-1)*(n-2))) AS q23
  FROM gates GROUP BY ALL)"""
_MOMENTS = "moments AS (SELECT *, s1 / n_gates AS m1, s2 / n_gates AS m2, s3 / n_gates AS m3 FROM sums)"
_COV = """cov AS (SELECT *, greatest((q11 - n_gates*m1*m1) / greatest(n_gates-1, 1), 0) / n_gates AS v11, greatest((q22 - n_gates*m2*m2) / greatest(n_gates-1, 1), 0) / n_gates AS v22,
  greatest((q33 - n_gates*m3*m3) / greatest(n_gates-1, 1), 0) / n_gates AS v33, (q12 - n_gates*m1*m2) / greatest(n_gates-1, 1) / n_gates AS v12,
  (q13 - n_gates*m1*m3) / greatest(n_gates-1, 1) / n_gates AS v13, (q23 - n_gates*m2*m3) / greatest(n_gates-1, 1) / n_gates AS v23 FROM moments)"""
_RIDGE = """ridged AS (SELECT *, v11 + 0.001*greatest(1, v11, v22, v33) AS r11, v22 + 0.001*greatest(1, v11, v22, v33) AS r22, v33 + 0.001*greatest(1, v11, v22, v33) AS r33, greatest(v11, v22, v33) > 0 AS ridge_ok FROM cov)"""
_Y = """ys AS (SELECT *, y / sigma_y AS z, sigma_y IS NOT NULL AS valid FROM (SELECT *, CASE WHEN m1 > 0 THEN (m2 - m1*m1)/m1 ELSE 0 END AS y,
  CASE WHEN n_gates > 1 AND ridge_ok AND m1 > 0 AND var > 0 THEN sqrt(var) END AS sigma_y FROM (SELECT *, greatest(0, (-m2/(m1*m1)-1)*(-m2/(m1*m1)-1)*r11 + (1/m1)*(1/m1)*r22 + 2*(-m2/(m1*m1)-1)*(1/m1)*v12) AS var FROM ridged)))"""
_CHAIN = [DETECTIONS, _BINS, _GATES, _SUMS, _MOMENTS, _COV, _RIDGE, _Y]


def upto(n: int) -> str:
    return "WITH " + ", ".join(_CHAIN[:n])


LADDER_SQL = upto(8)


def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.ladder(detections(spark, sf_dir), HOUR, WINDOW, STEP, LADDER)


def hour_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = B.base_bins(detections(spark, sf_dir), HOUR, by_channel=False)
    return B.gate_counts(B.sliding_windows(bins, HOUR, WINDOW, STEP), HOUR, WINDOW, STEP, LADDER)


@query(f"WITH {DETECTIONS} SELECT run_id, ts_us // {HOUR} AS bin, channel, count(*) AS n FROM det GROUP BY ALL")
def agg_base_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.base_bins(detections(spark, sf_dir), HOUR)


@query(f"{upto(3)} SELECT * FROM gates")
def agg_gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hour_gates(spark, sf_dir)


@query(f"{upto(5)} SELECT run_id, win, gate_us, n_gates, round(m1, 6) AS m1, round(m2, 6) AS m2, round(m3, 6) AS m3 FROM moments")
def agg_factorial_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.factorial_moments(B.moment_sums(hour_gates(spark, sf_dir), WINDOW))
    return rounded(out.select("run_id", "win", "gate_us", "n_gates", "m1", "m2", "m3"), "m1", "m2", "m3")


_V = ["v11", "v22", "v33", "v12", "v13", "v23"]


@query(f"{upto(6)} SELECT run_id, win, gate_us, {', '.join(f'round({v}, 5) AS {v}' for v in _V)} FROM cov")
def agg_moment_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ladder(spark, sf_dir).select("run_id", "win", "gate_us", *_V), *_V, digits=5)


@query(f"{upto(7)} SELECT run_id, win, gate_us, round(r11, 5) AS r11, round(r22, 5) AS r22, round(r33, 5) AS r33, ridge_ok FROM ridged")
def fn_ridge_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ladder(spark, sf_dir).select("run_id", "win", "gate_us", "r11", "r22", "r33", "ridge_ok"), "r11", "r22", "r33", digits=5)


@query(f"{LADDER_SQL} SELECT run_id, win, gate_us, n_gates, round(y, 6) AS y, round(sigma_y, 6) AS sigma_y, round(z, 6) AS z, valid, coalesce(valid AND y > 0 AND z >= 3, false) AS significant FROM ys")
def agg_feynman_y(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ladder(spark, sf_dir).withColumn("significant", F.coalesce(F.col("valid") & (F.col("y") > 0) & (F.col("z") >= 3), F.lit(False)))
    return rounded(out.select("run_id", "win", "gate_us", "n_gates", "y", "sigma_y", "z", "valid", "significant"), "y", "sigma_y", "z")


@query(f"{LADDER_SQL} SELECT run_id, win, gate_us, round(y, 6) AS y, round(-m2/(m1*m1)-1, 6) AS dy_dm1, round(1/m1, 6) AS dy_dm2, round(sigma_y*sigma_y, 6) AS var_y FROM ys WHERE m1 > 0")
def fn_feynman_y_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    m1, m2 = F.col("m1"), F.col("m2")
    out = ladder(spark, sf_dir).filter("m1 > 0").select("run_id", "win", "gate_us", "y", (-m2 / (m1 * m1) - 1).alias("dy_dm1"), (1 / m1).alias("dy_dm2"), (F.col("sigma_y") * F.col("sigma_y")).alias("var_y"))
    return rounded(out, "y", "dy_dm1", "dy_dm2", "var_y")


@query(f"{LADDER_SQL} SELECT run_id, win, round(max(CASE WHEN valid AND gate_us >= {LADDER[2]} AND n_gates >= 2 THEN abs(z) END), 6) AS max_abs_z FROM ys GROUP BY ALL")
def agg_max_abs_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    use = F.col("valid") & (F.col("gate_us") >= LADDER[2]) & (F.col("n_gates") >= 2)
    return ladder(spark, sf_dir).groupBy("run_id", "win").agg(F.round(F.max(F.when(use, F.abs("z"))), 6).alias("max_abs_z"))


_HIST = f"""hist AS (SELECT run_id, win, gate_us, n, count(*) AS freq FROM gates GROUP BY ALL UNION ALL
  SELECT * FROM (SELECT run_id, win, gate_us, CAST(0 AS BIGINT) AS n, CAST({WINDOW} // gate_us - count(*) AS BIGINT) AS freq FROM gates GROUP BY run_id, win, gate_us) WHERE freq > 0)"""
_KEYS = ["run_id", "win", "gate_us"]


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.multiplicity_histogram(hour_gates(spark, sf_dir), F.floor(F.lit(WINDOW) / F.col("gate_us")), _KEYS)


@query(f"{upto(3)}, {_HIST} SELECT * FROM hist")
def agg_multiplicity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(spark, sf_dir)


def _choose(k: int) -> str:
    return "(CASE WHEN n >= %d THEN CAST(1 AS DOUBLE)%s ELSE 0 END)" % (k, "".join(f"*(n-{i})/{i + 1}" for i in range(k)))


_HM = f"hm AS (SELECT run_id, win, gate_us, CAST(sum(freq) AS DOUBLE) AS m0, {', '.join(f'sum({_choose(k)}*freq)/sum(freq) AS m{k}' for k in range(1, 9))} FROM hist GROUP BY ALL)"
_MS = [f"m{k}" for k in range(9)]


@query(f"{upto(3)}, {_HIST}, {_HM} SELECT run_id, win, gate_us, {', '.join(f'round({m}, 5) AS {m}' for m in _MS)} FROM hm")
def agg_histogram_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.histogram_moments(histogram(spark, sf_dir), _KEYS), *_MS, digits=5)


_G = "(CAST(1e9 AS DOUBLE)/(gate_us*1000))"
_CUM = {1: "m1", 2: "(m2-m1*m1/2)", 3: "(m3-m2*m1+m1*m1*m1/3)", 4: "(m4-m3*m1+m2*m1*m1-m2*m2/2-m1*m1*m1*m1/4)"}
_BN, _BD = "(3*(m1*m1-2*m2)*(m1*m1-2*m2))", "(4*(m1*m1*m1-3*m1*m2+3*m3)*m1)"
_YSQL = {f"y{k}": f"({c}*{_G})" for k, c in _CUM.items()}
_YSQL |= {"ym": "CASE WHEN m1 <= 0 THEN 0 ELSE 2*m2/m1-m1 END"} | {f"y{k}f": f"CASE WHEN m1 <= 0 THEN 0 ELSE {_CUM[k]}/m1 END" for k in (2, 3, 4)}
# ysm for a gate of one second: hours would put 11 digits before the point.
_YSQL |= {f"ysm{k}": f"CASE WHEN m1 = 0 THEN 0 ELSE {_CUM[k]}/({'*'.join(['m1'] * k)}) END" for k in (2, 3, 4)}
_YSQL |= {"ybeta": f"CASE WHEN m1 <= 0 OR m2 <= 0 OR m3 <= 0 OR {_BD} = 0 THEN 0 ELSE {_BN}/{_BD} END"}


# Ratios of small differences are wide apart in size: so many digits of each.
def _digits(c: Column, n: int) -> Column:
    return F.when(F.abs(c) < 1e-6, 0.0).otherwise(F.format_string(f"%.{n - 1}e", c).cast("double"))


def _sql_digits(c: str, n: int) -> str:
    return f"CASE WHEN abs(({c})) < 1e-6 THEN 0.0 ELSE CAST(printf('%.{n - 1}e', ({c})::DOUBLE) AS DOUBLE) END"


# Derivatives are ratios of whole numbers, often halfway between two roundings; their logarithms never are.
def _logged(c: Column, n: int) -> Column:
    return F.round(F.signum(c) * F.log(1 + F.abs(c)), n)


def _places(d: str) -> int:
    return 3 if d.endswith("ybeta") else 5


def _sql_logged(c: str, n: int) -> str:
    return f"round(sign({c}) * ln(1 + abs({c})), {n})"


@query(f"{upto(3)}, {_HIST}, {_HM} SELECT run_id, win, gate_us, {', '.join(f'round({_YSQL[y]}, 3) AS {y}' for y in feynman.MEMBERS[:-1])}, {_sql_digits(_YSQL['ybeta'], 5)} AS ybeta FROM hm")
def fn_y_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    moments = B.histogram_moments(histogram(spark, sf_dir), _KEYS)
    family, second = feynman.y_family(F.col("gate_us") * 1000), feynman.y_family(F.lit(1e9))
    return moments.select(*_KEYS, *[F.round(second[y] if y.startswith("ysm") else family[y], 3).alias(y) for y in feynman.MEMBERS[:-1]], _digits(family["ybeta"], 5).alias("ybeta"))


def _slopes() -> dict[str, list[str]]:
    """Derivatives by m1 .. m4 as SQL, by the quotient rule on those of the cumulants."""
    cum = {1: ["1.0"], 2: ["(-m1)", "1.0"], 3: ["(m1*m1-m2)", "(-m1)", "1.0"], 4: ["(2*m1*m2-m3-m1*m1*m1)", "(m1*m1-m2)", "(-m1)", "1.0"]}
    power = {1: "m1", 2: "(m1*m1)", 3: "(m1*m1*m1)", 4: "(m1*m1*m1*m1)"}
    rise = {1: "1.0", 2: "(m1+m1)", 3: "((m1+m1)*m1+m1*m1)", 4: "(((m1+m1)*m1+m1*m1)*m1+m1*m1*m1)"}
    over = lambda k, n: [f"(({d}*{power[n]}-{_CUM[k]}*{rise[n]})/({power[n]}*{power[n]}))" if i == 0 else f"({d}/{power[n]})" for i, d in enumerate(cum[k])]
    out = {f"y{k}": cum[k] for k in cum} | {"ym": ["(-2*m2/m1/m1-1)", "(2/m1)"]} | {f"y{k}f": over(k, 1) for k in (2, 3, 4)} | {f"ysm{k}": over(k, k) for k in (2, 3, 4)}
    top = ["(12*m1*(m1*m1-2*m2))", "(-12*(m1*m1-2*m2))", "0.0"]
    low = ["(16*m1*m1*m1-24*m1*m2+12*m3)", "(-12*m1*m1)", "(12*m1)"]
    return out | {"ybeta": [f"(({t}*{_BD}-{_BN}*{d})/({_BD}*{_BD}))" for t, d in zip(top, low, strict=True)]}


_SLOPES = _slopes()
_S = {
    "11": "(2*m2+m1-m1*m1)", "22": "(6*m4+6*m3+m2-m2*m2)", "33": "(20*m6+30*m5+12*m4+m3-m3*m3)", "44": "(70*m8+140*m7+90*m6+20*m5+m4-m4*m4)", "12": "(3*m3+2*m2-m1*m2)",
    "13": "(4*m4+3*m3-m1*m3)", "14": "(5*m5+4*m4-m1*m4)", "23": "(10*m5+12*m4+3*m3-m2*m3)", "24": "(15*m6+20*m5+6*m4-m2*m4)", "34": "(35*m7+60*m6+30*m5+4*m4-m3*m4)",
}
_D = [f"d{k}_{y}" for y in feynman.MEMBERS for k in range(1, len(_SLOPES[y]) + 1)]
_DSQL = f"slopes AS (SELECT *, {', '.join(f'{d} AS d{k}_{y}' for y in feynman.MEMBERS for k, d in enumerate(_SLOPES[y], 1))} FROM hm)"


@query(f"{upto(3)}, {_HIST}, {_HM}, {_DSQL} SELECT run_id, win, gate_us, {', '.join(f'{_sql_logged(d, _places(d))} AS {d}' for d in _D)} FROM slopes")
def fn_y_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivatives of every member by every moment, for each gate, as sign * ln(1 + size)."""
    moments = feynman.with_variances(B.histogram_moments(histogram(spark, sf_dir), _KEYS))
    return moments.select(*_KEYS, *[_logged(F.col(d), _places(d)).alias(d) for d in _D])


#: A variance below this share of its terms' sizes is lost in rounding: the query has null there.
_LOST = 1e-6
_SIGMA = {y: f"CASE WHEN m0 < 2 THEN -1 WHEN abs(v_{y}) < {_LOST} * size_{y} THEN NULL WHEN v_{y} < 0 THEN 0 ELSE sqrt(greatest(v_{y}, 0)) END" for y in feynman.MEMBERS}


def _sql_terms(y: str) -> list[str]:
    n = range(1, len(_SLOPES[y]) + 1)
    return [f"d{i}_{y}*d{j}_{y}*{_S[f'{i}{j}']}*{1.0 if i == j else 2.0}" for i in n for j in n if i <= j]


@query(f"""{upto(3)}, {_HIST}, {_HM}, {_DSQL}, vars AS (SELECT run_id, win, gate_us, m0, {', '.join(f"{' + '.join(_sql_terms(y))} AS v_{y}, {' + '.join(f'abs({t})' for t in _sql_terms(y))} AS size_{y}" for y in feynman.MEMBERS)} FROM slopes),
  sigmas AS (SELECT run_id, win, gate_us, {', '.join(f'{s}/(CASE WHEN m0 < 2 THEN 1 ELSE sqrt(m0-1) END) AS sigma_{y}, {s}/(CASE WHEN m0 < 2 THEN 1 ELSE m0-1 END) AS cycle_{y}' for y, s in _SIGMA.items())} FROM vars)
  SELECT run_id, win, gate_us, {', '.join(f'{_sql_logged(f"{kind}_{y}", 6)} AS {kind}_{y}' for y in feynman.MEMBERS for kind in ('sigma', 'cycle'))} FROM sigmas""")
def fn_y_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of every member for each gate, taken as one second, under both normalisations: over the root of cycles - 1 (sigma) and over cycles - 1 (cycle), as sign * ln(1 + size)."""
    moments = feynman.with_variances(B.histogram_moments(histogram(spark, sf_dir), _KEYS))
    both = {f"{kind}_{name[6:]}": c for kind, root in (("sigma", True), ("cycle", False)) for name, c in feynman.y_sigma(F.lit(1e9), F.col("m0"), root).items()}
    kept = lambda y: (F.col("m0") < 2) | (F.abs(f"v_{y}") >= _LOST * F.col(f"size_{y}"))
    return moments.select(*_KEYS, *[F.when(kept(name.split("_")[1]), _logged(c, 6)).alias(name) for name, c in both.items()])


_FANO = f"""fano AS (SELECT run_id, win, N, e, mean, var, u2, u3, u4 FROM (SELECT *, s1/N AS mean, (s2 - s1*s1/N)/(N-1) AS var, s2/N-(s1/N)*(s1/N) AS u2, s3/N-3*(s1/N)*s2/N+2*(s1/N)*(s1/N)*(s1/N) AS u3,
  s4/N-4*(s1/N)*s3/N+6*(s1/N)*(s1/N)*s2/N-3*(s1/N)*(s1/N)*(s1/N)*(s1/N) AS u4 FROM (SELECT run_id, win, CAST({WINDOW // (4 * HOUR)} AS DOUBLE) AS N, sum(n) AS e, CAST(sum(n) AS DOUBLE) AS s1, CAST(sum(n*n) AS DOUBLE) AS s2, CAST(sum(n*n*n) AS DOUBLE) AS s3, CAST(sum(n*n*n*n) AS DOUBLE) AS s4
  FROM gates WHERE gate_us = {4 * HOUR} GROUP BY ALL)) WHERE e >= 20)"""


@query(f"""{upto(3)}, {_FANO} SELECT run_id, win, round(mean, 6) AS mean, round(var, 6) AS var, round((var-mean)/mean, 6) AS y,
  round(sqrt(greatest((var/(mean*mean))*(var/(mean*mean))*u2/N + (1/mean)*(1/mean)*greatest(u4-u2*u2, 0)/N - 2*(var/(mean*mean))*(1/mean)*u3/N, 0)), 6) AS sigma_y FROM fano""")
def agg_fano_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance-to-mean with ddof 1 and central-moment errors, in one pass of power sums; windows with fewer than 20 events are skipped."""
    n = F.col("n").cast("double")
    sums = hour_gates(spark, sf_dir).filter(F.col("gate_us") == 4 * HOUR).groupBy("run_id", "win").agg(F.sum("n").alias("events"), F.sum(n).alias("s1"), F.sum(n * n).alias("s2"), F.sum(n * n * n).alias("s3"), F.sum(n * n * n * n).alias("s4"))
    N = F.lit(float(WINDOW // (4 * HOUR)))
    e1, e2, e3, e4 = (F.col(f"s{k}") / N for k in (1, 2, 3, 4))
    rows = sums.filter("events >= 20").withColumns({"mean": e1, "var": (F.col("s2") - F.col("s1") * F.col("s1") / N) / (N - 1), "u2": e2 - e1 * e1, "u3": e3 - 3 * e1 * e2 + 2 * e1 * e1 * e1, "u4": e4 - 4 * e1 * e3 + 6 * e1 * e1 * e2 - 3 * e1 * e1 * e1 * e1})
    dm, dv = -F.col("var") / (F.col("mean") * F.col("mean")), 1 / F.col("mean")
    var_y = dm * dm * F.col("u2") / N + dv * dv * F.greatest(F.col("u4") - F.col("u2") * F.col("u2"), F.lit(0.0)) / N + 2 * dm * dv * F.col("u3") / N
    out = rows.select("run_id", "win", "mean", "var", ((F.col("var") - F.col("mean")) / F.col("mean")).alias("y"), F.sqrt(F.greatest(var_y, F.lit(0.0))).alias("sigma_y"))
    return rounded(out, "mean", "var", "y", "sigma_y")


@query(f"{LADDER_SQL} SELECT run_id, round(median(z), 6) AS median_z, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z, count(*) AS usable FROM ys WHERE valid AND gate_us = {4 * HOUR} GROUP BY ALL")
def agg_run_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = written(ladder(spark, sf_dir).filter(F.col("valid") & (F.col("gate_us") == 4 * HOUR)).select("run_id", "z"), "z-by-run")
    out = z.groupBy("run_id").agg(F.round(F.min("z"), 6).alias("min_z"), F.round(F.max("z"), 6).alias("max_z"), F.count(F.lit(1)).alias("usable"))
    return out.join(ranges.percentiles(z, ["run_id"], "z", {"median_z": 0.5}), "run_id").withColumn("median_z", F.round("median_z", 6))


@query(f"""{LADDER_SQL}, used AS (SELECT gate_us AS source, z, CAST(greatest(0, least(19, floor((z + 10)))) AS BIGINT) AS bucket FROM ys WHERE valid)
  SELECT source, bucket, count(*) AS n, round(avg(z), 6) AS mean_z, round(median(z), 6) AS median_z FROM used GROUP BY ALL""")
def agg_group_z_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = ladder(spark, sf_dir).filter("valid").select(F.col("gate_us").alias("source"), "z", F.greatest(F.lit(0), F.least(F.lit(19), F.floor(F.col("z") + 10))).cast("long").alias("bucket"))
    used, keys = written(used, "z-by-source"), ["source", "bucket"]
    out = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("z"), 6).alias("mean_z"))
    return out.join(ranges.percentiles(used, keys, "z", {"median_z": 0.5}), keys).withColumn("median_z", F.round("median_z", 6))


@query(f"{LADDER_SQL} SELECT gate_us, count(*) FILTER (NOT valid) AS invalid_steps, count(*) FILTER (n_gates < 10) AS below_floor FROM ys GROUP BY ALL")
def agg_gate_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder(spark, sf_dir).groupBy("gate_us").agg(F.count_if(~F.col("valid")).alias("invalid_steps"), F.count_if(F.col("n_gates") < 10).alias("below_floor"))


@query(f"{upto(5)} SELECT run_id, win, round(1e9*m1/(gate_us*1000.0), 9) AS rate_cps FROM moments WHERE gate_us = {HOUR}")
def fn_rate_from_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ladder(spark, sf_dir).filter(F.col("gate_us") == HOUR)
    return rows.select("run_id", "win", F.round(values.rate_from_gate(F.col("m1"), F.col("gate_us") * 1000.0), 9).alias("rate_cps"))


@query(f"{LADDER_SQL} SELECT run_id, win, gate_us, round(y, 6) AS y FROM ys WHERE gate_us = {8 * HOUR}")
def flt_gate_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ladder(spark, sf_dir).filter(F.col("gate_us") == 8 * HOUR).select("run_id", "win", "gate_us", "y"), "y")


@query(f"{LADDER_SQL} SELECT run_id, count(*) FILTER (v33 > 0 AND isfinite(v12)) AS kept, count(*) FILTER (NOT (v33 > 0 AND isfinite(v12))) AS dropped FROM ys GROUP BY ALL")
def flt_finite_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = (F.col("v33") > 0) & ~F.isnan("v12") & (F.abs("v12") < float("inf"))
    return ladder(spark, sf_dir).groupBy("run_id").agg(F.count_if(fine).alias("kept"), F.count_if(~fine).alias("dropped"))


_PLATEAU = f"""{LADDER_SQL}, lagged AS (SELECT *, lag(y) OVER w AS y0, lag(gate_us) OVER w AS g0, row_number() OVER w - 1 AS k FROM ys WINDOW w AS (PARTITION BY run_id, win ORDER BY gate_us)),
  flagged AS (SELECT *, coalesce(abs((y - y0)/(ln(gate_us) - ln(g0))) < 0.05*abs(y), false) AS flat, coalesce(valid AND y > 0 AND z >= 3, false) AS sig FROM lagged)"""


def plateaus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("run_id", "win").orderBy("gate_us")
    rows = ladder(spark, sf_dir).withColumns({"y0": F.lag("y").over(w), "g0": F.lag("gate_us").over(w), "k": F.row_number().over(w) - 1})
    slope = F.abs((F.col("y") - F.col("y0")) / (F.log("gate_us") - F.log("g0")))
    return rows.withColumns({"flat": F.coalesce(slope < 0.05 * F.abs("y"), F.lit(False)), "sig": F.coalesce(F.col("valid") & (F.col("y") > 0) & (F.col("z") >= 3), F.lit(False))})


@query(f"{_PLATEAU} SELECT run_id, win, gate_us, flat FROM flagged")
def win_gate_plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plateaus(spark, sf_dir).select("run_id", "win", "gate_us", "flat")


@query(f"""{_PLATEAU}, firsts AS (SELECT run_id, win, min(CASE WHEN sig THEN k END) AS first_sig FROM flagged GROUP BY ALL)
  SELECT run_id, win, CAST(first_sig AS INTEGER) AS first_sig, CAST(max(CASE WHEN sig AND flat AND k > first_sig THEN k END) AS INTEGER) AS plateau, CAST(coalesce(max(CASE WHEN sig AND flat AND k > first_sig THEN k END), first_sig, 0) AS INTEGER) AS desired
  FROM flagged JOIN firsts USING (run_id, win) GROUP BY run_id, win, first_sig""")
def win_first_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = plateaus(spark, sf_dir).withColumn("first_sig", F.min(F.when(F.col("sig"), F.col("k"))).over(Window.partitionBy("run_id", "win")))
    on = F.col("sig") & F.col("flat") & (F.col("k") > F.col("first_sig"))
    out = rows.groupBy("run_id", "win").agg(F.min("first_sig").alias("first_sig"), F.max(F.when(on, F.col("k"))).alias("plateau"))
    return out.withColumn("desired", F.coalesce("plateau", "first_sig", F.lit(0)))


@query(f"{LADDER_SQL} SELECT run_id, win, gate_us, round(y, 6) AS y, row_number() OVER (PARTITION BY run_id, win ORDER BY gate_us) AS place FROM ys")
def srt_gate_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates of every window in the order of their widths."""
    from pyspark.sql import Window

    rows = ladder(spark, sf_dir)
    return rounded(rows.select("run_id", "win", "gate_us", "y", F.row_number().over(Window.partitionBy("run_id", "win").orderBy("gate_us")).cast("long").alias("place")), "y")


@query(f"""WITH {DETECTIONS} SELECT run_id, ts_us // {DAY} AS day, {', '.join(f'count(*) FILTER (channel = {c}) AS c{c}' for c in range(1, 16))}, count(*) AS total, round(count(*)/86400.0, 9) AS rate FROM det GROUP BY ALL""")
def agg_window_counts15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all 15 channels in fixed windows of a day, in one aggregation."""
    det = detections(spark, sf_dir).withColumn("day", F.expr(f"ts_us div {DAY}"))
    return det.groupBy("run_id", "day").agg(*[F.count_if(F.col("channel") == c).alias(f"c{c}") for c in range(1, 16)], F.count(F.lit(1)).alias("total"), F.round(F.count(F.lit(1)) / 86400.0, 9).alias("rate"))
