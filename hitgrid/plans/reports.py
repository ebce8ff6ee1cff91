"""Scalar rules as columns: values with uncertainties, thresholds, routing, covariances, text and JSON fields."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..registry import query
from .scoring import _RUNS
from .views import table

_AB = "ab AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS a, sqrt(l_quantity) AS sa, l_extendedprice/1000 AS b, l_discount + 0.1 AS sb FROM lineitem)"


@query(f"WITH {_AB} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(a+b, 6) AS add_v, round(sqrt(sa*sa+sb*sb), 6) AS add_s, round(a*b, 6) AS mul_v, round(sqrt(a*sb*a*sb + b*sa*b*sa), 7) AS mul_s, round(a/b, 6) AS div_v, round(abs(a/b)*sqrt((sa/a)*(sa/a)+(sb/b)*(sb/b)), 6) AS div_s, round(1/b, 6) AS inv_v, round(sa/a, 6) AS frac FROM ab")
def fn_value_stdev(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    a, b = V.value(F.col("l_quantity"), F.sqrt("l_quantity")), V.value(F.col("l_extendedprice") / 1000, F.col("l_discount") + 0.1)
    out = rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    add, mul, div, inv = V.add(a, b), V.multiply(a, b), V.divide(a, b), V.inverse(b)
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return out.select(*keys, F.round(add["value"], 6).alias("add_v"), F.round(add["stdev"], 6).alias("add_s"), F.round(mul["value"], 6).alias("mul_v"), F.round(mul["stdev"], 7).alias("mul_s"), F.round(div["value"], 6).alias("div_v"), F.round(div["stdev"], 6).alias("div_s"), F.round(inv["value"], 6).alias("inv_v"), F.round(V.fractional(a), 6).alias("frac"))


def count_threshold(duration_s: Column, low: float = 20000.0, high: float = 40000.0) -> Column:
    """Counts needed after a duration: low at 30 s, high at 60 s, linear between."""
    d = F.least(F.greatest(duration_s, F.lit(30.0)), F.lit(60.0))
    return low + (high - low) * (d - 30.0) / 30.0


@query("SELECT p_partkey, round(20000 + 20000 * (least(60, greatest(30, p_size * 2.0)) - 30) / 30.0, 6) AS n_min FROM part")
def fn_count_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(count_threshold(F.col("p_size") * 2.0), 6).alias("n_min"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_tax > 0.07 THEN 'Unknown' WHEN l_discount >= 0.05 THEN CASE WHEN l_quantity < 5 AND l_discount < 0.08 THEN 'Centroid' ELSE 'Dual' END ELSE 'Single' END AS route FROM lineitem")
def fn_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown when out of distribution; else Dual or Single, and the centroid for duals too close and not sure enough."""
    dual = F.when((F.col("l_quantity") < 5) & (F.col("l_discount") < 0.08), "Centroid").otherwise("Dual")
    route = F.when(F.col("l_tax") > 0.07, "Unknown").when(F.col("l_discount") >= 0.05, dual).otherwise("Single")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", route.alias("route"))


#: Decision by order state, as a literal map.
_REASONS = {"F": "COUNTS_BELOW_THRESHOLD", "O": "OUT_OF_DISTRIBUTION", "P": "NOT_STABLE"}


@query("SELECT o_orderkey, CASE o_orderstatus " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _REASONS.items()) + " ELSE 'OTHER' END AS code FROM orders")
def fn_reason_code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.create_map(*[F.lit(x) for kv in _REASONS.items() for x in kv])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(codes[F.col("o_orderstatus")], F.lit("OTHER")).alias("code"))


def json_number(line: Column, *names: str) -> Column:
    """The number under the first of these names that an object has, letter case as given. Numbers may be text, and NaN, Infinity and -Infinity are named; anything else is null."""
    text = F.coalesce(*[F.get_json_object(line, f"$.{n}") for n in names], F.lit(None).cast("string"))
    named = F.when(text == "NaN", float("nan")).when(text == "Infinity", float("inf")).when(text == "-Infinity", float("-inf"))
    return F.coalesce(named, F.when(text.rlike(r"^\s*[-+]?[0-9.]+([eE][-+]?[0-9]+)?\s*$"), text.try_cast("double")))


_VALUE = """CASE event_id % 6 WHEN 0 THEN '{"Value": "NaN"}' WHEN 1 THEN '{"value": "-Infinity", "Value": 7}' WHEN 2 THEN '{"v": 1.5e3}' WHEN 3 THEN '{"value": "' || CAST(event_id AS VARCHAR) || '"}' WHEN 4 THEN '{"value": "nan"}' ELSE '{"value": ' END"""


@query("""SELECT event_id, 1 AS line, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, NULL::DOUBLE AS value FROM events
  UNION ALL SELECT event_id, 3, NULL, CASE event_id % 6 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN '-Infinity'::DOUBLE WHEN 2 THEN 1500 WHEN 3 THEN event_id END FROM events""")
def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON, blank ones left out: numbers under any of their spellings, named ones, and nulls for what is missing, broken or no number. Null text is a line without values."""
    text = F.concat(F.coalesce("props", F.lit("null")), F.lit("\n \n"), F.expr(_VALUE.replace("VARCHAR", "STRING")))
    lines = table(spark, sf_dir, "events").select("event_id", F.posexplode(F.split(text, "\n")).alias("at", "line_text")).filter(F.trim("line_text") != "")
    return lines.select("event_id", (F.col("at") + 1).alias("line"), json_number(F.col("line_text"), "k", "K").alias("k"), json_number(F.col("line_text"), "value", "Value", "v").alias("value"))


@query("SELECT o_orderkey, lower(o_orderpriority) AS priority, CAST(nullif(regexp_extract(o_orderpriority, '[0-9]+'), '') AS INTEGER) AS level, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def fn_string_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lower("o_orderpriority").alias("priority"), F.nullif(F.regexp_extract("o_orderpriority", "[0-9]+", 0), F.lit("")).cast("int").alias("level"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


_CELLS = [(i, j) for i in range(3) for j in range(3)]
_UPPER = [(i, j) for i, j in _CELLS if i <= j]


def parse_covariance(rows: DataFrame) -> DataFrame:
    """Adds c00 .. c22 (upper triangle), asymmetric (cells that differ from their mirror) and finite, from columns cov_m_ij of nine or of six cells, letter case aside.

    Nine cells become their mean with their mirror. Fails where neither set is whole. A missing or odd value isn't finite.
    """
    known = {c.lower(): c for c in rows.columns}
    name = lambda i, j: f"cov_m_{i}{j}"
    nine = all(name(i, j) in known for i, j in _CELLS)
    if not nine and not all(name(i, j) in known for i, j in _UPPER):
        raise ValueError("neither nine nor six covariance columns")
    cell = {(i, j): F.col(known[name(i, j) if nine or i <= j else name(j, i)]).cast("double") for i, j in _CELLS}
    mean = {(i, j): (cell[i, j] + cell[j, i]) / 2 for i, j in _UPPER}
    # As close as rounding makes them: 1e-5 of the size and 1e-8.
    odd = [F.abs(mean[min(i, j), max(i, j)] - cell[i, j]) > 1e-8 + 1e-5 * F.abs(cell[i, j]) for i, j in _CELLS if i != j]
    finite = F.lit(True)
    for c in cell.values():
        finite = finite & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return rows.withColumns({**{f"c{i}{j}": v for (i, j), v in mean.items()}, "asymmetric": sum((F.coalesce(o.cast("int"), F.lit(0)) for o in odd), F.lit(0)), "finite": finite})


_M9 = [f"({c})" for c in ("l_quantity", "l_discount*10", "l_tax*10", "l_discount*10 + CASE WHEN l_linenumber = 1 THEN 0.5 ELSE 0 END", "l_quantity + 1", "l_tax*5", "CASE WHEN l_linenumber = 2 THEN NULL ELSE l_tax*10 END", "l_tax*5", "l_quantity + 2")]
_MIRROR = [f"(({_M9[3 * i + j]} + {_M9[3 * j + i]})/2)" for i, j in _CELLS]
_KEYS4 = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query(f"""SELECT {_KEYS4}, 'nine' AS form, {', '.join(f'round(CAST({_MIRROR[3 * i + j]} AS DOUBLE), 9) AS c{i}{j}' for i, j in _UPPER)}, {' + '.join(f'CASE WHEN abs({_MIRROR[3 * i + j]} - {_M9[3 * i + j]}) > 1e-8 + 1e-5 * abs({_M9[3 * i + j]}) THEN 1 ELSE 0 END' for i, j in _CELLS if i != j)} AS asymmetric, l_linenumber <> 2 AS finite FROM lineitem
  UNION ALL SELECT {_KEYS4}, 'six', {', '.join(f'round(CAST({_M9[3 * i + j]} AS DOUBLE), 9)' for i, j in _UPPER)}, 0, true FROM lineitem""")
def fn_cov_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine or six cells of a covariance as a symmetric matrix, how many cells differed from their mirror, and whether all are finite."""
    keys, out = _KEYS4.split(", "), None
    for form, cells in (("nine", _CELLS), ("six", _UPPER)):
        rows = table(spark, sf_dir, "lineitem").select(*keys, F.lit(form).alias("form"), *[F.expr(_M9[3 * i + j]).alias(f"COV_m_{i}{j}") for i, j in cells])
        part = parse_covariance(rows).select(*keys, "form", *[F.round(f"c{i}{j}", 9).alias(f"c{i}{j}") for i, j in _UPPER], "asymmetric", "finite")
        out = part if out is None else out.unionByName(part)
    return out


def least_eigenvalue(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    """Of the symmetric matrix [[a, d, e], [d, b, f], [e, f, c]], in closed form."""
    q = (a + b + c) / 3
    p1 = d * d + e * e + f * f
    p2 = (a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2 * p1
    p = F.sqrt(p2 / 6)
    x, y, z = a - q, b - q, c - q
    det = x * (y * z - f * f) - d * (d * z - f * e) + e * (d * f - y * e)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))
    return F.when(p == 0, q).otherwise(q + 2 * p * F.cos(F.acos(r) / 3 + 2 * math.pi / 3))


def cholesky3(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> dict[str, Column]:
    """The lower factor of the positive definite [[a, d, e], [d, b, f], [e, f, c]], in closed form. Null where a pivot isn't positive."""
    root = lambda x: F.when(x > 0, F.sqrt(x))
    l11 = root(a)
    l21, l31 = d / l11, e / l11
    l22 = root(b - l21 * l21)
    l32 = (f - l31 * l21) / l22
    return {"l11": l11, "l21": l21, "l31": l31, "l22": l22, "l32": l32, "l33": root(c - l31 * l31 - l32 * l32)}


def whitened3(x: tuple[Column, Column, Column], factor: dict[str, Column]) -> tuple[Column, Column, Column]:
    """The solution of L z = x by forward substitution: of unit covariance where L is the factor of that of x. Its squared length is the Mahalanobis distance."""
    z1 = x[0] / factor["l11"]
    z2 = (x[1] - factor["l21"] * z1) / factor["l22"]
    return z1, z2, (x[2] - factor["l31"] * z1 - factor["l32"] * z2) / factor["l33"]


_MEANS = "mu AS (SELECT grp, avg(m1) AS a1, avg(m2) AS a2, avg(m3) AS a3 FROM runs GROUP BY 1)"
_DETS = "(s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s23 * s13) + s13 * (s12 * s23 - s22 * s13))"
_COF = {"11": "(s22*s33 - s23*s23)", "22": "(s11*s33 - s13*s13)", "33": "(s11*s22 - s12*s12)", "12": "(s13*s23 - s12*s33)", "13": "(s12*s23 - s13*s22)", "23": "(s12*s13 - s11*s23)"}
_QUAD = " + ".join(f"{1 if i == j else 2}*d{i}*d{j}*{_COF[f'{i}{j}']}" for i in (1, 2, 3) for j in range(i, 4))
_PER_RUN = "pr AS (SELECT grp, run, " + ", ".join(f"covar_samp(m{i}, m{j}) / count(*) AS s{i}{j}" for i in (1, 2, 3) for j in range(i, 4)) + " FROM w GROUP BY ALL HAVING count(*) >= 4)"


@query(f"""WITH {_RUNS}, {_MEANS}, {_PER_RUN}, j AS (SELECT pr.*, m1 - a1 AS d1, m2 - a2 AS d2, m3 - a3 AS d3 FROM pr JOIN runs USING (grp, run) JOIN mu USING (grp)), q AS (SELECT *, {_DETS} AS det FROM j)
  SELECT grp, run, det > 1e-4 * s11 * s22 * s33 AS regular, CASE WHEN det > 1e-4 * s11 * s22 * s33 THEN round(d1 / sqrt(s11), 5) END AS z1, CASE WHEN det > 1e-4 * s11 * s22 * s33 THEN round((d2 - d1 * s12 / s11) / sqrt(s22 - s12 * s12 / s11), 4) END AS z2,
    CASE WHEN det > 1e-4 * s11 * s22 * s33 THEN round(ln(1 + ({_QUAD}) / det), 4) END AS distance FROM q""")
def fn_psd_shift3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's mean against its group's, whitened by the covariance of the run's own mean, and ln(1 + d) of its Mahalanobis distance d.

    A covariance whose least eigenvalue is below 1e-9 is shifted up to it first; those that are all but singular (correlations
    leave less than 1e-4 of the determinant) have no values here, as rounding would rule them.
    """
    from .scoring import _COVS, run_means, run_windows

    means = run_means(spark, sf_dir)
    centre = means.groupBy("grp").agg(*[F.avg(f"m{k}").alias(f"a{k}") for k in (1, 2, 3)])
    own = run_windows(spark, sf_dir).groupBy("grp", "run").agg(F.count(F.lit(1)).alias("n"), *[(F.covar_samp(f"m{i}", f"m{j}") / F.count(F.lit(1))).alias(f"s{i}{j}") for i, j in _COVS]).filter("n >= 4")
    rows = own.join(means, ["grp", "run"]).join(centre, "grp")
    order = [F.col(f"s{i}{j}") for i, j in ((1, 1), (2, 2), (3, 3), (1, 2), (1, 3), (2, 3))]
    rows = rows.withColumn("shift", F.greatest(F.lit(0.0), 1e-9 - least_eigenvalue(*order)))
    a, b, c = (F.col(f"s{k}{k}") + F.col("shift") for k in (1, 2, 3))
    rows = rows.withColumn("regular", F.expr(f"{_DETS} > 1e-4 * s11 * s22 * s33"))
    rows = rows.withColumns(cholesky3(a, b, c, *order[3:]))
    factor = {k: F.col(k) for k in ("l11", "l21", "l31", "l22", "l32", "l33")}
    z = whitened3(tuple(F.col(f"m{k}") - F.col(f"a{k}") for k in (1, 2, 3)), factor)
    rows = rows.withColumns({f"z{k}": v for k, v in enumerate(z, 1)})
    shown = lambda c, n, name: F.when(F.col("regular"), F.round(c, n)).alias(name)
    return rows.select("grp", "run", "regular", shown(F.col("z1"), 5, "z1"), shown(F.col("z2"), 4, "z2"), shown(F.log(1 + F.expr("z1*z1 + z2*z2 + z3*z3")), 4, "distance"))


def tau_floor(tau: Column, floor: float = 0.5, k: float = 3.0) -> Column:
    return F.when(tau.isNotNull() & ~F.isnan(tau) & (tau > 0), F.greatest(F.lit(floor), k * tau)).otherwise(floor)


def updated_window(w: Column, rel_y: Column, rel_m1: Column, floor: Column, down: float, up: float, most: float = 60.0, eps_y: float = 0.10, eps_m1: float = 0.02, least: Column | float = 0.5) -> Column:
    """One step of the window's width: coarse rules that keep to `floor` (the bound of the correlation time), then a scale by the relative errors, clamped in rate and range.

    `least` bounds the last clamp from below: the window's own floor; only a contraction has `floor` there, too.
    """
    least = least if isinstance(least, Column) else F.lit(least)
    w = F.when((rel_y < 0.5 * eps_y) & (rel_m1 < 0.5 * eps_m1), F.greatest(0.9 * w, floor)).when((rel_y > 2 * eps_y) | (rel_m1 > 2 * eps_m1), F.least(1.2 * w, F.lit(most))).otherwise(w)
    w = F.when((rel_y > eps_y) | (rel_m1 > eps_m1), F.least(1.3 * w, F.lit(most))).when((rel_y < eps_y) & (rel_m1 < eps_m1), F.greatest(0.95 * w, floor)).otherwise(w)
    a, b = rel_y / eps_y, rel_m1 / eps_m1
    scale = F.greatest(a * a, b * b)
    scaled = F.least(F.greatest(F.least(F.greatest(w * scale, w * down), w * up), least), F.lit(most))
    return F.when(scale > 0, scaled).otherwise(w)


@query("SELECT p_partkey, CASE WHEN p_size > 3 THEN greatest(0.5, 3 * p_size / 10.0) ELSE 0.5 END AS tau_floor FROM part")
def fn_tau_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    tau = F.when(F.col("p_size") > 3, F.col("p_size") / 10.0)
    return table(spark, sf_dir, "part").select("p_partkey", tau_floor(tau).alias("tau_floor"))


_RY, _RM, _FL = "(p_size / 200.0)", "(p_retailprice / 50000)", "(CASE WHEN p_size % 3 = 0 THEN 14.0 ELSE 0.5 END)"
_W1 = f"(CASE WHEN {_RY} < 0.05 AND {_RM} < 0.01 THEN greatest(9.0, {_FL}) WHEN {_RY} > 0.2 OR {_RM} > 0.04 THEN 12.0 ELSE 10.0 END)"
_W2 = f"(CASE WHEN {_RY} > 0.1 OR {_RM} > 0.02 THEN least(1.3 * {_W1}, 60) WHEN {_RY} < 0.1 AND {_RM} < 0.02 THEN greatest(0.95 * {_W1}, {_FL}) ELSE {_W1} END)"
_SC = f"greatest(({_RY}/0.1)*({_RY}/0.1), ({_RM}/0.02)*({_RM}/0.02))"


@query(f"SELECT p_partkey, round(CAST(least(greatest(least(greatest(w * s, w * 0.5), w * 2.0), 0.5), 60.0) AS DOUBLE), 6) AS track, round(CAST(least(greatest(least(greatest(w * s, w * 0.5), w * 1.2), f), 60.0) AS DOUBLE), 6) AS contract FROM (SELECT p_partkey, CAST({_W2} AS DOUBLE) AS w, CAST({_SC} AS DOUBLE) AS s, CAST({_FL} AS DOUBLE) AS f FROM part)")
def fn_window_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under a correlation time's bound of 14 for a third of the parts: while tracking the last clamp minds the window's own floor, in a contraction that bound."""
    floor, ry, rm = F.when(F.col("p_size") % 3 == 0, 14.0).otherwise(0.5), F.col("p_size") / 200.0, F.col("p_retailprice") / 50000
    track = updated_window(F.lit(10.0), ry, rm, floor, 0.5, 2.0)
    contract = updated_window(F.lit(10.0), ry, rm, floor, 0.5, 1.2, least=floor)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(track, 6).alias("track"), F.round(contract, 6).alias("contract"))
