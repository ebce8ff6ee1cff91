"""Classification quality and calibration. A document's scaled length is its score, its quality label the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import clamp_logit
from ..operators import curves
from ..registry import query
from .views import table

_S = "s AS (SELECT d.doc_id, least(999, n_chars // 5) / 1000.0::DOUBLE AS p, l.quality AS y FROM documents d JOIN labels l USING (doc_id))"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, p, y)"""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.least(F.lit(999), F.expr("n_chars div 5")) / 1000.0).alias("p"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")


_C = "c AS (SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg FROM (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY 1))"


@query("WITH " + _S + ", k AS (SELECT count(*) FILTER (p >= 0.3 AND y = 1) AS tp, count(*) FILTER (p >= 0.3 AND y = 0) AS fp, count(*) FILTER (p < 0.3 AND y = 0) AS tn, count(*) FILTER (p < 0.3 AND y = 1) AS fn FROM s) SELECT *, round((tp+tn)/(tp+fp+tn+fn), 9) AS accuracy, round(tp/(tp+fp), 9) AS precision, round(tp/(tp+fn), 9) AS recall, round(2*tp/(2*tp+fp+fn), 9) AS f1 FROM k")
def agg_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    up, y = F.col("p") >= 0.3, F.col("y") == 1
    k = scores(spark, sf_dir).agg(F.count_if(up & y).alias("tp"), F.count_if(up & ~y).alias("fp"), F.count_if(~up & ~y).alias("tn"), F.count_if(~up & y).alias("fn"))
    return k.selectExpr("*", "round((tp+tn)/(tp+fp+tn+fn), 9) AS accuracy", "round(tp/(tp+fp), 9) AS precision", "round(tp/(tp+fn), 9) AS recall", "round(2*tp/(2*tp+fp+fn), 9) AS f1")


@query(f"WITH {_S}, {_C} SELECT p, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / all_pos, 9) AS tpr, round(fp / all_neg, 9) AS fpr, round(tp / (tp + fp), 9) AS precision FROM c UNION ALL SELECT 'Infinity'::DOUBLE, 0, 0, 0, 0, 1")
def agg_roc_pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each distinct score, and the start, where no score is high enough."""
    found = scores(spark, sf_dir)
    out = curves.curve(found).select("p", "tp", "fp", *[F.round(c, 9).alias(c) for c in ("tpr", "fpr", "precision")])
    start = spark.range(1).select(F.lit(float("inf")).alias("p"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"), F.lit(1.0).alias("precision"))
    return out.unionByName(start)


@query(f"WITH {_S}, {_C} SELECT round(sum(neg / all_neg * (2*tp - pos) / (2*all_pos)), 9) AS roc_auc, round(sum(pos / all_pos * (CASE WHEN tp - pos + fp - neg > 0 THEN (tp - pos) / (tp - pos + fp - neg) ELSE 1 END + tp / (tp + fp)) / 2), 9) AS pr_auc FROM c")
def agg_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.areas(curves.curve(scores(spark, sf_dir))).select(F.round("roc_auc", 9).alias("roc_auc"), F.round("pr_auc", 9).alias("pr_auc"))


_B = "b AS (SELECT least(9, CAST(floor(p * 10) AS BIGINT)) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS fy FROM s GROUP BY 1)"


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bin_ = F.least(F.lit(9), F.floor(F.col("p") * 10)).cast("long")
    return scores(spark, sf_dir).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("fy"))


@query(f"WITH {_S}, {_B} SELECT (SELECT round(avg((p - y)*(p - y)), 9) FROM s) AS brier, round(sum(n * abs(mp - fy)) / sum(n), 9) AS ece FROM b")
def agg_brier_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("p") - F.col("y")
    ece = bins(spark, sf_dir).agg((F.sum(F.col("n") * F.abs(F.col("mp") - F.col("fy"))) / F.sum("n")).alias("ece"))
    brier = scores(spark, sf_dir).agg(F.avg(d * d).alias("brier"))
    return brier.join(F.broadcast(ece)).select(F.round("brier", 9).alias("brier"), F.round("ece", 9).alias("ece"))  # one row each


@query(f"WITH {_S}, {_B} SELECT g.bin, g.bin / 10.0::DOUBLE AS start, coalesce(n, 0) AS n, round(mp, 9) AS mean_p, round(fy, 9) AS frequency FROM (SELECT unnest(range(10)) AS bin) g LEFT JOIN b ON g.bin = b.bin")
def agg_reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten bins, empty ones without means."""
    grid = spark.range(10).select(F.col("id").alias("bin"))
    out = grid.join(bins(spark, sf_dir), "bin", "left")
    return out.select("bin", (F.col("bin") / 10.0).alias("start"), F.coalesce("n", F.lit(0)).alias("n"), F.round("mp", 9).alias("mean_p"), F.round("fy", 9).alias("frequency"))


@query(f"WITH {_S} SELECT doc_id, round(ln(q / (1 - q)), 6) AS logit FROM (SELECT doc_id, greatest(1e-9, least(1 - 1e-9, p)) AS q FROM s)")
def fn_logit_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("doc_id", F.round(clamp_logit(F.col("p")), 6).alias("logit"))


#: Knots of a monotone curve: a straight piece, a flat one, a steep one, and ends inside (0, 1).
_XS, _YS = [0.05, 0.2, 0.4, 0.45, 0.9], [0.1, 0.3, 0.3, 0.75, 0.95]


def _sql_interpolated() -> str:
    pieces = " ".join(f"WHEN p <= {x1} THEN {y0} + (p - {x0}) / ({x1} - {x0}) * ({y1} - {y0})" for x0, x1, y0, y1 in zip(_XS, _XS[1:], _YS, _YS[1:], strict=False))
    return f"CASE WHEN p <= {_XS[0]} THEN {_YS[0]} {pieces} ELSE {_YS[-1]} END"


@query(f"WITH {_S} SELECT doc_id, round(1 / (1 + exp(-(1.7 * ln(q / (1 - q)) + 0.4))), 9) AS platt, round(CAST({_sql_interpolated()} AS DOUBLE), 9) AS isotonic FROM (SELECT doc_id, p, greatest(1e-9, least(1 - 1e-9, p)) AS q FROM s)")
def fn_apply_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores under a sigmoid and under a monotone curve's knots."""
    platt = 1 / (1 + F.exp(-(1.7 * clamp_logit(F.col("p")) + 0.4)))
    return scores(spark, sf_dir).select("doc_id", F.round(platt, 9).alias("platt"), F.round(curves.interpolated(F.col("p"), _XS, _YS), 9).alias("isotonic"))


@query(f"WITH {_S} SELECT doc_id, p >= 0.8::DOUBLE OR p <= 0.2::DOUBLE AS confident FROM s")
def fn_probability_confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("doc_id", ((F.col("p") >= 0.8) | (F.col("p") <= 0.2)).alias("confident"))


@query()
def ml_platt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted sigmoid applied to every score."""
    rows = scores(spark, sf_dir).withColumn("x", clamp_logit(F.col("p")))
    held = rows.select("x", "y").persist()
    try:
        a, b = curves.platt(held)
    finally:
        held.unpersist()
    return rows.select("doc_id", "y", (1 / (1 + F.exp(-(a * F.col("x") + b)))).alias("calibrated"))


@query()
def ml_isotonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted knots from 0 to 1, and how many scores lie behind each (none behind added ends)."""
    blocks = curves.isotonic(scores(spark, sf_dir))
    found = curves.knots(blocks).select(F.explode(F.arrays_zip("xs", "ys")).alias("k")).select(F.col("k.xs").alias("x"), F.col("k.ys").alias("y"))
    return found.join(blocks.select("x", "n"), "x", "left").select("x", "y", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {_S} SELECT round(max(n) / sum(n), 9) AS accuracy FROM (SELECT y, count(*) AS n FROM s GROUP BY 1)")
def ml_majority_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_class = scores(spark, sf_dir).groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    return by_class.agg(F.round(F.max("n") / F.sum("n"), 9).alias("accuracy"))
