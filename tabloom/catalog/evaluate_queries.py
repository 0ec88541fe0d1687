"""Queries for metrics, baselines, chart tables and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EvaluateConfig
from ..functions.columns import round_doubles
from ..operators import evaluate as V
from .registry import query
from .views import ord_, pred_cls, pred_reg, sql, union

_COUNTS = ("cm", "SELECT label, prediction, count(*) AS n FROM pred_cls GROUP BY label, prediction")
_CLASSES = ("cl", "SELECT label AS c FROM cm UNION SELECT prediction FROM cm")
_PER = ("per", "SELECT c AS class, coalesce((SELECT sum(n) FROM cm WHERE label = c), 0) AS support, "
               "coalesce((SELECT sum(n) FROM cm WHERE prediction = c), 0) AS predicted, "
               "coalesce((SELECT sum(n) FROM cm WHERE label = c AND prediction = c), 0) AS hits FROM cl")
_REP = ("rep", "SELECT class, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS precision, "
               "CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall, CASE WHEN predicted + "
               "support = 0 THEN 0 ELSE 2 * hits / (predicted + support) END AS f1, support, hits FROM "
               "per")
_CTES = (_COUNTS, _CLASSES, _PER, _REP)


def _counts(spark, sf):
    return V.confusion_counts(pred_cls(spark, sf))


@query("accuracy", sql("pred_cls", "SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 "
                       "END), 6) AS accuracy FROM pred_cls"))
def accuracy(spark, sf):
    return round_doubles(V.accuracy(pred_cls(spark, sf)))


@query("weighted_prf", sql("pred_cls", "SELECT round(sum(hits) / sum(support), 6) AS accuracy, "
                           "round(sum(precision * support) / sum(support), 6) AS precision, "
                           "round(sum(recall * support) / sum(support), 6) AS recall, "
                           "round(sum(f1 * support) / sum(support), 6) AS f1 FROM rep", *_CTES))
def weighted_prf(spark, sf):
    return round_doubles(V.weighted_scores(_counts(spark, sf)))


@query("confusion", sql("pred_cls", "SELECT a.c AS label, b.c AS prediction, coalesce((SELECT n FROM "
                        "cm WHERE label = a.c AND prediction = b.c), 0) AS n FROM cl a, cl b",
                        _COUNTS, _CLASSES))
def confusion(spark, sf):
    return V.confusion_matrix(_counts(spark, sf))


@query("class_report", sql("pred_cls", (
    "SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, "
    "CAST(support AS BIGINT) AS support FROM rep UNION ALL SELECT 'macro avg', round(avg(precision), "
    "6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM rep UNION ALL "
    "SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * "
    "support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS "
    "BIGINT) FROM rep"), *_CTES))
def class_report(spark, sf):
    return round_doubles(V.report_with_averages(_counts(spark, sf)))


def _auc(view, label, score):
    return (f"SELECT (sum(CASE WHEN {label} THEN r ELSE 0 END) - sum({label}::INT) * "
            f"(sum({label}::INT) + 1) / 2) / (sum({label}::INT) * sum((NOT {label})::INT)) AS auc, "
            f"sum({label}::INT) AS support FROM (SELECT *, rank() OVER (ORDER BY {score}) + (count(*) "
            f"OVER (PARTITION BY {score}) - 1) / 2 AS r FROM {view})")


@query("roc_auc", sql("pred_cls", "SELECT round(auc, 6) AS roc_auc FROM (" + _auc(
    "pred_cls", "(label_bin = 1)", "score") + ")"))
def roc_auc(spark, sf):
    return round_doubles(V.roc_auc(pred_cls(spark, sf), "label_bin", "score"))


_PROBS = {"F": "score / (1 + score)", "O": "0.4 / (1 + score)", "P": "0.6 / (1 + score)"}


@query("roc_auc_multiclass", sql("pred_cls", (
    "SELECT round(sum(auc * support) / sum(support), 6) AS roc_auc FROM (" + union(
        [_auc(f"(SELECT label, {e} AS p FROM pred_cls)", f"(label = '{c}')", "p")
         for c, e in _PROBS.items()]) + ")")))
def roc_auc_multiclass(spark, sf):
    d = pred_cls(spark, sf).withColumn("probability", F.expr(f"array({', '.join(_PROBS.values())})"))
    return round_doubles(V.roc_auc(d, "label", classes=list(_PROBS)))


@query("confidence", sql("pred_cls", "SELECT round(avg(m), 6) AS average_confidence, round(avg(CASE WHEN"
                         " m < 0.6 THEN 1.0 ELSE 0.0 END), 6) AS low_confidence_rate FROM (SELECT "
                         f"greatest({', '.join(_PROBS.values())}) AS m FROM pred_cls)"))
def confidence(spark, sf):
    d = pred_cls(spark, sf).withColumn("probability", F.expr(f"array({', '.join(_PROBS.values())})"))
    return round_doubles(V.confidence_summary(d))


@query("majority_baseline", sql("pred_cls", (
    "SELECT label, round(n / t, 6) AS accuracy, round(n / t * 2 * (n / t) / (1 + n / t), 6) AS f1 FROM "
    "(SELECT label, count(*) AS n FROM pred_cls GROUP BY label ORDER BY n DESC, label LIMIT 1), "
    "(SELECT count(*) AS t FROM pred_cls)")))
def majority_baseline(spark, sf):
    return round_doubles(V.majority_baseline(pred_cls(spark, sf)))


@query("largest_confusion", sql("pred_cls", "SELECT max(n) AS largest_error_count FROM cm WHERE label <> "
                                "prediction", _COUNTS))
def largest_confusion(spark, sf):
    return V.largest_confusion(_counts(spark, sf))


# --- regression --------------------------------------------------------------------------

_REGM = ("round(1 - avg((label - p) ^ 2) / var_pop(label), 6) AS r2, round(avg(abs(label - p)), 4) AS "
         "mae, round(avg((label - p) ^ 2) / 1000000, 4) AS mse_millions, round(sqrt(avg((label - p) ^ "
         "2)), 4) AS rmse")


def _metrics(df):
    return df.withColumn("mse_millions", F.col("mse") / 1e6).drop("mse")


@query("reg_metrics", sql("pred_reg", f"SELECT {_REGM} FROM (SELECT label, prediction AS p FROM "
                          "pred_reg)"))
def reg_metrics(spark, sf):
    m = _metrics(V.regression_metrics(pred_reg(spark, sf)))
    return m.select(F.round("r2", 6).alias("r2"), *[F.round(c, 4).alias(c) for c in (
        "mae", "rmse", "mse_millions")])


@query("mean_baseline", sql("pred_reg", f"SELECT round(p, 4) AS value, CAST(0.0 AS DOUBLE) AS r2, m.mae, m.mse_millions, "
                            f"m.rmse FROM (SELECT avg(label) AS p FROM pred_reg), (SELECT {_REGM} FROM "
                            "(SELECT label, (SELECT avg(label) FROM pred_reg) AS p FROM pred_reg)) m"))
def mean_baseline(spark, sf):
    m = _metrics(V.mean_baseline(pred_reg(spark, sf)))
    return m.select((F.round("r2", 6) + 0.0).alias("r2"), *[F.round(c, 4).alias(c) for c in (
        "value", "mae", "rmse", "mse_millions")])


@query("residuals", sql("pred_reg", "SELECT row_key, round(label - prediction, 6) AS residual, "
                        "round(abs(label - prediction), 6) AS absolute_error FROM pred_reg"))
def residuals(spark, sf):
    return round_doubles(V.residuals(pred_reg(spark, sf)).select(
        "row_key", "residual", "absolute_error"))


@query("error_summary", sql("pred_reg", (
    "SELECT count(*) AS point_count, round(min(label), 6) AS target_min, round(max(label), 6) AS "
    "target_max, round(min(prediction), 6) AS prediction_min, round(max(prediction), 6) AS "
    "prediction_max, round(avg(label - prediction), 6) AS residual_mean, round(stddev_pop(label - "
    "prediction), 6) AS residual_std, round(quantile_cont(abs(label - prediction), 0.5), 6) AS "
    "median_absolute_error, round(quantile_cont(abs(label - prediction), 0.9), 6) AS "
    "p90_absolute_error FROM pred_reg")))
def error_summary(spark, sf):
    return round_doubles(V.error_summary(pred_reg(spark, sf)))


# --- charts ------------------------------------------------------------------------------

def _hist(view, col, bins, lo, hi):
    return (f"SELECT CAST(b AS INT) AS bin, round({lo} + ({hi} - {lo}) / {bins} * b, 6) AS bin_start, "
            f"coalesce(n, 0) AS n FROM range({bins}) t(b) LEFT JOIN (SELECT CAST(greatest(0, least("
            f"{bins - 1}, floor(({col} - {lo}) / (({hi} - {lo}) / {bins})))) AS BIGINT) AS k, count(*) "
            f"AS n FROM {view} GROUP BY 1) ON k = b")


@query("histogram", sql("pred_reg", _hist("r", "v", 8, "(SELECT min(v) FROM r)", "(SELECT max(v) FROM "
                                          "r)"), ("r", "SELECT label - prediction AS v FROM pred_reg")))
def histogram(spark, sf):
    return round_doubles(V.histogram(V.residuals(pred_reg(spark, sf)), "residual", 8))


@query("confidence_histogram", sql("pred_cls", _hist("r", "v", 6, "0.0::DOUBLE", "1.0::DOUBLE"), (
    "r", f"SELECT greatest({', '.join(_PROBS.values())}) AS v FROM pred_cls")))
def confidence_histogram(spark, sf):
    d = pred_cls(spark, sf).selectExpr(f"greatest({', '.join(_PROBS.values())}) AS v")
    return round_doubles(V.histogram(d, "v", 6, 0.0, 1.0))


# --- decisions over metrics of ten segments ----------------------------------------------

def _segments(spark, sf):
    """Metrics per segment of the keys, with train and test accuracy and the gap between them."""
    d = pred_cls(spark, sf).selectExpr("*", "row_key % 10 AS segment", "row_key % 3 = 0 AS held_out")
    scores = V.weighted_scores(V.confusion_counts(d, ["segment"]), ["segment"])
    right = (F.col("label") == F.col("prediction")).cast("double")
    sides = d.groupBy("segment").agg(
        F.avg(F.when(~F.col("held_out"), right)).alias("train_score"),
        F.avg(F.when(F.col("held_out"), right)).alias("test_score"))
    return scores.join(sides, "segment").withColumn(
        "gap", F.round(F.col("train_score") - F.col("test_score"), 4))


_SEG = (
    ("d", "SELECT *, row_key % 10 AS segment, row_key % 3 = 0 AS held_out FROM pred_cls"),
    ("dc", "SELECT segment, label, prediction, count(*) AS n FROM d GROUP BY ALL"),
    ("dcl", "SELECT segment, label AS c FROM dc UNION SELECT segment, prediction FROM dc"),
    ("dper", "SELECT l.segment, c, coalesce(sum(n) FILTER (WHERE label = c), 0) AS support, "
             "coalesce(sum(n) FILTER (WHERE prediction = c), 0) AS predicted, coalesce(sum(n) FILTER "
             "(WHERE label = c AND prediction = c), 0) AS hits FROM dcl l JOIN dc ON dc.segment = "
             "l.segment GROUP BY l.segment, c"),
    ("dsc", "SELECT segment, sum(hits) / sum(support) AS accuracy, sum(CASE WHEN support = 0 THEN 0 ELSE "
            "hits END) / sum(support) AS recall, sum(2 * hits / (predicted + support) * support) / "
            "sum(support) AS f1 FROM dper GROUP BY segment"),
    ("sides", "SELECT segment, avg(CASE WHEN NOT held_out THEN (label = prediction)::INT END) AS "
              "train_score, avg(CASE WHEN held_out THEN (label = prediction)::INT END) AS test_score FROM "
              "d GROUP BY segment"),
    ("m", "SELECT *, round(train_score - test_score, 4) AS gap FROM dsc JOIN sides USING (segment)"),
    ("dec", "SELECT *, CASE WHEN accuracy >= 0.9 AND f1 >= 0.9 AND train_score - test_score < 0.1 THEN "
            "'deploy' WHEN accuracy >= 0.7 AND f1 >= 0.7 AND train_score - test_score > 0.15 THEN "
            "'iterate' WHEN accuracy >= 0.7 AND f1 >= 0.7 THEN 'deploy' WHEN accuracy >= 0.5 THEN "
            "'iterate' ELSE 'reject' END AS decision, CASE WHEN recall >= 0.85 THEN 'deploy' WHEN "
            "recall >= 0.85 * 0.8 THEN 'iterate' ELSE 'reject' END AS by_threshold FROM m"),
)


@query("decision", sql("pred_cls", "SELECT segment, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, "
                       "round(recall, 6) AS recall, gap, decision, by_threshold FROM dec", *_SEG))
def decision(spark, sf):
    strict = EvaluateConfig(primary_metric="recall", deployment_threshold=0.85)
    return round_doubles(_segments(spark, sf).select(
        "segment", "accuracy", "f1", "recall", "gap", V.decision("classification").alias("decision"),
        V.decision("classification", strict).alias("by_threshold")))


@query("recommendation", sql("pred_cls", (
    "SELECT segment, CASE WHEN good THEN 'deploy' WHEN bad THEN 'do_not_deploy' ELSE 'review' END AS "
    "recommendation, CASE WHEN good AND gap <= 0.08 THEN 'high' WHEN good THEN 'medium' WHEN bad THEN "
    "'high' ELSE 'medium' END AS confidence FROM (SELECT segment, gap, decision = 'deploy' OR (accuracy "
    ">= 0.8 AND f1 >= 0.8 AND gap <= 0.12) AS good, decision = 'reject' OR greatest(accuracy, f1) < 0.6 "
    "AS bad FROM dec)"), *_SEG))
def recommendation(spark, sf):
    d = _segments(spark, sf).withColumn("decision", V.decision("classification"))
    what, sure = V.recommendation("classification")
    return d.select("segment", what.alias("recommendation"), sure.alias("confidence"))


@query("regression_decision", sql("pred_reg", (
    "SELECT segment, decision, CASE WHEN r2 >= 0.8 THEN 'deploy' WHEN r2 < 0.5 THEN 'do_not_deploy' ELSE "
    "'review' END AS recommendation FROM (SELECT *, CASE WHEN r2 >= 0.8 THEN 'deploy' WHEN r2 >= 0.5 "
    "THEN 'iterate' ELSE 'reject' END AS decision FROM (SELECT row_key % 10 AS segment, 1 - avg((label - "
    "prediction * (1 + (row_key % 10) * 0.1)) ^ 2) / var_pop(label) AS r2 FROM pred_reg GROUP BY 1))")))
def regression_decision(spark, sf):
    d = pred_reg(spark, sf).selectExpr("row_key % 10 AS segment", "label",
                                       "prediction * (1 + (row_key % 10) * 0.1D) AS prediction")
    m = V.regression_metrics(d, ["segment"]).withColumn("gap", F.lit(None).cast("double")).withColumn(
        "decision", V.decision("regression"))
    return m.select("segment", "decision", V.recommendation("regression")[0].alias("recommendation"))


def _band(v, lo, hi, names):
    return (f"CASE WHEN {v} IS NULL THEN 'unknown' WHEN {v} <= {lo} THEN '{names[0]}' WHEN {v} <= {hi} "
            f"THEN '{names[1]}' ELSE '{names[2]}' END")


@query("bands", sql("pred_cls", (
    "SELECT segment, " + _band("gap", 0.03, 0.1, ("generalizes", "mild_overfit", "overfit")) +
    " AS generalization, " + _band("spread", 0.03, 0.08, ("stable", "fairly_stable", "unstable")) +
    " AS stability, " + _band("f1 - accuracy", 0.03, 0.1, ("close", "mild_overfit", "overfit")) +
    " AS loss FROM m JOIN (SELECT segment, stddev_pop(s) AS spread FROM (SELECT segment, row_key % 7 AS "
    "fold, avg((label = prediction)::INT) AS s FROM d GROUP BY ALL) GROUP BY segment) USING (segment)"),
    *_SEG))
def bands(spark, sf):
    folds = pred_cls(spark, sf).selectExpr(
        "row_key % 10 AS segment", "row_key % 7 AS fold",
        "CAST(label = prediction AS double) AS hit").groupBy("segment", "fold").agg(
        F.avg("hit").alias("s")).groupBy("segment").agg(F.stddev_pop("s").alias("spread"))
    return _segments(spark, sf).join(folds, "segment").select(
        "segment", V.generalization_band(F.col("gap")).alias("generalization"),
        V.stability_band(F.col("spread")).alias("stability"),
        V.loss_band(F.col("f1") - F.col("accuracy")).alias("loss"))


@query("improvement", sql("pred_cls", (
    "SELECT round((a.accuracy - b.accuracy) * 100, 6) AS accuracy_points, round((s - r) / s * 100, 6) AS "
    "rmse_pct FROM (SELECT avg((label = prediction)::INT) AS accuracy FROM pred_cls) a, (SELECT max(n) / "
    "sum(n) AS accuracy FROM (SELECT count(*) AS n FROM pred_cls GROUP BY label)) b, (SELECT "
    "sqrt(avg((label - prediction) ^ 2)) AS r, stddev_pop(label) AS s FROM pr)"),
    ("pr", "SELECT o_totalprice AS label, CAST(0.9 * o_totalprice + 15000 + (o_orderkey % 17) * 100 AS "
           "double) AS prediction FROM orders")))
def improvement(spark, sf):
    cls, reg = pred_cls(spark, sf), pred_reg(spark, sf)
    a = V.accuracy(cls).withColumn("_k", F.lit(1)).join(
        V.majority_baseline(cls).select(F.col("accuracy").alias("base"), F.lit(1).alias("_k")), "_k")
    r = V.regression_metrics(reg).select(F.col("rmse"), F.lit(1).alias("_k")).join(
        V.mean_baseline(reg).select(F.col("rmse").alias("base_rmse"), F.lit(1).alias("_k")), "_k")
    return round_doubles(a.join(r, "_k").select(
        V.accuracy_improvement(F.col("accuracy"), F.col("base")).alias("accuracy_points"),
        V.rmse_improvement(F.col("rmse"), F.col("base_rmse")).alias("rmse_pct")))
