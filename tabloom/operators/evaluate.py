"""Metrics of predictions, baselines, chart tables and decisions.

Input frames hold one row per scored record: row_key, label, prediction and, where needed,
class probabilities. Classification metrics all derive from the confusion counts, so the rows
are aggregated once, before any shuffle, to (label, prediction, n). `groups` keeps several
models or segments apart in the same pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..config import LIMITS, EvaluateConfig
from ..functions.columns import ratio, ref
from ..functions.ordering import running_sums
from ..functions.quantiles import exact_quantiles
from ..functions.scratch import settle


# --- classification ----------------------------------------------------------------------

def confusion_counts(df: DataFrame, groups: Sequence[str] = (), label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    return df.groupBy(*[ref(g) for g in groups], ref(label).cast("string").alias("label"),
                      ref(prediction).cast("string").alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_matrix(counts: DataFrame, sparse: bool = False) -> DataFrame:
    """Every (label, prediction) cell of the label union, zeros included; `sparse` leaves zeros out.

    The full matrix is the label table joined with itself: its size is the size of the result.
    """
    if sparse:
        return counts.select("label", "prediction", "n")
    labels = counts.select(F.explode(F.array("label", "prediction")).alias("label")).distinct()
    zeros = labels.crossJoin(labels.withColumnRenamed("label", "prediction")).withColumn(
        "n", F.lit(0).cast("long"))
    return counts.select("label", "prediction", "n").unionByName(zeros).groupBy(
        "label", "prediction").agg(F.sum("n").alias("n"))


def class_report(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Per class: precision, recall, f1, support; 0 where a denominator is 0."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    sides = counts.select(*[ref(g) for g in groups], F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"),
                 zero.alias("predicted"), hit.alias("hits")),
        F.struct(F.col("prediction").alias("class"), zero.alias("support"),
                 F.col("n").alias("predicted"), zero.alias("hits")))).alias("s")).select(
        *[ref(g) for g in groups], "s.*")
    per = sides.groupBy(*[ref(g) for g in groups], "class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
        F.sum("hits").alias("hits"))
    zero_safe = [(n, F.coalesce(ratio(F.col("hits"), F.col(d)), F.lit(0.0)))
                 for n, d in (("precision", "predicted"), ("recall", "support"))]
    f1 = F.coalesce(ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")), F.lit(0.0))
    return per.select(*[ref(g) for g in groups], "class", *[c.alias(n) for n, c in zero_safe],
                      f1.alias("f1"), "support", "hits", "predicted")


def report_with_averages(counts: DataFrame) -> DataFrame:
    """The per-class rows plus `macro avg` and `weighted avg`."""
    rows = class_report(counts).select("class", "precision", "recall", "f1", "support")
    names = ("precision", "recall", "f1")
    weighted = [F.coalesce(ratio(F.sum(F.col(n) * F.col("support")), F.sum("support")),
                           F.lit(0.0)).alias(n) for n in names]
    macro = rows.agg(*[F.avg(n).alias(n) for n in names], F.sum("support").alias("support"))
    mean = rows.agg(*weighted, F.sum("support").alias("support"))
    return rows.unionByName(macro.withColumn("class", F.lit("macro avg"))).unionByName(
        mean.withColumn("class", F.lit("weighted avg")))


def weighted_scores(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """accuracy and support-weighted precision, recall, f1 (per group)."""
    per = class_report(counts, groups)
    total = F.sum("support")
    return per.groupBy(*[ref(g) for g in groups]).agg(
        ratio(F.sum("hits"), total).alias("accuracy"),
        *[ratio(F.sum(F.col(n) * F.col("support")), total).alias(n)
          for n in ("precision", "recall", "f1")])


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


def majority_baseline(df: DataFrame, label: str = "label") -> DataFrame:
    """Always predicting the most frequent class (the smallest one on ties)."""
    counts = df.groupBy(ref(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("label"))).alias("b"),
                      F.sum("n").alias("total"))
    acc = ratio(-F.col("b.m"), F.col("total"))
    return best.select(F.col("b.label").alias("label"), acc.alias("accuracy"),
                       (acc * 2 * acc / (1 + acc)).alias("f1"))


def largest_confusion(counts: DataFrame) -> DataFrame:
    off = F.when(F.col("label") != F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    return counts.agg(F.coalesce(F.max(off), F.lit(0)).alias("largest_error_count"))


def probabilities_from_margins(margins: Column) -> Column:
    """Softmax of an array of class margins, shifted by the maximum."""
    top = F.array_max(margins)
    powers = F.transform(margins, lambda x: F.exp(x - top))
    total = F.greatest(F.aggregate(powers, F.lit(0.0), lambda a, x: a + x), F.lit(1e-9))
    return F.transform(powers, lambda x: x / total)


def probabilities_from_margin(margin: Column) -> Column:
    """Sigmoid of one margin as the array of both class probabilities."""
    p = 1 / (1 + F.exp(-margin))
    return F.array(1 - p, p)


def confidence_summary(df: DataFrame, probabilities: str = "probability") -> DataFrame:
    """Mean of the largest class probability and the share of rows below 0.6."""
    top = F.array_max(ref(probabilities))
    return df.agg(F.avg(top).alias("average_confidence"),
                  F.avg((top < 0.6).cast("double")).alias("low_confidence_rate"))


# --- ROC-AUC -----------------------------------------------------------------------------

def roc_auc(df: DataFrame, label: str = "label", score: str = "score",
            classes: Sequence[str] | None = None, probabilities: str = "probability") -> DataFrame:
    """Exact area under the ROC curve, ties counted half.

    Binary: `label` is 0/1 and `score` a number. With `classes`, one-vs-rest over the
    probability array, weighted by class support. Equal scores are merged before any ranking,
    so what is ranked are distinct scores, in value ranges of bounded size.
    """
    if classes is None:
        points = df.select(F.lit("1").alias("cls"), ref(score).cast("double").alias("score"),
                           (ref(label) == 1).cast("long").alias("hit"))
    else:
        each = F.array(*[F.struct(F.lit(c).alias("cls"), ref(probabilities)[i].alias("score"),
                                  (ref(label).cast("string") == c).cast("long").alias("hit"))
                         for i, c in enumerate(classes)])
        points = df.select(F.explode(each).alias("p")).select("p.*")
    merged = points.groupBy("cls", "score").agg(
        F.sum("hit").alias("pos"), (F.count(F.lit(1)) - F.sum("hit")).alias("neg"))
    rows = merged.count()
    if rows > LIMITS.rows_per_bucket:
        merged = settle(merged, "roc")
    ranked = running_sums(merged, "score", ["neg"], rows, groups=["cls"])
    area = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    per = ranked.groupBy("cls").agg(
        F.try_divide(area, (F.sum("pos").cast("double") * F.sum("neg").cast("double"))).alias("auc"),
        F.sum("pos").alias("support"))
    return per.agg(ratio(F.sum(F.col("auc") * F.col("support")), F.sum("support")).alias("roc_auc"))


# --- regression --------------------------------------------------------------------------

def regression_metrics(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    y, p = F.col("label").cast("double"), F.col("prediction").cast("double")
    one = df.groupBy(*[ref(g) for g in groups]).agg(
        F.avg(F.abs(y - p)).alias("mae"), F.avg((y - p) * (y - p)).alias("mse"),
        F.var_pop(y).alias("_var"))
    r2 = F.when(F.col("_var") > 0, 1 - F.try_divide(F.col("mse"), F.col("_var"))).otherwise(
        F.when(F.col("mse") == 0, 1.0).otherwise(0.0))
    return one.select(*[ref(g) for g in groups], r2.alias("r2"), "mae", "mse",
                      F.sqrt("mse").alias("rmse"))


def mean_baseline(df: DataFrame) -> DataFrame:
    """Always predicting the mean label."""
    mean = df.agg(F.avg(F.col("label").cast("double"))).first()[0]
    return regression_metrics(df.withColumn("prediction", F.lit(mean).cast("double"))).select(
        F.lit(mean).cast("double").alias("value"), "r2", "mae", "mse", "rmse")


def residuals(df: DataFrame) -> DataFrame:
    gap = F.col("label").cast("double") - F.col("prediction").cast("double")
    return df.select("*", gap.alias("residual"), F.abs(gap).alias("absolute_error"))


def error_summary(df: DataFrame) -> DataFrame:
    r = residuals(df)
    median, p90 = exact_quantiles(r, ["absolute_error"], (0.5, 0.9))["absolute_error"]
    return r.agg(
        F.count(F.lit(1)).alias("point_count"), F.min("label").alias("target_min"),
        F.max("label").alias("target_max"), F.min("prediction").alias("prediction_min"),
        F.max("prediction").alias("prediction_max"), F.avg("residual").alias("residual_mean"),
        F.stddev_pop("residual").alias("residual_std")).select(
        "*", F.lit(median).cast("double").alias("median_absolute_error"),
        F.lit(p90).cast("double").alias("p90_absolute_error"))


# --- charts ------------------------------------------------------------------------------

def histogram(df: DataFrame, column: str, bins: int, low: float | None = None,
              high: float | None = None) -> DataFrame:
    """(bin, bin_start, n) of equal width, empty bins included; the maximum is in the last bin."""
    v = ref(column).cast("double")
    if low is None or high is None:
        ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
        low = ends["lo"] if low is None else low
        high = ends["hi"] if high is None else high
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_start double, n long")
    if low == high:
        return df.where(v.isNotNull()).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(0).alias("bin"), F.lit(low).alias("bin_start"), "n")
    step = (high - low) / bins
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((v - low) / step))).cast("int")
    counted = df.where(v.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin", (F.lit(low) + F.lit(step) * F.col("bin")).alias("bin_start"),
        F.coalesce("n", F.lit(0)).alias("n"))


# --- decisions ---------------------------------------------------------------------------

def decision(task: str, cfg: EvaluateConfig = EvaluateConfig()) -> Column:
    """deploy | iterate | reject from a metrics row.

    Classification reads accuracy, f1, recall, train_score, test_score; regression reads r2.
    """
    c = F.col
    if task == "regression":
        return F.when(c("r2") >= 0.8, "deploy").when(c("r2") >= 0.5, "iterate").otherwise("reject")
    if cfg.deployment_threshold is not None:
        metric = c(cfg.primary_metric if cfg.primary_metric in ("accuracy", "f1", "recall")
                   else "accuracy")
        bar = float(cfg.deployment_threshold)
        return F.when(metric >= bar, "deploy").when(metric >= bar * 0.8, "iterate").otherwise("reject")
    gap = c("train_score") - c("test_score")
    strong = (c("accuracy") >= 0.9) & (c("f1") >= 0.9) & (gap < 0.1)
    fair = (c("accuracy") >= 0.7) & (c("f1") >= 0.7)
    return (F.when(strong, "deploy").when(fair & (gap > 0.15), "iterate").when(fair, "deploy")
            .when(c("accuracy") >= 0.5, "iterate").otherwise("reject"))


def recommendation(task: str) -> tuple[Column, Column]:
    """(recommendation, confidence) from a metrics row with `decision` and `gap`."""
    c = F.col
    tight = c("gap").isNotNull() & (c("gap") <= 0.08)
    if task == "regression":
        good = (c("decision") == "deploy") | (F.coalesce(c("r2"), F.lit(0.0)) >= 0.8)
        bad = (c("decision") == "reject") | (F.coalesce(c("r2"), F.lit(0.0)) < 0.5)
    else:
        acc, f1 = (F.coalesce(c(m), F.lit(0.0)) for m in ("accuracy", "f1"))
        good = (c("decision") == "deploy") | (
            (acc >= 0.8) & (f1 >= 0.8) & (c("gap").isNull() | (c("gap") <= 0.12)))
        bad = (c("decision") == "reject") | (F.greatest(acc, f1) < 0.6)
    what = F.when(good, "deploy").when(bad, "do_not_deploy").otherwise("review")
    sure = F.when(good, F.when(tight, "high").otherwise("medium")).when(bad, "high").otherwise("medium")
    return what, sure


def band(value: Column, low: float, high: float, names: Sequence[str]) -> Column:
    """Three named bands; null gives `unknown`."""
    return (F.when(value.isNull(), "unknown").when(value <= low, names[0])
            .when(value <= high, names[1]).otherwise(names[2]))


def generalization_band(gap: Column) -> Column:
    return band(gap, 0.03, 0.1, ("generalizes", "mild_overfit", "overfit"))


def stability_band(cv_std: Column) -> Column:
    return band(cv_std, 0.03, 0.08, ("stable", "fairly_stable", "unstable"))


def loss_band(loss_gap: Column) -> Column:
    return band(loss_gap, 0.03, 0.1, ("close", "mild_overfit", "overfit"))


def rmse_improvement(model_rmse: Column, baseline_rmse: Column) -> Column:
    """Percent by which the model lowers the baseline RMSE; 0 for a zero baseline."""
    return F.coalesce(ratio(baseline_rmse - model_rmse, baseline_rmse) * 100, F.lit(0.0))


def accuracy_improvement(model_accuracy: Column, baseline_accuracy: Column) -> Column:
    """Percentage points above the baseline."""
    return (model_accuracy - baseline_accuracy) * 100
