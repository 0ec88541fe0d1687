"""Run history as long append-only tables, and comparison of runs.

runs:           run_id, parent_run_id, seq, reason
run_values:     run_id, section, key, value       (configs and metrics as text)
run_metrics:    run_id, metric, step, value
run_features:   run_id, feature
run_params:     run_id, name, value               (hyperparameters of the chosen model)
run_dropped:    run_id, feature, reason
run_comparison: run_id, model, cv_mean, cv_std, position, error
run_trials:     run_id, model, trial, value, params
run_curve:      run_id, split, round, loss
manifest:       run_id, attempt, at, whole

Rows are written under an attempt first; they become visible when the manifest names the attempt, which is the last
write. A run that dies on the way leaves rows that nobody reads, and its retry is a new attempt. Where a run was
published more than once, the latest whole attempt counts, with what was added to the run after it.
"""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..config import STAGES

# fixed values: the metrics that summarise a run
SUMMARY_METRICS = ("best_score", "train_score", "test_score", "accuracy", "precision", "recall", "f1",
                   "roc_auc", "r2", "mae", "mse", "rmse")
SUMMARY_FIELDS = ("task_type", "model_name", *SUMMARY_METRICS, "deployment_decision",
                  "selected_features", "hyperparameters")


#: Text entries of a run's metrics section that belong to its summary.
SUMMARY_TEXTS = tuple(f for f in SUMMARY_FIELDS if f not in SUMMARY_METRICS
                      and f not in ("selected_features", "hyperparameters"))
#: Columns of the tables that a run may have beside its values, metrics, features and parameters.
RUN_TABLES = {
    "run_dropped": {"feature": "string", "reason": "string"},
    "run_comparison": {"model": "string", "cv_mean": "double", "cv_std": "double", "position": "int",
                       "error": "string"},
    "run_trials": {"model": "string", "trial": "string", "value": "double", "params": "string"},
    "run_curve": {"split": "string", "round": "int", "loss": "double"},
}


def flatten(values: Mapping, prefix: str = "") -> list[tuple[str, str | None]]:
    """Nested settings as (dotted key, text); private keys (leading underscore) are left out."""
    out: list[tuple[str, str | None]] = []
    for k, v in values.items():
        if str(k).startswith("_"):
            continue
        name = f"{prefix}.{k}" if prefix else str(k)
        if isinstance(v, Mapping):
            out += flatten(v, name)
        else:
            out.append((name, None if v is None else str(v)))
    return out


_MANIFEST = "run_id string, attempt string, at long, whole boolean"


class RunStore:
    """Appends run tables under one path and reads back what was published.

    `attempt` collects all writes of a run and publishes them together; a write outside of it is published at once, as an
    addition to its run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._open: tuple[str, str] | None = None

    @contextlib.contextmanager
    def attempt(self, run_id: str) -> Iterator[RunStore]:
        """All that is logged inside becomes visible at the end, or not at all."""
        if self._open:
            raise ValueError(f"an attempt of run {self._open[0]!r} is open")
        self._open = run_id, uuid.uuid4().hex
        try:
            yield self
            self._publish(*self._open, True)
        finally:
            self._open = None

    def _publish(self, run_id: str, attempt: str, whole: bool) -> None:
        self.spark.createDataFrame([(run_id, attempt, time.time_ns() // 1000, whole)], _MANIFEST).write.mode("append").parquet(
            f"{self.path}/manifest")

    def _append(self, run_id: str, tables: Mapping[str, DataFrame]) -> None:
        if self._open and self._open[0] != run_id:
            raise ValueError(f"an attempt of run {self._open[0]!r} is open, not of {run_id!r}")
        attempt = self._open[1] if self._open else uuid.uuid4().hex
        for table, df in tables.items():
            df.withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(f"{self.path}/{table}")
        if not self._open:
            self._publish(run_id, attempt, False)

    def published(self) -> DataFrame:
        """(run_id, attempt) whose rows count: one row per run and later addition."""
        manifest = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        last = manifest.where("whole").groupBy("run_id").agg(F.max(F.struct("at", "attempt")).alias("last"))
        known = manifest.join(last, "run_id", "left")
        return known.where(F.col("last").isNull() | (F.struct("at", "attempt") == F.col("last"))
                           | (~F.col("whole") & (F.col("at") >= F.col("last.at")))).select("run_id", "attempt")

    def read(self, table: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{table}")
        return rows.join(self.published(), ["run_id", "attempt"], "left_semi").drop("attempt")

    def log_run(self, run_id: str, seq: int, configs: Mapping[str, Mapping], metrics: Mapping,
                features: list[str], parent: str | None = None, reason: str | None = None) -> None:
        new = self.spark.createDataFrame
        rows = [(run_id, stage, k, v) for stage, cfg in configs.items() for k, v in flatten(cfg)]
        rows += [(run_id, "metrics", k, v) for k, v in flatten(metrics)]
        numbers = [(run_id, k, 0, float(v)) for k, v in metrics.items()
                   if isinstance(v, (int, float)) and not isinstance(v, bool)]
        self._append(run_id, {
            "runs": new([(run_id, parent, seq, reason)], "run_id string, parent_run_id string, seq long, reason string"),
            "run_values": new(rows, "run_id string, section string, key string, value string"),
            "run_metrics": new(numbers, "run_id string, metric string, step int, value double"),
            "run_features": new([(run_id, f) for f in features], "run_id string, feature string")})

    def log_params(self, run_id: str, params: Mapping) -> None:
        rows = [(run_id, k, v) for k, v in flatten(params)]
        self._append(run_id, {"run_params": self.spark.createDataFrame(rows, "run_id string, name string, value string")})

    def log_table(self, table: str, run_id: str, rows: DataFrame) -> None:
        """Appends rows of one run to run_dropped, run_comparison, run_trials or run_curve; a column that the
        rows lack is null, others are left behind."""
        have = set(rows.columns)
        self._append(run_id, {table: rows.select(F.lit(run_id).alias("run_id"), *[
            (F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in RUN_TABLES[table].items()])})


def diff_values(before: DataFrame, after: DataFrame) -> DataFrame:
    """(section, key, before, after) for the entries that differ; absent is null."""
    left = before.select("section", "key", F.col("value").alias("before"))
    right = after.select("section", "key", F.col("value").alias("after"))
    return left.join(right, ["section", "key"], "full_outer").where(
        ~F.col("before").eqNullSafe(F.col("after")))


def changed_stages(diff: DataFrame) -> DataFrame:
    """(stage, position, changes) in the order the stages run."""
    known = F.array(*[F.lit(s) for s in STAGES])
    return diff.groupBy(F.col("section").alias("stage")).agg(F.count(F.lit(1)).alias("changes")).select(
        "stage", F.array_position(known, F.col("stage")).cast("int").alias("position"),
        "changes").where(F.col("position") > 0)


def diff_features(before: DataFrame, after: DataFrame) -> DataFrame:
    """(feature, change): added or removed."""
    added = after.join(before, "feature", "left_anti").select("feature").distinct()
    removed = before.join(after, "feature", "left_anti").select("feature").distinct()
    return added.withColumn("change", F.lit("added")).unionByName(
        removed.withColumn("change", F.lit("removed")))


def metrics_wide(run_metrics: DataFrame, metrics=SUMMARY_METRICS) -> DataFrame:
    """One row per run, one column per metric (its last step)."""
    return run_metrics.groupBy("run_id").pivot("metric", list(metrics)).agg(
        F.max_by("value", "step"))


def run_summary(runs: DataFrame, run_values: DataFrame, run_metrics: DataFrame, run_features: DataFrame,
                run_params: DataFrame) -> DataFrame:
    """One row per run with the 17 fields that sum it up; what was not logged is null, lists are empty.

    Selected features are a sorted list and hyperparameters a sorted list of name=value; a run has as many as
    its table has columns and its model settings."""
    texts = run_values.where(F.col("section") == "metrics").groupBy("run_id").pivot(
        "key", list(SUMMARY_TEXTS)).agg(F.max("value"))
    features = run_features.groupBy("run_id").agg(F.sort_array(F.collect_set("feature")).alias("selected_features"))
    params = run_params.groupBy("run_id").agg(F.sort_array(F.collect_set(F.concat(
        "name", F.lit("="), F.coalesce("value", F.lit(""))))).alias("hyperparameters"))
    out = runs.select("run_id").distinct()
    for part in (texts, metrics_wide(run_metrics), features, params):
        out = out.join(part, "run_id", "left")
    none = F.array().cast("array<string>")
    return out.select("run_id", *[F.coalesce(f, none).alias(f) if f in ("selected_features", "hyperparameters")
                                  else F.col(f) for f in SUMMARY_FIELDS])


def best_trials(run_trials: DataFrame) -> DataFrame:
    """(run_id, model, trials, best_value, best_trial, params): the best trial of each searched model."""
    best = F.max_by(F.struct("trial", "params"), F.struct("value", "trial"))
    return run_trials.groupBy("run_id", "model").agg(
        F.count(F.lit(1)).alias("trials"), F.max("value").alias("best_value"), best.alias("b")).select(
        "run_id", "model", "trials", "best_value", F.col("b.trial").alias("best_trial"),
        F.col("b.params").alias("params"))


def best_compared(run_comparison: DataFrame) -> DataFrame:
    """(run_id, model, best_cv_score, best_cv_std, candidates, failed): the winner of each run's comparison."""
    ranked = F.when(F.col("cv_mean").isNotNull(), F.struct((-F.col("position")).alias("p"), "model", "cv_mean", "cv_std"))
    return run_comparison.groupBy("run_id").agg(
        F.max(ranked).alias("b"), F.count(F.lit(1)).alias("candidates"),
        F.count("error").alias("failed")).select(
        "run_id", F.col("b.model").alias("model"), F.col("b.cv_mean").alias("best_cv_score"),
        F.col("b.cv_std").alias("best_cv_std"), "candidates", "failed")


def with_previous(runs: DataFrame) -> DataFrame:
    """Adds the run committed just before; one row per run, so one small ordered window."""
    w = W.partitionBy(F.lit(1)).orderBy("seq")
    return runs.withColumn("previous_run_id", F.lag("run_id").over(w))


def compare_last_two(runs: DataFrame, run_values: DataFrame, run_features: DataFrame) -> DataFrame:
    """(kind, section, name, before, after): all differences between the two latest runs."""
    last = with_previous(runs).orderBy(F.desc("seq")).limit(1).first()
    if last is None or last["previous_run_id"] is None:
        return runs.sparkSession.createDataFrame(
            [], "kind string, section string, name string, before string, after string")

    def of(df, run_id):
        return df.where(F.col("run_id") == run_id)

    old, new = last["previous_run_id"], last["run_id"]
    values = diff_values(of(run_values, old), of(run_values, new)).select(
        F.when(F.col("section") == "metrics", "metric").otherwise("config").alias("kind"), "section",
        F.col("key").alias("name"), "before", "after")
    features = diff_features(of(run_features, old), of(run_features, new)).select(
        F.lit("feature").alias("kind"), F.lit("feature_engineering").alias("section"),
        F.col("feature").alias("name"),
        F.when(F.col("change") == "removed", "selected").alias("before"),
        F.when(F.col("change") == "added", "selected").alias("after"))
    return values.unionByName(features)


def best_run(run_metrics: DataFrame, metric: str) -> DataFrame:
    return run_metrics.where(F.col("metric") == metric).agg(
        F.max_by("run_id", F.struct("value", "run_id")).alias("run_id"), F.max("value").alias("value"))


def search_runs(run_metrics: DataFrame, metric: str, at_least: float, limit: int = 100) -> DataFrame:
    """Runs whose metric reaches a value, best first."""
    return run_metrics.where((F.col("metric") == metric) & (F.col("value") >= at_least)).orderBy(
        F.desc("value"), "run_id").limit(limit).select("run_id", "value")
