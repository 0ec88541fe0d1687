"""Candidate models: specs, fitting, cross-validation, search and comparison.

Folds are a column. One cross-validation fits each candidate once per fold and writes a single
wide out-of-fold table (a prediction and a probability column per candidate); scores, the
leaderboard, diversity, voting and stacking are all aggregates or fits over that table.
"""

from __future__ import annotations

import json
import math
import random
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import TrainConfig
from ..functions.columns import ref
from ..functions.lookups import lookup
from ..functions.scratch import settle
from . import trees as T
from .evaluate import (confusion_counts, probabilities_from_margin, probabilities_from_margins,
                       regression_metrics, weighted_scores)
from .kernel import KernelLearner
from .ridge import RidgeLearner, fold_grams, held_scores, solve_without


# --- candidates --------------------------------------------------------------------------

@dataclass(frozen=True)
class TableSignals:
    rows: int
    features: int
    class_balance: float = 1.0
    high_missing_columns: int = 0
    high_correlations: int = 0
    outlier_columns: int = 0


def choose_candidates(task: str, s: TableSignals, top: int = 3) -> list[str]:
    """Model names in order of preference for the shape and quality of the table."""
    linear_svm = {"classification": ["LogisticRegression", "SVM"], "regression": ["Ridge", "SVR"]}
    boosted = ["XGBoost", "LightGBM"]
    wide = s.features > s.rows * 0.5
    correlated, gaps, outliers = s.high_correlations > 3, s.high_missing_columns > 2, \
        s.outlier_columns > 0
    margin = linear_svm[task][1]
    if s.rows < 1000:
        names = [*linear_svm[task], "RandomForest"]
    elif task == "regression" and s.rows < 10_000:
        names = ["RandomForest", "GradientBoosting", "XGBoost", "Ridge"]
    else:
        names = ["RandomForest", "GradientBoosting", *boosted]
    blocked = set()
    if task == "classification":
        if s.class_balance < 0.1:
            names += [*boosted, "RandomForest"]
        if wide:
            names.append("LogisticRegression")
            blocked.add(margin)
        if correlated:
            names += ["RandomForest", "GradientBoosting", "LightGBM"]
        if gaps:
            names += ["RandomForest", "GradientBoosting", "LightGBM"]
        if outliers:
            blocked.add(margin)
            names += ["RandomForest", "GradientBoosting"]
    else:
        if wide:
            names.append("Ridge")
        if correlated:
            names += ["Ridge", "LightGBM"]
        if outliers:
            blocked.add(margin)
            names += ["RandomForest", "GradientBoosting", "LightGBM"]
    return [n for n in dict.fromkeys(names) if n not in blocked][:top]


@dataclass(frozen=True)
class Spec:
    name: str
    family: str
    params: dict[str, Any] = field(default_factory=dict)
    space: dict[str, tuple] = field(default_factory=dict)
    priority: int = 1
    weight: float = 1.0


_FAMILY = {"RandomForest": "tree_ensemble", "GradientBoosting": "boosted_trees",
           "XGBoost": "boosted_trees", "LightGBM": "boosted_trees", "LogisticRegression": "linear",
           "Ridge": "linear", "SVM": "kernel", "SVR": "kernel"}
_FAMILY_DEFAULT = {"linear": ("LogisticRegression", "Ridge"), "kernel": ("SVM", "SVR"),
                   "tree_ensemble": ("RandomForest",) * 2, "boosted_trees": ("GradientBoosting",) * 2}

# fixed values: search ranges as (kind, low, high) or ("choice", options)
SEARCH_SPACES: dict[str, dict[str, tuple]] = {
    "RandomForest": {
        "n_estimators": ("int", 50, 300), "max_depth": ("int", 3, 20),
        "min_samples_leaf": ("int", 1, 10), "max_features": ("choice", ("sqrt", "log2", "all"))},
    "GradientBoosting": {
        "n_estimators": ("int", 50, 300), "max_depth": ("int", 2, 10),
        "learning_rate": ("log", 0.01, 0.3), "subsample": ("float", 0.5, 1.0)},
    "XGBoost": {
        "n_estimators": ("int", 50, 300), "max_depth": ("int", 2, 12),
        "learning_rate": ("log", 0.01, 0.3), "subsample": ("float", 0.5, 1.0),
        "colsample_bytree": ("float", 0.5, 1.0), "min_child_weight": ("int", 1, 10),
        "gamma": ("float", 0.0, 0.5)},
    "LightGBM": {
        "n_estimators": ("int", 50, 300), "max_depth": ("int", 2, 15),
        "learning_rate": ("log", 0.01, 0.3), "num_leaves": ("int", 10, 100),
        "subsample": ("float", 0.5, 1.0), "colsample_bytree": ("float", 0.5, 1.0),
        "min_child_samples": ("int", 5, 50)},
    "LogisticRegression": {"C": ("log", 0.001, 100.0), "max_iter": ("int", 500, 2000)},
    "Ridge": {"alpha": ("log", 0.001, 100.0)},
}


def default_params(name: str, rows: int) -> dict[str, Any]:
    return {
        "RandomForest": {"n_estimators": min(100, max(10, rows // 100)), "max_depth": 10},
        "GradientBoosting": {"n_estimators": 100, "max_depth": 5, "learning_rate": 0.1},
        "XGBoost": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1},
        "LightGBM": {"n_estimators": 100, "max_depth": 8, "learning_rate": 0.1},
        "LogisticRegression": {"max_iter": 1000, "C": 1.0},
        "Ridge": {"alpha": 1.0}, "SVM": {"C": 1.0, "kernel": "rbf"}, "SVR": {"C": 1.0, "kernel": "rbf"},
    }[name]


def build_specs(names: Sequence[str], task: str, rows: int,
                cfg: TrainConfig = TrainConfig()) -> list[Spec]:
    """One spec per name, in order, with defaults, overrides and search ranges."""
    names = list(names)
    if cfg.force_model_name:
        names = [cfg.force_model_name] + [n for n in names if n != cfg.force_model_name]
    elif cfg.preferred_model_family:
        first = [n for n in names if _FAMILY[n] == cfg.preferred_model_family]
        if not first:
            first = [_FAMILY_DEFAULT[cfg.preferred_model_family][task == "regression"]]
        names = first + [n for n in names if n not in first]
    specs = []
    for i, n in enumerate(names):
        params = _overridden(n, default_params(n, rows), cfg)
        specs.append(Spec(n, _FAMILY[n], params, SEARCH_SPACES.get(n, {}), i + 1,
                          round(1 / len(names), 4)))
    return specs


def _overridden(name: str, params: dict[str, Any], cfg: TrainConfig) -> dict[str, Any]:
    p = dict(params)
    strength = cfg.regularization_strength
    if cfg.reduce_complexity and name == "RandomForest":
        p.update(max_depth=min(p["max_depth"], 6), n_estimators=min(p["n_estimators"], 80))
    if cfg.reduce_complexity and name == "GradientBoosting":
        p.update(max_depth=min(p["max_depth"], 3), n_estimators=min(p["n_estimators"], 80),
                 learning_rate=min(p["learning_rate"], 0.08))
    if strength in ("high", "very_high"):
        high = strength == "high"
        if name == "LogisticRegression":
            p["C"] = 0.5 if high else 0.25
        elif name in ("SVM", "SVR"):
            p["C"] = 0.7 if high else 0.4
        elif name == "Ridge":
            p["alpha"] = 2.0 if high else 4.0
    return p


def scoring_metric(task: str, cfg: TrainConfig = TrainConfig()) -> str:
    if task != "classification":
        return "r2"
    wanted = (cfg.metric_priority or "").strip().lower()
    return wanted if wanted in ("recall", "precision", "f1") else "accuracy"


# --- estimators --------------------------------------------------------------------------

@dataclass(frozen=True)
class FitContext:
    """What converting parameters needs to know about the training rows."""

    task: str
    rows: int
    classes: int = 2
    label_std: float = 1.0
    seed: int = 42
    weight_col: str | None = None


#: Models that class weights reach; boosted models and regressors learn without.
WEIGHTED = ("LogisticRegression", "RandomForest", "SVM")
TREES = ("RandomForest", "GradientBoosting", "XGBoost", "LightGBM")


def tree_params(spec: Spec, task: str, seed: int = 42) -> T.TreeParams:
    """The settings of a tree model; each of the boosted names keeps its own defaults of regularisation."""
    p, name = spec.params, spec.name
    common = {"trees": int(p.get("n_estimators", 100)), "depth": min(int(p.get("max_depth", 5)), 30), "seed": seed}
    if name == "RandomForest":
        columns = p.get("max_features", "sqrt" if task == "classification" else "all")
        return T.TreeParams(False, columns=1.0 if columns == "all" else columns, least_rows=int(p.get("min_samples_leaf", 1)), **common)
    boosted = common | {"rate": float(p.get("learning_rate", 0.1)), "rows": float(p.get("subsample", 1.0)),
                        "columns": float(p.get("colsample_bytree", 1.0)), "l1": float(p.get("reg_alpha", 0.0))}
    if name == "XGBoost":
        return T.TreeParams(True, l2=float(p.get("reg_lambda", 1.0)), least_weight=float(p.get("min_child_weight", 1)),
                            least_gain=float(p.get("gamma", 0.0)), **boosted)
    if name == "LightGBM":
        return T.TreeParams(True, leaves=int(p.get("num_leaves", 31)), least_rows=int(p.get("min_child_samples", 20)),
                            least_weight=1e-3, l2=float(p.get("reg_lambda", 0.0)), **boosted)
    return T.TreeParams(True, least_rows=int(p.get("min_samples_leaf", 1)), **boosted)


def make_estimator(spec: Spec, ctx: FitContext):
    """The learner for a spec: histogram trees, ridge by its normal equations, or a Spark ML estimator. Margin models
    have a Gaussian kernel, or none with kernel="linear"; binary-only learners are wrapped one-vs-rest."""
    p, name = spec.params, spec.name
    cols = {"featuresCol": "features", "labelCol": "label"}
    weight = {"weightCol": ctx.weight_col} if ctx.weight_col and name in WEIGHTED else {}
    if name in TREES:
        return T.TreeLearner(tree_params(spec, ctx.task, ctx.seed), ctx.task)
    if name == "Ridge":
        return RidgeLearner(float(p.get("alpha", 1.0)))
    if name == "LogisticRegression":
        return LogisticRegression(regParam=1 / (float(p.get("C", 1.0)) * max(ctx.rows, 1)),
                                  maxIter=int(p.get("max_iter", 1000)), standardization=False,
                                  **cols, **weight)
    if name in ("SVM", "SVR") and p.get("kernel", "rbf") == "rbf":
        return KernelLearner(ctx.task, float(p.get("C", 1.0)), ctx.classes, int(p.get("n_features", 256)), ctx.seed, p.get("gamma"),
                             weight.get("weightCol"), label_std=ctx.label_std)
    if name in ("SVM", "SVR"):
        return _linear_margin(spec, ctx, cols | weight)
    raise ValueError(f"unknown model {name!r}")


def _linear_margin(spec: Spec, ctx: FitContext, columns: dict[str, str]):
    """Hinge loss for classes, Huber loss (quadratic near the line, linear beyond) for numbers."""
    penalty = 1 / (float(spec.params.get("C", 1.0)) * max(ctx.rows, 1))
    if spec.name == "SVR":
        return LinearRegression(loss="huber", epsilon=1.35, standardization=False, regParam=penalty, **columns)
    svm = LinearSVC(regParam=penalty, maxIter=100, **columns)
    return OneVsRest(classifier=svm, **columns) if ctx.classes > 2 else svm


def class_probabilities(scored: DataFrame) -> Column | None:
    """Array of class probabilities of a scored frame, from margins where a model has no own."""
    if "probability" in scored.columns:
        return vector_to_array("probability")
    if "rawPrediction" in scored.columns:
        raw = vector_to_array("rawPrediction")
        return F.when(F.size(raw) == 2, probabilities_from_margin(raw[1])).otherwise(
            probabilities_from_margins(raw))
    return None


def class_probabilities_of(column: str) -> Column:
    """A probability vector column as an array."""
    return vector_to_array(column)


def add_scores(df: DataFrame, model, prefix: str) -> DataFrame:
    """Adds `<prefix>_pred` and, for classifiers, `<prefix>_prob`; a projection, no shuffle."""
    scored = model.transform(df)
    prob = class_probabilities(scored)
    out = [ref(c) for c in df.columns] + [F.col("prediction").alias(f"{prefix}_pred")]
    if prob is not None:
        out.append(prob.alias(f"{prefix}_prob"))
    return scored.select(*out)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, weight): rows / (classes * class rows)."""
    counts = df.groupBy(ref(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("k")).first()
    return counts.select("label", (F.lit(float(totals["rows"] or 0)) / (
        F.lit(float(max(totals["k"], 1))) * F.col("n"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """Adds each row's class weight, whatever the number of classes."""
    counts = df.groupBy(ref(label).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    weights = class_weights(df, label).select(F.col("label").cast("string").alias("value"),
                                              F.col("weight").alias("stat"))
    return lookup(df, label, settle(counts.join(weights, "value"), "class-weights"),
                  F.lit(None).cast("double"), name)


def fit_context(train: DataFrame, task: str, seed: int = 42,
                weight_col: str | None = None) -> FitContext:
    row = train.agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("top"),
                    F.stddev_pop("label").alias("s")).first()
    classes = int(row["top"] or 0) + 1 if task == "classification" else 0
    return FitContext(task, row["n"], classes, row["s"] or 1.0, seed, weight_col)


# --- cross-validation --------------------------------------------------------------------

@dataclass
class CrossValidation:
    """Out-of-fold predictions of every candidate and their fold scores."""

    oof: DataFrame | None        # row_key, label, fold, <i>_pred, <i>_prob; None if rows were not kept
    scores: DataFrame            # model, tag, fold, score
    names: list[str]
    failed: dict[str, str]


def fit_all(jobs: Sequence, parallelism: int) -> list:
    """Runs independent fits from a few threads; Spark interleaves their stages."""
    if parallelism <= 1 or len(jobs) <= 1:
        return [j() for j in jobs]
    with ThreadPool(parallelism) as pool:
        return pool.map(lambda j: j(), jobs)


def _fold_contexts(data: DataFrame, ctx: FitContext, folds: int) -> list[FitContext]:
    """The context of the training rows of each fold, from one aggregate by fold."""
    mean = data.agg(F.avg("label")).first()[0] or 0.0
    d = F.col("label") - F.lit(mean)
    per = {r["fold"]: r for r in data.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("q")).collect()}
    out = []
    for k in range(folds):
        rest = [r for f, r in per.items() if f != k]
        n = sum(r["n"] for r in rest)
        s, q = (sum(r[x] or 0.0 for r in rest) for x in ("s", "q"))
        spread = math.sqrt(max(q / n - (s / n) ** 2, 0.0)) if n else 0.0
        out.append(replace(ctx, rows=max(n, 1), label_std=spread or 1.0))
    return out


def cross_validate(data: DataFrame, row_key: str, specs: Sequence[Spec], task: str, folds: int,
                   cfg: TrainConfig = TrainConfig(), metric: str | None = None,
                   prefixes: Sequence[str] | None = None, keep_rows: bool = True,
                   binned: T.Binned | None = None) -> CrossValidation:
    """`data` holds row_key, label, features and fold; `binned` its rows from trees.bin_rows, if they are there already.

    All tree fits of all folds share their passes, and all ridge fits one Gram matrix per fold. Without `keep_rows` no
    out-of-fold rows are written: each fold's held-out rows are summed up where they are scored, and only the fold
    scores stay. A candidate whose learner fails is left out and named in `failed`; other faults are raised.
    """
    metric = metric or scoring_metric(task, cfg)
    tags = list(prefixes or [f"m{i}" for i in range(len(specs))])
    failed: dict[str, str] = {}
    trees, ridges, others = _by_learner(specs, tags, task, cfg, failed)
    parts: list[DataFrame] = []
    fitted: dict[tuple[int, int], Any] = {}
    if trees:
        binned = binned or T.bin_rows(data, row_key, task)
        fits = [T.Fit(tags[i], tree_params(specs[i], task, cfg.seed), k) for i in trees for k in range(folds)]
        if keep_rows:
            fitted |= dict(zip([(i, k) for i in trees for k in range(folds)], T.fit_models(binned, fits)))
        else:
            parts.append(_held_scores(T.held_out(binned, fits), {tags[i]: specs[i].name for i in trees}, task, metric))
    if ridges:
        grams = fold_grams(data)
        if keep_rows:
            fitted |= {(i, k): solve_without(grams, k, [float(specs[i].params.get("alpha", 1.0))])[0]
                       for i in ridges for k in range(folds)}
        else:
            found = held_scores(grams, folds, {tags[i]: float(specs[i].params.get("alpha", 1.0)) for i in ridges})
            names = {tags[i]: specs[i].name for i in ridges}
            parts.append(data.sparkSession.createDataFrame(
                [(names[t], t, k, s) for t, k, s in found], "model string, tag string, fold int, score double"))
    if others:
        ctx = fit_context(data, task, cfg.seed, "weight" if "weight" in data.columns else None)
        contexts = _fold_contexts(data, ctx, folds)

        def job(i: int, k: int):
            def run():
                try:
                    return make_estimator(specs[i], contexts[k]).fit(data.where(F.col("fold") != k))
                except (IllegalArgumentException, Py4JJavaError) as e:
                    # the learner refused these rows: reported, and left out of the comparison
                    failed[tags[i]] = f"{type(e).__name__}: {e}"
                    return None
            return run

        todo = [(i, k) for k in range(folds) for i in others]
        fitted |= dict(zip(todo, fit_all([job(i, k) for i, k in todo], cfg.parallelism)))
    good = [i for i in range(len(specs)) if tags[i] not in failed]
    if not good:
        raise RuntimeError(f"every candidate failed: {failed}")
    scored = sorted({i for i, _ in fitted} & set(good))
    oof = None
    if scored:
        held_out = []
        for k in range(folds):
            held = data.where(F.col("fold") == k).select(ref(row_key), "label", "fold", "features")
            for i in scored:
                held = add_scores(held, fitted[i, k], tags[i])
            held_out.append(held.drop("features"))
        oof = reduce(DataFrame.unionByName, held_out)
        if keep_rows:
            oof = settle(oof, "oof")
        parts.append(candidate_scores(oof, {tags[i]: specs[i].name for i in scored}, task, metric))
    scores = settle(reduce(DataFrame.unionByName, parts), "fold-scores")
    return CrossValidation(oof if keep_rows else None, scores, [specs[i].name for i in good], failed)


def _by_learner(specs: Sequence[Spec], tags: Sequence[str], task: str, cfg: TrainConfig,
                failed: dict[str, str]) -> tuple[list[int], list[int], list[int]]:
    """Places of the specs that share tree passes, that share Gram matrices, and of the rest; trees that cannot grow are
    entered in `failed`."""
    trees, ridges, others = [], [], []
    for i, s in enumerate(specs):
        if s.name in TREES:
            try:
                tree_params(s, task, cfg.seed).check()
                trees.append(i)
            except ValueError as e:
                failed[tags[i]] = f"ValueError: {e}"
        else:
            (ridges if s.name == "Ridge" else others).append(i)
    return trees, ridges, others


def _held_scores(outcome: DataFrame, names: Mapping[str, str], task: str, metric: str) -> DataFrame:
    """(model, tag, fold, score) from the summed outcomes of held-out rows."""
    if task == "classification":
        text = outcome.withColumns({c: F.col(c).cast("string") for c in ("label", "prediction")})
        scores = weighted_scores(text, ["tag", "fold"]).select("tag", "fold", F.col(metric).alias("score"))
    else:
        r2 = F.when(F.col("spread") > 0, 1 - F.try_divide(F.col("mse"), F.col("spread"))).otherwise(
            F.when(F.col("mse") == 0, 1.0).otherwise(0.0))
        scores = outcome.select("tag", "fold", r2.alias("score"))
    model = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("tag"))
    return scores.select(model.alias("model"), "tag", F.col("fold").cast("int").alias("fold"), "score")


def _group_scores(rows: DataFrame, groups: Sequence[str], task: str, metric: str) -> DataFrame:
    out = weighted_scores(confusion_counts(rows, groups), groups) if task == "classification" else \
        regression_metrics(rows, groups)
    return out.select(*groups, F.col(metric).alias("score"))


def candidate_scores(oof: DataFrame, names: Mapping[str, str], task: str, metric: str) -> DataFrame:
    """(model, tag, fold, score) of all candidates from one scan; `names` maps tag to model.

    A row becomes one (tag, prediction) pair per candidate, summed up before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(t).alias("tag"),
                               ref(f"{t}_pred").alias("prediction")) for t, n in names.items()])
    rows = oof.select("fold", "label", F.explode(pairs).alias("c")).select("fold", "label", "c.*")
    return _group_scores(rows, ["model", "tag", "fold"], task, metric)


def fold_scores(oof: DataFrame, prediction: str, task: str, metric: str) -> DataFrame:
    """(fold, score) of one prediction column."""
    rows = oof.select("fold", "label", ref(prediction).alias("prediction"))
    return _group_scores(rows, ["fold"], task, metric)


def leaderboard(scores: DataFrame, by: str = "model") -> DataFrame:
    """(model, cv_mean, cv_std, folds, position): best mean first, steadier on ties."""
    board = scores.groupBy(ref(by)).agg(
        F.avg("score").alias("cv_mean"), F.stddev_pop("score").alias("cv_std"),
        F.count(F.lit(1)).alias("folds"))
    # one row per candidate, so a single ordered window is tiny
    w = W.partitionBy(F.lit(1)).orderBy(F.desc("cv_mean"), F.asc("cv_std"), ref(by))
    return board.withColumn("position", F.row_number().over(w))


def with_failures(board: DataFrame, failed: Mapping[str, str], by: str = "tag") -> DataFrame:
    """The leaderboard with a row, without scores, for each candidate that failed, and its error."""
    lost = board.sparkSession.createDataFrame(list(failed.items()), f"{by} string, error string")
    return board.withColumn("error", F.lit(None).cast("string")).unionByName(
        lost, allowMissingColumns=True)


def pick_best(board: DataFrame, criterion: str = "score") -> DataFrame:
    """One row of the leaderboard by score, stability among the better half, or a balance."""
    if criterion == "stable":
        half = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(W.partitionBy(F.lit(1))) / 2))
        top = board.withColumn("_half", half).where(F.col("position") <= F.col("_half")).drop("_half")
        return top.orderBy("cv_std", "position").limit(1)
    if criterion == "balanced":
        return board.orderBy(F.desc(F.col("cv_mean") - 0.5 * F.col("cv_std")), "position").limit(1)
    return board.orderBy("position").limit(1)


# --- search ------------------------------------------------------------------------------

def sample_params(space: Mapping[str, tuple], rng: random.Random) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for name in sorted(space):
        kind, *rest = space[name]
        if kind == "int":
            out[name] = rng.randint(*rest)
        elif kind == "float":
            out[name] = rng.uniform(*rest)
        elif kind == "log":
            out[name] = math.exp(rng.uniform(math.log(rest[0]), math.log(rest[1])))
        else:
            out[name] = rng.choice(list(rest[0]))
    return out


def random_search(data: DataFrame, row_key: str, spec: Spec, task: str, folds: int,
                  cfg: TrainConfig = TrainConfig(), binned: T.Binned | None = None) -> tuple[Spec, DataFrame]:
    """Best of the seeded random trials (all in one cross-validation, no rows written) and the trial table
    with each trial's parameters as JSON."""
    rng = random.Random(cfg.seed)
    trials = []
    for _ in range(cfg.n_trials):
        trials.append(replace(spec, params={**spec.params, **sample_params(spec.space, rng)}))
    tags = [f"t{i}" for i in range(len(trials))]
    cv = cross_validate(data, row_key, trials, task, folds, cfg, prefixes=tags, keep_rows=False, binned=binned)
    params = data.sparkSession.createDataFrame(
        [(t, json.dumps(s.params, sort_keys=True)) for t, s in zip(tags, trials)], "trial string, params string")
    # one row per trial on both sides
    board = settle(leaderboard(cv.scores, by="tag").withColumnRenamed("tag", "trial")
                   .join(F.broadcast(params), "trial"), "trials")
    best = board.orderBy("position").first()["trial"]
    return trials[tags.index(best)], board


def _scaled(kind: tuple, value: float) -> float:
    """A numeric setting's place between its ends, on the scale that it is drawn on."""
    low, high = kind[1], kind[2]
    if kind[0] == "log":
        low, high, value = math.log(low), math.log(high), math.log(value)
    return (value - low) / (high - low) if high > low else 0.5


def _unscaled(kind: tuple, place: float) -> Any:
    low, high = kind[1], kind[2]
    if kind[0] == "log":
        return math.exp(math.log(low) + place * (math.log(high) - math.log(low)))
    value = low + place * (high - low)
    return min(max(round(value), low), high) if kind[0] == "int" else value


def _log_density(kind: tuple, seen: Sequence[Any], value: Any) -> float:
    """Log density of a value under bumps at the seen ones, with one flat part, so that nothing is impossible."""
    if kind[0] == "choice":
        options = list(kind[1])
        return math.log((1 + sum(v == value for v in seen)) / (len(options) + len(seen)))
    x, at = _scaled(kind, value), [_scaled(kind, v) for v in seen]
    width = max(0.05, 0.5 / (1 + len(at)))
    bumps = [math.exp(-0.5 * ((x - a) / width) ** 2) / (width * math.sqrt(2 * math.pi)) for a in at]
    return math.log((1 + sum(bumps)) / (1 + len(at)))


def propose_params(space: Mapping[str, tuple], done: Sequence[tuple[Mapping[str, Any], float]], rng: random.Random,
                   drawn: int = 24, good_share: float = 0.25) -> dict[str, Any]:
    """Settings for the next trial: of some drawn near the better trials, those that are the likelier among the better
    the less likely among the rest. `done` holds settings and scores; failed or running trials count as -inf."""
    ranked = sorted(done, key=lambda t: -t[1])
    good = [t[0] for t in ranked[:max(1, math.ceil(good_share * len(ranked)))] if t[1] > -math.inf]
    bad = [t[0] for t in ranked[len(good):]]
    if not good:
        return sample_params(space, rng)

    def draw() -> dict[str, Any]:
        flat = sample_params(space, rng)
        out: dict[str, Any] = {}
        for name in sorted(space):
            kind, near = space[name], rng.randrange(len(good) + 1)
            if near == len(good):
                out[name] = flat[name]
            elif kind[0] == "choice":
                out[name] = good[near][name]
            else:
                width = max(0.05, 0.5 / (1 + len(good)))
                out[name] = _unscaled(kind, min(max(rng.gauss(_scaled(kind, good[near][name]), width), 0.0), 1.0))
        return out

    def gain(params: Mapping[str, Any]) -> float:
        return sum(_log_density(space[n], [g[n] for g in good], params[n]) - _log_density(space[n], [b[n] for b in bad], params[n])
                   for n in space)

    return max((draw() for _ in range(drawn)), key=gain)


def search_loop(space: Mapping[str, tuple], trials: int, rng: random.Random, evaluate, first: int = 5,
                generation: int = 5) -> list[tuple[dict[str, Any], float]]:
    """Settings and scores of all trials. The first ones are random; after them each generation is proposed from all
    scores so far. `evaluate` scores a list of settings at once; a trial that failed is -inf."""
    done: list[tuple[dict[str, Any], float]] = []
    while len(done) < trials:
        n = min(trials - len(done), generation if done else first)
        batch: list[dict[str, Any]] = []
        for _ in range(n):
            # proposals of one generation keep away from each other
            running = [(p, -math.inf) for p in batch]
            batch.append(propose_params(space, [*done, *running], rng) if done else sample_params(space, rng))
        done += list(zip(batch, evaluate(batch)))
    return done


def model_search(data: DataFrame, row_key: str, spec: Spec, task: str, folds: int, cfg: TrainConfig = TrainConfig(),
                 binned: T.Binned | None = None) -> tuple[Spec, DataFrame]:
    """Like random_search, but trials come in generations that are proposed from the scores before them. A trial whose
    learner fails takes part as the worst, and is left out of the trial table."""
    scores, specs = [], {}

    def evaluate(batch: list[dict[str, Any]]) -> list[float]:
        own = {f"t{len(specs) + i}": replace(spec, params={**spec.params, **p}) for i, p in enumerate(batch)}
        specs.update(own)
        try:
            cv = cross_validate(data, row_key, list(own.values()), task, folds, cfg, prefixes=list(own), keep_rows=False, binned=binned)
        except RuntimeError:  # every trial of the generation failed
            return [-math.inf] * len(batch)
        scores.append(cv.scores)
        means = {r["tag"]: r["m"] for r in cv.scores.groupBy("tag").agg(F.avg("score").alias("m")).collect()}
        return [means[t] if means.get(t) is not None else -math.inf for t in own]

    found = search_loop(spec.space, cfg.n_trials, random.Random(cfg.seed), evaluate)
    if not scores:
        raise RuntimeError(f"every trial of {spec.name} failed")
    params = data.sparkSession.createDataFrame(
        [(t, json.dumps(s.params, sort_keys=True)) for t, s in specs.items()], "trial string, params string")
    # one row per trial on both sides
    board = settle(leaderboard(reduce(DataFrame.unionByName, scores), by="tag").withColumnRenamed("tag", "trial")
                   .join(F.broadcast(params), "trial"), "trials")
    best = max(range(len(found)), key=lambda i: (found[i][1], -i))
    return specs[f"t{best}"], board


SEARCHES = {"random": random_search, "model": model_search}


# --- single model ------------------------------------------------------------------------

@dataclass
class SingleFit:
    model: Any
    train_score: float
    test_score: float
    seconds: float


def score_model(model, df: DataFrame, task: str) -> float:
    """Accuracy or r2 of a fitted model on a frame."""
    scored = model.transform(df).select("label", "prediction")
    if task == "classification":
        return scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    return regression_metrics(scored).first()["r2"]


def _fitted(spec: Spec, ctx: FitContext, train: DataFrame, binned: T.Binned | None):
    learner = make_estimator(spec, ctx)
    return learner.fit_binned(binned) if binned and isinstance(learner, T.TreeLearner) else learner.fit(train)


def fit_single(train: DataFrame, test: DataFrame, spec: Spec, task: str,
               cfg: TrainConfig = TrainConfig(), binned: T.Binned | None = None) -> SingleFit:
    """`binned`: the rows of `train` from trees.bin_rows, if they are there already."""
    ctx = fit_context(train, task, cfg.seed, "weight" if "weight" in train.columns else None)
    start = time.perf_counter()
    model = _fitted(spec, ctx, train, binned)
    seconds = time.perf_counter() - start
    return SingleFit(model, score_model(model, train, task), score_model(model, test, task), seconds)


def has_rounds(model) -> bool:
    """Whether a fitted model was boosted in rounds, so that it has a training curve."""
    return isinstance(model, T.TreeModel) and model.rounds > 0


def training_curve(model: T.TreeModel, train: DataFrame, test: DataFrame, task: str) -> DataFrame:
    """(round, split, loss) of a boosted model: mean squared error, or mean log loss over all classes. One pass per split
    evaluates every round."""
    rows = [(i + 1, name, float(x)) for name, df in (("train", train), ("test", test))
            for i, x in enumerate(model.losses(df))]
    return train.sparkSession.createDataFrame(rows, "round int, split string, loss double")


def best_round(curve: DataFrame) -> DataFrame:
    """The earliest round with the lowest test loss, and all losses scaled to [0, 1] per split."""
    return curve.where("split = 'test'").agg(
        F.min(F.struct("loss", "round")).alias("b")).select(
        F.col("b.round").alias("best_round"), F.col("b.loss").alias("loss"))


def normalized_losses(curve: DataFrame, split: str = "split", loss: str = "loss") -> DataFrame:
    """Losses scaled by the ends of their split; a flat curve becomes 0.5."""
    ends = curve.groupBy(ref(split)).agg(F.min(loss).alias("_lo"), F.max(loss).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return curve.join(F.broadcast(ends), split).withColumn(
        "scaled", F.when(span == 0, F.lit(0.5)).otherwise(
            F.try_divide(F.col(loss) - F.col("_lo"), span))).drop("_lo", "_hi")


# --- ensembles ---------------------------------------------------------------------------

def diversity(df: DataFrame, predictions: Sequence[str]) -> DataFrame:
    """Mean share of rows on which two members disagree, over all pairs; one aggregate."""
    pairs = [(a, b) for i, a in enumerate(predictions) for b in predictions[i + 1:]]
    if not pairs:
        return df.sparkSession.createDataFrame([(0.0,)], "diversity double")
    aggs = [F.avg((ref(a) != ref(b)).cast("double")).alias(f"d{i}") for i, (a, b) in enumerate(pairs)]
    mean = sum((F.col(f"d{i}") for i in range(len(pairs))), F.lit(0.0)) / len(pairs)
    return df.agg(*aggs).select(mean.alias("diversity"))


def ensemble_worthwhile(board: DataFrame, gap: float = 0.01, std: float = 0.05) -> DataFrame:
    """True when the two best are close or the best is unsteady."""
    best = board.groupBy().pivot("position", [1, 2]).agg(
        F.first("cv_mean").alias("mean"), F.first("cv_std").alias("std"))
    two = F.col("2_mean").isNotNull()
    worth = two & ((F.col("1_mean") - F.col("2_mean") < gap) | (F.col("1_std") > std))
    return best.select((F.col("1_mean") - F.col("2_mean")).alias("gap"),
                       F.col("1_std").alias("best_std"),
                       F.coalesce(worth, F.lit(False)).alias("use_ensemble"))


def hard_vote(predictions: Sequence[Column]) -> Column:
    """Most frequent member prediction, the smallest on ties."""
    votes = F.array(*predictions)
    tallies = F.transform(F.array_distinct(votes), lambda x: F.struct(
        (-F.size(F.filter(votes, lambda y: y == x))).alias("n"), x.alias("v")))
    return F.array_min(tallies)["v"]


def mean_probabilities(probabilities: Sequence[Column]) -> Column:
    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), probabilities)
    return F.transform(total, lambda x: x / len(probabilities))


def soft_vote(probabilities: Sequence[Column]) -> Column:
    """Class index with the highest mean probability, the first on ties."""
    mean = mean_probabilities(probabilities)
    return (F.array_position(mean, F.array_max(mean)) - 1).cast("double")


def average_vote(predictions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, predictions) / len(predictions)


def meta_features(df: DataFrame, tags: Sequence[str], task: str, classes: int) -> DataFrame:
    """Member outputs as the feature vector of the meta-learner."""
    if task == "classification":
        first = 1 if classes == 2 else 0
        cols = [ref(f"{t}_prob")[i] for t in tags for i in range(first, classes)]
    else:
        cols = [ref(f"{t}_pred") for t in tags]
    return df.withColumn("features", array_to_vector(F.array(*[c.cast("double") for c in cols])))


@dataclass
class Ensemble:
    """Members fitted on the whole train split, and how their outputs combine."""

    kind: str
    task: str
    classes: int
    members: list[tuple[str, Any]]
    meta: Any = None

    def transform(self, df: DataFrame) -> DataFrame:
        out, tags = df, [f"e{i}" for i in range(len(self.members))]
        for t, (_, model) in zip(tags, self.members):
            out = add_scores(out, model, t)
        if self.kind == "stacking":
            inputs = meta_features(out.withColumnRenamed("features", "_features"), tags, self.task,
                                   self.classes)
            out = self.meta.transform(inputs).drop("features").withColumnRenamed(
                "_features", "features")
        elif self.task == "classification":
            probs = [ref(f"{t}_prob") for t in tags]
            out = out.withColumn("prediction", soft_vote(probs)).withColumn(
                "probability", array_to_vector(mean_probabilities(probs)))
        else:
            out = out.withColumn("prediction", average_vote([ref(f"{t}_pred") for t in tags]))
        return out.drop(*[f"{t}_{s}" for t in tags for s in ("pred", "prob")])


def _meta_spec(task: str) -> Spec:
    name = "LogisticRegression" if task == "classification" else "Ridge"
    return Spec(name, "linear", default_params(name, 0))


def fit_meta(oof: DataFrame, tags: Sequence[str], task: str, classes: int, seed: int = 42):
    """The meta-learner, trained on out-of-fold member outputs."""
    inputs = meta_features(oof, tags, task, classes)
    return make_estimator(_meta_spec(task), replace(fit_context(inputs, task, seed),
                                                    classes=classes)).fit(inputs)


def build_ensemble(train: DataFrame, cv: CrossValidation, specs: Sequence[Spec], tags: Sequence[str],
                   task: str, cfg: TrainConfig = TrainConfig(), binned: T.Binned | None = None) -> Ensemble:
    """Fits the given members on the whole train split; stacking reuses the out-of-fold table. `binned` as in fit_single."""
    ctx = fit_context(train, task, cfg.seed, "weight" if "weight" in train.columns else None)
    models = fit_all([lambda s=s: _fitted(s, ctx, train, binned) for s in specs], cfg.parallelism)
    meta = fit_meta(cv.oof, tags, task, ctx.classes, cfg.seed) if cfg.ensemble_type == "stacking" \
        else None
    return Ensemble(cfg.ensemble_type, task, ctx.classes, [(s.name, m) for s, m in zip(specs, models)],
                    meta)


def ensemble_fold_scores(cv: CrossValidation, tags: Sequence[str], task: str, classes: int, folds: int,
                         metric: str, cfg: TrainConfig = TrainConfig()) -> DataFrame:
    """(fold, score) of the combined out-of-fold outputs.

    Stacking fits the meta-learner without the fold it scores, so no row is scored by a learner
    that saw its label.
    """
    if cfg.ensemble_type != "stacking":
        combined = soft_vote([ref(f"{t}_prob") for t in tags]) if task == "classification" else \
            average_vote([ref(f"{t}_pred") for t in tags])
        return fold_scores(cv.oof.withColumn("_vote", combined), "_vote", task, metric)
    inputs = meta_features(cv.oof, tags, task, classes)
    ctx = replace(fit_context(inputs, task, cfg.seed), classes=classes)

    def job(k):
        return lambda: make_estimator(_meta_spec(task), ctx).fit(inputs.where(F.col("fold") != k))

    metas = fit_all([job(k) for k in range(folds)], cfg.parallelism)
    scored = reduce(DataFrame.unionByName, [
        m.transform(inputs.where(F.col("fold") == k)).select("fold", "label", "prediction")
        for k, m in enumerate(metas)])
    return fold_scores(scored, "prediction", task, metric)
