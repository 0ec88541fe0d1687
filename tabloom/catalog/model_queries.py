"""Queries for models, comparison, ensembles, explanation, scoring and run history."""

from __future__ import annotations

import random
from dataclasses import replace
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import AutoMLConfig, FeatureConfig, TrainConfig
from ..functions.columns import ref, round_doubles, rounded
from ..functions.scratch import scratch_path, settle
from ..operators import encode as E, features as X, history as H, kernel as K, models as M, profile as P
from ..operators import score as S, split as G
from ..operators.explain import importance_table as importance_rows, model_importance
from ..plans.automl import run_automl
from ..sources.tables import append_run_metadata
from ..streaming.scoring import route_files, score_files
from .registry import query
from .views import ord_, ord_dirty, ord_lab, sql, table, union

KEY = "o_orderkey"
_FEATURES = ["o_totalprice", "c_acctbal", "c_nationkey", "priority"]
_DEFAULTS = TrainConfig(parallelism=4)  # folds, trials and model settings as a run has them


def _data(spark, sf, target="label", features=_FEATURES) -> DataFrame:
    """row_key, label, features, split: the planted label over four features, split exactly."""
    d = ord_lab(spark, sf).withColumn("priority", F.substring("o_orderpriority", 1, 1).cast("int"))
    d = d.withColumn("x", F.col("c_acctbal") / 1000)
    d = G.train_test_split(d.withColumn("label", ref(target).cast("double")), KEY,
                           "label" if target == "label" else None)
    d = X.assemble(d, features, keep=[KEY, "label", "split"]).withColumnRenamed(KEY, "row_key")
    return settle(d, "vectors")


def _folded(spark, sf, target="label", features=_FEATURES):
    train = _data(spark, sf, target, features).where("split = 'train'").drop("split")
    return settle(G.assign_folds(train, "row_key", _DEFAULTS.cv_folds,
                                 "label" if target == "label" else None), "folds")


def _specs(names, data, task="classification"):
    return M.build_specs(names, task, data.count(), _DEFAULTS)


# --- candidates --------------------------------------------------------------------------

_BIG = {"classification": ["RandomForest", "GradientBoosting", "XGBoost"],
        "regression": ["RandomForest", "GradientBoosting", "XGBoost"]}
_SMALL = {"classification": ["LogisticRegression", "SVM", "RandomForest"],
          "regression": ["Ridge", "SVR", "RandomForest"]}
_SCOPES = {"orders": ("o_orderstatus", "o_totalprice"), "customer": ("c_mktsegment", "c_acctbal"),
           "supplier": ("s_nationkey", "s_acctbal")}


def _candidate_sql(scope, task):
    small = union([f"SELECT {i + 1} AS position, '{m}' AS model, TRUE AS small"
                   for i, m in enumerate(_SMALL[task])])
    big = union([f"SELECT {i + 1}, '{m}', FALSE" for i, m in enumerate(_BIG[task])])
    return (f"SELECT '{scope}' AS scope, '{task}' AS task, position, model FROM ({small} UNION ALL "
            f"{big}) WHERE small = (SELECT count(*) < 1000 FROM {scope})")


@query("candidates", union([_candidate_sql(s, t) for s in _SCOPES
                            for t in ("classification", "regression")]))
def candidates(spark, sf):
    rows = []
    for scope, (cls, reg) in _SCOPES.items():
        d = table(spark, sf, scope)
        n, balance = d.count(), P.class_balance(d, cls).first()[0]
        for task in ("classification", "regression"):
            signals = M.TableSignals(n, len(d.columns) - 1,
                                     balance if task == "classification" else 1.0)
            rows += [(scope, task, i + 1, m)
                     for i, m in enumerate(M.choose_candidates(task, signals))]
    return spark.createDataFrame(rows, "scope string, task string, position int, model string")


# each nation is a table whose signals are counts of its orders, so that every rule fires for some of them
_SIGNALS = ("sig", "SELECT c_nationkey AS scope, count(*) * (1 + c_nationkey % 30) AS n, CASE WHEN c_nationkey % 4 = 0 THEN count(*) * 20 "
                   "ELSE 5 END AS features, min(m) / max(m) AS balance, count(*) % 5 AS gaps, count(*) % 7 AS pairs, count(*) % 3 AS "
                   "outliers FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, o_orderstatus) AS m FROM ord) AS o GROUP BY c_nationkey")
_BOTH = "XGBoost', 'LightGBM"
_RULES = ("rules", f"""
SELECT scope, task, CASE
    WHEN n < 1000 THEN (CASE task WHEN 'classification' THEN ['LogisticRegression', 'SVM'] ELSE ['Ridge', 'SVR'] END) || ['RandomForest']
    WHEN task = 'regression' AND n < 10000 THEN ['RandomForest', 'GradientBoosting', 'XGBoost', 'Ridge']
    ELSE ['RandomForest', 'GradientBoosting', '{_BOTH}'] END
  || CASE WHEN task = 'classification' AND balance < 0.1 THEN ['{_BOTH}', 'RandomForest'] ELSE [] END
  || CASE WHEN features > n * 0.5 THEN [CASE task WHEN 'classification' THEN 'LogisticRegression' ELSE 'Ridge' END] ELSE [] END
  || CASE WHEN pairs > 3 THEN CASE task WHEN 'classification' THEN ['RandomForest', 'GradientBoosting', 'LightGBM'] ELSE ['Ridge', 'LightGBM'] END ELSE [] END
  || CASE WHEN task = 'classification' AND gaps > 2 THEN ['RandomForest', 'GradientBoosting', 'LightGBM'] ELSE [] END
  || CASE WHEN outliers > 0 THEN CASE task WHEN 'classification' THEN ['RandomForest', 'GradientBoosting']
     ELSE ['RandomForest', 'GradientBoosting', 'LightGBM'] END ELSE [] END AS names,
  CASE WHEN outliers > 0 OR task = 'classification' AND features > n * 0.5
       THEN CASE task WHEN 'classification' THEN 'SVM' ELSE 'SVR' END ELSE '' END AS blocked
FROM sig, (VALUES ('classification'), ('regression')) AS t(task)""")


@query("candidate_rules", sql("ord", (
    "SELECT scope, task, CAST(row_number() OVER (PARTITION BY scope, task ORDER BY min(i)) AS INT) AS position, model FROM (SELECT scope, "
    "task, blocked, unnest(names) AS model, unnest(range(len(names))) AS i FROM rules) WHERE model <> blocked GROUP BY scope, task, model"),
    _SIGNALS, _RULES))
def candidate_rules(spark, sf):
    """The full list of candidates for each nation's signals, whatever rule they come from."""
    ord_(spark, sf).createOrReplaceTempView("ord")
    rows = []
    for r in spark.sql(_SIGNALS[1]).collect():  # one row per nation
        for task in ("classification", "regression"):
            signals = M.TableSignals(r["n"], r["features"], float(r["balance"]) if task == "classification" else 1.0, r["gaps"], r["pairs"],
                                     r["outliers"])
            rows += [(r["scope"], task, i + 1, m) for i, m in enumerate(M.choose_candidates(task, signals, top=9))]
    return spark.createDataFrame(rows, "scope long, task string, position int, model string")


_SPEC_NAMES = ("RandomForest", "GradientBoosting", "LogisticRegression", "Ridge")


@query("model_specs", union([
    f"SELECT '{s}' AS scope, '{m}' AS model, '{M._FAMILY[m]}' AS family, {i + 1} AS priority, 0.25 AS weight, "
    + {"RandomForest": f"concat('max_depth=10,n_estimators=', CAST(least(100, greatest(10, (SELECT count(*) FROM {s}) // 100)) AS VARCHAR))",
       "GradientBoosting": "'learning_rate=0.1,max_depth=5,n_estimators=100'", "LogisticRegression": "'C=1.0,max_iter=1000'",
       "Ridge": "'alpha=1.0'"}[m] + " AS params" for s in _SCOPES for i, m in enumerate(_SPEC_NAMES)]))
def model_specs(spark, sf):
    """The settings that each model starts with, which follow the number of rows."""
    rows = []
    for scope in _SCOPES:
        for s in M.build_specs(_SPEC_NAMES, "classification", table(spark, sf, scope).count()):
            params = ",".join(f"{k}={v}" for k, v in sorted(s.params.items()))
            rows.append((scope, s.name, s.family, s.priority, s.weight, params))
    return spark.createDataFrame(rows, "scope string, model string, family string, priority int, weight double, params string")


# --- fits --------------------------------------------------------------------------------

def _urgent(spark, sf, label):
    """Key, one feature that is 0 or 1, and a label."""
    d = ord_lab(spark, sf).withColumn("urgent", (F.col("o_orderpriority") == "1-URGENT").cast("double"))
    return X.assemble(d.withColumn("label", F.expr(label).cast("double")), ["urgent"], keep=[KEY, "label", "urgent"])


def _first_round(spark, sf, name, task, label, **params):
    rows = _urgent(spark, sf, label)
    spec = M.Spec(name, "boosted_trees", {"n_estimators": 1, "max_depth": 1, "learning_rate": 1.0, **params})
    return M.make_estimator(spec, M.fit_context(rows, task)).fit(rows).transform(rows)


@query("boost_step", sql("ord_lab", "SELECT CAST(o_orderpriority = '1-URGENT' AS DOUBLE) AS urgent, round(avg(y), 2) AS prediction, "
                                    "count(*) AS n FROM ord_lab GROUP BY ALL"))
def boost_step(spark, sf):
    """One boosted tree with one split and rate 1: the mean of either side."""
    scored = _first_round(spark, sf, "GradientBoosting", "regression", "y")
    return scored.groupBy("urgent").agg(F.round(F.avg("prediction"), 2).alias("prediction"), F.count(F.lit(1)).alias("n"))


@query("boost_logistic_step", sql("ord_lab", (
    "SELECT urgent, round(1 / (1 + exp(-(ln(p / (1 - p)) + 0.5 * sum(label - p) / (count(*) * p * (1 - p) + 1)))), 4) AS probability "
    "FROM (SELECT CAST(o_orderpriority = '1-URGENT' AS DOUBLE) AS urgent, label, avg(label) OVER () AS p FROM ord_lab) GROUP BY urgent, p")))
def boost_logistic_step(spark, sf):
    """One round of regularised logistic boosting: start from the log odds, add rate * G / (H + 1)."""
    scored = _first_round(spark, sf, "XGBoost", "classification", "label", learning_rate=0.5)
    return scored.select("urgent", M.class_probabilities_of("probability")[1].alias("p")).groupBy("urgent").agg(
        F.round(F.avg("p"), 4).alias("probability"))


@query("forest_step", sql("ord_lab", "SELECT CAST(o_orderpriority = '1-URGENT' AS DOUBLE) AS urgent, CAST(o_orderpriority = '1-URGENT' AS "
                                     "DOUBLE) AS prediction, count(*) AS n, CAST(1.0 AS DOUBLE) AS importance FROM ord_lab GROUP BY ALL"))
def forest_step(spark, sf):
    """A forest on the one feature that is the label: every tree finds it, whatever rows it draws."""
    rows = _urgent(spark, sf, "CAST(o_orderpriority = '1-URGENT' AS INT)")
    model = M.make_estimator(_specs(["RandomForest"], rows)[0], M.fit_context(rows, "classification")).fit(rows)
    weight = model_importance(model, ["urgent"])["urgent"]
    return model.transform(rows).groupBy("urgent", "prediction").agg(F.count(F.lit(1)).alias("n")).withColumn("importance", F.lit(round(weight, 9)))

def _fit_report(spark, sf, name, task="classification", target="label"):
    data = _data(spark, sf, target)
    spec = _specs([name], data, task)[0]
    fit = M.fit_single(data.where("split = 'train'"), data.where("split = 'test'"), spec, task, _DEFAULTS)
    weights = model_importance(fit.model, _FEATURES)
    return spark.createDataFrame(
        [(name, f, w, fit.train_score, fit.test_score) for f, w in weights.items()],
        "model string, feature string, importance double, train_score double, test_score double")


@query("rf_fit")
def rf_fit(spark, sf):
    return _fit_report(spark, sf, "RandomForest")


@query("gbt_fit")
def gbt_fit(spark, sf):
    return _fit_report(spark, sf, "GradientBoosting", "regression", "y")


@query("logreg_fit")
def logreg_fit(spark, sf):
    return _fit_report(spark, sf, "LogisticRegression")


@query("svm_fit")
def svm_fit(spark, sf):
    return _fit_report(spark, sf, "SVM")


_COSINES = 4
#: frequencies and phases of the map as SQL: a number in (0, 1) from the first 48 bits of md5
_U = "((('0x' || substr(md5({0}), 1, 12))::BIGINT + 0.5) / 281474976710656.0)"


def _fourier_sql():
    def u(kind, *place):
        return _U.format("'" + ":".join(str(p) for p in (7, kind, *place)) + "'")

    columns = ("c_acctbal", "o_totalprice")
    parts = []
    for j in range(_COSINES):
        inner = " + ".join(f"sqrt(-2 * ln({u('r', i, j)})) * cos(2 * pi() * {u('a', i, j)}) * ({c} - m{i}) / s{i}"
                           for i, c in enumerate(columns))
        parts.append(f"round(sqrt(2.0 / {_COSINES}) * cos({inner} + 2 * pi() * {u('p', j)}), 6) AS z{j}")
    moments = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(columns))
    return sql("ord_lab", f"SELECT o_orderkey, {', '.join(parts)} FROM ord_lab, (SELECT {moments} FROM ord_lab)")


@query("fourier_map", _fourier_sql())
def fourier_map(spark, sf):
    """Each order's random Fourier features over two columns, gamma 1/2 (frequencies of deviation 1)."""
    d = X.assemble(ord_lab(spark, sf), ["c_acctbal", "o_totalprice"], keep=[KEY])
    z = vector_to_array("fourier")
    return K.fit_map(d, _COSINES, seed=7, gamma=0.5).apply(d).select(
        KEY, *[F.round(z[j], 6).alias(f"z{j}") for j in range(_COSINES)])


@query("svm_rbf_fit", sql("ord_lab", (
    "SELECT count(*) AS n, count(*) FILTER (power((c_acctbal - m0) / s0, 2) + power((o_totalprice - m1) / s1, 2) < 1.4) AS inside, TRUE AS "
    "kernel_separates, FALSE AS line_separates FROM ord_lab, (SELECT avg(c_acctbal) AS m0, stddev_pop(c_acctbal) AS s0, avg(o_totalprice) AS "
    "m1, stddev_pop(o_totalprice) AS s1 FROM ord_lab)")))
def svm_rbf_fit(spark, sf):
    """Orders near the middle of two columns against those around: a closed border, which the kernel finds (over 95 % right) and a
    line does not (under 80 %)."""
    d = X.assemble(ord_lab(spark, sf), ["c_acctbal", "o_totalprice"], keep=[KEY])
    even = K.fit_map(d, 1, gamma=0.5)
    v = vector_to_array("features")
    radius = sum((F.pow((v[i] - even.mean[i]) * even.scale[i], F.lit(2.0)) for i in range(2)), F.lit(0.0))
    d = settle(d.withColumn("label", (radius < 1.4).cast("double")), "ring")
    ctx = M.fit_context(d, "classification")
    scored = d
    for kernel in ("rbf", "linear"):
        spec = M.Spec("SVM", "kernel", {"C": 1.0, "kernel": kernel})
        scored = M.add_scores(scored, M.make_estimator(spec, ctx).fit(d), kernel)
    right = {k: F.avg((F.col(f"{k}_pred") == F.col("label")).cast("double")) for k in ("rbf", "linear")}
    return scored.agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("inside"),
                      (right["rbf"] > 0.95).alias("kernel_separates"), (right["linear"] > 0.8).alias("line_separates"))


@query("single_fit")
def single_fit(spark, sf):
    return _fit_report(spark, sf, "Ridge", "regression", "y")


@query("ridge_fit", sql("ord_lab", (
    "SELECT round(w, 6) AS coefficient, round(my - w * mx, 4) AS intercept FROM (SELECT "
    "(covar_pop(x, y) * count(*)) / (var_pop(x) * count(*) + 1.0) AS w, avg(x) AS mx, avg(y) AS my FROM "
    "(SELECT c_acctbal / 1000 AS x, y FROM ord_lab))")))
def ridge_fit(spark, sf):
    """One feature, penalty 1.0: the closed form of ridge regression."""
    d = ord_lab(spark, sf).select((F.col("c_acctbal") / 1000).alias("x"), F.col("y").alias("label"))
    train = X.assemble(d, ["x"], keep=["label"])
    spec = M.Spec("Ridge", "linear", M.default_params("Ridge", 0))
    model = M.make_estimator(spec, M.fit_context(train, "regression")).fit(train)
    return spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))],
                                 "coefficient double, intercept double").select(
        F.round("coefficient", 6).alias("coefficient"), F.round("intercept", 4).alias("intercept"))


@query("single_ridge", sql("ord_lab", (
    "SELECT round(any_value(w), 6) AS coefficient, round(max(r2) FILTER (part = 'train'), 5) AS train_score, round(max(r2) FILTER (part = "
    "'test'), 5) AS test_score FROM (SELECT part, any_value(w) AS w, 1 - sum((y - my - w * (x - mx)) ** 2) / (var_pop(y) * count(*)) AS r2 "
    "FROM (SELECT *, CASE WHEN rn > cut THEN 'train' ELSE 'test' END AS part FROM k, (SELECT CAST(ceil(0.2 * count(*)) AS BIGINT) AS cut FROM "
    "k)), (SELECT covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 1.0) AS w, avg(x) AS mx, avg(y) AS my FROM k WHERE rn > (SELECT "
    "CAST(ceil(0.2 * count(*)) AS BIGINT) FROM k)) GROUP BY part)"),
    ("k", "SELECT c_acctbal / 1000 AS x, y, row_number() OVER (ORDER BY md5(concat('42:', CAST(o_orderkey AS string)))) AS rn FROM ord_lab")))
def single_ridge(spark, sf):
    """One model fitted on the train rows and scored on both splits, in closed form."""
    data = _data(spark, sf, "y", ["x"])
    fit = M.fit_single(data.where("split = 'train'"), data.where("split = 'test'"), _specs(["Ridge"], data, "regression")[0], "regression",
                       _DEFAULTS)
    return spark.createDataFrame([(round(fit.model.coef[0], 6), round(fit.train_score, 5), round(fit.test_score, 5))],
                                 "coefficient double, train_score double, test_score double")


@query("rf_importance")
def rf_importance(spark, sf):
    d = X.add_derived(ord_lab(spark, sf).select("label", "o_totalprice", "c_acctbal", "c_nationkey"),
                      ["o_totalprice__mul__c_acctbal"])
    cols = ["o_totalprice", "c_acctbal", "c_nationkey", "o_totalprice__mul__c_acctbal"]
    scores = X.forest_importance(d, cols, "label", True, FeatureConfig())
    return spark.createDataFrame(list(scores.items()), "feature string, score double")


@query("importance_table")
def importance_table(spark, sf):
    data = _data(spark, sf)
    spec = _specs(["RandomForest"], data)[0]
    model = M.make_estimator(spec, M.fit_context(data, "classification")).fit(data)
    return importance_rows(spark, model_importance(model, _FEATURES), top=3)


@query("pca")
def pca(spark, sf):
    vec = table(spark, sf, "embeddings").select(
        array_to_vector(F.col("embedding").cast("array<double>")).alias("_v"))
    plan = X.fit_pca_vectors(vec, 10)
    return spark.createDataFrame(list(zip(plan.components, plan.explained, plan.cumulative)),
                                 "component string, explained double, cumulative double")


@query("training_curve")
def training_curve(spark, sf):
    data = _data(spark, sf, "y")
    train, test = data.where("split = 'train'"), data.where("split = 'test'")
    spec = _specs(["GradientBoosting"], data, "regression")[0]
    model = M.make_estimator(spec, M.fit_context(train, "regression")).fit(train)
    return M.normalized_losses(M.training_curve(model, train, test, "regression"))


@query("best_round")
def best_round(spark, sf):
    """The round with the lowest loss on the held-out rows."""
    data = _data(spark, sf, "y")
    train, test = data.where("split = 'train'"), data.where("split = 'test'")
    model = M.make_estimator(_specs(["XGBoost"], data, "regression")[0],
                             M.fit_context(train, "regression")).fit(train)
    return M.best_round(M.training_curve(model, train, test, "regression"))


# --- comparison --------------------------------------------------------------------------

@query("leaderboard")
def leaderboard(spark, sf):
    folded = _folded(spark, sf)
    specs = _specs(["RandomForest", "LogisticRegression"], folded)
    cv = M.cross_validate(folded, "row_key", specs, "classification", _DEFAULTS.cv_folds, _DEFAULTS)
    return M.with_failures(M.leaderboard(cv.scores), cv.failed, "model")


# Ridge on one feature has a closed form: w = cov * n / (var * n + alpha). The digest order of the
# keys gives the split and the folds in SQL too.
_RIDGE_CTES = (
    ("k", f"SELECT o_orderkey, c_acctbal / 1000 AS x, y, row_number() OVER (ORDER BY md5(concat('42:', "
          "CAST(o_orderkey AS string)))) AS rn FROM ord_lab"),
    ("tr", "SELECT *, CAST(ntile(5) OVER (ORDER BY rn) - 1 AS INT) AS fold FROM k WHERE rn > (SELECT "
           "CAST(ceil(0.2 * count(*)) AS BIGINT) FROM k)"),
    ("alphas", "SELECT * FROM ({alphas}) AS a(trial, alpha)"),
    ("st", "SELECT a.trial, f.fold, any_value(a.alpha) AS alpha, count(*) AS n, avg(x) AS mx, avg(y) AS my, "
           "covar_pop(x, y) AS cxy, var_pop(x) AS vx FROM tr, alphas a, range(5) f(fold) WHERE tr.fold <> "
           "f.fold GROUP BY a.trial, f.fold"),
    ("w", "SELECT trial, fold, cxy * n / (vx * n + alpha) AS w, mx, my FROM st"),
    ("pred", "SELECT w.trial, tr.o_orderkey, tr.fold, y, my + w * (x - mx) AS p FROM tr JOIN w ON tr.fold = "
             "w.fold"),
)


def _ridge_sql(body, alphas):
    rows = " UNION ALL ".join(f"SELECT '{t}', {a!r}" for t, a in alphas)
    return sql("ord_lab", body, *[(n, s.replace("{alphas}", rows)) for n, s in _RIDGE_CTES])


def _trial_alphas():
    rng = random.Random(_DEFAULTS.seed)
    return [(f"t{i}", M.sample_params(M.SEARCH_SPACES["Ridge"], rng)["alpha"])
            for i in range(_DEFAULTS.n_trials)]


@query("oof", _ridge_sql("SELECT o_orderkey AS row_key, fold, round(p, 4) AS prediction FROM pred",
                         [("m0", 1.0)]))
def oof(spark, sf):
    """Out-of-fold predictions of ridge regression on one feature."""
    folded = _folded(spark, sf, "y", ["x"])
    cv = M.cross_validate(folded, "row_key", _specs(["Ridge"], folded, "regression"), "regression",
                          _DEFAULTS.cv_folds, _DEFAULTS)
    return cv.oof.select("row_key", "fold", F.round("m0_pred", 4).alias("prediction"))


@query("random_search", _ridge_sql(
    "SELECT trial, round(avg(r2), 5) AS cv_mean, count(*) AS folds FROM (SELECT trial, fold, 1 - sum((y - p) "
    "* (y - p)) / (var_pop(y) * count(*)) AS r2 FROM pred GROUP BY trial, fold) GROUP BY trial",
    _trial_alphas()))
def random_search(spark, sf):
    """All trials of the search for a ridge penalty, on one feature."""
    folded = _folded(spark, sf, "y", ["x"])
    spec = _specs(["Ridge"], folded, "regression")[0]
    _, trials = M.random_search(folded, "row_key", spec, "regression", _DEFAULTS.cv_folds, _DEFAULTS)
    return trials.select("trial", F.round("cv_mean", 5).alias("cv_mean"), "folds")


def _ensemble(spark, sf, kind):
    cfg = TrainConfig(parallelism=4, ensemble_type=kind)
    folded = _folded(spark, sf)
    specs = _specs(["RandomForest", "LogisticRegression"], folded)
    cv = M.cross_validate(folded, "row_key", specs, "classification", cfg.cv_folds, cfg)
    return folded, specs, cv, cfg


@query("stacking")
def stacking(spark, sf):
    _, _, cv, cfg = _ensemble(spark, sf, "stacking")
    return M.ensemble_fold_scores(cv, ["m0", "m1"], "classification", 2, cfg.cv_folds, "accuracy", cfg)


@query("ensemble_topk")
def ensemble_topk(spark, sf):
    """The best two members, refitted on the train rows, soft-voting on the test rows."""
    folded, specs, cv, cfg = _ensemble(spark, sf, "voting")
    top = M.leaderboard(cv.scores, by="tag").where("position <= 2").orderBy("position").collect()
    tags = [r["tag"] for r in top]
    made = M.build_ensemble(folded.drop("fold"), cv, [specs[int(t[1:])] for t in tags], tags,
                            "classification", cfg)
    test = _data(spark, sf).where("split = 'test'")
    return made.transform(test).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("class_weights", sql("ord", "SELECT o_orderstatus AS label, round((SELECT count(*) FROM ord) / "
                            "((SELECT count(DISTINCT o_orderstatus) FROM ord) * count(*)), 6) AS weight "
                            "FROM ord GROUP BY o_orderstatus"))
def class_weights(spark, sf):
    return round_doubles(M.class_weights(ord_(spark, sf), "o_orderstatus"))


_MEMBERS = {
    "a": "CASE WHEN o_totalprice > 250000 THEN 2 WHEN o_totalprice > 120000 THEN 1 ELSE 0 END",
    "b": "o_orderkey % 3",
    "c": "CASE WHEN o_orderpriority < '3' THEN 2 ELSE 1 END",
}
_MP = {"a": ["o_totalprice / 500000", "0.3", "0.7 - o_totalprice / 500000"],
       "b": ["(o_orderkey % 10) / 10", "0.5", "0.5 - (o_orderkey % 10) / 10"],
       "c": ["0.2", "0.35", "0.45"]}
_VOTES = ("v", "SELECT o_orderkey, " + ", ".join(f"{e} AS {n}" for n, e in _MEMBERS.items()) + ", " +
          ", ".join(f"({' + '.join(_MP[m][i] for m in _MP)}) / 3 AS p{i}" for i in range(3)) +
          " FROM orders")


def _votes(spark, sf):
    d = table(spark, sf, "orders").selectExpr(
        KEY, "o_totalprice", *[f"CAST({e} AS double) AS {n}" for n, e in _MEMBERS.items()],
        *[f"array({', '.join(f'CAST({x} AS double)' for x in ps)}) AS {m}_prob"
          for m, ps in _MP.items()])
    return d


@query("voting", "WITH v AS (" + _VOTES[1] + ") SELECT o_orderkey, CAST(CASE WHEN a = b OR a = c THEN a "
                 "WHEN b = c THEN b ELSE least(a, b, c) END AS DOUBLE) AS hard, CAST(CASE WHEN p0 >= p1 "
                 "AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS DOUBLE) AS soft, round((a + b + "
                 "c) / 3, 6) AS average FROM v")
def voting(spark, sf):
    d = _votes(spark, sf)
    return d.select(KEY, M.hard_vote([F.col(m) for m in _MEMBERS]).alias("hard"),
                    M.soft_vote([F.col(f"{m}_prob") for m in _MEMBERS]).alias("soft"),
                    rounded(M.average_vote([F.col(m) for m in _MEMBERS])).alias("average"))


@query("diversity", "WITH v AS (" + _VOTES[1] + ") SELECT round((avg((a <> b)::INT) + avg((a <> c)::INT) "
                    "+ avg((b <> c)::INT)) / 3, 6) AS diversity FROM v")
def diversity(spark, sf):
    return round_doubles(M.diversity(_votes(spark, sf), list(_MEMBERS)))


_SCORES = ("s", "SELECT o_orderpriority AS model, o_orderkey % 5 AS fold, avg(o_totalprice) / 300000 AS "
                "score FROM orders GROUP BY ALL")
_BOARD = ("b", "SELECT model, avg(score) AS cv_mean, stddev_pop(score) AS cv_std, count(*) AS folds, "
               "row_number() OVER (ORDER BY avg(score) DESC, stddev_pop(score), model) AS position FROM s "
               "GROUP BY model")
_WITH = f"WITH s AS ({_SCORES[1]}), b AS ({_BOARD[1]}) "


def _board(spark, sf):
    """A leaderboard whose models are order priorities and whose scores are mean prices."""
    return M.leaderboard(table(spark, sf, "orders").selectExpr(
        "o_orderpriority AS model", "o_orderkey % 5 AS fold", "o_totalprice").groupBy(
        "model", "fold").agg((F.avg("o_totalprice") / 300000).alias("score")))


@query("leaderboard_order", _WITH + "SELECT model, round(cv_mean, 6) AS cv_mean, round(cv_std, 6) AS "
                            "cv_std, folds, position FROM b")
def leaderboard_order(spark, sf):
    return round_doubles(_board(spark, sf))


@query("pick_best", _WITH + (
    "SELECT 'score' AS criterion, model FROM b WHERE position = 1 UNION ALL SELECT 'stable', model FROM "
    "(SELECT * FROM b WHERE position <= (SELECT greatest(1, count(*) // 2) FROM b) ORDER BY cv_std, "
    "position LIMIT 1) UNION ALL SELECT 'balanced', model FROM (SELECT * FROM b ORDER BY cv_mean - 0.5 * "
    "cv_std DESC, position LIMIT 1)"))
def pick_best(spark, sf):
    board = _board(spark, sf)
    return reduce(DataFrame.unionByName, [
        M.pick_best(board, c).select(F.lit(c).alias("criterion"), "model")
        for c in ("score", "stable", "balanced")])


@query("ensemble_worth", _WITH + (
    "SELECT round(a.cv_mean - c.cv_mean, 6) AS gap, round(a.cv_std, 6) AS best_std, a.cv_mean - c.cv_mean "
    "< 0.01 OR a.cv_std > 0.05 AS use_ensemble FROM b a, b c WHERE a.position = 1 AND c.position = 2"))
def ensemble_worth(spark, sf):
    return round_doubles(M.ensemble_worthwhile(_board(spark, sf)))


# --- scoring -----------------------------------------------------------------------------

_SERVE_NUM, _SERVE_CAT = ["price", "acctbal", "num_text"], ["segment", "priority"]


def _num(c):
    return f"TRY_CAST({c} AS DOUBLE)"


@query("serving_schema", sql("ord_dirty", union([
    f"SELECT '{c}' AS \"column\", round(quantile_cont({_num(c)}, 0.5), 6) AS median, "
    f"round(avg({_num(c)}), 6) AS mean, round(CASE WHEN stddev_samp({_num(c)}) > 0 THEN "
    f"stddev_samp({_num(c)}) ELSE 1.0 END, 6) AS std, round(min({_num(c)}), 6) AS min, "
    f"round(max({_num(c)}), 6) AS max FROM ord_dirty" for c in _SERVE_NUM])))
def serving_schema(spark, sf):
    return round_doubles(S.serving_stats(ord_dirty(spark, sf), _SERVE_NUM))


@query("serving_levels", sql("ord_dirty", union([
    f"SELECT DISTINCT '{c}' AS \"column\", {c} AS level FROM ord_dirty WHERE {c} IS NOT NULL"
    for c in [*_SERVE_CAT, "order_date"]])))
def serving_levels(spark, sf):
    return S.serving_levels(ord_dirty(spark, sf), [*_SERVE_CAT, "order_date"])


_FITTED = ("t", "SELECT * FROM ord_dirty WHERE target = 'F'")


def _serving(spark, sf, order=()):
    d = ord_dirty(spark, sf)
    return d, S.fit_serving_schema(d.where("target = 'F'").where("priority <> 'N/A'"), _SERVE_NUM,
                                   [*_SERVE_CAT, "order_date"], order)


def _range_checks(c):
    lo, hi = (f"(SELECT {f}({_num(c)}) FROM tt)" for f in ("min", "max"))
    return [f"CASE WHEN {c} IS NOT NULL AND {_num(c)} IS NULL THEN 'not_numeric:{c}' END",
            f"CASE WHEN {_num(c)} < {lo} THEN 'below_min:{c}' END",
            f"CASE WHEN {_num(c)} > {hi} THEN 'above_max:{c}' END"]


_CHECKS = [x for c in _SERVE_NUM for x in _range_checks(c)] + [
    f"CASE WHEN {c} IS NOT NULL AND {c} NOT IN (SELECT {c} FROM tt WHERE {c} IS NOT NULL) THEN "
    f"'unexpected_category:{c}' END" for c in [*_SERVE_CAT, "order_date"]]


@query("validate_rows", sql("ord_dirty", "SELECT o_orderkey, concat_ws(',', " + ", ".join(
    ["CAST(NULL AS string)"] + _CHECKS) + ") AS errors FROM ord_dirty", _FITTED,
    ("tt", "SELECT * FROM t WHERE priority <> 'N/A'")))
def validate_rows(spark, sf):
    """Rules from the finished orders, applied to all; one column has too many levels to inline."""
    d, schema = _serving(spark, sf)
    return S.validate_rows(d, schema).select(KEY, F.array_join("errors", ",").alias("errors"))


_ORDER = ["price", "num_text", "acctbal", "price__mul__acctbal", "price__div__num_text",
          "segment__BUILDING", "segment__MACHINERY", "never_seen"]


def _filled(c):
    return f"coalesce({_num(c)}, (SELECT quantile_cont({_num(c)}, 0.5) FROM tt))"


@query("prepare_rows", sql("ord_dirty", (
    "SELECT o_orderkey, round(price, 6) AS price, round(num_text, 6) AS num_text, round(acctbal, 6) AS "
    "acctbal, round(price * acctbal, 4) AS price__mul__acctbal, round(CASE WHEN abs(num_text) > 1e-6 THEN "
    "price / num_text ELSE 0 END, 6) AS price__div__num_text, CAST(coalesce(segment = 'BUILDING', FALSE) "
    "AS DOUBLE) AS segment__BUILDING, CAST(coalesce(segment = 'MACHINERY', FALSE) AS DOUBLE) AS "
    "segment__MACHINERY, CAST(0.0 AS DOUBLE) AS never_seen FROM (SELECT o_orderkey, segment, "
    f"{_filled('price')} AS price, {_filled('num_text')} AS num_text, {_filled('acctbal')} AS acctbal "
    "FROM ord_dirty)"), _FITTED, ("tt", "SELECT * FROM t WHERE priority <> 'N/A'")))
def prepare_rows(spark, sf):
    d, schema = _serving(spark, sf, _ORDER)
    return round_doubles(S.prepare_rows(d, schema, keep=[KEY]).withColumn(
        "price__mul__acctbal", F.round("price__mul__acctbal", 4)))


@query("rebuild_interactions", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_tax, 6) AS "
                               "l_quantity__mul__l_tax, round(CASE WHEN abs(l_discount) > 1e-6 THEN "
                               "l_tax / l_discount ELSE 0 END, 6) AS l_tax__div__l_discount, "
                               "round(l_quantity + l_tax, 6) AS l_quantity__add__l_tax, "
                               "round(l_quantity - l_tax, 6) AS l_quantity__sub__l_tax FROM lineitem")
def rebuild_interactions(spark, sf):
    names = ["l_quantity__mul__l_tax", "l_tax__div__l_discount", "l_quantity__add__l_tax",
             "l_quantity__sub__l_tax"]
    d = X.add_derived(table(spark, sf, "lineitem"), names)
    return round_doubles(d.select("l_orderkey", "l_linenumber", *names))


def _scorer(spark, sf):
    """A logistic model on four features, with its serving schema from the training rows."""
    # written, so that the steps of fitting and scoring do not join the tables anew
    d = settle(ord_lab(spark, sf).select(KEY, "o_totalprice", "c_acctbal", "o_orderpriority", "label"), "orders")
    numeric, text = ["o_totalprice", "c_acctbal"], ["o_orderpriority"]
    coded = E.ordinal_encode(d, d, text)
    train = X.assemble(coded.withColumn("label", F.col("label").cast("double")), numeric + text,
                       keep=["label"])
    model = M.make_estimator(_specs(["LogisticRegression"], train)[0],
                             M.fit_context(train, "classification")).fit(train)
    schema = S.fit_serving_schema(d, numeric, text, numeric + text)
    return d, S.Scorer(schema, model, "classification", ["0", "1"], S.ordinal_codes(d, text))


def _agreement(scored, d, scorer):
    """Rows scored, and rows whose prediction or probabilities differ from the model's own."""
    direct = scorer.model.transform(X.assemble(
        E.ordinal_encode(d, d, ["o_orderpriority"]), scorer.schema.feature_order, keep=[KEY])).select(
        ref(KEY).alias("_k"), F.col("prediction").cast("int").cast("string").alias("_p"),
        M.class_probabilities_of("probability")[1].alias("_q"))
    both = scored.join(direct, ref(KEY) == F.col("_k"), "full")
    near = (ref("prediction") == ref("_p")) & (F.abs(F.col("probabilities")["1"] - F.col("_q")) < 1e-9)
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.when(
        F.coalesce(near, F.lit(False)), 0).otherwise(1)), F.lit(0)).alias("mismatches"))


_AGREES = "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS mismatches FROM orders JOIN customer ON o_custkey = c_custkey"


@query("batch_predict", _AGREES)
def batch_predict(spark, sf):
    """Every raw row scored through the serving steps, against the model on prepared rows."""
    d, scorer = _scorer(spark, sf)
    return _agreement(scorer.predict_batch(d, [KEY]), d, scorer)


@query("stream_score", _AGREES)
def stream_score(spark, sf):
    """The same scoring over a stream of files, run until all are processed."""
    d, scorer = _scorer(spark, sf)
    source, out = scratch_path(spark, "incoming"), scratch_path(spark, "scored")
    rows = d.select(KEY, "o_totalprice", "c_acctbal", "o_orderpriority")
    rows.write.parquet(source)
    score_files(spark, source, rows.schema, scorer, [KEY], out,
                scratch_path(spark, "checkpoint")).awaitTermination()
    return _agreement(spark.read.parquet(out), d, scorer)


_PRICED = "SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM ord_lab WHERE o_totalprice < 200000"


@query("stream_routes", sql("ord_lab", (
    "SELECT CASE WHEN o_totalprice BETWEEN lo AND hi THEN 'scored' ELSE 'rejected' END AS route, count(*) AS n, count(DISTINCT o_orderkey) "
    f"AS keys FROM ord_lab, ({_PRICED}) GROUP BY ALL")))
def stream_routes(spark, sf):
    """Both routes of a stream whose files arrive in two steps with a restart between them: every row is on one, once."""
    d, scorer = _scorer(spark, sf)
    ends = d.where("o_totalprice < 200000").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")).first()
    schema = replace(scorer.schema, ranges=scorer.schema.ranges | {"o_totalprice": (ends["lo"], ends["hi"])})
    scorer = replace(scorer, schema=schema)
    source, scored, rejected = (scratch_path(spark, n) for n in ("incoming", "scored", "rejected"))
    checkpoint = scratch_path(spark, "checkpoint")
    rows = d.select(KEY, "o_totalprice", "c_acctbal", "o_orderpriority")
    for part in (0, 1):
        rows.where(F.pmod(KEY, F.lit(2)) == part).write.mode("append").parquet(source)
        route_files(spark, source, rows.schema, scorer, [KEY], scored, rejected, checkpoint).awaitTermination()
    out = [spark.read.parquet(p).select(F.lit(n).alias("route"), KEY) for n, p in (("scored", scored), ("rejected", rejected))]
    return out[0].unionByName(out[1]).groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(KEY).alias("keys"))


@query("model_roundtrip", "SELECT name, count(*) AS n_rows, CAST(0 AS BIGINT) AS mismatches FROM orders JOIN customer ON "
                          "o_custkey = c_custkey, (VALUES ('RandomForest'), ('XGBoost'), ('LogisticRegression')) AS m(name) GROUP BY name")
def model_roundtrip(spark, sf):
    """Stored and reloaded models against those that were stored, row by row: a forest, boosted trees, a Spark ML model."""
    data = _data(spark, sf)
    ctx, out = M.fit_context(data, "classification"), []
    for spec in _specs(["RandomForest", "XGBoost", "LogisticRegression"], data):
        model, path = M.make_estimator(spec, ctx).fit(data), scratch_path(spark, "model")
        S.save_model_data(model, path, spark)
        a = model.transform(data).select("row_key", F.col("prediction").alias("a"))
        b = S.load_model_data(path, spark).transform(data).select("row_key", F.col("prediction").alias("b"))
        out.append(a.join(b, "row_key", "full").agg(
            F.lit(spec.name).alias("name"), F.count(F.lit(1)).alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), 0).otherwise(1)), F.lit(0)).alias("mismatches")))
    return reduce(DataFrame.unionByName, out)


def _run_scorer(spark, sf, **train):
    """Raw rows and the scorer of a run on them: dates, rare levels, logs, derived columns and codes included."""
    d = ord_lab(spark, sf).drop("y")
    cfg = AutoMLConfig(train=TrainConfig(parallelism=4, optimize=False, **train))
    return d.drop("label"), run_automl(d, KEY, "label", cfg).scorer


def _roundtrip(spark, rows, scorer):
    """Rows scored by a scorer, and those that differ after it was stored and read into a fresh object."""
    path = scratch_path(spark, "scorer")
    S.save_scorer(scorer, path)
    again = S.load_scorer(spark, path)
    both = [s.score(rows, [KEY]).select(ref(KEY), F.struct("prediction", F.transform_values("probabilities", lambda k, v: F.round(v, 9)).alias("p")).alias(n))
            for s, n in ((scorer, "a"), (again, "b"))]
    same = F.coalesce((F.col("a.prediction") == F.col("b.prediction")) & (F.map_entries("a.p") == F.map_entries("b.p")), F.lit(False))
    return both[0].join(both[1], KEY, "full").agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.when(same, 0).otherwise(1)), F.lit(0)).alias("mismatches"))


@query("scorer_roundtrip", _AGREES)
def scorer_roundtrip(spark, sf):
    """The scorer of a real run, stored with its fitted plan, model and tables, reloaded, scoring all raw rows."""
    return _roundtrip(spark, *_run_scorer(spark, sf))


@query("ensemble_roundtrip", _AGREES)
def ensemble_roundtrip(spark, sf):
    """The same with an ensemble in the scorer: every member and the meta-learner are stored."""
    data = _data(spark, sf)
    folded = settle(G.assign_folds(data.where("split = 'train'").drop("split"), "row_key", 3, "label"), "folds")
    specs = [replace(s, params={**s.params, "n_estimators": 20}) for s in _specs(["RandomForest", "XGBoost"], folded)]
    cfg = replace(_DEFAULTS, ensemble_type="stacking")
    cv = M.cross_validate(folded, "row_key", specs, "classification", 3, cfg)
    made = M.build_ensemble(folded.drop("fold"), cv, specs, ["m0", "m1"], "classification", cfg)
    d = ord_lab(spark, sf).withColumn("priority", F.substring("o_orderpriority", 1, 1).cast("int"))
    schema = S.fit_serving_schema(d, _FEATURES, [], _FEATURES)
    return _roundtrip(spark, d, S.Scorer(schema, made, "classification", ["0", "1"]))


# --- run history -------------------------------------------------------------------------
# Each order year is a run: its settings, metrics and features are aggregates of that year.

_STAGE = ("CASE o_orderpriority WHEN '1-URGENT' THEN 'preprocessing' WHEN '2-HIGH' THEN "
          "'feature_engineering' WHEN '3-MEDIUM' THEN 'training' ELSE 'evaluation' END")
_METRIC = "CASE o_orderstatus WHEN 'F' THEN 'accuracy' WHEN 'O' THEN 'f1' ELSE 'rmse' END"
_RUN_CTES = (
    ("runs", "SELECT DISTINCT CAST(year(o_orderdate) AS string) AS run_id, year(o_orderdate) AS seq FROM "
             "ord"),
    ("rv", f"SELECT CAST(year(o_orderdate) AS string) AS run_id, {_STAGE} AS section, o_orderstatus AS "
           "key, CAST(count(*) % 3 AS string) AS value FROM ord GROUP BY ALL"),
    ("rm", f"SELECT CAST(year(o_orderdate) AS string) AS run_id, {_METRIC} AS metric, "
           "CAST(month(o_orderdate) AS INT) AS step, avg(o_totalprice) AS value FROM ord GROUP BY ALL"),
    ("rf", "SELECT CAST(year(o_orderdate) AS string) AS run_id, concat('nation_', CAST(c_nationkey AS "
           "string)) AS feature FROM ord GROUP BY ALL HAVING avg(c_acctbal) > 4500"),
    ("lr", "SELECT run_id, lag(run_id) OVER (ORDER BY seq) AS prev FROM runs ORDER BY seq DESC LIMIT 1"),
)


def _runs(spark, sf):
    year = F.year("o_orderdate")
    return ord_(spark, sf).select(year.cast("string").alias("run_id"),
                                  year.cast("long").alias("seq")).distinct()


def _run_values(spark, sf):
    return ord_(spark, sf).groupBy(
        F.year("o_orderdate").cast("string").alias("run_id"), F.expr(_STAGE).alias("section"),
        F.col("o_orderstatus").alias("key")).agg(
        (F.count(F.lit(1)) % 3).cast("string").alias("value"))


def _run_metrics(spark, sf):
    return ord_(spark, sf).groupBy(
        F.year("o_orderdate").cast("string").alias("run_id"), F.expr(_METRIC).alias("metric"),
        F.month("o_orderdate").alias("step")).agg(F.avg("o_totalprice").alias("value"))


def _run_features(spark, sf):
    return ord_(spark, sf).groupBy(
        F.year("o_orderdate").cast("string").alias("run_id"),
        F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("feature")).agg(
        F.avg("c_acctbal").alias("bal")).where("bal > 4500").drop("bal")


_DIFF = ("SELECT coalesce(a.section, b.section) AS section, coalesce(a.key, b.key) AS key, a.value AS "
         "before, b.value AS after FROM (SELECT * FROM rv WHERE run_id = '1998') a FULL JOIN (SELECT * FROM "
         "rv WHERE run_id = '1999') b ON a.section = b.section AND a.key = b.key WHERE a.value IS DISTINCT "
         "FROM b.value")


def _diff(spark, sf):
    v = _run_values(spark, sf)
    return H.diff_values(v.where("run_id = '1998'"), v.where("run_id = '1999'"))


@query("run_diff", sql("ord", _DIFF, *_RUN_CTES))
def run_diff(spark, sf):
    return _diff(spark, sf)


@query("changed_stages", sql("ord", (
    "SELECT section AS stage, CASE section WHEN 'preprocessing' THEN 2 WHEN 'feature_engineering' THEN 3 "
    f"WHEN 'training' THEN 5 ELSE 6 END AS position, count(*) AS changes FROM ({_DIFF}) GROUP BY section"),
    *_RUN_CTES))
def changed_stages(spark, sf):
    return H.changed_stages(_diff(spark, sf))


@query("feature_diff", sql("ord", (
    "SELECT feature, 'added' AS change FROM rf WHERE run_id = '1999' AND feature NOT IN (SELECT feature FROM"
    " rf WHERE run_id = '1998') UNION ALL SELECT feature, 'removed' FROM rf WHERE run_id = '1998' AND "
    "feature NOT IN (SELECT feature FROM rf WHERE run_id = '1999')"), *_RUN_CTES))
def feature_diff(spark, sf):
    f = _run_features(spark, sf)
    return H.diff_features(f.where("run_id = '1998'").select("feature"),
                           f.where("run_id = '1999'").select("feature"))


_SIDES = "(SELECT {t}.* FROM {t}, lr WHERE {t}.run_id = lr.{w})"


@query("compare_runs", sql("ord", (
    "SELECT 'config' AS kind, coalesce(a.section, b.section) AS section, coalesce(a.key, b.key) AS name, "
    "a.value AS before, b.value AS after FROM " + _SIDES.format(t="rv", w="prev") + " a FULL JOIN " +
    _SIDES.format(t="rv", w="run_id") + " b ON a.section = b.section AND a.key = b.key WHERE a.value IS "
    "DISTINCT FROM b.value UNION ALL SELECT 'feature', 'feature_engineering', coalesce(a.feature, "
    "b.feature), CASE WHEN a.feature IS NOT NULL THEN 'selected' END, CASE WHEN b.feature IS NOT NULL THEN "
    "'selected' END FROM " + _SIDES.format(t="rf", w="prev") + " a FULL JOIN " +
    _SIDES.format(t="rf", w="run_id") + " b ON a.feature = b.feature WHERE a.feature IS NULL OR b.feature IS"
    " NULL"), *_RUN_CTES))
def compare_runs(spark, sf):
    return H.compare_last_two(_runs(spark, sf), _run_values(spark, sf), _run_features(spark, sf))


@query("metrics_wide", sql("ord", "SELECT run_id, " + ", ".join(
    f"round(arg_max(value, step) FILTER (WHERE metric = '{m}'), 6) AS {m}"
    for m in ("accuracy", "f1", "rmse")) + " FROM rm GROUP BY run_id", *_RUN_CTES))
def metrics_wide(spark, sf):
    return round_doubles(H.metrics_wide(_run_metrics(spark, sf), ("accuracy", "f1", "rmse")))


@query("best_run", sql("ord", "SELECT run_id, round(value, 6) AS value FROM rm WHERE metric = 'accuracy' "
                       "ORDER BY value DESC, run_id DESC LIMIT 1", *_RUN_CTES))
def best_run(spark, sf):
    return round_doubles(H.best_run(_run_metrics(spark, sf), "accuracy"))


@query("search_runs", sql("ord", "SELECT run_id, round(value, 6) AS value FROM rm WHERE metric = 'f1' AND "
                          "value >= 200000", *_RUN_CTES))
def search_runs(spark, sf):
    return round_doubles(H.search_runs(_run_metrics(spark, sf), "f1", 200000, limit=1000))


# settings of a run: how many orders of each priority its year has
_PARAMS = ("rp", "SELECT CAST(year(o_orderdate) AS string) AS run_id, o_orderpriority AS name, CAST(count(*) AS "
                 "string) AS value FROM ord GROUP BY ALL")
_FACTS = {"task_type": "min(o_orderstatus)", "model_name": "max(o_orderpriority)",
          "deployment_decision": "min(c_mktsegment)"}
_FACT = ("rt", "SELECT CAST(year(o_orderdate) AS string) AS run_id, " + ", ".join(
    f"{e} AS {k}" for k, e in _FACTS.items()) + " FROM ord GROUP BY ALL")


@query("run_summary", sql("ord", "SELECT run_id, task_type, model_name, deployment_decision, " + ", ".join(
    f"round(arg_max(value, step) FILTER (WHERE metric = '{m}'), 6) AS {m}" for m in H.SUMMARY_METRICS) +
    ", any_value(features) AS selected_features, any_value(params) AS hyperparameters FROM rm JOIN rt USING "
    "(run_id) LEFT JOIN (SELECT run_id, string_agg(feature, ',' ORDER BY feature) AS features FROM rf GROUP BY "
    "run_id) USING (run_id) LEFT JOIN (SELECT run_id, string_agg(concat(name, '=', value), ',' ORDER BY "
    "concat(name, '=', value)) AS params FROM rp GROUP BY run_id) USING (run_id) GROUP BY ALL",
    *_RUN_CTES, _PARAMS, _FACT))
def run_summary(spark, sf):
    """The 17 fields that sum up each run; metrics that were not logged are null."""
    year = F.year("o_orderdate").cast("string").alias("run_id")
    facts = ord_(spark, sf).groupBy(year).agg(*[F.expr(e).alias(k) for k, e in _FACTS.items()]).select(
        "run_id", F.lit("metrics").alias("section"), F.explode(F.array(*[F.struct(
            F.lit(k).alias("key"), F.col(k).alias("value")) for k in _FACTS])).alias("e")).select(
        "run_id", "section", "e.*")
    params = ord_(spark, sf).groupBy(year, F.col("o_orderpriority").alias("name")).agg(
        F.count(F.lit(1)).cast("string").alias("value"))
    out = H.run_summary(_runs(spark, sf), facts, _run_metrics(spark, sf), _run_features(spark, sf), params)
    lists = {c: F.when(F.size(c) > 0, F.array_join(c, ",")) for c in ("selected_features", "hyperparameters")}
    return round_doubles(out.withColumns(lists))


# each year compares the market segments by the balance of their orders; the days of the month are its trials
@query("run_comparison", sql("ord", (
    "SELECT run_id, arg_min(model, position) AS model, round(arg_min(cv_mean, position), 6) AS best_cv_score, "
    "round(arg_min(cv_std, position), 6) AS best_cv_std, count(*) AS candidates, CAST(0 AS BIGINT) AS failed FROM "
    "(SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY cv_mean DESC, cv_std, model) AS position FROM "
    "(SELECT CAST(year(o_orderdate) AS string) AS run_id, c_mktsegment AS model, avg(c_acctbal) AS cv_mean, "
    "stddev_pop(c_acctbal) AS cv_std FROM ord GROUP BY ALL)) GROUP BY run_id")))
def run_comparison(spark, sf):
    """The winner of each run's comparison, with the runner-ups counted, from the stored tables."""
    d = ord_(spark, sf).groupBy(F.year("o_orderdate").cast("string").alias("run_id"), F.col("c_mktsegment").alias("model")).agg(
        F.avg("c_acctbal").alias("cv_mean"), F.stddev_pop("c_acctbal").alias("cv_std"))
    board = settle(d.withColumn("position", F.row_number().over(W.partitionBy("run_id").orderBy(
        F.desc("cv_mean"), "cv_std", "model"))), "boards")
    store = H.RunStore(spark, scratch_path(spark, "runs"))
    for run in sorted(r["run_id"] for r in board.select("run_id").distinct().collect()):
        store.log_table("run_comparison", run, board.where(F.col("run_id") == run))
    return round_doubles(H.best_compared(store.read("run_comparison")))


@query("run_trials", sql("ord", (
    "SELECT run_id, model, count(*) AS trials, round(max(value), 6) AS best_value, arg_max(trial, value) AS "
    "best_trial, arg_max(params, value) AS params FROM (SELECT CAST(year(o_orderdate) AS string) AS run_id, "
    "o_orderstatus AS model, concat('t', CAST(day(o_orderdate) AS string)) AS trial, avg(o_totalprice) AS value, "
    "concat('{\"orders\": ', CAST(count(*) AS string), '}') AS params FROM ord GROUP BY ALL) GROUP BY ALL")))
def run_trials(spark, sf):
    """The best trial of each model that a run searched."""
    trials = ord_(spark, sf).groupBy(
        F.year("o_orderdate").cast("string").alias("run_id"), F.col("o_orderstatus").alias("model"),
        F.concat(F.lit("t"), F.day("o_orderdate").cast("string")).alias("trial")).agg(
        F.avg("o_totalprice").alias("value"),
        F.concat(F.lit('{"orders": '), F.count(F.lit(1)).cast("string"), F.lit("}")).alias("params"))
    return round_doubles(H.best_trials(trials))


@query("run_store", "SELECT 'config' AS kind, 'training' AS section, 'status' AS name, min(o_orderstatus) AS "
                    "before, 'O' AS after FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'feature', "
                    "'feature_engineering', 'a', 'selected', NULL UNION ALL SELECT 'feature', "
                    "'feature_engineering', 'c', NULL, 'selected' UNION ALL SELECT 'metric', 'metrics', 'bal', "
                    "CAST(round(avg(c_acctbal) FILTER (o_orderstatus = 'F'), 2) AS VARCHAR), CAST(round(avg(c_acctbal)"
                    " FILTER (o_orderstatus = 'O'), 2) AS VARCHAR) FROM orders JOIN customer ON o_custkey = c_custkey"
                    " UNION ALL SELECT 'metric', 'metrics', 'rows', CAST(count(*) FILTER (o_orderstatus = 'F') AS "
                    "VARCHAR), CAST(count(*) FILTER (o_orderstatus = 'O') AS VARCHAR) FROM orders JOIN customer ON "
                    "o_custkey = c_custkey")
def run_store(spark, sf):
    """Two runs logged to the append-only tables, then compared."""
    store = H.RunStore(spark, scratch_path(spark, "runs"))
    for seq, (status, features) in enumerate((("F", ["a", "b"]), ("O", ["b", "c"]))):
        d = ord_(spark, sf).where(F.col("o_orderstatus") == status)
        m = d.agg(F.round(F.avg("c_acctbal"), 2).alias("bal"), F.count(F.lit(1)).alias("n")).first()
        store.log_run(f"run-{status}", seq, {"training": {"status": status, "folds": 5}},
                      {"bal": m["bal"], "rows": m["n"]}, features, reason="new status")
    return H.compare_last_two(store.read("runs"), store.read("run_values"), store.read("run_features"))


@query("run_retry", sql("ord", (
    "SELECT concat('run-', o_orderstatus) AS run_id, count(DISTINCT c_mktsegment) AS features, CAST(1 AS BIGINT) AS metrics, "
    "round(avg(c_acctbal), 4) AS bal FROM ord GROUP BY o_orderstatus")))
def run_retry(spark, sf):
    """Runs whose first attempt dies after half of its tables: nothing of it is read, and the retry counts once."""
    store = H.RunStore(spark, scratch_path(spark, "runs"))
    d = ord_(spark, sf)
    facts = d.groupBy("o_orderstatus").agg(F.avg("c_acctbal").alias("bal"), F.sort_array(F.collect_set("c_mktsegment")).alias("segments"))
    for seq, r in enumerate(sorted(facts.collect())):  # one row per status
        run = f"run-{r['o_orderstatus']}"
        for dies in (True, False):
            try:
                with store.attempt(run):
                    store.log_run(run, seq, {"training": {"dies": dies}}, {"bal": r["bal"]}, r["segments"])
                    if dies:
                        raise InterruptedError(run)
                    store.log_params(run, {"seq": seq})
            except InterruptedError:
                continue
    features = store.read("run_features").groupBy("run_id").agg(F.count(F.lit(1)).alias("features"))
    metrics = store.read("run_metrics").groupBy("run_id").agg(F.count(F.lit(1)).alias("metrics"), F.round(F.max("value"), 4).alias("bal"))
    return features.join(metrics, "run_id")


@query("run_metadata_sink", sql("ord", (
    "SELECT concat('run-', o_orderstatus) AS run_id, 'RandomForest' AS model_name, CAST(NULL AS VARCHAR) AS "
    "task_type, round(avg((c_acctbal > 0)::INT), 6) AS accuracy, CAST(NULL AS DOUBLE) AS f1, CAST(NULL AS "
    "DOUBLE) AS r2, CAST(NULL AS VARCHAR) AS deployment_decision FROM ord WHERE o_orderstatus IN ('F', 'O', "
    "'P') GROUP BY o_orderstatus")))
def run_metadata_sink(spark, sf):
    path = scratch_path(spark, "metadata")
    for status in ("F", "O", "P"):
        row = ord_(spark, sf).where(F.col("o_orderstatus") == status).agg(
            F.lit(f"run-{status}").alias("run_id"), F.lit("RandomForest").alias("model_name"),
            F.avg((F.col("c_acctbal") > 0).cast("double")).alias("accuracy"))
        append_run_metadata(row, path)
    return round_doubles(spark.read.parquet(path))


def _end_to_end(spark, sf, **train):
    r = run_automl(ord_lab(spark, sf).drop("y"), KEY, "label", AutoMLConfig(train=TrainConfig(parallelism=4, **train)))
    rows = [(k, float(v)) for k, v in r.metrics.items() if v is not None]
    rows += [(f"importance:{k}", v) for k, v in r.importance.items()]
    rows += [(f"candidate:{b['model']}", b["cv_mean"]) for b in r.trained.leaderboard.collect()]
    if r.trained.trials is not None:
        rows += [(f"trials:{t['model']}", float(t["count"])) for t in r.trained.trials.groupBy("model").count().collect()]
    rows += [("ensemble_members", float(len(r.trained.ensemble or [])))]
    return spark.createDataFrame(rows, "metric string, value double")


@query("automl_end_to_end")
def automl_end_to_end(spark, sf):
    """All stages on orders with the planted label, dates included, with the default settings: every candidate is
    searched with all trials and compared."""
    return _end_to_end(spark, sf)


@query("automl_ensemble_end_to_end")
def automl_ensemble_end_to_end(spark, sf):
    """The same with the ensemble on: the best candidates are combined where that scores higher."""
    return _end_to_end(spark, sf, ensemble=True)
