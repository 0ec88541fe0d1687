"""Models: invariants of fits, cross-validation, search, ensembles, scoring and history."""

import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.config import AutoMLConfig, FeatureConfig, TrainConfig
from tabloom.operators import features as X, history as H, models as M, score as S, split as G
from tabloom.operators.explain import model_importance
from tabloom.plans.automl import run_automl
from tabloom.streaming.scoring import rejected_stream, score_files

QUICK = TrainConfig(cv_folds=3, n_trials=2, parallelism=4)


def small_specs(names, task, cfg=QUICK):
    """Specs whose models are small, for tests that are about what stands around the fits."""
    small = {"n_estimators": 3, "max_depth": 3, "max_iter": 20, "learning_rate": 0.3}
    return [replace(s, params={k: small.get(k, v) for k, v in s.params.items()})
            for s in M.build_specs(names, task, 600, cfg)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=600), rng.normal(size=600)
    return spark.createDataFrame(
        [(i, float(x), float(y), float(2.5 * x + 0.75 * y), int(x + y > 0) + int(x > 1))
         for i, (x, y) in enumerate(zip(a, b))], "id long, a double, b double, y double, c int").cache()


def vectors(rows, target, k=3):
    v = X.assemble(rows.withColumn("label", F.col(target).cast("double")), ["a", "b"], keep=["id", "label"])
    return G.assign_folds(v, "id", k).cache()


def test_candidate_rules():
    def pick(task, **kw):
        return M.choose_candidates(task, M.TableSignals(**kw), top=9)

    assert pick("classification", rows=500, features=5) == ["LogisticRegression", "SVM", "RandomForest"]
    assert pick("classification", rows=500, features=5, outlier_columns=1) == [
        "LogisticRegression", "RandomForest", "GradientBoosting"]
    assert pick("classification", rows=50, features=40) == ["LogisticRegression", "RandomForest"]
    assert pick("classification", rows=50_000, features=5, class_balance=0.05)[:3] == [
        "RandomForest", "GradientBoosting", "XGBoost"]
    assert pick("regression", rows=5000, features=5) == ["RandomForest", "GradientBoosting", "XGBoost", "Ridge"]
    assert pick("regression", rows=500, features=5, outlier_columns=2) == [
        "Ridge", "RandomForest", "GradientBoosting", "LightGBM"]


def test_spec_overrides():
    names = ["RandomForest", "GradientBoosting", "XGBoost"]
    specs = M.build_specs(names, "classification", 50_000, TrainConfig(preferred_model_family="linear"))
    assert [s.name for s in specs] == ["LogisticRegression", *names]
    forced = M.build_specs(names, "classification", 500, TrainConfig(force_model_name="XGBoost"))
    assert forced[0].name == "XGBoost" and len(forced) == 3 and forced[0].weight == 0.3333
    small = M.build_specs(names, "classification", 50_000, TrainConfig(reduce_complexity=True))
    assert small[0].params["max_depth"] == 6 and small[1].params["learning_rate"] == 0.08
    strong = M.build_specs(["Ridge", "LogisticRegression"], "regression", 10,
                           TrainConfig(regularization_strength="very_high"))
    assert strong[0].params["alpha"] == 4.0 and strong[1].params["C"] == 0.25
    assert M.build_specs(names, "classification", 2_000)[0].params["n_estimators"] == 20
    assert M.scoring_metric("classification", TrainConfig(metric_priority="Recall")) == "recall"


def test_ridge_equals_closed_form(rows):
    v = vectors(rows, "y")
    model = M.make_estimator(M.Spec("Ridge", "linear", {"alpha": 3.0}), M.fit_context(v, "regression")).fit(v)
    data = np.array([(r.a, r.b, r.y) for r in rows.select("a", "b", "y").collect()])
    x, y = data[:, :2] - data[:, :2].mean(0), data[:, 2] - data[:, 2].mean()
    want = np.linalg.solve(x.T @ x + 3.0 * np.eye(2), x.T @ y)
    assert np.allclose(model.coefficients.toArray(), want, atol=1e-6)


@pytest.mark.parametrize("name,target,task", [
    ("RandomForest", "c", "classification"), ("GradientBoosting", "c", "classification"),
    ("SVM", "c", "classification"), ("LogisticRegression", "c", "classification"),
    ("LightGBM", "y", "regression"), ("SVR", "y", "regression"), ("RandomForest", "y", "regression")])
def test_every_model_fits_scores_and_explains(rows, name, target, task):
    v = vectors(rows, target)
    spec = small_specs([name], task)[0]
    model = M.make_estimator(spec, M.fit_context(v, task)).fit(v)
    scored = M.add_scores(v, model, "m")
    assert scored.count() == 600
    if task == "classification":
        p = scored.select(F.aggregate("m_prob", F.lit(0.0), lambda a, x: a + x).alias("s"),
                          F.size("m_prob").alias("n")).agg(F.min("s"), F.max("s"), F.min("n")).first()
        assert abs(p[0] - 1) < 1e-9 and abs(p[1] - 1) < 1e-9 and p[2] == 3
    assert M.score_model(model, v, task) > 0.5
    weights = model_importance(model, ["a", "b"])
    assert set(weights) == {"a", "b"} and all(w >= 0 for w in weights.values())


def test_cross_validation_covers_every_row_once(rows):
    v = vectors(rows, "y")
    specs = small_specs(["Ridge", "RandomForest"], "regression")
    cv = M.cross_validate(v, "id", specs, "regression", 3, QUICK)
    assert cv.oof.count() == 600 and cv.oof.select("id").distinct().count() == 600
    board = M.leaderboard(cv.scores).orderBy("position").collect()
    assert board[0]["model"] == "Ridge" and board[0]["folds"] == 3 and board[0]["cv_mean"] > 0.99


def test_a_failing_candidate_is_left_out(rows):
    v = vectors(rows, "y")
    bad = M.Spec("RandomForest", "tree_ensemble", {"n_estimators": 0, "max_depth": 2})
    good = M.Spec("Ridge", "linear", {"alpha": 1.0})
    cv = M.cross_validate(v, "id", [bad, good], "regression", 3, QUICK)
    assert cv.names == ["Ridge"] and list(cv.failed) == ["m0"]
    with pytest.raises(RuntimeError):
        M.cross_validate(v, "id", [bad], "regression", 3, QUICK)


def test_search_is_reproducible(rows):
    v, spec = vectors(rows, "y"), small_specs(["Ridge"], "regression")[0]
    first = M.random_search(v, "id", spec, "regression", 3, QUICK)
    again = M.random_search(v, "id", spec, "regression", 3, QUICK)
    assert first[0].params == again[0].params and first[1].count() == 2
    best = first[1].where("position = 1").first()
    assert json.loads(best["params"]) == first[0].params


def test_scores_without_rows_are_the_same(rows):
    v, specs = vectors(rows, "c"), small_specs(["RandomForest", "LogisticRegression"], "classification")
    kept = M.cross_validate(v, "id", specs, "classification", 3, QUICK)
    bare = M.cross_validate(v, "id", specs, "classification", 3, QUICK, keep_rows=False)
    assert bare.oof is None and sorted(bare.scores.collect()) == sorted(kept.scores.collect())
    one = {r["fold"]: r["score"] for r in M.fold_scores(kept.oof, "m1_pred", "classification", "accuracy").collect()}
    assert one == {r["fold"]: r["score"] for r in kept.scores.where("tag = 'm1'").collect()}


@pytest.mark.parametrize("kind,target,task", [("voting", "c", "classification"),
                                              ("stacking", "c", "classification"),
                                              ("voting", "y", "regression"), ("stacking", "y", "regression")])
def test_ensembles(rows, kind, target, task):
    cfg = TrainConfig(**{**QUICK.__dict__, "ensemble_type": kind})
    v = vectors(rows, target)
    names = ["RandomForest", "LogisticRegression" if task == "classification" else "Ridge"]
    specs = small_specs(names, task, cfg)
    cv = M.cross_validate(v, "id", specs, task, 3, cfg)
    metric = M.scoring_metric(task, cfg)
    assert M.ensemble_fold_scores(cv, ["m0", "m1"], task, 3, 3, metric, cfg).count() == 3
    made = M.build_ensemble(v.drop("fold"), cv, specs, ["m0", "m1"], task, cfg)
    out = made.transform(v)
    assert out.count() == 600 and M.score_model(made, v, task) > 0.7


def test_votes(spark):
    d = spark.createDataFrame([(2.0, 1.0, 2.0), (0.0, 2.0, 1.0)], "a double, b double, c double")
    cols = [F.col(c) for c in "abc"]
    assert [r[0] for r in d.select(M.hard_vote(cols)).collect()] == [2.0, 0.0]
    p = spark.createDataFrame([([0.6, 0.4], [0.1, 0.9])], "p array<double>, q array<double>")
    assert p.select(M.soft_vote([F.col("p"), F.col("q")])).first()[0] == 1.0


def test_training_curve_and_class_weights(rows, spark):
    v = vectors(rows, "y")
    model = M.make_estimator(small_specs(["GradientBoosting"], "regression")[0],
                             M.fit_context(v, "regression")).fit(v)
    curve = M.training_curve(model, v, v, "regression")
    assert curve.count() == 6
    best = M.best_round(curve).first()
    assert best["best_round"] == 3
    scaled = M.normalized_losses(curve).agg(F.min("scaled"), F.max("scaled")).first()
    assert tuple(scaled) == (0.0, 1.0)
    three = vectors(rows, "c")
    model = M.make_estimator(small_specs(["GradientBoosting"], "classification")[0],
                             M.fit_context(three, "classification")).fit(three)
    assert M.has_rounds(model)
    losses = {(r["split"], r["round"]): r["loss"] for r in M.training_curve(model, three, three, "classification").collect()}
    assert len(losses) == 6 and losses["train", 3] < losses["train", 1]
    w = M.with_class_weights(rows.withColumn("label", F.col("c").cast("double")))
    assert abs(w.agg(F.sum("weight")).first()[0] - 600) < 1e-9


def test_pick_best_and_ensemble_rule(spark):
    scores = spark.createDataFrame(
        [("a", 0, 0.9), ("a", 1, 0.7), ("b", 0, 0.79), ("b", 1, 0.79), ("c", 0, 0.5), ("c", 1, 0.5),
         ("d", 0, 0.1), ("d", 1, 0.1)], "model string, fold int, score double")
    board = M.leaderboard(scores)
    assert M.pick_best(board).first()["model"] == "a"
    assert M.pick_best(board, "stable").first()["model"] == "b"
    assert M.pick_best(board, "balanced").first()["model"] == "b"
    assert M.ensemble_worthwhile(board).first()["use_ensemble"]
    assert not M.ensemble_worthwhile(board.where("position = 1")).first()["use_ensemble"]


# --- the whole chain ---------------------------------------------------------------------

@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    n = 400
    a, b = rng.normal(size=n), rng.lognormal(size=n)
    word = rng.choice(["red", "green", "blue"], n)
    day = [f"2024-{i % 12 + 1:02d}-{i % 27 + 1:02d}" for i in range(n)]
    df = spark.createDataFrame(
        [(i, float(x), None if i % 50 == 0 else float(y), str(w), d, "yes" if x + (w == "red") > 0.3 else "no")
         for i, (x, y, w, d) in enumerate(zip(a, b, word, day))],
        "id long, a double, b double, word string, day string, target string").cache()
    cfg = AutoMLConfig(features=FeatureConfig(importance_trees=4, importance_depth=4),
                       train=TrainConfig(**{**QUICK.__dict__, "optimize": False, "ensemble": True}))
    small, given = {"n_estimators": 3, "max_depth": 3, "max_iter": 20}, M.default_params
    with pytest.MonkeyPatch.context() as patch:  # small models: the test is about the chain
        patch.setattr(M, "default_params", lambda name, rows: {
            k: small.get(k, v) for k, v in given(name, rows).items()})
        store = H.RunStore(spark, str(tmp_path_factory.mktemp("store") / "runs"))
        return df, run_automl(df, "id", "target", cfg, store, reason="first"), store


def test_run_is_logged(trained):
    _, r, store = trained
    row = H.run_summary(*[store.read(t) for t in ("runs", "run_values", "run_metrics", "run_features", "run_params")]).first()
    assert row["run_id"] == r.run_id and row["task_type"] == "classification"
    assert row["model_name"] == r.trained.name and row["deployment_decision"] == r.decision
    assert row["selected_features"] == sorted(r.features.selected) and row["r2"] is None
    assert abs(row["accuracy"] - r.metrics["accuracy"]) < 1e-12
    assert len(row["hyperparameters"]) == len(r.trained.params)
    won = H.best_compared(store.read("run_comparison")).first()
    assert won["candidates"] == r.trained.leaderboard.count() and won["best_cv_score"] == row["best_score"]
    assert store.read("run_dropped").where("feature is null or reason is null").count() == 0
    if r.trained.curve is not None:
        assert store.read("run_curve").count() == r.trained.curve.count()


def test_full_run(trained):
    df, r, _ = trained
    assert r.prepared.task == "classification" and r.decision in ("deploy", "iterate", "reject")
    assert r.metrics["accuracy"] > r.metrics["baseline_accuracy"]
    assert 0.5 < r.metrics["roc_auc"] <= 1
    assert r.predictions.count() == r.prepared.frame.where("split = 'test'").count()
    assert set(r.importance) == set(r.features.selected)


def test_scoring_raw_rows_batch_and_stream(trained, spark, tmp_path):
    df, r, _ = trained
    # the raw rows of the training split pass validation and give the same predictions as training did
    train_ids = r.prepared.frame.where("split = 'train'").select("id")
    raw = df.join(train_ids, "id", "left_semi").drop("target")
    batch = r.scorer.predict_batch(raw, ["id"])
    assert batch.count() == train_ids.count()
    assert {x["prediction"] for x in batch.select("prediction").distinct().collect()} <= {"yes", "no"}
    raw.write.parquet(str(tmp_path / "in"))
    score_files(spark, str(tmp_path / "in"), raw.schema, r.scorer, ["id"], str(tmp_path / "out"),
                str(tmp_path / "ck")).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((x["id"], x["prediction"]) for x in streamed.collect()) == sorted(
        (x["id"], x["prediction"]) for x in batch.collect())
    bad = raw.withColumn("a", F.lit(1e9))
    with pytest.raises(ValueError):
        r.scorer.predict_batch(bad, ["id"])
    assert rejected_stream(bad, r.scorer, ["id"]).count() == bad.count()


def test_scorer_agrees_with_test_predictions(trained):
    df, r, _ = trained
    raw = df.join(r.predictions.select("id"), "id", "left_semi").drop("target")
    again = {x["id"]: x["prediction"] for x in r.scorer.score(raw, ["id"]).collect()}
    names = {0.0: "no", 1.0: "yes"}
    assert all(again[x["id"]] == names[x["prediction"]] for x in r.predictions.collect())


def test_the_scorer_of_a_run_is_stored(trained, spark, tmp_path):
    df, r, _ = trained
    raw = df.join(r.prepared.frame.where("split = 'train'").select("id"), "id", "left_semi").drop("target")
    S.save_scorer(r.scorer, str(tmp_path / "scorer"))
    again = S.load_scorer(spark, str(tmp_path / "scorer"))
    assert again.steps.to_json() == r.scorer.steps.to_json() and again.schema.feature_order == r.scorer.schema.feature_order
    one, two = (sorted((x["id"], x["prediction"]) for x in s.predict_batch(raw, ["id"]).collect()) for s in (r.scorer, again))
    assert one == two and len(one) == raw.count()
    raw.write.parquet(str(tmp_path / "in"))
    score_files(spark, str(tmp_path / "in"), raw.schema, again, ["id"], str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted((x["id"], x["prediction"]) for x in spark.read.parquet(str(tmp_path / "out")).collect()) == one


# --- history -----------------------------------------------------------------------------

def test_run_history(spark, tmp_path):
    store = H.RunStore(spark, str(tmp_path / "runs"))
    base = {"preprocessing": {"scaler": "auto", "_private": 1}, "training": {"cv": {"folds": 5}}}
    store.log_run("r1", 1, base, {"accuracy": 0.8, "model_name": "RF"}, ["a", "b"])
    store.log_run("r2", 2, {**base, "training": {"cv": {"folds": 3}}}, {"accuracy": 0.9, "model_name": "RF"},
                  ["b", "c"], parent="r1", reason="fewer folds")
    diff = H.compare_last_two(store.read("runs"), store.read("run_values"), store.read("run_features"))
    got = {(r["kind"], r["name"]): (r["before"], r["after"]) for r in diff.collect()}
    assert got == {("config", "cv.folds"): ("5", "3"), ("metric", "accuracy"): ("0.8", "0.9"),
                   ("feature", "a"): ("selected", None), ("feature", "c"): (None, "selected")}
    metrics = store.read("run_metrics")
    assert H.best_run(metrics, "accuracy").first()["run_id"] == "r2"
    assert [r["run_id"] for r in H.search_runs(metrics, "accuracy", 0.85).collect()] == ["r2"]
    assert H.metrics_wide(metrics).count() == 2
    values = store.read("run_values")
    stages = H.changed_stages(H.diff_values(values.where("run_id = 'r1'"), values.where("run_id = 'r2'")))
    assert [r["stage"] for r in stages.collect()] == ["training"]
