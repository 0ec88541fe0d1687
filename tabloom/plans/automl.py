"""The whole chain: profile, prepare, engineer, choose, train, evaluate, explain, package."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..config import LIMITS, AutoMLConfig, FeatureConfig, PrepareConfig
from ..functions.columns import numeric_columns, ref
from ..functions.lookups import lookup
from ..functions.scratch import settle
from ..operators import checks as C, encode as E, evaluate as V, features as X, history as H, models as M
from ..operators import prepare as P, quality as Q, rows as R, scale as Z, score as S, split as G
from ..operators import trees as TR, types as T
from ..operators.explain import model_importance
from ..operators.plan import Cleaning, Components, DateParts, Derived, FittedPlan, Logs, RareGroups, ShiftedLogs
from ..operators.profile import class_balance


@dataclass
class Prepared:
    """Result of the preparation stage."""

    frame: DataFrame                  # row_key, features (clean, grouped, logged), target, split
    encoded: DataFrame | None         # row_key, encoded and scaled features, target, split
    task: str
    types: dict[str, str]
    drops: list[C.Drop]
    strategy: str
    medians: dict[str, float]
    modes: dict[str, str]
    rare: list[str]
    logged: list[str]
    encoding: dict[str, str]
    scaler: str
    date_parts: dict[str, list[str]]
    inputs: tuple[list[str], list[str]]  # raw numeric and other columns the kept features need
    plan: FittedPlan                     # the fitted steps, for new raw rows too

    def apply(self, rows: DataFrame) -> DataFrame:
        return self.plan.apply(rows)


def prepare(df: DataFrame, row_key: str, target: str, cfg: PrepareConfig = PrepareConfig(),
            encode: bool = False) -> Prepared:
    """Drops, filters, splits and cleans; every statistic comes from the train split.

    `row_key` identifies rows and is not a feature.
    """
    R.split_target(df, target)
    features = [c for c in df.columns if c not in (target, row_key)]
    date_plan = P.fit_dates(df, T.datetime_like(df, features))
    wide = P.apply_dates(df, date_plan)
    features = [c for c in wide.columns if c not in (target, row_key)]

    facts = T.column_facts(wide, features)
    ids = [C.Drop(c, "identifier", why)
           for c, why in T.identifier_columns(wide, cfg, features, facts).items()]
    leaks, _ = C.target_leakage(wide, target, features)
    missing = C.missing_strategy(wide, cfg, features)
    drops = C.merge_drops(ids, C.low_variance(wide, cfg, features, facts), leaks,
                          C.sparse_drops(missing), keep=cfg.force_keep_columns,
                          force=cfg.force_drop_columns, available=features)
    gone = {d.column for d in drops}
    kept = [c for c in features if c not in gone]
    model_rows = R.modeling_rows(wide.select(ref(row_key), *[ref(c) for c in kept], ref(target)),
                                 target, kept, missing.drop_rows)
    types = T.detect_types(model_rows, kept)
    task = T.task_type(model_rows, target)

    split = settle(G.train_test_split(model_rows, row_key, target if task == "classification" else None,
                                      cfg.test_size, cfg.seed), "split")
    train = split.where(F.col("split") == "train")
    numeric = [c for c in kept if types[c] == "numeric"]
    categorical = [c for c in kept if types[c] == "categorical"]
    binary = [c for c in kept if types[c] == "binary"]
    text = categorical + binary
    medians, modes = P.fit_medians(train, numeric), P.fit_modes(train, text)

    cleaning = Cleaning(numeric, text, medians, modes)
    clean_train = cleaning.apply(train)
    rare_plans = [p for p in (P.fit_rare(clean_train, c, cfg) for c in categorical) if p] \
        if cfg.rare_category_grouping else []
    grouped_train = P.apply_rare(clean_train, rare_plans)
    logged = P.skewed_columns(grouped_train, numeric, cfg.skew_threshold)
    scaler = Z.choose_scaler(grouped_train, numeric, cfg)

    # few rare levels are listed in the plan, many stay a table
    finish = FittedPlan([cleaning, *[RareGroups(p.column, p.inline, p.table if p.inline is None else None) for p in rare_plans],
                         Logs(logged)])
    ready = settle(finish.apply(split), "prepared")

    raw = [c for c in df.columns if c in kept
           or any(f"{c}__{p}" in kept for p in date_plan.get(c, ()))]
    inputs = ([c for c in raw if types.get(c) == "numeric"],
              [c for c in raw if types.get(c) != "numeric"])

    strategy = C.final_strategy(missing, bool(medians or modes),
                                any(d.reason == "sparse" for d in drops))
    encoded, encoding = None, {}
    if encode:
        ready_train = ready.where(F.col("split") == "train")
        plan = E.fit_encodings(ready_train, categorical, binary, cfg)
        encoding = plan.strategy
        matrix = E.apply_encodings(ready, plan, numeric, keep=[row_key, target, "split"])
        scaling = Z.fit_scaler(ready_train, numeric, scaler.scaler)
        encoded = Z.apply_scaler(matrix, scaling)
    return Prepared(ready, encoded, task, types, drops, strategy, medians, modes,
                    [p.column for p in rare_plans], logged, encoding, scaler.scaler, date_plan,
                    inputs, FittedPlan([DateParts(date_plan)]) + finish)


@dataclass
class Engineered:
    """Result of the feature stage."""

    frame: DataFrame
    selected: list[str]
    numeric: list[str]
    categorical: list[str]
    generated: list[str]
    scores: dict[str, float]
    log: list[tuple[int, str, list[str]]]
    plan: FittedPlan                     # the fitted steps, for new prepared rows too
    shifts: dict[str, float] = field(default_factory=dict)
    explained: list[float] | None = None

    def apply(self, rows: DataFrame) -> DataFrame:
        return self.plan.apply(rows)

    def log_frame(self) -> DataFrame:
        return self.frame.sparkSession.createDataFrame(
            self.log, "seq int, type string, columns array<string>")


def engineer(df: DataFrame, row_key: str, target: str, task: str,
             cfg: FeatureConfig = FeatureConfig(), keep: Sequence[str] = ("split",)) -> Engineered:
    """Adds interactions, filters redundant and unimportant columns, and selects features.

    Statistics come from all rows, or only from the train split with cfg.fit_on = "train".
    """
    keep = [c for c in keep if c in df.columns]
    log: list[tuple[int, str, list[str]]] = []

    def note(kind: str, columns: Sequence[str]) -> None:
        if columns:
            log.append((len(log), kind, list(columns)))

    def fit_rows(frame):
        return frame.where(F.col("split") == "train") if cfg.fit_on == "train" and "split" in keep \
            else frame

    special = {row_key, target, *keep}
    columns = [c for c in df.columns if c not in special]
    indexes = [c for c in columns if T.index_like_name(c)]
    note("drop_index_like_columns", sorted(indexes))
    columns = [c for c in columns if c not in indexes]
    numeric = [c for c in columns if c in set(numeric_columns(df))]
    copies = C.copy_columns(fit_rows(df), cfg.correlation_threshold, numeric)
    note("correlation_filter", copies)
    columns = [c for c in columns if c not in copies]
    numeric = [c for c in numeric if c not in copies]
    text = [c for c in columns if c not in numeric]

    medians, modes = P.fit_medians(fit_rows(df), numeric), P.fit_modes(fit_rows(df), text)
    note("numeric_imputation", list(medians))
    note("categorical_imputation", list(modes))
    steps: list = [Cleaning(list(numeric), text, medians, modes)]
    frame = steps[0].apply(df.select(ref(row_key), ref(target), *[ref(k) for k in keep], *[ref(c) for c in columns]))
    shifts = P.fit_shifted_logs(fit_rows(frame), numeric)
    note("log1p_transform", list(shifts))
    steps.append(ShiftedLogs(shifts))
    frame = steps[-1].apply(frame)

    generated: list[str] = []
    if cfg.use_interactions:
        sources = X.top_variance(X.variances(fit_rows(frame), numeric), cfg.interaction_sources)
        generated = X.interaction_names(sources, columns) if sources else []
        note("generated_interactions", generated)
        steps.append(Derived(list(generated)))
        frame = steps[-1].apply(frame)
    columns, numeric = columns + generated, numeric + generated
    redundant = X.redundant_columns(numeric, X.moments(fit_rows(frame), numeric, at_least=cfg.correlation_threshold),
                                    cfg.correlation_threshold)
    note("correlation_filter", redundant)
    columns = [c for c in columns if c not in redundant]
    generated = [c for c in generated if c not in redundant]

    frame = frame.where(ref(target).isNotNull()).select(
        ref(row_key), ref(target), *[ref(k) for k in keep], *[ref(c) for c in columns])
    frame = settle(frame, "engineered")
    text = [c for c in columns if c in text]
    rows = fit_rows(frame)
    coded = E.ordinal_encode(rows, rows, text)
    if task == "classification":
        coded = E.with_label_codes(coded, target, settle(E.label_codes(rows, target), "classes"), "_label")
    else:
        coded = coded.withColumn("_label", ref(target).cast("double"))
    scores = X.forest_importance(coded, columns, "_label", task == "classification", cfg)

    selected = X.select_by_score(columns, scores, cfg)
    low = [c for c in columns if c not in selected]
    selected = X.override_selection(selected, columns, cfg)
    note("feature_importance_filter", sorted(c for c in low if c not in selected))
    capped = X.cap_selection(selected, columns, scores, cfg.n_features_to_select)
    note("selection_cap", sorted(set(selected) - set(capped)))
    selected, reduced = capped, None
    if cfg.use_pca:
        numbers, words = X.split_selected(frame, selected)
        reduced = X.fit_pca(fit_rows(frame), numbers, cfg.n_pca_components)
        if reduced:
            steps.append(Components(list(reduced.columns), reduced.means, reduced.weights, list(reduced.components)))
            frame = steps[-1].apply(frame)
            selected = words + reduced.components
            generated = [g for g in generated if g not in numbers] + reduced.components
            note("pca", reduced.components)
    numbers, words = X.split_selected(frame, selected)

    return Engineered(frame, selected, numbers, words, generated, scores, log, FittedPlan(steps), shifts,
                      reduced.explained if reduced else None)


@dataclass
class Trained:
    model: Any
    name: str
    leaderboard: DataFrame
    cv: M.CrossValidation | None
    params: dict[str, Any]
    train_score: float
    test_score: float
    ensemble: list[str] | None
    seconds: float
    trials: DataFrame | None = None      # model, trial, cv_mean, params of a search
    curve: DataFrame | None = None       # round, split, loss of a boosted model


def train(vectors: DataFrame, row_key: str, specs: Sequence[M.Spec], task: str,
          cfg: AutoMLConfig = AutoMLConfig()) -> Trained:
    """Compares candidates on folds of the train split, tunes, fits the winner, maybe an ensemble.

    `vectors` holds row_key, label, features, split.
    """
    t, metric = cfg.train, M.scoring_metric(task, cfg.train)
    fit_rows = vectors.where(F.col("split") == "train").drop("split")
    if t.class_weights and task == "classification":
        fit_rows = M.with_class_weights(fit_rows)
    rows = fit_rows.count()
    folds = max(2, G.comparison_folds(t.cv_folds, rows) if t.multi_model
                else G.single_folds(t.cv_folds, rows))
    folded = settle(G.assign_folds(fit_rows, row_key, folds,
                                   "label" if task == "classification" else None, t.seed), "folds")
    specs = list(specs) if t.multi_model else list(specs)[:1]
    trials, binned = None, {}
    inner = max(2, G.search_folds(folds, rows))
    if any(s.name in M.TREES for s in specs):  # rows are binned once for all fits on the same folds
        binned[folds] = TR.bin_rows(folded, row_key, task)
    if t.optimize and t.n_trials > 0:
        search_rows = folded if inner == folds else settle(folded.withColumn("fold", F.col("fold") % inner), "search-folds")
        if binned and inner != folds:
            binned[inner] = TR.bin_rows(search_rows, row_key, task)
        # searches do not know of each other, so that one fills the tasks that another leaves idle at the end of a generation
        found = M.fit_all([lambda s=s: M.SEARCHES[t.search](search_rows, row_key, s, task, inner, t, binned.get(inner))
                           if s.space else (s, None) for s in specs], t.parallelism)
        boards = [board.withColumn("model", F.lit(s.name)) for s, (_, board) in zip(specs, found) if board is not None]
        specs = [s for s, _ in found]
        trials = reduce(DataFrame.unionByName, boards) if boards else None
    cv = M.cross_validate(folded, row_key, specs, task, folds, t, metric, binned=binned.get(folds))
    board = settle(M.leaderboard(cv.scores, by="tag").join(
        cv.scores.select("tag", "model").distinct(), "tag"), "leaderboard")
    shown = M.with_failures(board, cv.failed)
    order = board.orderBy("position").collect()
    winner = specs[int(order[0]["tag"][1:])]
    start = time.perf_counter()
    test_rows = vectors.where(F.col("split") == "test")
    single = M.fit_single(folded.drop("fold"), test_rows, winner, task, t, binned.get(folds))
    model, name, test_score, members = single.model, winner.name, single.test_score, None
    if t.ensemble and len(order) >= 2 and M.ensemble_worthwhile(board).first()["use_ensemble"]:
        top = order[:t.ensemble_top_k]
        tags = [r["tag"] for r in top]
        classes = M.fit_context(folded, task).classes
        combined = M.ensemble_fold_scores(cv, tags, task, classes, folds, metric, t).agg(
            F.avg("score")).first()[0]
        if combined > order[0]["cv_mean"]:
            members = [r["model"] for r in top]
            model = M.build_ensemble(folded.drop("fold"), cv,
                                     [specs[int(g[1:])] for g in tags], tags, task, t, binned.get(folds))
            name = f"Ensemble ({', '.join(members)})"
            test_score = M.score_model(model, test_rows, task)
    for rows_of in binned.values():
        rows_of.release()
    # the curve is that of the winner itself, whether or not an ensemble took its place
    curve = M.training_curve(single.model, folded, test_rows, task) \
        if M.has_rounds(single.model) and test_rows.count() else None
    return Trained(model, name, shown, cv, dict(winner.params), single.train_score, test_score, members,
                   time.perf_counter() - start, trials, curve)


@dataclass
class AutoMLResult:
    quality: DataFrame
    prepared: Prepared
    features: Engineered
    specs: list[M.Spec]
    trained: Trained
    predictions: DataFrame
    metrics: dict[str, Any]
    decision: str
    recommendation: str
    importance: dict[str, float]
    scorer: S.Scorer
    run_id: str | None = None            # its name in the run store, if there is one


def spread_out(df: DataFrame, row_key: str) -> DataFrame:
    """The raw rows as every stage reads them again: joins and scans behind them run once, and a table of many rows lies in as many even
    parts as there are tasks at a time."""
    rows, spark = df.count(), df.sparkSession
    # what cannot be hashed or written stays as it is
    if rows <= LIMITS.small_table_rows or any(k in kind for _, kind in df.dtypes for k in ("map<", "void", "interval", "variant")):
        return df
    parts = max(spark.sparkContext.defaultParallelism, -(-rows // LIMITS.rows_per_bucket))
    # by all columns, so that keys that repeat or are missing do not meet; sorted, so that parts come out alike in every run
    return settle(df.repartition(parts, *[ref(c) for c in df.columns]).sortWithinPartitions(ref(row_key)), "raw")


def run_automl(df: DataFrame, row_key: str, target: str, cfg: AutoMLConfig = AutoMLConfig(),
               store: H.RunStore | None = None, parent: str | None = None,
               reason: str | None = None) -> AutoMLResult:
    """All stages in order. Frames that later stages re-read are written to the shared folder.

    With a `store` the run's settings, metrics, features, comparison, trials and curve are appended to it."""
    df = spread_out(df, row_key)
    quality = Q.data_quality(df.drop(row_key), target)
    ready = prepare(df, row_key, target, cfg.prepare)
    task = ready.task
    made = engineer(ready.frame, row_key, target, task, cfg.features)

    signals = M.TableSignals(
        rows=made.frame.count(), features=len(made.selected),
        class_balance=class_balance(made.frame, target).first()[0] if task == "classification" else 1.0,
        **_signal_counts(quality))
    specs = M.build_specs(M.choose_candidates(task, signals), task, signals.rows, cfg.train)

    train_rows = made.frame.where(F.col("split") == "train")
    codes = {c: settle(t, "levels") for c, t in S.ordinal_codes(train_rows, made.categorical).items()}
    coded = made.frame
    for c, table in codes.items():
        order = coded.columns
        coded = lookup(coded, c, table, F.lit(-1.0), "_code").withColumn(c, F.col("_code")).select(
            *[ref(o) for o in order])
    if task == "classification":
        names = settle(E.label_codes(made.frame, target), "classes")
        labelled = E.with_label_codes(coded, target, names)
    else:
        labelled = coded.withColumn("label", ref(target).cast("double"))
    vectors = settle(X.assemble(labelled, made.selected, keep=[row_key, "label", "split"]), "vectors")
    fitted = train(vectors, row_key, specs, task, cfg)

    scored = fitted.model.transform(vectors.where(F.col("split") == "test"))
    prob = M.class_probabilities(scored)
    columns = [ref(row_key), F.col("label"), F.col("prediction")]
    if task == "classification" and prob is not None:
        columns.append(prob.alias("probability"))
    predictions = settle(scored.select(*columns), "predictions")
    metrics = evaluate(predictions, task, fitted)
    verdict = predictions.sparkSession.createDataFrame(
        [{k: v for k, v in metrics.items() if isinstance(v, float)}]).withColumn(
        "gap", F.col("train_score") - F.col("test_score")).withColumn(
        "decision", V.decision(task, cfg.evaluate)).select(
        "decision", V.recommendation(task)[0].alias("recommendation")).first()

    # ranges and levels come from the raw training rows; dates are not restricted to seen levels
    numeric_in, other_in = ready.inputs
    raw_train = R.rows_with_keys(df, train_rows.select(ref(row_key)), row_key)
    schema = S.fit_serving_schema(raw_train, numeric_in,
                                  [c for c in other_in if c not in ready.date_parts], made.selected)
    # the model has one score per class, so its names are no longer list than it
    classes = [r["value"] for r in names.orderBy("stat").collect()] if task == "classification" else []
    scorer = S.Scorer(schema, fitted.model, task, classes, codes, ready.plan + made.plan)
    result = AutoMLResult(quality, ready, made, specs, fitted, predictions, metrics, verdict["decision"],
                          verdict["recommendation"], model_importance(fitted.model, made.selected), scorer)
    if store is not None:
        result.run_id = uuid.uuid4().hex
        log_result(store, result, cfg, parent, reason)
    return result


#: Steps of the feature stage that take columns away.
DROPPING = ("drop_index_like_columns", "correlation_filter", "feature_importance_filter", "selection_cap")


def log_result(store: H.RunStore, result: AutoMLResult, cfg: AutoMLConfig, parent: str | None = None,
               reason: str | None = None) -> None:
    """Publishes a finished run in the store as a whole; runs are ordered by the time they are logged at."""
    run_id, fitted, new = result.run_id, result.trained, store.spark.createDataFrame
    settings = {"preprocessing": asdict(cfg.prepare), "feature_engineering": asdict(cfg.features),
                "training": asdict(cfg.train), "evaluation": asdict(cfg.evaluate)}
    best = fitted.leaderboard.where("position = 1").first()
    facts = {**result.metrics, "best_score": best["cv_mean"] if best else None, "task_type": result.prepared.task,
             "model_name": fitted.name, "deployment_decision": result.decision}
    # a column's last drop is the one that counts
    dropped = {d.column: d.reason for d in result.prepared.drops}
    dropped |= {c: kind for _, kind, columns in result.features.log if kind in DROPPING for c in columns
                if c not in result.features.selected}
    with store.attempt(run_id):
        store.log_run(run_id, time.time_ns() // 1000, settings, facts, result.features.selected, parent, reason)
        store.log_params(run_id, fitted.params)
        store.log_table("run_dropped", run_id, new(list(dropped.items()), "feature string, reason string"))
        store.log_table("run_comparison", run_id, fitted.leaderboard)
        if fitted.trials is not None:
            store.log_table("run_trials", run_id, fitted.trials.withColumn("value", F.col("cv_mean")))
        if fitted.curve is not None:
            store.log_table("run_curve", run_id, fitted.curve)


def _signal_counts(quality: DataFrame) -> dict[str, int]:
    q = quality.first()
    return {"high_missing_columns": q["high_missing_count"], "high_correlations": q["high_corr_count"],
            "outlier_columns": q["outlier_columns_count"]}


def evaluate(predictions: DataFrame, task: str, fitted: Trained) -> dict[str, Any]:
    """Test metrics beside the baseline's and the train score."""
    out: dict[str, Any] = {"train_score": float(fitted.train_score),
                           "test_score": float(fitted.test_score)}
    if task == "classification":
        out.update(V.weighted_scores(V.confusion_counts(predictions)).first().asDict())
        out["baseline_accuracy"] = V.majority_baseline(predictions).first()["accuracy"]
        if "probability" in predictions.columns:
            n = predictions.select(F.size("probability")).first()[0]
            if n == 2:
                binary = predictions.select("label", F.col("probability")[1].alias("score"))
                out["roc_auc"] = V.roc_auc(binary).first()[0]
            else:
                text = predictions.withColumn("label", F.col("label").cast("int").cast("string"))
                out["roc_auc"] = V.roc_auc(text, classes=[str(i) for i in range(n)]).first()[0]
    else:
        out.update(V.regression_metrics(predictions).first().asDict())
        out["baseline_rmse"] = V.mean_baseline(predictions).first()["rmse"]
    return out

