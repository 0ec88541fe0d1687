"""Decisions on small planted frames, and statistics against pandas/numpy."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.config import FeatureConfig, PrepareConfig, TrainConfig
from tabloom.functions.columns import normalize_name
from tabloom.operators import checks as C, encode as E, evaluate as V, features as X, prepare as P
from tabloom.operators import profile as Q, quality, rows as R, scale as Z, score as S, types as T
from tabloom.plans.automl import engineer, prepare
from tabloom.sources import tables


def frame(spark, pdf, schema=None):
    clean = pdf.astype(object).where(pdf.notna(), None)
    return spark.createDataFrame([tuple(r) for r in clean.itertuples(index=False)],
                                 schema or list(pdf.columns))


# --- profile -----------------------------------------------------------------------------

def test_duplicates_and_missing(spark):
    df = spark.createDataFrame([(1, 1.0, None), (1, 1.0, None), (2, 2.0, 1), (2, 2.0, 1), (3, None, 0)],
                               "a int, b double, target int")
    row = Q.duplicate_rows(df).first()
    assert (row["duplicate_rows"], row["duplicate_pct"]) == (2, 40.0)
    over = Q.missing_overview(df).first()
    assert (over["total_missing_cells"], over["rows_with_missing"], over["missing_columns_count"]) == (3, 3, 2)
    assert Q.shape_counts(df, "target").first()["feature_count"] == 2


def test_placeholders_cardinality_and_flags(spark):
    rows = [(-999.0 if i < 3 else 100.0 + i, 1.0 + i, f"id{i}", i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "price double, area double, id_col string, target int")
    small = df.limit(10)
    assert [r["column"] for r in Q.numeric_placeholders(small.select("price", "area")).collect()] == ["price"]
    assert [r["column"] for r in Q.high_cardinality(df).collect()] == ["id_col"]
    flags = quality.quality_flags(quality.data_quality(df, "target")).collect()
    assert {f["severity"] for f in flags} <= {"low", "medium", "high"}
    assert "high_cardinality" in {f["field"] for f in flags}


def test_correlation_handles_gaps_and_constants(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.normal(size=200), "b": rng.normal(size=200), "k": 3.0})
    pdf["c"] = 2 * pdf["a"] + 0.01 * pdf["b"]
    pdf.loc[::7, "b"] = np.nan
    got = {(r["col_a"], r["col_b"]): r["r"] for r in
           Q.correlation_matrix(frame(spark, pdf, "a double, b double, k double, c double")).collect()}
    want = pdf.corr()
    for (a, b), r in got.items():
        if math.isnan(want.loc[a, b]):
            assert r is None
        else:
            assert abs(r - want.loc[a, b]) < 1e-9


def test_target_statistics(spark):
    df = spark.createDataFrame([(c,) for c in ["a"] * 30 + ["b"] * 10 + [None] * 2], "t string")
    row = Q.imbalance(df, "t").first()
    assert (row["imbalance_ratio"], row["imbalance_severity"]) == (15.0, "severe")
    assert abs(Q.class_balance(df, "t").first()[0] - 1 / 3) < 1e-12


# --- types and checks --------------------------------------------------------------------

def test_names():
    assert normalize_name("  Hours-per  Week! ") == "hours_per_week"
    assert T.identifier_name("Unnamed: 0") and T.identifier_name("Customer ID") and not T.identifier_name("idea")
    assert X.base_columns("x__mul__y__mul__z") == ["x", "y", "z"]
    assert C.copy_base("signal_copy", ["signal", "signal_copy"]) == "signal"
    assert X.dependents("age", ["age__mul__pay", "wage__mul__pay", "age"]) == ["age__mul__pay"]


def test_types_of_each_kind(spark):
    rows = [(i, float(i) / 3, "yes" if i % 2 else "no", f"2024-01-{i % 28 + 1:02d}", f"w{i % 9}", i % 2,
             str(20240000 + i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, num double, flag string, day string, word string, bit int, "
                                     "digits string")
    assert T.detect_types(df, df.columns[1:]) == {
        "num": "numeric", "flag": "binary", "day": "datetime", "word": "categorical", "bit": "binary",
        "digits": "categorical"}
    assert T.task_type(df, "bit") == "classification" and T.task_type(df, "num") == "regression"
    assert T.task_type(df, "id") == "regression" and T.task_type(df, "flag") == "classification"


def test_date_sample_of_a_sparse_column(spark):
    """A column whose first values come after the table head still gets its own sample."""
    rows = [(i, f"2024-02-{i % 28 + 1:02d}" if i >= 2500 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, day string")
    assert T.datetime_like(df, ["day"]) == ["day"]


def test_identifier_and_variance(spark):
    rows = [(i, f"CUST{i}", float(i), random.Random(i).random(), "k", "b" if i == 7 else "a")
            for i in range(400)]
    df = spark.createDataFrame(rows, "key long, code string, seq double, noise double, const string, "
                                     "near string")
    assert set(T.identifier_columns(df, columns=df.columns[1:])) == {"code", "seq"}
    drops = {d.column: d.reason for d in C.low_variance(df)}
    assert drops == {"const": "constant", "near": "other"}


def test_leakage_and_copies(spark):
    rows = [(i, f"c{i % 3}" if i % 10 else None, f"c{i % 3}" if i % 10 else None, float(i), i * 1.001)
            for i in range(100)]
    df = spark.createDataFrame(rows, "id long, target string, outcome string, signal double, "
                                     "signal_copy double")
    drops, similar = C.target_leakage(df.withColumnRenamed("id", "target_hint"), "target")
    assert [d.column for d in drops] == ["outcome"] and similar == ["target_hint"]
    assert C.copy_columns(df) == ["signal_copy"]


@pytest.mark.parametrize("n,gaps,overrides,want", [
    (1400, {"a": 20}, {}, ("drop_rows", True)),
    (800, {"a": 20}, {}, ("impute", False)),
    (1400, {"a": 300}, {}, ("impute", False)),
    (1400, {"a": 20, "b": 1300}, {}, ("mixed", True)),
    (1400, {"b": 1300}, {}, ("drop_columns", False)),
    (1400, {}, {}, ("none", False)),
    (1400, {"a": 20}, {"protect_rows_from_drop": True}, ("impute", False)),
    (1400, {"a": 300}, {"missing_value_strategy": "drop_rows"}, ("drop_rows", True)),
])
def test_missing_strategy(spark, n, gaps, overrides, want):
    rows = [(None if i < gaps.get("a", 0) else 1.0, None if i < gaps.get("b", 0) else 2.0, 3.0)
            for i in range(n)]
    s = C.missing_strategy(spark.createDataFrame(rows, "a double, b double, c double"),
                           PrepareConfig(**overrides))
    assert (s.strategy, s.drop_rows) == want


def test_missing_strategy_never_drops_every_column(spark):
    df = spark.createDataFrame([(None, None)] * 9 + [(1.0, 2.0)], "a double, b double")
    assert C.missing_strategy(df).drop_columns == ("a",)


def test_drop_plan_order_and_overrides():
    plan = C.merge_drops([C.Drop("a", "identifier", "")], [C.Drop("a", "constant", ""),
                                                           C.Drop("b", "constant", "")],
                         keep=["b"], force=["z", "c"], available=["a", "b", "c"])
    assert [(d.column, d.reason) for d in plan] == [("a", "identifier"), ("c", "manual")]


# --- transforms --------------------------------------------------------------------------

def test_dates(spark):
    day = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    df = spark.createDataFrame([(d, d + dt.timedelta(minutes=61 * i), dt.date(2024, 1, 1))
                                for i, d in enumerate(day)], "d timestamp_ntz, t timestamp_ntz, same date")
    plan = P.fit_dates(df, ["d", "t", "same"])
    assert plan == {"d": ["month", "day", "dayofweek"], "same": ["ordinal"],
                    "t": ["month", "day", "dayofweek", "hour", "minute"]}
    first = P.apply_dates(df, plan).orderBy("t__month", "t__day").first()
    assert first["same__ordinal"] == 738886.0 and first["d__dayofweek"] == 0.0


def test_imputation_and_modes(spark):
    df = spark.createDataFrame([(1.0, "b"), (None, "a"), (3.0, "a"), (10.0, "b"), (None, None)],
                               "num double, cat string")
    assert P.fit_medians(df, ["num"]) == {"num": 3.0}
    assert P.fit_modes(df, ["cat"]) == {"cat": "a"}  # tie: the smaller value
    empty = spark.createDataFrame([(None, None)], "num double, cat string")
    assert P.fit_medians(empty, ["num"]) == {"num": 0.0} and P.fit_modes(empty, ["cat"]) == {"cat": "missing"}
    clean = P.apply_cleaning(df, ["num"], ["cat"], {"num": 3.0}, {"cat": "a"}).collect()
    assert clean[1]["num"] == 3.0 and clean[4]["cat"] == "a"


def test_rare_levels_inline_and_joined(spark, monkeypatch):
    values = [f"big{i % 12}" for i in range(1180)] + [f"rare{i}" for i in range(20)]
    df = spark.createDataFrame([(v,) for v in values], "city string")
    plan = P.fit_rare(df, "city")
    assert plan.inline == sorted(f"rare{i}" for i in range(20))
    inline = sorted(r["city"] for r in P.apply_rare(df, [plan]).collect())
    joined = sorted(r["city"] for r in P.apply_rare(
        df, [P.RareLevels("city", None, plan.table)]).collect())
    assert inline == joined and inline.count("Other") == 20
    many = spark.createDataFrame([(f"zip{i % 240}",) for i in range(1400)], "z string")
    assert P.fit_rare(many, "z") is None  # everything is rare: grouping would hide the column


def test_skew_and_logs(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"value": rng.lognormal(0, 1, 300), "flat": rng.normal(size=300),
                        "few": rng.choice([0.0, 0.0, 0.0, 0.0, 50.0], 300), "low": rng.lognormal(0, 1, 300) - 3})
    df = frame(spark, pdf, "value double, flat double, few double, low double")
    stats = {r["column"]: r["skew"] for r in P.skew_stats(df, list(pdf)).collect()}
    assert all(abs(stats[c] - pdf[c].skew()) < 1e-9 for c in pdf)
    assert P.skewed_columns(df, list(pdf)) == ["value"]
    shifts = P.fit_shifted_logs(df, ["value", "low"])
    assert shifts["value"] == 0.0 and abs(shifts["low"] - (abs(pdf["low"].min()) + 1)) < 1e-12
    gap = spark.createDataFrame([(None,), (-2.0,), (1.0,)], "v double")
    got = [r["v"] for r in P.apply_logs(gap, ["v"]).collect()]
    assert got[0] is None and got[1] == 0.0 and abs(got[2] - math.log(2)) < 1e-12


def test_encodings(spark):
    train = spark.createDataFrame([("a", "yes", f"z{i % 30}") for i in range(60)]
                                  + [("b", "no", "z0")] * 40, "cat string, flag string, zip string")
    plan = E.fit_encodings(train, ["cat", "zip"], ["flag"])
    assert plan.strategy == {"flag": "binary", "cat": "onehot", "zip": "frequency"}
    new = spark.createDataFrame([("a", "yes", "z0"), ("new", "maybe", "zzz")], train.schema)
    got = [tuple(r) for r in E.apply_encodings(new, plan, []).collect()]
    assert E.apply_encodings(new, plan, []).columns == ["flag", "cat__a", "cat__b", "zip__frequency"]
    assert got == [(1.0, 1.0, 0.0, 0.42), (0.0, 0.0, 0.0, 0.0)]
    codes = [r["cat"] for r in E.ordinal_encode(new, train, ["cat"]).collect()]
    assert codes == [0.0, -1.0]


def test_scalers(spark):
    rng = np.random.default_rng(5)
    heavy = np.concatenate([rng.normal(10, 1, 900), np.full(100, 1000.0)])
    df = spark.createDataFrame([(float(v), float(i), 4.0) for i, v in enumerate(heavy)],
                               "heavy double, even double, same double")
    assert Z.choose_scaler(df, ["heavy", "even"]).scaler == "RobustScaler"
    assert Z.choose_scaler(df, ["even", "same"]).scaler == "StandardScaler"
    assert Z.choose_scaler(df, []).scaler == "None"
    std = Z.apply_scaler(df, Z.fit_scaler(df, ["even", "same"], "StandardScaler"))
    row = std.agg(F.avg("even"), F.stddev_pop("even"), F.max("same")).first()
    assert abs(row[0]) < 1e-9 and abs(row[1] - 1) < 1e-9 and row[2] == 0.0
    rob = Z.fit_scaler(df, ["heavy"], "RobustScaler")
    assert abs(rob.center["heavy"] - np.median(heavy)) < 1e-9


# --- features ----------------------------------------------------------------------------

def test_interactions_and_near_zero_denominators(spark):
    df = spark.createDataFrame([(6.0, 3.0, 2.0), (1.0, 0.0, 1.0), (1.0, 1e-9, 1.0)], "x double, y double, z double")
    names = X.interaction_names(["x", "y"], df.columns)
    assert names == ["x__mul__y", "x__div__y", "x__mul__y__mul__z"]
    got = X.add_derived(df, names).collect()
    assert got[0]["x__div__y"] == 2.0 and got[0]["x__mul__y__mul__z"] == 36.0
    assert got[1]["x__div__y"] == 0.0 and got[2]["x__div__y"] == 0.0


def greedy_reference(columns, corr, var, threshold):
    """Plain restatement of the walk over pairs, for comparison."""
    gone = set()
    for i, a in enumerate(columns):
        if a in gone:
            continue
        for b in columns[i + 1:]:
            if b in gone or not abs(corr[a, b]) > threshold:
                continue
            derived = [X.is_derived(c) for c in (a, b)]
            if derived[0] != derived[1]:
                gone.add(a if derived[0] else b)
            elif var[a] != var[b]:
                gone.add(a if var[a] < var[b] else b)
            else:
                gone.add(max(a, b))
    return sorted(gone)


@pytest.mark.parametrize("limit", [50, 3])
def test_correlation_filter_narrow_and_wide(spark, limit):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(300, 3))
    pdf = pd.DataFrame({"a": base[:, 0], "b": base[:, 0] * 2 + 1e-3 * base[:, 1], "c": base[:, 1],
                        "d": base[:, 1] * 0.5, "e": base[:, 2], "a__mul__e": base[:, 0] * 3})
    df = frame(spark, pdf, ", ".join(f"`{c}` double" for c in pdf))
    m = X.moments(df, list(pdf), limit)
    corr = pdf.corr()
    assert all(abs(r - corr.loc[a, b]) < 1e-6 for (a, b), r in m.r.items())
    want = greedy_reference(list(pdf), {(a, b): corr.loc[a, b] for a in pdf for b in pdf},
                            m.variance, 0.95)
    assert X.redundant_columns(list(pdf), m) == want == ["a", "a__mul__e", "d"]


def test_selection_rules():
    order = ["a", "b", "c", "a__mul__b", "c__div__a"]
    scores = {"a": 0.001, "b": 0.002, "c": 0.5, "a__mul__b": 0.4, "c__div__a": 0.005}
    assert X.select_by_score(order, scores) == ["a", "b", "c", "a__mul__b"]
    assert X.select_by_score(order, dict.fromkeys(order, 0.0)) == ["a"]
    assert X.cap_selection(["a", "b", "c", "a__mul__b"], order, scores, 2) == ["a", "b", "c", "a__mul__b"]
    cfg = FeatureConfig(include_features=("c__div__a",), exclude_features=("b",))
    assert X.override_selection(["c", "a__mul__b"], order, cfg) == ["a", "c", "c__div__a"]


def test_engineering_on_odd_names_and_copies(spark):
    rng = np.random.default_rng(9)
    n = 80
    pdf = pd.DataFrame({"key": range(n), "row_id": range(n), "signal": rng.normal(10, 2, n),
                        "hours-per-week": rng.uniform(1, 60, n), "x.y": rng.lognormal(0, 1, n),
                        "category": rng.choice(["a", "b"], n), "constant_noise": 1.0})
    pdf["signal_copy"] = pdf["signal"] * 1.0
    pdf["target"] = pdf["signal"] * 3 + pdf["hours-per-week"]
    pdf.loc[3, "signal"] = np.nan
    pdf.loc[5, "category"] = None
    schema = ("key long, row_id long, signal double, `hours-per-week` double, `x.y` double, category "
              "string, constant_noise double, signal_copy double, target double")
    df = frame(spark, pdf, schema)
    made = engineer(df, "key", "target", "regression", FeatureConfig(importance_trees=5, importance_depth=3))
    kinds = {k for _, k, _ in made.log}
    assert {"drop_index_like_columns", "correlation_filter", "numeric_imputation", "categorical_imputation",
            "generated_interactions", "log1p_transform"} <= kinds
    assert "row_id" not in made.frame.columns and "signal_copy" not in made.frame.columns
    assert abs(sum(made.scores.values()) - 1) < 1e-6
    assert any("hours-per-week" in s for s in made.selected)
    for s in made.selected:
        if X.is_derived(s):
            assert set(X.base_columns(s)) & set(made.frame.columns) <= set(made.selected)
    assert made.apply(df).count() == n


def test_pca_variance(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(200, 4)) * [5, 2, 1, 0.1]
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double, d double")
    plan = X.fit_pca(df, ["a", "b", "c", "d"])
    cov = np.linalg.eigvalsh(np.cov(data.T))[::-1]
    assert np.allclose(plan.explained, cov / cov.sum(), atol=1e-9)
    out = np.array([tuple(r) for r in plan.apply(df).collect()])
    assert np.allclose(out.mean(axis=0), 0, atol=1e-9) and np.allclose(out.var(axis=0, ddof=1), cov, rtol=1e-6)


# --- preparation end to end --------------------------------------------------------------

def test_preparation_rules(spark):
    rng = np.random.default_rng(42)
    n = 1400
    city = [f"city_{i % 12}" for i in range(n - 18)] + [f"tiny_{i % 6}" for i in range(18)]
    pdf = pd.DataFrame({
        "Unnamed: 0": range(n), "customer_id": [f"C{i}" for i in range(n)],
        "value": rng.lognormal(0, 1, n), "extreme": rng.normal(0, 1, n),
        "category_low": rng.choice(["a", "b", "c"], n), "zip_code": [f"z{i % 240}" for i in range(n)],
        "rare_city": rng.permutation(city), "mostly_missing": 1.0 * np.arange(n),
        "event_date": [str(dt.date(2023, 1, 1) + dt.timedelta(days=i % 300)) for i in range(n)],
        "target": rng.choice(["yes", "no"], n)})
    pdf.loc[:39, "extreme"] = 10.0 ** 4
    pdf.loc[40:109, "extreme"] = -10.0 ** 4
    pdf.loc[:19, "value"] = np.nan
    pdf.loc[:19, "category_low"] = None
    pdf.loc[rng.permutation(n)[:1260], "mostly_missing"] = np.nan
    pdf["rowkey"] = range(n)
    types = {"Unnamed: 0": "long", "rowkey": "long", "value": "double", "extreme": "double",
             "mostly_missing": "double"}
    df = frame(spark, pdf, ", ".join(f"`{c}` {types.get(c, 'string')}" for c in pdf))
    got = prepare(df, "rowkey", "target", encode=True)
    reasons = {d.column: d.reason for d in got.drops}
    assert reasons["customer_id"] == "identifier" and reasons["Unnamed: 0"] == "identifier"
    assert reasons["mostly_missing"] == "sparse"
    assert got.strategy == "mixed" and got.frame.count() == n - 20
    assert got.encoding["zip_code"] == "frequency" and got.encoding["category_low"] == "onehot"
    assert got.rare == ["rare_city"] and got.scaler == "RobustScaler" and "value" in got.logged
    assert "event_date__month" in got.frame.columns and "event_date" not in got.frame.columns
    sizes = {r["split"]: r["count"] for r in got.frame.groupBy("split").count().collect()}
    assert sizes == {"train": 1104, "test": 276}
    assert got.encoded.where("zip_code__frequency > 0").count() > 0
    assert not [c for c in got.encoded.columns if got.encoded.where(F.col(f"`{c}`").isNull()).limit(1).count()]


# --- evaluation --------------------------------------------------------------------------

def brute_auc(labels, scores):
    pos = [s for y, s in zip(labels, scores) if y]
    neg = [s for y, s in zip(labels, scores) if not y]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def test_roc_auc_with_ties_and_many_ranges(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(800)]
    df = spark.createDataFrame(rows, "label int, score double")
    want = brute_auc(*zip(*rows))
    assert abs(V.roc_auc(df).first()[0] - want) < 1e-12
    from tabloom.functions import ordering
    original = ordering.running_sums
    monkeypatch.setattr(V, "running_sums", lambda *a, **k: original(*a, **{**k, "per_bucket": 10}))
    assert abs(V.roc_auc(df).first()[0] - want) < 1e-12
    assert V.roc_auc(df.where("label = 1")).first()[0] is None


def test_report_counts_classes_never_predicted_or_never_seen(spark):
    rows = [("a", "a")] * 5 + [("a", "x")] * 2 + [("b", "a")] * 3
    df = spark.createDataFrame(rows, "label string, prediction string")
    counts = V.confusion_counts(df)
    rep = {r["class"]: r for r in V.report_with_averages(counts).collect()}
    assert rep["b"]["precision"] == 0.0 and rep["x"]["recall"] == 0.0 and rep["x"]["support"] == 0
    assert rep["a"]["precision"] == 5 / 8 and rep["a"]["recall"] == 5 / 7
    assert abs(rep["macro avg"]["recall"] - (5 / 7) / 3) < 1e-12
    assert V.confusion_matrix(counts).count() == 9
    assert V.weighted_scores(counts).first()["accuracy"] == 0.5


def test_regression_metrics_and_constant_targets(spark):
    rng = np.random.default_rng(8)
    y = rng.normal(size=100)
    p = y + rng.normal(scale=0.3, size=100)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "label double, prediction double")
    m = V.regression_metrics(df).first()
    assert abs(m["r2"] - (1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9
    assert abs(V.mean_baseline(df).first()["r2"]) < 1e-9
    same = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "label double, prediction double")
    assert V.regression_metrics(same).first()["r2"] == 0.0
    assert V.regression_metrics(same.limit(1)).first()["r2"] == 1.0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 8, 8)], "v double")
    assert [r["n"] for r in V.histogram(df, "v", 8).orderBy("bin").collect()] == [1, 1, 1, 0, 0, 0, 0, 2]
    one = V.histogram(df.where("v = 8"), "v", 8).collect()
    assert len(one) == 1 and one[0]["n"] == 2


# --- scoring -----------------------------------------------------------------------------

def test_validation_messages(spark):
    train = spark.createDataFrame([(20, 1.5, "n"), (60, 9.5, "s"), (40, 5.0, "n")],
                                  "age int, income double, region string")
    schema = S.fit_serving_schema(train, ["age", "income"], ["region"])
    rows = spark.createDataFrame([("30", "2.0", "n"), ("x", "99", "w"), (None, None, None), ("1", "2", "s")],
                                 "age string, income string, region string")
    got = [r["errors"] for r in S.validate_rows(rows, schema).collect()]
    assert got == [[], ["not_numeric:age", "above_max:income", "unexpected_category:region"], [],
                   ["below_min:age"]]
    lacking = S.validate_rows(rows.drop("income"), schema).first()["errors"]
    assert lacking == ["missing:income"]
    ready = S.prepare_rows(rows.where("age IS NULL"), schema).first()
    assert ready["age"] == 40.0 and ready["income"] == 5.0 and ready["region__n"] == 0.0


def test_sources(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    pd.DataFrame({"Unnamed: 0": [0, 1], "a": [1.5, 2.5], "b": ["x", "y"]}).to_csv(path, index=False)
    df = tables.read_table(spark, path)
    assert df.columns == ["a", "b"] and df.count() == 2
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.xlsx")
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert tables.clean_scan(nan).where("v IS NULL").count() == 1
    array = str(tmp_path / "t.json")
    (tmp_path / "t.json").write_text('[{"a": 1}, {"a": 2}]')
    assert tables.read_json(spark, array, records_array=True).count() == 2


def test_row_helpers(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, t string")
    assert R.modeling_rows(df, "t").count() == 1
    with pytest.raises(ValueError):
        R.split_target(df, "nope")
    assert R.align_columns(df, ["id", "new"]).first()["new"] == 0.0


def test_config_defaults():
    cfg = TrainConfig()
    assert (cfg.cv_folds, cfg.n_trials, cfg.ensemble_top_k) == (5, 20, 3)


def test_layout_shapes_lose_no_date(spark):
    import random

    from pyspark.sql import functions as F
    from tabloom.operators import types as T

    rng = random.Random(0)
    days = ["3/4/2021", "03/14/2021", "3/4/2021 7:05", "2021/3/4", "4-Mar-2021", "04-MAR-2021", "Mar 4, 2021", "4.3.2021", "2021-03-04",
            "2021-03-04 10:11:12", " 2021-03-04 ", "2021", "+12021/3/4", "3/4/12021", "N/A", "1-URGENT", "CUST12", "", "12", "3/4/2021 ",
            "31/31/2021", "10.5", "a,1", "T12:00", "4-Mar-2021\t", "2021-3-4T5:6", "\u0663/4/2021"]
    alphabet = "0123456789/-.,: MarTZ+"
    rows = days + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    rows += [list_of[:k] + rng.choice(alphabet) + list_of[k + rng.randrange(2):] for list_of in days for k in range(len(list_of))]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    plain = F.coalesce(F.col("v").try_cast("timestamp_ntz"), *[
        F.try_to_timestamp("v", F.lit(p)).cast("timestamp_ntz") for p in T.DATE_LAYOUTS])
    both = df.select("v", plain.alias("a"), T.parse_timestamp(F.col("v")).alias("b"))
    assert both.where(~F.col("a").eqNullSafe(F.col("b"))).collect() == []
    assert both.where("b is not null").count() > 30
