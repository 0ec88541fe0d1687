"""Nothing is dropped above a size: levels, labels, classes, columns; and where scratch tables go."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.config import TrainConfig
from tabloom.functions import scratch
from tabloom.functions.columns import distinct_hashes
from tabloom.operators import encode as E, evaluate as V, features as X, models as M, profile as P
from tabloom.operators import score as S, split as G, types as T


def test_every_serving_level_is_a_feature(spark):
    df = spark.range(600).select(F.col("id").cast("double").alias("x"), F.concat(F.lit("v"), "id").alias("c"))
    schema = S.fit_serving_schema(df, ["x"], ["c"])
    assert len(schema.feature_order) == 601
    row = S.prepare_rows(df.where("c = 'v599'"), schema).first()
    assert row["c__v599"] == 1.0 and row["c__v0"] == 0.0


def test_every_cell_of_the_confusion_matrix(spark):
    pairs = spark.range(600).select(F.col("id").cast("string").alias("label"), F.lit("0").alias("prediction"))
    counts = V.confusion_counts(pairs)
    full = V.confusion_matrix(counts)
    assert full.count() == 360_000 and full.agg(F.sum("n")).first()[0] == 600
    assert V.confusion_matrix(counts, sparse=True).count() == 600


def test_many_classes_get_codes_and_weights(spark):
    df = spark.range(25_000).select("id", F.format_string("k%05d", "id").alias("target"))
    coded = E.with_label_codes(df, "target", E.label_codes(df, "target"))
    assert coded.where(F.col("label") != F.col("id")).count() == 0
    weighted = M.with_class_weights(coded)
    assert weighted.agg(F.min("weight"), F.max("weight")).first() == (1.0, 1.0)


def test_all_columns_are_profiled(spark):
    df = spark.range(30).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(25)])
    got = {r["column"]: r["unique_values"] for r in P.column_profile(df).collect()}
    assert got == {f"c{i}": i + 1 for i in range(25)}
    plan = df.select(*df.columns)._jdf.queryExecution().toString()
    assert "Expand" not in plan


def test_types_read_whole_columns(spark):
    """The first rows are codes, the rest are dates."""
    df = spark.range(1000).select("id", F.when(F.col("id") < 150, F.concat(F.lit("x"), "id")).otherwise(
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).cast("string")).alias("day"))
    assert T.datetime_like(df, ["day"]) == ["day"]


def test_distinct_hashes_counts_exactly(spark):
    df = spark.createDataFrame([(None, "a", None), (1, "a", None), (1, "b", None), (2, None, None)],
                               "a int, b string, c double")
    assert distinct_hashes(df, df.columns) == {"a": 2, "b": 2, "c": 0}


def test_duplicates_tell_nulls_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", None), (None, None)], "a string, b string")
    assert P.duplicate_rows(df).first()["duplicate_rows"] == 1


def test_wide_correlations_with_gaps(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 40)) + np.arange(40) * 100
    x[:, 1] = x[:, 0] * 2 + 1
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 39] = 5.0
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(40)))
    got = {(r.col_a, r.col_b): r.r for r in P.correlation_pairs(df).collect()}
    assert len(got) == 780
    for i, j in ((0, 1), (3, 17), (20, 38)):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert abs(got[f"c{i}", f"c{j}"] - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-9
    assert got["c0", "c39"] is None


def test_weighted_comparison_of_three_classes(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 1)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))],
                               "id long, a double, b double, label double")
    v = scratch.settle(G.assign_folds(
        X.assemble(M.with_class_weights(df), ["a", "b"], keep=["id", "label", "weight"]), "id", 2)).coalesce(1).cache()
    specs = [M.Spec("SVM", "kernel", {"C": 1.0}), M.Spec("GradientBoosting", "boosted_trees", {"n_estimators": 2}),
             M.Spec("LogisticRegression", "linear", {"max_iter": 20}), M.Spec("RandomForest", "tree_ensemble", {"n_estimators": 3})]
    cv = M.cross_validate(v, "id", specs, "classification", 2, TrainConfig(parallelism=4))
    assert cv.failed == {} and len(cv.names) == 4


def test_faults_that_are_not_the_learners_are_raised(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 2)) for i in range(20)], "id long, a double, label double")
    v = G.assign_folds(X.assemble(df, ["a"], keep=["id", "label"]), "id", 2)
    with pytest.raises(ValueError):
        M.cross_validate(v, "id", [M.Spec("NoSuchModel", "linear")], "classification", 2)


def test_failures_stand_in_the_leaderboard(spark):
    board = M.leaderboard(spark.createDataFrame([("a", 0, 0.5)], "tag string, fold int, score double"), "tag")
    rows = {r["tag"]: r for r in M.with_failures(board, {"b": "refused"}).collect()}
    assert rows["a"]["error"] is None and rows["b"]["error"] == "refused" and rows["b"]["position"] is None


def test_scratch_scope_removes_its_tables(spark):
    with scratch.scratch_scope(spark):
        df = scratch.settle(spark.range(3))
        folder = df.inputFiles()[0].rsplit("/", 2)[0]
        assert df.count() == 3
    fs, where = scratch._file_system(spark, folder)
    assert not fs.exists(where)


def test_scratch_refuses_one_machines_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def __init__(self, real):
            self._jvm, self._jsc = real._jvm, real._jsc

    class Conf:
        def __init__(self, named):
            self.named = named

        def get(self, key, default=None):
            return self.named if key == "spark.checkpoint.dir" else "file:/tmp/warehouse"

    from pyspark.sql import SparkSession
    real = SparkSession.getActiveSession()

    class Session:
        def __init__(self, named):
            self.conf, self.sparkContext = Conf(named), Context(real.sparkContext)

    with pytest.raises(ValueError):
        scratch.shared_root(Session(None))
    assert scratch.shared_root(Session("file:/tmp/shared")) == "file:/tmp/shared"
