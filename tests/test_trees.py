"""Histogram trees and ridge Gram matrices: equal on one block and on many, and equal to plain computations."""

import heapq

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabloom.operators import models as M, split as G, trees as T
from tabloom.operators.ridge import fold_grams, held_scores, solve_without

BOOST = T.TreeParams(True, 4, 3, 0.3)
KINDS = {
    "plain": BOOST,
    "sampled": T.TreeParams(True, 3, 4, 0.3, rows=0.7, columns=0.5, l1=0.01, l2=1.0, least_weight=1.0, least_gain=0.001),
    "leaves": T.TreeParams(True, 3, 6, 0.3, leaves=7, least_rows=5),
    "forest": T.TreeParams(False, 5, 5, columns="sqrt", least_rows=2),
}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    n = 500
    x = np.round(rng.normal(size=(n, 4)), 2)
    x[rng.random((n, 4)) < 0.05] = np.nan
    z = np.nan_to_num(x)
    y = np.where(z[:, 0] > 0.2, 3.0, -1.0) + z[:, 1] ** 2 + rng.normal(scale=0.1, size=n)
    three = (z[:, 0] > 0).astype(int) + (z[:, 1] > 0.5)
    rows = [(i, Vectors.dense(v), float(a), float(b), float(b > 0), i % 3) for i, (v, a, b) in enumerate(zip(x, y, three))]
    return spark.createDataFrame(rows, _schema()).repartition(3).cache()


def _schema():
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as t

    return t.StructType([t.StructField("id", t.LongType()), t.StructField("features", VectorUDT()),
                         *[t.StructField(c, t.DoubleType()) for c in ("y", "three", "two")], t.StructField("fold", t.IntegerType())])


def labelled(vectors, target):
    return vectors.select("id", "features", F.col(target).alias("label"), "fold")


@pytest.mark.parametrize("target", ["y", "two", "three"])
def test_many_blocks_grow_the_trees_of_one(vectors, target):
    task = "regression" if target == "y" else "classification"
    binned = T.bin_rows(labelled(vectors, target), "id", task)
    assert binned.blocks.count() >= 3
    kinds = KINDS if target == "y" else {k: KINDS[k] for k in ("sampled", "forest")}
    fits = [T.Fit(name, p, k % 3 if k else -1) for k, (name, p) in enumerate(kinds.items())]
    for one, many in zip(T.fit_models(binned, fits), T.fit_models(binned, fits, limit=0)):
        for name in ("root", "output", "feature", "bin", "left", "value", "gain", "rows"):
            assert np.array_equal(getattr(one.trees, name), getattr(many.trees, name)), name
    if target == "two":
        assert sorted(map(tuple, T.held_out(binned, fits).collect())) == sorted(map(tuple, T.held_out(binned, fits, 0).collect()))


def test_parts_of_a_forest_are_the_forest(vectors):
    binned = T.bin_rows(labelled(vectors, "three"), "id", "classification")
    params = T.TreeParams(False, 23, 4, columns="sqrt")
    cut = T.fit_models(binned, [T.Fit("f", params)])[0]                                     # alone: cut into parts
    whole = T.fit_models(binned, [T.Fit(f"f{i}", params, i % 3 - 1) for i in range(12)])[0]  # many fits: one task each
    for name in ("root", "output", "feature", "bin", "left", "value", "gain", "rows"):
        assert np.array_equal(getattr(cut.trees, name), getattr(whole.trees, name)), name
    assert len(cut.trees.root) == 23


def test_jobs_do_not_grow_with_fits(vectors, spark):
    binned = T.bin_rows(labelled(vectors, "y"), "id", "regression")
    counts = []
    for n in (1, 6):
        spark.sparkContext.setJobGroup(f"fits-{n}", "count jobs")
        T._fit_spread(binned, [T.Fit(f"f{i}", T.TreeParams(True, 2, 3, 0.1 + i / 10), i % 3) for i in range(n)], T.Goal.of(binned))
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fits-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] <= counts[0] + 4


def _best_first(x, r, leaves, least):
    """Plain growth by the greatest gain over all thresholds of all columns; the predictions of the rows."""
    def split(rows):
        best = None
        for f in range(x.shape[1]):
            for v in np.unique(x[rows, f])[:-1]:
                a, b = rows[x[rows, f] <= v], rows[x[rows, f] > v]
                if min(len(a), len(b)) >= least:
                    gain = r[a].sum() ** 2 / len(a) + r[b].sum() ** 2 / len(b) - r[rows].sum() ** 2 / len(rows)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                        best = gain, a, b
        return best

    out, heap, number, done = np.zeros(len(r)), [], 0, [np.arange(len(r))]
    first = split(done[0])
    if first:
        heap, done = [(-first[0], 0, done[0], first)], []
    count = 1
    while heap:
        _, _, rows, (_, a, b) = heapq.heappop(heap)
        if count >= leaves:
            done.append(rows)
            continue
        count += 1
        for part in (a, b):
            found = split(part)
            number += 1
            if found:
                heapq.heappush(heap, (-found[0], number, part, found))
            else:
                done.append(part)
    for rows in done:
        out[rows] = r[rows].mean()
    return out


@pytest.mark.parametrize("leaves", [2, 5, 9])
def test_growth_by_leaves_is_best_first(leaves):
    rng = np.random.default_rng(leaves)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = x[:, 0] * (x[:, 1] > 6) + rng.normal(size=300)
    edges = [np.unique(c)[:-1] for c in x.T]
    block = T.Block(T.bin_values(x, edges), y, np.ones(300), np.zeros(300, np.int32), np.arange(300, dtype=np.uint64))
    goal = T.Goal(0, float(y.mean()), float(y.std()), (0.0,))
    trees, margins = T.fit_block(block, T.Fit("t", T.TreeParams(True, 1, 20, 1.0, leaves=leaves, least_rows=3)), goal)
    want = _best_first(x, (y - y.mean()) / y.std(), leaves, 3)
    assert np.allclose(margins[0], want, atol=1e-5)


def test_a_planted_step_equals_sparks_tree(spark):
    from pyspark.ml.regression import DecisionTreeRegressor

    rng = np.random.default_rng(0)
    x = rng.integers(0, 20, 400)
    rows = spark.createDataFrame([(i, Vectors.dense([float(v)]), 5.0 if v > 11 else 2.0) for i, v in enumerate(x)], ["id", "features", "label"])
    own = T.TreeLearner(T.TreeParams(True, 1, 1, 1.0), "regression").fit(rows).transform(rows).select("id", "prediction").collect()
    theirs = DecisionTreeRegressor(maxDepth=1).fit(rows).transform(rows).select("id", "prediction").collect()
    assert {r["id"]: round(r["prediction"], 4) for r in own} == {r["id"]: round(r["prediction"], 4) for r in theirs}


def test_a_model_is_stored_as_data(vectors, spark, tmp_path):
    data = labelled(vectors, "three")
    binned = T.bin_rows(data, "id", "classification")
    for kind, model in zip(("boosted", "forest"), T.fit_models(binned, [T.Fit("a", BOOST), T.Fit("b", KINDS["forest"])])):
        model.save(spark, str(tmp_path / kind))
        again = T.TreeModel.load(spark, str(tmp_path / kind))
        both = [{r["id"]: (r["prediction"], tuple(r["probability"].toArray())) for r in m.transform(data).collect()} for m in (model, again)]
        assert both[0] == both[1] and M.score_model(again, data, "classification") > 0.85
        assert abs(model.featureImportances.toArray().sum() - 1) < 1e-9
        again = T.fit_models(binned, [T.Fit("a", model.params)])[0]  # fits are reproducible
        assert np.array_equal(again.trees.value, model.trees.value)


def test_losses_fall_and_rows_do_not_matter(vectors):
    data = labelled(vectors, "two")
    learner = T.TreeLearner(BOOST, "classification")
    model = learner.fit(data)
    losses = model.losses(data)
    assert len(losses) == model.rounds == 4 and losses == sorted(losses, reverse=True)
    again = learner.fit(data.repartition(7))
    assert np.array_equal(again.trees.value, model.trees.value) and np.array_equal(again.trees.bin, model.trees.bin)


def test_one_class_and_constant_columns(spark):
    rows = spark.createDataFrame([(i, Vectors.dense([1.0, float("nan")]), 0.0) for i in range(20)], ["id", "features", "label"])
    for params in (BOOST, KINDS["forest"]):
        scored = T.TreeLearner(params, "classification").fit(rows).transform(rows)
        assert scored.where("prediction <> 0").count() == 0 and scored.first()["probability"].toArray().tolist() == [1.0]
        number = T.TreeLearner(params, "regression").fit(rows).transform(rows)
        assert number.where("prediction <> 0").count() == 0
    with pytest.raises(ValueError):
        T.TreeLearner(T.TreeParams(True, 0, 3), "regression").fit(rows)


# --- ridge -------------------------------------------------------------------------------

def test_ridge_folds_and_penalties_from_one_scan(spark):
    rng = np.random.default_rng(7)
    n, k = 300, 6
    x = rng.normal(size=(n, k)) * [1, 10, 0.1, 1, 1, 1000] + 5
    x[:, 4] = x[:, 3]  # singular without a penalty
    y = x @ rng.normal(size=k) + rng.normal(size=n) + 100
    fold = np.arange(n) % 4
    rows = spark.createDataFrame([(Vectors.dense(v), float(b), int(f)) for v, b, f in zip(x, y, fold)],
                                 ["features", "label", "fold"]).repartition(5).withColumn("fold", F.col("fold").cast("int"))
    grams = fold_grams(rows)
    penalties = {"a": 0.01, "b": 3.0, "c": 500.0}
    got = {(t, f): s for t, f, s in held_scores(grams, 4, penalties)}
    for f in range(4):
        a, b = x[fold != f], y[fold != f]
        for (tag, p), model in zip(penalties.items(), solve_without(grams, f, list(penalties.values()))):
            c = a - a.mean(0)
            w = np.linalg.solve(c.T @ c + p * np.eye(k), c.T @ (b - b.mean()))
            assert np.allclose(model.coef, w, atol=1e-6)
            held, want = x[fold == f], y[fold == f]
            e = want - (b.mean() + (held - a.mean(0)) @ w)
            assert abs(got[tag, f] - (1 - (e @ e) / ((want - want.mean()) ** 2).sum())) < 1e-7
    first = solve_without(grams, None, [0.0])[0]
    scored = first.transform(rows).select(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0]
    assert scored < 2


def test_a_ridge_search_is_a_few_jobs_for_any_trials(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, Vectors.dense(rng.normal(size=60)), float(i % 7)) for i in range(400)], ["id", "features", "label"])
    folded = G.assign_folds(rows, "id", 5).cache()
    folded.count()
    counts = []
    for trials in (2, 40):
        spark.sparkContext.setJobGroup(f"trials-{trials}", "count jobs")
        spec = M.build_specs(["Ridge"], "regression", 400)[0]
        _, board = M.random_search(folded, "id", spec, "regression", 5, M.TrainConfig(n_trials=trials))
        assert board.count() == trials
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trials-{trials}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1]
