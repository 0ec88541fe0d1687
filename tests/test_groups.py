"""Trees grown from distinct rows and their counts, against trees grown from the rows."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabloom.operators import trees as T

LIMIT = 30_000  # less than the rows, more than the distinct ones


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    n = 1500
    x = rng.integers(0, 5, (n, 2)).astype(float)
    x[rng.random((n, 2)) < 0.05] = np.nan
    z = np.nan_to_num(x)
    y = z[:, 0] * (z[:, 1] > 2) + rng.normal(scale=0.3, size=n)
    three = (z[:, 0] > 2).astype(int) + (z[:, 1] > 2) * (rng.random(n) < 0.8)
    rows = [(i, Vectors.dense(v), float(a), float(b), float(b > 0), i % 3) for i, (v, a, b) in enumerate(zip(x, y, three))]
    return spark.createDataFrame(rows, ["id", "features", "y", "three", "two", "fold"]).repartition(3).cache()


def _binned(vectors, target, weight=None):
    data = vectors.select("id", "features", F.col(target).alias("label"), "fold", *([F.expr(weight).alias("weight")] if weight else []))
    return T.bin_rows(data, "id", "regression" if target == "y" else "classification")


FITS = [T.Fit("f0", T.TreeParams(False, 6, 5, columns="sqrt", least_rows=2)), T.Fit("f1", T.TreeParams(False, 4, 3), 1),
        T.Fit("f2", T.TreeParams(False, 3, 4, seed=7), 2), T.Fit("b0", T.TreeParams(True, 4, 3, 0.3)),
        T.Fit("b1", T.TreeParams(True, 3, 6, 0.3, leaves=6, columns=0.5, l1=0.01, l2=1.0, least_weight=1.0), 0)]


@pytest.mark.parametrize("target,weight", [("two", None), ("three", None), ("two", "IF(two = 1, 1.7, 0.6)"), ("y", None), ("y", "1 + fold")])
def test_distinct_rows_grow_the_trees_of_all(vectors, target, weight, monkeypatch):
    binned = _binned(vectors, target, weight)
    assert binned.bytes > LIMIT
    rows = T.fit_models(binned, FITS)

    def never(*_):
        raise AssertionError("a level of every round became a job")

    monkeypatch.setattr(T, "_fit_spread", never)
    groups = T.fit_models(binned, FITS, LIMIT)
    for fit, a, b in zip(FITS, rows, groups):
        for name in ("root", "output", "feature", "bin", "left", "rows"):
            assert np.array_equal(getattr(a.trees, name), getattr(b.trees, name)), (fit.tag, name)
        for name in ("value", "gain"):
            one, many = getattr(a.trees, name), getattr(b.trees, name)
            # sums of rounded labels and of rounded differences differ by a unit a row
            near = target == "y" and fit.params.boosted
            assert np.allclose(one, many, rtol=1e-4, atol=1e-5) if near else np.array_equal(one, many), (fit.tag, name)


def test_fits_that_draw_rows_per_round_stay_with_the_rows(vectors):
    binned = _binned(vectors, "two")
    fits = [*FITS, T.Fit("s", T.TreeParams(True, 2, 3, 0.3, rows=0.6))]
    for a, b in zip(T.fit_models(binned, fits), T.fit_models(binned, fits, LIMIT)):
        assert np.array_equal(a.trees.value, b.trees.value) and np.array_equal(a.trees.feature, b.trees.feature)


def test_rows_that_differ_are_not_grouped(vectors):
    binned = _binned(vectors, "two")
    goal = T.Goal.of(binned)
    groups = T.group_rows(binned, goal, LIMIT)
    assert groups.count.sum() == 1500 and len(groups.key) <= 36 * 2 * 3
    assert T.group_rows(binned, goal, 100) is None


def test_routes_end_where_a_walk_ends(vectors):
    binned = _binned(vectors, "three")
    block = T._sent_block(binned)
    for model in T.fit_models(binned, FITS):
        t = model.trees
        for tree in range(len(t.root)):
            want = []
            for row in block.bins.T[:200]:
                node = t.root[tree]
                while t.feature[node] >= 0:
                    node = t.left[node] + (row[t.feature[node]] > t.bin[node])
                want.append(node)
            assert t.route(tree, block.bins[:, :200]).tolist() == want
    assert len(t.route(0, block.bins[:, :0])) == 0
