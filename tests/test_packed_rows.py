"""Binned rows that fit a task packed, and the counting of cells."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tabloom.operators import trees as T

N, WIDTH = 1200, 6
FITS = [T.Fit("f", T.TreeParams(False, 4, 6, columns="sqrt"), 1), T.Fit("b", T.TreeParams(True, 4, 5, 0.3, l2=1.0)),
        T.Fit("s", T.TreeParams(True, 3, 4, 0.3, rows=0.6, columns=0.5), 0)]
ARRAYS = ("root", "output", "feature", "bin", "left", "value", "gain", "rows")


def _binned(spark, classes, weight=None):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(N, WIDTH))
    x[rng.random((N, WIDTH)) < 0.03] = np.nan
    z = np.nan_to_num(x)
    y = z[:, 0] + z[:, 1] * z[:, 2] + rng.normal(scale=0.2, size=N)
    label = np.digitize(y, [0.0, 0.8][:classes - 1]) if classes else y
    rows = [(i, Vectors.dense(v), float(a), i % 3) for i, (v, a) in enumerate(zip(x, label))]
    data = spark.createDataFrame(rows, ["id", "features", "label", "fold"]).repartition(3)
    return T.bin_rows(data.selectExpr("*", f"{weight} AS weight") if weight else data, "id",
                      "classification" if classes else "regression")


@pytest.mark.parametrize("classes,weight,row", [(2, None, 1), (3, None, 1), (2, "1 + fold", 9), (0, None, 8)])
def test_rows_that_fit_packed_are_not_fitted_level_by_level(spark, monkeypatch, classes, weight, row):
    binned = _binned(spark, classes, weight)
    want, held = T.fit_models(binned, FITS), sorted(T.held_out(binned, [f for f in FITS if f.held >= 0]).collect())
    limit = N * (WIDTH + 12 + row)   # the rows packed; all distinct, so that groups take more
    assert binned.bytes > limit

    def never(*_):
        raise AssertionError("a level of every round became a job")

    monkeypatch.setattr(T, "_fit_spread", never)
    for a, b in zip(want, T.fit_models(binned, FITS, limit)):
        assert all(np.array_equal(getattr(a.trees, f), getattr(b.trees, f)) for f in ARRAYS)
    assert sorted(T.held_out(binned, [f for f in FITS if f.held >= 0], limit).collect()) == held


def test_packed_rows_grow_the_trees_of_blocks_that_stay(spark):
    for classes, weight in ((2, None), (3, None), (2, "1 + fold"), (0, None)):
        binned = _binned(spark, classes, weight)
        for a, b in zip(T.fit_models(binned, FITS), T.fit_models(binned, FITS, 0)):
            assert all(np.array_equal(getattr(a.trees, f), getattr(b.trees, f)) for f in ARRAYS), (classes, weight)


def _plain(bins, node, own, times, h, g):
    cells = {}
    for i in range(len(node)):
        for f in range(len(bins)) if own is None else own[node[i] if len(own) > 1 else 0]:
            c = cells.setdefault((int(node[i]) * len(bins) + int(f)) * T.BINS + int(bins[f, i]), np.zeros(2 + len(g), np.int64))
            c += np.array([times[i], h[i], *g[:, i]], np.int64)
    return cells


@pytest.mark.parametrize("rows", [0, 1, 40, 900])
@pytest.mark.parametrize("columns", ["all", "tree", "node"])
def test_cells_are_the_sums_of_their_rows(rows, columns):
    rng = np.random.default_rng(rows)
    bins, node = rng.integers(0, T.BINS, (5, rows)).astype(np.uint8), rng.integers(0, 4, rows)
    own = {"all": None, "tree": np.array([[1, 3]]), "node": np.sort(rng.permuted(np.tile(np.arange(5), (4, 1)), axis=1)[:, :2], axis=1)}[columns]
    times = rng.integers(1, 4, rows)
    for h in (times * float(T.UNIT), rng.integers(0, 99, rows).astype(float)):
        g = rng.integers(-99, 99, (2, rows)).astype(float)
        got, want = T.count_cells(bins, node, 4, own, times, h, g), _plain(bins, node, own, times, h, g)
        assert got.key.tolist() == sorted(want)
        assert [tuple(map(int, (n, a, *b))) for n, a, b in zip(got.n, got.h, got.g.T)] == [tuple(map(int, want[k])) for k in sorted(want)]


def test_only_the_smaller_of_two_children_is_counted(monkeypatch):
    rng = np.random.default_rng(5)
    bins, counted, real = rng.integers(0, T.BINS, (3, 4000)).astype(np.uint8), [], T._tables
    y = (bins[0] > 20).astype(float) + (bins[1] > 9)

    def told(bins, *rest):
        counted.append(bins.shape[1])
        return real(bins, *rest)

    monkeypatch.setattr(T, "_tables", told)
    block = T.Block(bins, y, np.ones(1), np.zeros(4000, np.int32), rng.integers(0, 1 << 62, 4000).astype(np.uint64))
    T.fit_block(block, T.Fit("b", T.TreeParams(True, 1, 4)), T.Goal(0))
    assert counted[0] == 4000 and len(counted) > 1 and max(counted[1:]) <= 2000
