"""What the fits of a run share: counted pairs of features, rows that are binned and sent once, searches side by side, even parts."""

import threading
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabloom.config import LIMITS, AutoMLConfig, TrainConfig
from tabloom.operators import models as M, trees as T
from tabloom.plans import automl as A

RNG = np.random.default_rng(11)
ROWS, WIDTH = 3000, 7
BINNED = RNG.integers(0, T.BINS, (WIDTH, ROWS)).astype(np.uint8)


def _block(label, weight=None):
    return T.Block(BINNED, label, np.ones(1) if weight is None else weight, (np.arange(ROWS) % 3).astype(np.int32),
                   np.arange(ROWS, dtype=np.uint64) * np.uint64(977))


def _label(kind):
    z = BINNED[0] / 16.0 + BINNED[1] * BINNED[2] / 400.0
    return z if not kind else np.digitize(z, [1.5, 2.4][:kind - 1]).astype(float)


def _goal(kind):
    return T.Goal(kind, 2.0, 0.8) if not kind else T.Goal(kind, start=(0.1,) if kind == 2 else (-1.0, -1.2, -1.1))


SETTINGS = [T.TreeParams(True, 3, 5, 0.3, l2=1.0, least_weight=1.0), T.TreeParams(True, 3, 9, 0.3, rows=0.6, columns=0.5),
            T.TreeParams(True, 3, 8, 0.3, leaves=7, least_rows=20, least_weight=1e-3), T.TreeParams(False, 4, 9, columns="sqrt"),
            T.TreeParams(False, 3, 7, columns=1.0, least_rows=4)]


def _plain(block, fit, goal):
    """The trees of a fit by counting every node's cells from its rows, a feature at a time."""
    p, made = fit.params, []
    seen = block.fold != fit.held
    margins = goal.margins(p, len(seen))
    for t in range(p.trees):
        times = T.drawn(p, t, block.hash) * seen
        g, h = goal.gradients(p, block, margins if p.boosted else None)
        g, h = np.broadcast_to(g, (goal.outputs, ROWS)), np.broadcast_to(h, (goal.outputs, ROWS) if p.boosted else ROWS)
        for k in range(goal.outputs if p.boosted else 1):
            growth = T.Growth(p, t * goal.outputs + k if p.boosted else t, WIDTH, 1 if p.boosted else goal.outputs)
            own_g, own_h = (g[k:k + 1], h[k]) if p.boosted else (g, h)
            node = np.zeros(ROWS, np.int64)
            while len(growth.open):
                was, own = growth.open, growth.own
                at = np.flatnonzero((times > 0) & np.isin(node, was))
                if not len(at):
                    break
                spot = np.searchsorted(was, node[at])
                loads = np.concatenate([times[None, at], own_h[None, at] * times[at], own_g[:, at] * times[at]]).astype(np.int64)
                sums = np.zeros((len(loads), len(was), WIDTH, T.BINS), np.int64)
                for f in range(WIDTH):
                    use = np.ones(len(at), bool) if own is None else (own[spot if len(own) > 1 else 0] == f).any(-1) & (spot >= 0)
                    for load, out in zip(loads, sums):
                        np.add.at(out[:, f], (spot[use], BINNED[f, at[use]]), load[use])
                key = np.flatnonzero(sums[0])
                sums = sums.reshape(len(loads), -1)[:, key]
                growth.take(T.best_splits(T.Cells(key, sums[0], sums[1], sums[2:]), WIDTH, p))
                inner = growth.feature[node] >= 0
                right = BINNED[np.maximum(growth.feature[node], 0), np.arange(ROWS)] > growth.bin[node]
                node = np.where(inner, growth.left[node] + right, node)
            made.append(growth.finish(not p.boosted))
            one = T._joined([made[-1]], [k], made[-1]["value"].shape[1])
            gone = one.value[one.route(0, BINNED)]
            if p.boosted:
                margins[k] += gone[:, 0]
            else:
                margins += gone.T / p.trees
    return made, margins


@pytest.mark.parametrize("kind", [0, 2, 3])
@pytest.mark.parametrize("params", range(len(SETTINGS)))
def test_trees_are_those_of_plain_counting(kind, params):
    fit = T.Fit("f", replace(SETTINGS[params], trees=1 if kind == 3 else 2), 1)
    for weight in (None, 1.0 + np.arange(ROWS) % 4):
        block = _block(_label(kind), weight)
        trees, margins = T.fit_block(block, fit, _goal(kind))
        want, told = _plain(block, fit, _goal(kind))
        for name in ("feature", "bin", "value", "gain", "rows"):
            assert np.array_equal(getattr(trees, name), np.concatenate([w[name] for w in want])), name
        assert np.array_equal(margins, told)
        _, held = T.fit_block(block, fit, _goal(kind), keep=False)
        assert np.array_equal(held[:, block.fold == 1], told[:, block.fold == 1])
        if not fit.params.boosted:
            break


@pytest.mark.parametrize("params", range(len(SETTINGS)))
def test_a_search_keeps_no_trees(params):
    block = _block(_label(2))
    trees, margins = T.fit_block(block, T.Fit("f", SETTINGS[params], 1), _goal(2), keep=False)
    kept, want = T.fit_block(block, T.Fit("f", SETTINGS[params], 1), _goal(2))
    assert not len(trees.feature) and len(kept.feature)
    assert np.array_equal(margins[:, block.fold == 1], want[:, block.fold == 1])


@pytest.mark.parametrize("boosted", [True, False])
def test_two_features_are_counted_in_one_pass(monkeypatch, boosted):
    passes, real = [], np.bincount
    monkeypatch.setattr(T.np, "bincount", lambda x, *a, **k: passes.append(len(x)) or real(x, *a, **k))
    T.fit_block(_block(_label(2)), T.Fit("f", T.TreeParams(boosted, 1, 1, l2=1.0)), _goal(2))
    # the root alone: four pairs of seven features, gradients and hessians, or all counts of a forest in one number
    assert sum(n > ROWS // 2 for n in passes) <= 4 * 2 + 2


def test_searches_of_all_candidates_run_side_by_side(spark, monkeypatch):
    meet = threading.Barrier(2, timeout=60)

    def search(data, row_key, spec, *rest):
        meet.wait()
        return spec, None

    real, calls = T.bin_rows, []
    monkeypatch.setattr(A.TR, "bin_rows", lambda *a, **k: calls.append(1) or real(*a, **k))
    monkeypatch.setitem(M.SEARCHES, "model", search)
    rows = [(i, float(i % 2), Vectors.dense([float(i % 7), float(i % 2) + 0.01 * (i % 13)]), "test" if i % 5 == 0 else "train")
            for i in range(200)]
    vectors = spark.createDataFrame(rows, ["id", "label", "features", "split"])
    specs = [replace(s, params=s.params | {"n_estimators": 3}) for s in M.build_specs(["XGBoost", "GradientBoosting"], "classification", 200)]
    done = A.train(vectors, "id", specs, "classification", AutoMLConfig(train=TrainConfig(cv_folds=3)))
    assert done.name in ("XGBoost", "GradientBoosting")
    assert len(calls) == 1  # the winner learns from the rows as they were binned for the comparison


def test_raw_rows_are_dealt_out_evenly(spark, monkeypatch):
    rows = spark.range(0, 2000, 1, 1).select(F.when(F.col("id") % 4 > 0, F.col("id")).alias("key"), (F.col("id") % 97).alias("a"),
                                             F.concat(F.lit("x"), (F.col("id") % 11).cast("string")).alias("b.c"))
    assert A.spread_out(rows, "key") is rows
    monkeypatch.setattr(A, "LIMITS", replace(LIMITS, small_table_rows=100, rows_per_bucket=500))
    out = A.spread_out(rows, "key")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 1000
