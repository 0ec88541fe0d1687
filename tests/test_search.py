"""Model-based search: repeatable, never out of range, and better than random draws on a planted optimum."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tabloom.config import TrainConfig
from tabloom.operators import models as M, split as G

SPACE = {"rate": ("log", 0.001, 1.0), "depth": ("int", 1, 20), "share": ("float", 0.0, 1.0), "kind": ("choice", ("a", "b", "c"))}


def planted(p):
    """Highest at rate 0.03, depth 7, share 0.8, kind b."""
    return -(math.log10(p["rate"] / 0.03) ** 2 + ((p["depth"] - 7) / 8) ** 2 + 2 * (p["share"] - 0.8) ** 2 + 0.5 * (p["kind"] != "b"))


def run(seed, fail=lambda p: False):
    seen = []

    def evaluate(batch):
        seen.append(len(batch))
        return [-math.inf if fail(p) else planted(p) for p in batch]

    return M.search_loop(SPACE, 20, random.Random(seed), evaluate), seen


def test_it_beats_random_draws_on_a_planted_optimum():
    own = [max(s for _, s in run(seed)[0]) for seed in range(40)]
    plain = []
    for seed in range(40):
        rng = random.Random(seed)
        plain.append(max(planted(M.sample_params(SPACE, rng)) for _ in range(20)))
    assert np.mean(own) > np.mean(plain) and np.median(own) > np.median(plain)
    assert sum(a > b for a, b in zip(own, plain)) >= 24


def test_it_is_repeatable_and_keeps_to_the_ranges():
    first, sizes = run(3)
    assert first == run(3)[0] and len(first) == 20 and sizes == [5, 5, 5, 5]
    for p, _ in first:
        assert 0.001 <= p["rate"] <= 1 and 1 <= p["depth"] <= 20 and isinstance(p["depth"], int) and 0 <= p["share"] <= 1 and p["kind"] in "abc"


def test_failed_trials_are_the_worst():
    done, _ = run(1, fail=lambda p: p["kind"] == "a")
    late = [p["kind"] for p, _ in done[10:]]
    assert late.count("a") <= 3 and max(done, key=lambda t: t[1])[0]["kind"] != "a"
    assert len(run(1, fail=lambda p: True)[0]) == 20


def test_trials_of_trees(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    rows = spark.createDataFrame([(i, Vectors.dense(v), float(v[0] > 0) + float(v[1] > 1)) for i, v in enumerate(x)], ["id", "features", "label"])
    folded = G.assign_folds(rows, "id", 3, "label").cache()
    spec = M.Spec("XGBoost", "boosted_trees", {}, {"n_estimators": ("int", 1, 6), "max_depth": ("int", 0, 3), "learning_rate": ("log", 0.05, 0.5)})
    cfg = TrainConfig(n_trials=12)
    best, board = M.model_search(folded, "id", spec, "classification", 3, cfg)
    again, _ = M.model_search(folded, "id", spec, "classification", 3, cfg)
    told = board.orderBy("position").collect()
    assert best.params == again.params and best.params["max_depth"] > 0
    # trees without depth cannot be grown: such trials failed, all others are in the table
    assert all(json.loads(r["params"])["max_depth"] > 0 for r in told) and 1 <= len(told) <= 12
    assert json.loads(told[0]["params"]) == best.params or abs(told[0]["cv_mean"] - max(r["cv_mean"] for r in told)) < 1e-12
    with pytest.raises(RuntimeError):
        M.model_search(folded, "id", M.Spec("XGBoost", "boosted_trees", {}, {"max_depth": ("int", 0, 0)}), "classification", 3, TrainConfig(n_trials=2))
