"""Two-level ranks, running sums and look-ups against brute force, with tiny buckets and hot keys."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions import lookups, ordering
from tabloom.functions.quantiles import exact_quantiles
from tabloom.operators import split as G


def digest(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows; one class and one value hold more than a third of them."""
    rng = random.Random(7)
    rows = [(i, "hot" if i % 5 < 2 else f"c{i % 7}", 1.0 if i % 3 == 0 else rng.gauss(0, 50),
             None if i % 11 == 0 else rng.expovariate(0.1)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id long, cls string, v double, w double").cache()


PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0)


@pytest.mark.parametrize("limit", [10, 300, 10_000])
def test_quantiles_match_numpy_with_and_without_narrowing(skewed, limit):
    rows, df = skewed
    got = exact_quantiles(df, ["v", "w"], PROBS, limit=limit)
    for name, i in (("v", 2), ("w", 3)):
        values = [r[i] for r in rows if r[i] is not None]
        assert np.allclose(got[name], np.quantile(values, PROBS), rtol=0, atol=1e-9)


def test_quantiles_of_empty_and_constant_columns(spark):
    df = spark.createDataFrame([(None, 2.0)] * 50, "a double, b double")
    for limit in (5, 1000):
        got = exact_quantiles(df, ["a", "b"], (0.25, 0.5), limit=limit)
        assert got == {"a": [None, None], "b": [2.0, 2.0]}


def test_running_sums_across_ranges(skewed):
    rows, df = skewed
    out = ordering.running_sums(df.select("id", "cls", (F.col("id") % 10).alias("x")), "id", ["x"],
                                3000, ["cls"], per_bucket=100)
    got = {r["id"]: r["x_before"] for r in out.collect()}
    seen: dict = {}
    for i, cls, *_ in rows:
        assert got[i] == seen.get(cls, 0)
        seen[cls] = seen.get(cls, 0) + i % 10


@pytest.mark.parametrize("limit", [1000, 3])
def test_lookup_small_and_hot_cold(skewed, limit, spark):
    rows, df = skewed
    table = spark.createDataFrame(
        [("hot", 1200, 1.5)] + [(f"c{i}", 1, float(i)) for i in range(5)], "value string, n long, stat double")
    got = {r["id"]: r["s"] for r in lookups.lookup(df, "cls", table, F.lit(-1.0), "s", limit).collect()}
    want = {"hot": 1.5, **{f"c{i}": float(i) for i in range(5)}}
    assert len(got) == len(rows)
    assert all(got[r[0]] == want.get(r[1], -1.0) for r in rows)


def test_lookup_of_null_uses_default(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "id int, k string")
    table = spark.createDataFrame([("a", 10, 0.5), ("b", 1, 0.1), (None, 3, 9.0)],
                                  "value string, n long, stat double")
    for limit in (10, 0):
        got = {r["id"]: r["s"] for r in lookups.lookup(df, "k", table, F.lit(0.0), "s", limit).collect()}
        assert got == {1: 0.0, 2: 0.5}


def test_ranked_levels_in_ranges(spark):
    names = [f"k{i:05d}" for i in range(2000)]
    df = spark.createDataFrame([(n, 1) for n in names], "value string, n long")
    for limit in (100, 5000):
        got = {r["value"]: r["code"] for r in lookups.ranked_levels(df, limit).collect()}
        assert got == {n: i for i, n in enumerate(names)}


# --- splits ------------------------------------------------------------------------------

def brute_split(rows, test_size, seed):
    n = len(rows)
    n_train = n - math.ceil(test_size * n)
    by = {}
    for i, cls in rows:
        by.setdefault(cls, []).append(i)
    floor = {c: len(v) * n_train // n for c, v in by.items()}
    rest = sorted(by, key=lambda c: (-(len(by[c]) * n_train % n), c))
    for c in rest[:n_train - sum(floor.values())]:
        floor[c] += 1
    test = set()
    for c, ids in by.items():
        test |= set(sorted(ids, key=lambda i: digest(seed, i))[:len(ids) - floor[c]])
    return test


@pytest.mark.parametrize("size,prefix", [(0.2, 1), (0.2, 3), (0.33, 2)])
def test_stratified_split_sizes_and_members(skewed, monkeypatch, size, prefix):
    rows, df = skewed
    monkeypatch.setattr(G, "SPLIT_PREFIX", prefix)
    out = G.train_test_split(df, "id", "cls", size).collect()
    got = {r["id"] for r in out if r["split"] == "test"}
    assert len(out) == len(rows)
    assert got == brute_split([(r[0], r[1]) for r in rows], size, 42)
    assert len(got) == math.ceil(size * len(rows))


@pytest.mark.parametrize("prefix,most", [(1, 2), (2, 1), (1, 400)])
def test_large_buckets_are_counted_again(skewed, monkeypatch, prefix, most):
    rows, df = skewed
    cut = G._cut_digests
    monkeypatch.setattr(G, "SPLIT_PREFIX", prefix)
    monkeypatch.setattr(G, "_cut_digests", lambda keyed, counts, wanted: cut(keyed, counts, wanted, most))
    got = {r["id"] for r in G.train_test_split(df, "id", "cls", 0.2).where("split = 'test'").collect()}
    assert got == brute_split([(r[0], r[1]) for r in rows], 0.2, 42)
    folds = G.assign_folds(df, "id", 5, "cls")
    monkeypatch.setattr(G, "_cut_digests", cut)
    assert sorted(folds.select("id", "fold").collect()) == sorted(G.assign_folds(df, "id", 5, "cls").select("id", "fold").collect())


def test_split_falls_back_when_a_class_is_too_small(spark):
    df = spark.createDataFrame([(i, "a" if i else "lonely") for i in range(50)], "id long, cls string")
    out = G.train_test_split(df, "id", "cls").collect()
    assert sum(r["split"] == "test" for r in out) == 10


def test_folds_are_balanced_per_class(skewed):
    rows, df = skewed
    for exact in (True, False):
        out = G.assign_folds(df, "id", 5, "cls", exact=exact).groupBy("cls", "fold").count().collect()
        assert sum(r["count"] for r in out) == len(rows)
        assert {r["fold"] for r in out} == set(range(5))
        if exact:
            for cls in {r["cls"] for r in out}:
                sizes = [r["count"] for r in out if r["cls"] == cls]
                assert max(sizes) - min(sizes) <= 1


def test_folds_of_tiny_classes(spark):
    df = spark.createDataFrame([(i, "big" if i < 40 else "two" if i < 42 else None) for i in range(43)],
                               "id long, cls string")
    out = G.assign_folds(df, "id", 5, "cls")
    assert out.count() == 43 and out.where("fold IS NULL OR fold > 4").count() == 0
    assert out.where("cls = 'two'").select("fold").distinct().count() == 2


def test_stride_sample_positions(skewed, monkeypatch):
    rows, df = skewed
    from tabloom.config import ScaleLimits
    for per_bucket in (200_000, 100):
        monkeypatch.setattr(G, "LIMITS", ScaleLimits(rows_per_bucket=per_bucket))
        got = sorted(r["id"] for r in G.stride_sample(df, "id", 140).collect())
        assert got == [(i * 3000) // 140 for i in range(140)]
    assert G.stride_sample(df.limit(50), "id", 140).count() == 50
