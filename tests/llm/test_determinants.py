"""Minimum covariance determinant: estimates and verdicts against a plain search with many random starts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import outliers as O

FLOOR2 = np.diag(np.array(O.FLOORS) ** 2)


def plain_mcd(x, share=0.75, starts=150, seed=0):
    """(log determinant, mean, covariance) of the best of many concentrated random starts."""
    rng, h, best = np.random.default_rng(seed), math.ceil(share * len(x)), None
    for _ in range(starts):
        own = x[rng.choice(len(x), 8, replace=False)]
        last = math.inf
        for _ in range(60):
            m, c = own.mean(0), np.cov(own.T, bias=True) + FLOOR2
            det = np.linalg.slogdet(c)[1]
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            own = x[np.argsort(d, kind="stable")[:h]]
            if abs(last - det) < 1e-9:
                break
            last = det
        if best is None or det < best[0]:
            best = det, m, c
    return best


def pool(seed, n, far):
    """Correlated vectors, a fifth of them in a tight group elsewhere, which draws a plain covariance to itself."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, O.P)) @ np.diag([2, 1, 2, 1.5, 1]) @ (np.eye(O.P) + 0.4 * np.tri(O.P, k=-1))
    x[: n // 5] = far + 0.2 * rng.normal(size=(n // 5, O.P))
    return x


@pytest.fixture(scope="module")
def mixed():
    return {"a": pool(1, 200, [14, -9, 14, 9, 12]), "b": pool(2, 150, [-15, 9, 0, 0, 10]), "c": pool(3, 120, [0, 0, 20, 0, 0])}


def test_estimates_and_verdicts_equal_a_plain_search(spark, mixed):
    rows = [(p, *map(float, r)) for p, x in mixed.items() for r in x]
    df = spark.createDataFrame(rows, "pool string, x0 double, x1 double, x2 double, x3 double, x4 double")
    found = O.smallest_determinants(df, 3, 0.75, 20, 1e-3)
    assert found.count() == 3
    got = {r["pool"]: r for r in found.collect()}
    d2 = {p: [] for p in mixed}
    for r in O._distances(df, found, 3).collect():
        d2[r["pool"]].append((tuple(r[f"x{i}"] for i in range(O.P)), r["d2"]))
    limit = O.consistency(0.75) * O.quantile5(0.9999)
    for p, x in mixed.items():
        det, m, c = plain_mcd(x)
        # the share is cut at a class of distances, so a few texts more may count
        assert got[p]["log_det"] == pytest.approx(det, abs=0.15)
        want = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) <= limit
        kept = {v: d <= limit for v, d in d2[p]}
        assert [kept[tuple(map(float, r))] for r in x] == want.tolist()
        assert not want[: len(x) // 5].any() and want[len(x) // 5:].mean() > 0.97


def test_the_kept_start_has_the_smallest_determinant(spark, mixed):
    rows = [("p", *map(float, r)) for r in mixed["a"]]
    df = spark.createDataFrame(rows, "pool string, x0 double, x1 double, x2 double, x3 double, x4 double")
    first = O._first_distances(df, 1)
    assert {r["pool"] for r in first.select("pool").distinct().collect()} == {f"{s}|p" for s in O.STARTS}
    ends = O._moments(O._nearest(first, 0.75, 3)).agg(F.min("log_det")).first()[0]
    assert O.smallest_determinants(df, 1, 0.75, 20, 1e-3).first()["log_det"] <= ends + 1e-9


def test_pools_of_equal_vectors_and_no_rows(spark):
    df = spark.createDataFrame([("p", 1.0, 1.0, 0.0, 0.0, 0.0)] * 40, "pool string, x0 double, x1 double, x2 double, x3 double, x4 double")
    r = O.smallest_determinants(df, 1, 0.75, 20, 1e-3).first()
    assert r["m0"] == 1.0 and r["log_det"] == pytest.approx(sum(2 * math.log(f) for f in O.FLOORS))
    assert O.smallest_determinants(df.where("false"), 0, 0.75, 20, 1e-3).count() == 0


@pytest.mark.parametrize("p,want", [(0.5, 4.351), (0.75, 6.626), (0.99, 15.086), (0.9999, 25.745)])
def test_quantiles(p, want):
    assert O.quantile5(p) == pytest.approx(want, abs=1e-3)
