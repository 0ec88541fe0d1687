"""Exact quantiles of many ranks from a few scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions import quantiles as Q

PROBS = [k / 32 for k in range(33)]


@pytest.fixture(scope="module")
def columns(spark):
    rng = np.random.default_rng(3)
    n = 6000
    data = {"spread": rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n), "few": rng.integers(-3, 3, n).astype(float),
            "heavy": np.where(rng.random(n) < 0.6, 7.25, rng.normal(size=n)), "zeros": np.where(rng.random(n) < 0.5, -0.0, 0.0),
            "ends": rng.choice([-np.inf, np.inf, 1.0, 1.0 + 2 ** -52], n)}
    frame = spark.createDataFrame([tuple(map(float, r)) for r in zip(*data.values())], list(data)).withColumn(
        "gaps", F.when(F.col("few") > 0, F.col("heavy"))).withColumn("empty", F.lit(None).cast("double"))
    return frame.repartition(4).cache(), data


@pytest.mark.parametrize("limit,read", [(100, 10), (100, 1000), (100, 100_000)])
def test_quantiles_equal_those_of_sorted_values(columns, limit, read, monkeypatch):
    monkeypatch.setattr(Q, "_READ", read)
    monkeypatch.setattr(Q, "_CUTS", 1 << 10)
    frame, data = columns
    found = Q.exact_quantiles(frame, frame.columns, PROBS, limit)
    data = data | {"gaps": data["heavy"][data["few"] > 0]}
    assert found.pop("empty") == [None] * len(PROBS)
    for name, values in data.items():
        ordered = np.sort(values)
        for p, q in zip(PROBS, found[name]):
            at = p * (len(ordered) - 1)
            a, b = ordered[int(at)], ordered[min(int(at) + 1, len(ordered) - 1)]
            assert q == (a if a == b else a + (b - a) * (at - int(at))) or np.isnan(q) and np.isinf([a, b]).any(), (name, p)


def test_scans_do_not_grow_with_ranks(columns, spark):
    """Before, every rank had five sums and a sketch of its own in each scan."""
    frame, _ = columns
    asked = []
    narrow = Q._narrow_once
    try:
        Q._narrow_once = lambda base, searches, boxes: (asked.append(len(searches)), narrow(base, searches, boxes))[1]
        Q.exact_quantiles(frame, ["spread", "heavy"], PROBS, 100)
    finally:
        Q._narrow_once = narrow
    assert asked[0] > 60 and len(asked) <= 6
