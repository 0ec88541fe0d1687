"""Ridge regression from one Gram matrix per fold: every penalty and every left-out fold comes from one scan.

The scan sums products of (features, label, 1) by fold, about the means of all rows, partially in each task. The
matrix of the rows without a fold is the sum of the others', so fits and scores of all penalties and folds are
algebra on matrices whose size is that of the features.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Grams:
    """Sums of products of (features, label, 1) about `center` (of features and label), by fold."""

    center: np.ndarray
    folds: dict[int, np.ndarray]

    def without(self, fold: int | None) -> np.ndarray:
        size = len(self.center) + 1
        return sum((g for k, g in self.folds.items() if k != fold), np.zeros((size, size)))


def fold_grams(data: DataFrame) -> Grams:
    """`data` holds label, features and perhaps fold."""
    import pyarrow as pa

    fold = F.col("fold").cast("int") if "fold" in data.columns else F.lit(0)
    rows = data.where(F.col("label").isNotNull()).select(fold.alias("fold"), F.col("label").cast("double").alias("label"), "features")
    mean = rows.agg(Summarizer.mean(F.col("features")).alias("x"), F.avg("label").alias("y")).first()
    if mean["y"] is None:
        return Grams(np.zeros(1), {})
    center = np.append(mean["x"].toArray(), mean["y"])
    size = len(center) + 1

    def products(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, size - 2)
            z = np.concatenate([x, batch.column(1).to_numpy(zero_copy_only=False)[:, None]], axis=1) - center
            z = np.concatenate([z, np.ones((n, 1))], axis=1)
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for k in np.unique(own).tolist():
                part = z[own == k]
                sums[k] = sums.get(k, 0) + part.T @ part
        yield from told(sums)

    def told(sums):
        for k, g in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * size, pa.int32()), pa.array(range(size), pa.int32()),
                                              pa.array(list(g), pa.list_(pa.float64()))], names=["fold", "line", "sums"])

    def added(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for k, i, v in zip(*(batch.column(c).to_pylist() for c in range(3))):
                sums[k, i] = sums.get((k, i), 0) + np.array(v)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in sums], pa.int32()), pa.array([i for _, i in sums], pa.int32()),
                 pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["fold", "line", "sums"])

    schema = "fold int, line int, sums array<double>"
    lines = rows.select("fold", "label", vector_to_array("features").alias("v")).mapInArrow(products, schema)
    # the lines of a matrix are added up in different tasks; features x features x folds numbers come back
    found = lines.repartition("fold", "line").mapInArrow(added, schema).collect()
    folds: dict[int, np.ndarray] = {}
    for r in found:
        folds.setdefault(r["fold"], np.zeros((size, size)))[r["line"]] = r["sums"]
    return Grams(center, folds)


@dataclass
class RidgeModel:
    coef: list[float]
    intercept: float

    @property
    def coefficients(self) -> DenseVector:
        return DenseVector(self.coef)

    def transform(self, df: DataFrame) -> DataFrame:
        products = F.zip_with(vector_to_array("features"), F.lit(self.coef), lambda a, b: a * b) if self.coef else F.array().cast(
            "array<double>")
        return df.withColumn("prediction", F.aggregate(products, F.lit(float(self.intercept)), lambda a, b: a + b))


def solve_without(grams: Grams, fold: int | None, penalties: Sequence[float]) -> list[RidgeModel]:
    """The model of each penalty on all rows but those of a fold, from one decomposition."""
    g = grams.without(fold)
    k = len(grams.center) - 1
    n = max(g[-1, -1], 1.0)
    s = g[-1, :k + 1]
    a = g[:k, :k] - np.outer(s[:k], s[:k]) / n
    b = g[:k, k] - s[:k] * s[k] / n
    values, vectors = np.linalg.eigh(a) if k else (np.empty(0), np.empty((0, 0)))
    values = np.maximum(values, 0)
    out = []
    for p in penalties:
        below = values + p
        # without a penalty, directions in which the rows do not vary stay at zero
        w = vectors @ np.where(below > 1e-12 * max(values.max(initial=0), 1), (vectors.T @ b) / np.where(below > 0, below, 1), 0)
        out.append(RidgeModel([float(x) for x in w], float(grams.center[k] + s[k] / n - w @ (grams.center[:k] + s[:k] / n))))
    return out


def held_scores(grams: Grams, folds: int, penalties: Mapping[str, float]) -> list[tuple[str, int, float]]:
    """(tag, fold, r2 on the fold's rows) of the models fitted without the fold."""
    out = []
    for fold in range(folds):
        g = grams.folds.get(fold)
        if g is None or not g[-1, -1]:
            continue
        k, n = len(grams.center) - 1, g[-1, -1]
        spread = g[k, k] / n - (g[k, -1] / n) ** 2
        for tag, model in zip(penalties, solve_without(grams, fold, list(penalties.values()))):
            # the residual is a fixed combination of (features, label, 1) about the centre
            mix = np.concatenate([-np.array(model.coef), [1.0], [grams.center[k] - model.intercept - np.dot(model.coef, grams.center[:k])]])
            mse = max(float(mix @ g @ mix) / n, 0.0)
            out.append((tag, fold, float(1 - mse / spread) if spread > 0 else float(mse == 0)))
    return out


@dataclass(frozen=True)
class RidgeLearner:
    penalty: float

    def fit(self, data: DataFrame) -> RidgeModel:
        return solve_without(fold_grams(data), None, [self.penalty])[0]
