"""Margin models with a Gaussian kernel, as linear margin models over random Fourier features.

A seeded map takes a row to `features` cosines whose scalar products approximate exp(-gamma |x - y|^2), so that a
linear learner over them draws curved borders at the cost of a linear one; no matrix of row pairs is built. Columns
are first evened to mean 0 and deviation 1 (a constant column takes no part, a missing value stands at the mean).
gamma is 1 / the median squared distance between rows, measured from all rows to a bounded number of anchors:
the distinct rows with the smallest digests.

Frequencies come from md5 of (seed, place), so a map is its few parameters, and SQL can compute it too.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import asdict, dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..functions.workers import importable

ANCHORS = 64
#: Squared distances are counted in classes of 1 % width.
CLASSES = 100


def uniform(seed: int, *place) -> float:
    """A number in (0, 1) from md5 of '<seed>:<place>:...'."""
    text = ":".join(str(p) for p in (seed, *place))
    return (int(hashlib.md5(text.encode()).hexdigest()[:12], 16) + 0.5) / 16 ** 12


def normal(seed: int, i: int, j: int) -> float:
    return math.sqrt(-2 * math.log(uniform(seed, "r", i, j))) * math.cos(2 * math.pi * uniform(seed, "a", i, j))


@dataclass(frozen=True)
class FourierMap:
    mean: tuple[float, ...]
    scale: tuple[float, ...]   # 1 / deviation; 0 for a constant column
    gamma: float
    features: int
    seed: int

    def matrices(self) -> tuple[np.ndarray, np.ndarray]:
        """Frequencies (columns x features) and phases."""
        wide = math.sqrt(2 * self.gamma)
        w = np.array([[wide * normal(self.seed, i, j) for j in range(self.features)] for i in range(len(self.mean))])
        return w.reshape(len(self.mean), self.features), np.array(
            [2 * math.pi * uniform(self.seed, "p", j) for j in range(self.features)])

    def apply(self, df: DataFrame, column: str = "features", out: str = "fourier") -> DataFrame:
        """Adds the vector of cosines; one Arrow pass, no shuffle."""
        w, phase = self.matrices()
        importable(df.sparkSession)
        mean, scale, size = np.array(self.mean), np.array(self.scale), self.features

        def cosines(v: pa.Array) -> pa.Array:
            x = _evened(v, mean, scale)
            z = math.sqrt(2 / size) * np.cos(x @ w + phase)
            return pa.ListArray.from_arrays(pa.array(np.arange(0, len(z) * size + 1, size), pa.int32()), pa.array(z.ravel()))

        told = F.arrow_udf(cosines, "array<double>")
        return df.withColumn(out, array_to_vector(told(vector_to_array(F.col(column)))))


def _evened(v: pa.Array, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), len(mean))
    return np.nan_to_num((x - mean) * scale, nan=0.0, posinf=0.0, neginf=0.0)


def fit_map(data: DataFrame, features: int = 256, seed: int = 42, gamma: float | None = None,
            column: str = "features", anchors: int = ANCHORS) -> FourierMap:
    """Means and deviations from one aggregate, gamma from one count of distance classes unless given."""
    vector = F.col(column)
    row = data.agg(Summarizer.metrics("mean", "variance", "count").summary(vector).alias("s")).first()["s"]
    n = row["count"]
    mean, var = row["mean"].toArray(), row["variance"].toArray() * (max(n - 1, 1) / max(n, 1))
    if np.isnan(mean).any():  # gaps: moments of the values that are there
        mean, var = _moments_with_gaps(data, column, len(mean))
    steady = var > 1e-24 * np.maximum(mean ** 2, 1e-300)
    scale = np.where(steady, 1 / np.sqrt(np.where(steady, var, 1.0)), 0.0)
    if gamma is None:
        middle = median_distance(data, mean, scale, column, anchors)
        gamma = 1 / middle if middle > 0 else 1 / max(int(steady.sum()), 1)
    return FourierMap(tuple(float(x) for x in mean), tuple(float(x) for x in scale), float(gamma), features, seed)


def _moments_with_gaps(data: DataFrame, column: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    values = data.select(F.posexplode(vector_to_array(column)).alias("i", "v")).where(~F.isnan("v"))
    found = {r["i"]: (r["m"], r["s"]) for r in values.groupBy("i").agg(
        F.avg("v").alias("m"), F.var_pop("v").alias("s")).collect()}
    return tuple(np.array([found.get(i, (0.0, 0.0))[k] for i in range(size)]) for k in (0, 1))


def median_distance(data: DataFrame, mean: np.ndarray, scale: np.ndarray, column: str = "features",
                    anchors: int = ANCHORS) -> float:
    """Median squared distance above 0, to 1 %, between all rows and the anchors; 0 if all rows are equal."""
    importable(data.sparkSession)
    rows = data.select(vector_to_array(column).alias("v")).withColumn("h", F.xxhash64("v"))
    distinct = rows.agg(F.approx_count_distinct("h")).first()[0]
    # eight times as many digests as wanted lie below this bound
    share = min(8 * anchors / max(distinct, 1), 1.0)
    bound = int(-2 ** 63 + share * (2 ** 64 - 1)) if share < 1 else 2 ** 63 - 1
    low = rows.where(F.col("h") <= F.lit(bound)).groupBy("h").agg(F.min("v").alias("v")).orderBy("h").limit(anchors).collect()
    if not low:
        return 0.0
    at = np.nan_to_num((np.array([r["v"] for r in low]) - mean) * scale, nan=0.0, posinf=0.0, neginf=0.0)

    def count(batches):
        sums: dict[int, int] = {}
        for batch in batches:
            x = _evened(batch.column(0), mean, scale)
            d = (x ** 2).sum(1)[:, None] + (at ** 2).sum(1)[None, :] - 2 * x @ at.T
            d = d[d > 1e-9]
            steps, n = np.unique(np.floor(np.log(d) * CLASSES).astype(np.int64), return_counts=True)
            for s, k in zip(steps.tolist(), n.tolist()):
                sums[s] = sums.get(s, 0) + k
        yield pa.RecordBatch.from_pydict({"step": pa.array(list(sums), pa.int64()), "n": pa.array(list(sums.values()), pa.int64())})

    # a few thousand classes at most, whatever the rows
    found = rows.select("v").mapInArrow(count, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).orderBy("step").collect()
    left = sum(r["n"] for r in found) / 2
    for r in found:
        left -= r["n"]
        if left <= 0:
            return math.exp((r["step"] + 0.5) / CLASSES)
    return 0.0


@dataclass
class KernelModel:
    """A map and one column of weights (the last for the constant) per class, or one in all for two classes and for numbers."""

    map: FourierMap
    weights: np.ndarray
    task: str

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction, for classes also rawPrediction; the cosines never leave the task."""
        importable(df.sparkSession)
        mean, scale = np.array(self.map.mean), np.array(self.map.scale)
        frequencies, phase = self.map.matrices()
        weights, both = self.weights, self.task == "classification" and self.weights.shape[1] == 1

        def margins(v: pa.Array) -> pa.Array:
            m = _cosines(_evened(v, mean, scale), frequencies, phase) @ weights
            m = np.concatenate([-m, m], 1) if both else m
            return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.ravel()))

        m = F.arrow_udf(margins, "array<double>")(vector_to_array("features"))
        if self.task != "classification":
            return df.withColumn("prediction", m[0])
        # the first of equal margins wins
        return df.withColumn("rawPrediction", array_to_vector(m)).withColumn("prediction", (F.array_position(
            vector_to_array("rawPrediction"), F.array_max(vector_to_array("rawPrediction"))) - 1).cast("double"))

    def told(self) -> dict[str, Any]:
        return {"map": asdict(self.map), "weights": self.weights.tolist(), "task": self.task}

    @staticmethod
    def of(told: dict[str, Any]) -> "KernelModel":
        m = told["map"]
        return KernelModel(FourierMap(tuple(m["mean"]), tuple(m["scale"]), m["gamma"], m["features"], m["seed"]),
                           np.array(told["weights"]), told["task"])


def _cosines(x: np.ndarray, frequencies: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Cosines and a constant."""
    z = math.sqrt(2 / len(phase)) * np.cos(x @ frequencies + phase)
    return np.concatenate([z, np.ones((len(z), 1))], 1)


@dataclass(frozen=True)
class KernelLearner:
    """Squared hinge loss for classes, one against the rest; squared loss beyond `epsilon` label deviations for numbers.

    |w|^2 / 2 + C x the loss is minimised by Newton steps. A step is one scan, in which each task maps its rows and adds up the
    products of those inside the margin, for up to `together` classes; neither cosines nor rows are stored. The scan also
    tells the loss, so a step that did not lower it is halved. It ends when all classes gain less than `least`."""

    task: str
    c: float = 1.0
    classes: int = 2
    features: int = 256
    seed: int = 42
    gamma: float | None = None
    weight_col: str | None = None
    epsilon: float = 0.1
    label_std: float = 1.0
    steps: int = 25
    least: float = 1e-4
    together: int = 16

    def fit(self, data: DataFrame) -> KernelModel:
        importable(data.sparkSession)
        made = fit_map(data, self.features, self.seed, self.gamma)
        weight = F.col(self.weight_col).cast("double") if self.weight_col else F.lit(1.0)
        rows = data.where(F.col("label").isNotNull()).select(
            vector_to_array("features").alias("v"), F.col("label").cast("double").alias("label"), weight.alias("weight"))
        wanted = [None] if self.task != "classification" else [1] if self.classes <= 2 else list(range(self.classes))
        found = [self._solve(rows, made, wanted[at:at + self.together]) for at in range(0, len(wanted), self.together)]
        return KernelModel(made, np.concatenate(found, 1), self.task)

    def _solve(self, rows: DataFrame, made: FourierMap, wanted: list) -> np.ndarray:
        size = self.features + 1
        matrices = made.matrices()
        best, best_loss = np.zeros((size, len(wanted))), [math.inf] * len(wanted)
        goal, ended = best.copy(), [False] * len(wanted)
        tried = best.copy()
        for _ in range(self.steps):
            live = [k for k in range(len(wanted)) if not ended[k]]
            if not live:
                break
            sums = self._scan(rows, made, matrices, [wanted[k] for k in live], tried[:, live])
            for k, (gram, right, loss) in zip(live, sums):
                total = loss * self.c + 0.5 * float(tried[:-1, k] @ tried[:-1, k])
                gain = best_loss[k] - total
                if gain < 0:  # a step too far
                    ended[k] = float(np.abs(goal[:, k] - best[:, k]).max()) < 1e-6
                    goal[:, k] = (goal[:, k] + best[:, k]) / 2
                    tried[:, k] = goal[:, k]
                    continue
                ended[k] = gain <= self.least * max(total, 1e-12)
                best[:, k], best_loss[k] = tried[:, k], total
                a = 2 * self.c * gram
                a[np.arange(size - 1), np.arange(size - 1)] += 1.0
                a[-1, -1] += 1e-9
                goal[:, k] = np.linalg.solve(a, 2 * self.c * right)
                tried[:, k] = goal[:, k]
        return best

    def _scan(self, rows: DataFrame, made: FourierMap, matrices, wanted: list, w: np.ndarray) -> list:
        """Per class: products of the rows that bear loss, their products with what they should reach, and the loss."""
        mean, scale = np.array(made.mean), np.array(made.scale)
        size, numbers, slack = len(w), self.task != "classification", self.epsilon * self.label_std

        def products(batches):
            sums = [np.zeros((size + 1, size + 1)) for _ in wanted]
            for batch in batches:
                z = _cosines(_evened(batch.column(0), mean, scale), *matrices)
                label = batch.column(1).to_numpy(zero_copy_only=False)
                share = batch.column(2).to_numpy(zero_copy_only=False)
                for k, cls in enumerate(wanted):
                    out = z @ w[:, k]
                    if numbers:
                        off = label - out
                        bears, reach = np.abs(off) > slack, label - np.sign(off) * slack
                    else:
                        reach = np.where(label == cls, 1.0, -1.0)
                        bears = reach * out < 1
                    own = np.concatenate([z[bears], reach[bears, None]], 1)
                    sums[k][:size, :] += (own[:, :size] * share[bears, None]).T @ own
                    sums[k][size, size] += float(share[bears] @ (reach[bears] - out[bears]) ** 2)
            yield from told({(k, i): line for k, g in enumerate(sums) for i, line in enumerate(g)})

        def told(lines):
            if lines:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in lines], pa.int32()), pa.array([i for _, i in lines], pa.int32()),
                     pa.array(list(lines.values()), pa.list_(pa.float64()))], names=["k", "line", "sums"])

        def added(batches):
            lines: dict[tuple, np.ndarray] = {}
            for batch in batches:
                for k, i, v in zip(*(batch.column(c).to_pylist() for c in range(3))):
                    lines[k, i] = lines.get((k, i), 0) + np.array(v)
            yield from told(lines)

        schema = "k int, line int, sums array<double>"
        # classes x features x features numbers come back, for up to `together` classes
        found = rows.mapInArrow(products, schema).repartition("k", "line").mapInArrow(added, schema).collect()
        out = [np.zeros((size + 1, size + 1)) for _ in wanted]
        for r in found:
            out[r["k"]][r["line"]] = r["sums"]
        return [(g[:size, :size], g[:size, size], float(g[size, size])) for g in out]
