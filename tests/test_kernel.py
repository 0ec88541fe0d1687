"""Kernel machines: the map approximates the Gaussian kernel, gaps and copies are defined, models are stored."""

import numpy as np
import pytest

from tabloom.operators import features as X, kernel as K, models as M, score as S


def vectors(spark, x, label=None):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(0 if label is None else label[i])) for i, r in enumerate(x)]
    names = [f"c{j}" for j in range(x.shape[1])]
    df = spark.createDataFrame(rows, ", ".join(["id long", *[f"{n} double" for n in names], "label double"]))
    return X.assemble(df, names, keep=["id", "label"])


def test_products_of_cosines_are_the_kernel(spark):
    x = np.random.default_rng(0).normal(size=(60, 3)) * [1, 10, 100]
    made = K.fit_map(vectors(spark, x), features=4000, gamma=0.3)
    z = np.array([r.fourier.toArray() for r in made.apply(vectors(spark, x)).orderBy("id").collect()])
    even = (x - x.mean(0)) / x.std(0)
    far = ((even[:, None] - even[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-0.3 * far)).max() < 0.1


def test_bandwidth_is_the_median_distance(spark):
    x = np.random.default_rng(1).normal(size=(50, 2))
    d = vectors(spark, x)
    even = (x - x.mean(0)) / x.std(0)
    far = ((even[:, None] - even[None]) ** 2).sum(-1)
    want = np.median(far[far > 1e-9])
    assert K.fit_map(d).gamma == pytest.approx(1 / want, rel=0.03)
    assert K.fit_map(d).gamma == K.fit_map(d.repartition(7)).gamma


def test_gaps_copies_constants_and_no_rows(spark):
    x = np.array([[1.0, 5.0], [np.nan, 5.0], [3.0, 5.0]] + [[1.0, 5.0]] * 30)
    made = K.fit_map(vectors(spark, x), features=8)
    assert made.scale[1] == 0 and np.isfinite(made.gamma)
    z = [r.fourier.toArray() for r in made.apply(vectors(spark, x)).orderBy("id").collect()]
    assert np.isfinite(z).all() and (z[0] == z[5]).all()
    assert K.fit_map(vectors(spark, np.ones((4, 2)))).gamma == 1.0


def ring(spark, n=800):
    x = np.random.default_rng(2).normal(size=(n, 2))
    return vectors(spark, x, ((x ** 2).sum(1) < 1.4).astype(int))


def test_a_ring_needs_the_kernel_and_the_model_is_stored(spark, tmp_path):
    d = ring(spark).cache()
    ctx = M.fit_context(d, "classification")
    fitted = {k: M.make_estimator(M.Spec("SVM", "kernel", {"C": 1.0, "kernel": k}), ctx).fit(d) for k in ("rbf", "linear")}
    right = {k: M.score_model(m, d, "classification") for k, m in fitted.items()}
    assert right["rbf"] > 0.95 and right["linear"] < 0.75
    S.save_model_data(fitted["rbf"], str(tmp_path / "m"), spark)
    again = S.load_model_data(str(tmp_path / "m"), spark)
    one, two = (m.transform(d).orderBy("id").select("prediction").collect() for m in (fitted["rbf"], again))
    assert one == two


def test_a_curve_needs_the_kernel(spark):
    x = np.random.default_rng(3).uniform(-2, 2, size=(600, 1))
    d = vectors(spark, x, np.sin(3 * x[:, 0])).cache()
    ctx = M.fit_context(d, "regression")
    r2 = {k: M.score_model(M.make_estimator(M.Spec("SVR", "kernel", {"C": 1.0, "kernel": k}), ctx).fit(d), d, "regression")
          for k in ("rbf", "linear")}
    assert r2["rbf"] > 0.9 and r2["linear"] < 0.5
