"""Correlation tiles: many columns, gaps, narrow pairs with a target, several scans, no rows."""

import numpy as np
import pandas as pd
import pytest

from tabloom.operators import profile as P


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 30)) + np.arange(30) * 50
    x[:, 3] = 3 * x[:, 2] + 1
    x[:, 4] = 7.0
    x[rng.random(300) < 0.2, 10] = np.nan
    x[:, 11] = np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(30)])
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    return spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(30))).repartition(5), pdf


def same(found, pdf):
    want = pdf.corr()
    for r in found:
        w = want.loc[r.col_a, r.col_b]
        if np.isnan(w) or "c4" in (r.col_a, r.col_b):
            assert r.r is None
        else:
            assert r.r == pytest.approx(w, abs=1e-9)


@pytest.mark.parametrize("cells", [16_000_000, 1])
def test_tiles_of_any_size_and_number_of_scans(spark, wide, monkeypatch, cells):
    df, pdf = wide
    monkeypatch.setattr(P, "TILE", 16)
    centers = P.column_centers(df, df.columns)
    found = P.tile_correlations(df, centers, P.tiles_of_columns(df.columns, True), cells).collect()
    assert len(found) == 30 * 31 // 2 == len({(r.col_a, r.col_b) for r in found})
    same(found, pdf)


def test_pairs_with_one_target_are_narrow(wide):
    df, pdf = wide
    pairs = [(c, "c0") for c in df.columns[1:]]
    assert [len(t.right) for t in P.tiles_of_pairs(pairs)] == [1]
    found = P.correlation_pairs(df, pairs=pairs, batch=5).collect()
    assert {(r.col_a, r.col_b) for r in found} == set(pairs)
    same(found, pdf)


def test_only_strong_pairs_come_back(wide):
    df, _ = wide
    pairs = [(a, b) for i, a in enumerate(df.columns) for b in df.columns[i + 1:]]
    assert list(P.correlations(df, pairs, batch=5, at_least=0.9)) == [("c2", "c3")]
    assert P.correlations(df, pairs[:100], at_least=0.9).keys() == {("c2", "c3")}


def test_a_table_without_rows(wide):
    df, _ = wide
    found = P.correlation_pairs(df.where("c0 is null"), batch=5).collect()
    assert len(found) == 30 * 29 // 2 and all(r.r is None for r in found)
