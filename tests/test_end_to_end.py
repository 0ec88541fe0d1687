"""The end-to-end queries run the whole chain, with every candidate, trial and fold."""

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["automl_end_to_end", "automl_ensemble_end_to_end"])
def test_the_chain_ends_with_all_trials(spark, sf, name):
    got = {r["metric"]: r["value"] for r in entry.queries()[name](spark, sf).collect()}
    candidates = [m.split(":")[1] for m in got if m.startswith("candidate:")]
    searched = {m.split(":")[1]: v for m, v in got.items() if m.startswith("trials:")}
    assert len(candidates) == 3 and searched == {c: 20.0 for c in searched} and set(searched) <= set(candidates)
    assert {"RandomForest", "GradientBoosting", "XGBoost"} == set(candidates) == set(searched)
    labels = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderpriority = '1-URGENT' AS urgent").agg({"urgent": "count"}).first()[0]
    assert labels >= 1000  # so that the rules choose tree models
    assert got["accuracy"] > 0.95 > got["baseline_accuracy"] and got["roc_auc"] > 0.95
    assert all(v > 0.95 for m, v in got.items() if m.startswith("candidate:"))
    assert abs(sum(v for m, v in got.items() if m.startswith("importance:")) - 1) < 1e-6
    assert (got["ensemble_members"] > 0) <= (name == "automl_ensemble_end_to_end")
