"""Runs are published as a whole, and streams are routed to two places, each row once."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators import features as X, history as H, score as S
from tabloom.operators.ridge import RidgeLearner
from tabloom.streaming.scoring import route_files


def _log(store, run, value):
    store.log_run(run, 1, {"training": {"folds": 5}}, {"accuracy": value}, ["a", "b"])
    store.log_params(run, {"depth": 3})


def test_a_run_that_dies_is_not_seen_and_its_retry_counts_once(spark, tmp_path):
    store = H.RunStore(spark, str(tmp_path / "runs"))
    with store.attempt("r0"):
        _log(store, "r0", 0.5)
    with pytest.raises(ZeroDivisionError):
        with store.attempt("r1"):
            store.log_run("r1", 2, {}, {"accuracy": 0.1}, ["x"])
            1 / 0
    assert [r["run_id"] for r in store.read("runs").collect()] == ["r0"]
    assert store.read("run_features").where("feature = 'x'").count() == 0
    # the retry comes from another process
    again = H.RunStore(spark, str(tmp_path / "runs"))
    with again.attempt("r1"):
        _log(again, "r1", 0.9)
        assert again.read("runs").count() == 1  # nothing is visible before the end
    assert sorted(r["run_id"] for r in again.read("runs").collect()) == ["r0", "r1"]
    assert {r["run_id"]: r["value"] for r in again.read("run_metrics").collect()} == {"r0": 0.5, "r1": 0.9}
    assert again.read("run_features").count() == 4 and again.read("run_params").count() == 2


def test_the_last_whole_attempt_counts_with_what_is_added_later(spark, tmp_path):
    store = H.RunStore(spark, str(tmp_path / "runs"))
    for value in (0.1, 0.2):
        with store.attempt("r"):
            _log(store, "r", value)
    assert [r["value"] for r in store.read("run_metrics").collect()] == [0.2]
    rows = spark.createDataFrame([("f", "low variance")], "feature string, reason string")
    store.log_table("run_dropped", "r", rows)
    assert store.read("run_dropped").count() == 1
    with pytest.raises(ValueError):
        with store.attempt("s"):
            store.log_params("r", {})


def test_every_row_of_a_stream_takes_one_route(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i % 50), "ab"[i % 2] if i % 9 else "new", float(i)) for i in range(300)],
                                 "id long, x double, word string, label double")
    known = rows.where("x < 40 AND word <> 'new'")
    data = X.assemble(known.withColumn("word", (F.col("word") == "a").cast("double")), ["x", "word"], keep=["label"])
    scorer = S.Scorer(S.fit_serving_schema(known, ["x"], ["word"], ["x", "word"]), RidgeLearner(1.0).fit(data), "regression",
                      codes=S.ordinal_codes(known, ["word"]))
    raw = rows.drop("label")
    source, scored, rejected, check = (str(tmp_path / n) for n in ("in", "scored", "rejected", "check"))
    for part in range(3):  # a restart between the files
        raw.where(F.col("id") % 3 == part).write.mode("append").parquet(source)
        for _ in range(2):  # and one with nothing new
            route_files(spark, source, raw.schema, scorer, ["id"], scored, rejected, check).awaitTermination()
    good, bad = spark.read.parquet(scored), spark.read.parquet(rejected)
    wrong = {r["id"] for r in rows.where("x >= 40 OR word = 'new'").collect()}
    assert sorted(r["id"] for r in bad.collect()) == sorted(wrong)
    assert sorted(r["id"] for r in good.collect()) == sorted(set(range(300)) - wrong)
    assert bad.where("size(errors) = 0").count() == 0
    batch = {r["id"]: r["prediction"] for r in scorer.predict_batch(raw, ["id"], strict=False).collect()}
    assert {r["id"]: r["prediction"] for r in good.collect()} == batch
    # a batch that is replayed after a crash overwrites its own folder
    last = max(int(r["batch"]) for r in good.select("batch").distinct().collect())
    (tmp_path / "check" / "commits" / str(last)).unlink()
    (tmp_path / "check" / "commits" / f".{last}.crc").unlink(missing_ok=True)
    route_files(spark, source, raw.schema, scorer, ["id"], scored, rejected, check).awaitTermination()
    assert spark.read.parquet(scored).count() == 300 - len(wrong) and spark.read.parquet(rejected).count() == len(wrong)
