"""Scoring of a stream of files: valid rows alone, or both routes at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.score import Scorer, split_valid, validate_rows


def score_stream(rows: DataFrame, scorer: Scorer, keep: Sequence[str]) -> DataFrame:
    """Valid rows of a streaming frame with their prediction. No state, so no watermark."""
    valid, _ = split_valid(validate_rows(rows, scorer.schema))
    return scorer.score(valid, keep)


def rejected_stream(rows: DataFrame, scorer: Scorer, keep: Sequence[str]) -> DataFrame:
    """Invalid rows with their list of problems, for a dead-letter sink."""
    _, rejected = split_valid(validate_rows(rows, scorer.schema))
    return rejected.select(*keep, "errors")


def score_files(spark: SparkSession, source: str, schema, scorer: Scorer, keep: Sequence[str],
                out: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Scores every file not yet scored and appends the result; restarts continue exactly once."""
    rows = spark.readStream.format(fmt).schema(schema).load(source)
    return (score_stream(rows, scorer, keep).writeStream.format("parquet").outputMode("append")
            .option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def route_files(spark: SparkSession, source: str, schema, scorer: Scorer, keep: Sequence[str], scored: str,
                rejected: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Writes every row not yet seen to one of two places: predictions of valid rows, and invalid rows with their problems.

    Each micro-batch is read and validated once. It goes to a folder of its own number in both places, which a replay
    after a failure overwrites, so each row is there once."""
    def write(batch: DataFrame, number: int) -> None:
        marked = validate_rows(batch, scorer.schema).persist()
        try:
            valid, bad = split_valid(marked)
            scorer.score(valid, keep).write.mode("overwrite").parquet(f"{scored}/batch={number}")
            bad.write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        finally:
            marked.unpersist()

    rows = spark.readStream.format(fmt).schema(schema).load(source)
    return (rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
