"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (evaluate_queries, feature_queries, model_queries, prepare_queries,  # noqa: F401
               profile_queries)
from .registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["dataset_summary"](spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
