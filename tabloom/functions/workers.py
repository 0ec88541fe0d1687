"""Lets Python tasks import this library."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> SparkSession:
    """Adds the library's folder to the workers' path, as far as they run where the driver does (a cluster gets the
    library by --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])
    return spark
