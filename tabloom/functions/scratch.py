"""Where intermediate tables go, and how they go away.

They lie in the folder that `spark.checkpoint.dir` names, else in the warehouse folder. Executors of
a cluster must be able to read both, so a folder of one machine is refused unless the master is local.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


_scopes: list[list[str]] = []


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def shared_root(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    root = named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    fs, where = _file_system(spark, root)
    qualified = fs.makeQualified(where).toString()
    local = spark.sparkContext.master.split("[")[0] == "local"
    # a named folder is the cluster's promise that it is shared, even if its scheme is file:
    if not named and not local and qualified.startswith("file:"):
        raise ValueError(f"{qualified} lies on one machine; set spark.checkpoint.dir to a shared folder")
    return qualified.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    folder = f"{shared_root(spark)}/tabloom-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(folder)
    else:  # outside a scope a lazy result may still read it: it goes when the application ends
        fs, where = _file_system(spark, folder)
        fs.deleteOnExit(where)
    return f"{folder}/{name}"


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes on leaving what is settled inside; results to be kept must be written before."""
    _scopes.append([])
    try:
        yield
    finally:
        for folder in _scopes.pop():
            fs, where = _file_system(spark, folder)
            fs.delete(where, True)


def settle(df: DataFrame, name: str = "frame", partition_by: str | None = None) -> DataFrame:
    """Write a frame that later steps read many times, and read it back with short lineage."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
