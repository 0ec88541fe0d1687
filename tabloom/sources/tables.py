"""Scans and sinks: CSV, JSON and Parquet in; models and run metadata out."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import ref


def clean_scan(df: DataFrame) -> DataFrame:
    """Drops imported index columns (`Unnamed...`) and turns NaN into null."""
    kept = [f for f in df.schema.fields if not f.name.startswith("Unnamed")]
    return df.select(*[
        F.nanvl(ref(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else ref(f.name)
        for f in kept])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Typed CSV. Pass a schema in production: inference costs one extra scan."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return clean_scan(reader.csv(path))


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None,
              records_array: bool = False) -> DataFrame:
    """JSON lines (splittable), or files that each hold one array of records."""
    reader = spark.read.option("multiLine", records_array)
    return clean_scan((reader.schema(schema) if schema else reader).json(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return clean_scan(spark.read.parquet(path))


_READERS = {".csv": read_csv, ".json": read_json, ".parquet": read_parquet}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Chooses the scan by file extension."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in _READERS:
        raise ValueError(f"unsupported file type {suffix!r}; use one of {sorted(_READERS)}")
    return _READERS[suffix](spark, path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


RUN_METADATA_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("model_name", T.StringType()),
    T.StructField("task_type", T.StringType()), T.StructField("accuracy", T.DoubleType()),
    T.StructField("f1", T.DoubleType()), T.StructField("r2", T.DoubleType()),
    T.StructField("deployment_decision", T.StringType()),
])


def append_run_metadata(metadata: DataFrame, path: str) -> None:
    """Appends run rows; missing metric columns are stored as null."""
    have = set(metadata.columns)
    metadata.select(*[
        (ref(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in RUN_METADATA_SCHEMA]).write.mode("append").parquet(path)
