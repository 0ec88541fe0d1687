"""Value -> statistic look-ups that stay balanced when one value fills much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import LIMITS
from .columns import ref

_HOT_SHARE = 0.001  # at most 1,000 values can each hold this share of the rows
_SPREAD = 512


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n): one shuffle of map-side-combined counts; the null group is kept."""
    return df.groupBy(ref(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def lookup(df: DataFrame, column: str, table: DataFrame, default: Column, name: str,
           limit: int = LIMITS.broadcast_rows) -> DataFrame:
    """Adds `name` = table.stat for the row whose table.value equals the column, else default.

    `table` is (value, n, stat) with unique values. A table of a measured small size is
    broadcast. A larger one is joined in two parts at once: values frequent enough to skew a
    shuffle (never more than 1/_HOT_SHARE of them) are broadcast, and their rows are spread over
    salted keys that match nothing in the shuffled join for the rest.
    """
    key = ref(column).cast("string")
    table = table.where(F.col("value").isNotNull())
    head = table.limit(limit + 1).agg(F.count(F.lit(1)).alias("rows"),
                                      F.sum(F.length("value")).alias("text")).first()
    if head["rows"] <= limit and (head["text"] or 0) <= LIMITS.broadcast_text:
        small = F.broadcast(table.select(F.col("value").alias("_v"), F.col("stat").alias("_s")))
        return (df.join(small, key == F.col("_v"), "left")
                .withColumn(name, F.coalesce("_s", default)).drop("_v", "_s"))
    total = table.agg(F.sum("n")).first()[0]
    is_hot = F.col("n") >= F.lit(total * _HOT_SHARE)
    hot = F.broadcast(table.where(is_hot).select(
        F.col("value").alias("_hv"), F.col("stat").alias("_hs")))
    cold = table.where(~is_hot).select(
        F.struct(F.col("value"), F.lit(-1).alias("salt")).alias("_cv"), F.col("stat").alias("_cs"))
    marked = df.join(hot, key == F.col("_hv"), "left")
    elsewhere = F.col("_hv").isNotNull() | key.isNull()
    join_key = F.struct(
        F.when(elsewhere, F.lit("")).otherwise(key).alias("value"),
        F.when(elsewhere, F.pmod(F.monotonically_increasing_id(), F.lit(_SPREAD)).cast("int"))
        .otherwise(F.lit(-1)).alias("salt"))
    return (marked.withColumn("_k", join_key)
            .join(cold, F.col("_k") == F.col("_cv"), "left")
            .withColumn(name, F.coalesce("_hs", "_cs", default))
            .drop("_k", "_hv", "_hs", "_cv", "_cs"))


def ranked_levels(levels: DataFrame, limit: int = LIMITS.small_table_rows) -> DataFrame:
    """(value, n) -> plus `code`, the 0-based position in text order.

    Few levels are ranked by one window. Many are cut into ranges by evenly hashed sample
    levels and ranked range by range.
    """
    levels = levels.where(F.col("value").isNotNull())
    total = levels.count()
    if total <= limit:
        return levels.withColumn("code", F.row_number().over(
            W.partitionBy(F.lit(1)).orderBy("value")) - 1)
    cuts = _sample_cuts(levels, total)
    bucketed = levels.withColumn("bucket", F.size(F.filter(
        F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("value"))))
    counts = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"))
    before = counts.select(F.col("bucket"), (F.sum("m").over(
        W.partitionBy(F.lit(1)).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
        - F.col("m")).alias("before"))
    return (bucketed.join(F.broadcast(before), "bucket")
            .withColumn("code", F.col("before") + F.row_number().over(
                W.partitionBy("bucket").orderBy("value")) - 1)
            .drop("bucket", "before"))


def _sample_cuts(levels: DataFrame, total: int, wanted: int = 256) -> list[str]:
    """About `wanted` levels picked by hash; their number is bounded by the modulus."""
    step = max(1, total // wanted)
    rows: Sequence = (levels.where(F.pmod(F.xxhash64("value"), F.lit(step)) == 0)
                      .select("value").collect())
    return sorted(r["value"] for r in rows)
