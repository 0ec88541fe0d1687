"""Global order, positions and running sums without a single-task window.

All of them work in two levels: rows go into ordered buckets, the small table of bucket
counts gets prefix sums, and rows are ranked only inside their bucket. The number of buckets
follows the measured row count, so a bucket stays small at any scale.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import LIMITS
from .columns import ref

MAX_RANGES = 20_000


def seeded_digest(key: Column, seed: int) -> Column:
    """Reproducible pseudo-random order of rows: md5 of '<seed>:<key>'."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def digest_fraction(digest: Column) -> Column:
    """Uniform number in [0, 1) from the first 48 bits of a digest."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12))


def bucket_offsets(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups..., bucket, n) -> the same plus `before` = rows in earlier buckets.

    One window task sees the buckets of one group: at most 65,536 short rows.
    """
    w = W.partitionBy(*[ref(g) for g in groups]) if groups else W.partitionBy(F.lit(1))
    w = w.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    return counts.withColumn("before", F.sum("n").over(w) - F.col("n"))


def range_splits(df: DataFrame, column: str, buckets: int) -> list[float]:
    """Inner cut points that spread the values of a numeric column over `buckets` ranges."""
    if buckets <= 1:
        return []
    probs = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(ref(column).cast("double"), probs,
                                     max(10_000, 4 * buckets)).alias("q")).first()
    return sorted(set(row["q"] or []))


def range_bucket(df: DataFrame, column: str, splits: Sequence[float], name: str) -> DataFrame:
    """Adds the ordered bucket number of a numeric column (binary search in the JVM)."""
    if not splits:
        return df.withColumn(name, F.lit(0.0))
    as_double = df.withColumn("_rb", ref(column).cast("double"))
    edges = [-math.inf, *splits, math.inf]
    return Bucketizer(splits=edges, inputCol="_rb", outputCol=name).transform(as_double).drop("_rb")


def running_sums(df: DataFrame, order: str, values: Sequence[str], rows: int,
                 groups: Sequence[str] = (), suffix: str = "_before",
                 per_bucket: int = LIMITS.rows_per_bucket) -> DataFrame:
    """Adds, for each value column, the sum over all rows that come strictly earlier.

    `order` must be numeric, and unique inside a group (aggregate equal keys first).
    """
    upto = W.unboundedPreceding, W.currentRow
    splits = range_splits(df, order, min(MAX_RANGES, math.ceil(rows / per_bucket)))
    if not splits:  # all rows fit one range
        w = W.partitionBy(*([ref(g) for g in groups] or [F.lit(1)])).orderBy(ref(order)).rowsBetween(*upto)
        return df.select("*", *[(F.sum(ref(v)).over(w) - ref(v)).alias(v + suffix) for v in values])
    bucketed = range_bucket(df, order, splits, "_bucket")
    sums = bucketed.groupBy(*[ref(g) for g in groups], "_bucket").agg(
        *[F.sum(ref(v)).alias(f"_s_{v}") for v in values])
    w = W.partitionBy(*([ref(g) for g in groups] or [F.lit(1)])).orderBy("_bucket").rowsBetween(*upto)
    offsets = sums.select(
        *[ref(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col("_bucket").alias("_ob"),
        *[(F.sum(F.col(f"_s_{v}")).over(w) - F.col(f"_s_{v}")).alias(f"_o_{v}") for v in values])
    match = F.col("_bucket") == F.col("_ob")
    for i, g in enumerate(groups):
        match = match & ref(g).eqNullSafe(F.col(f"_g{i}"))
    inner = W.partitionBy(*[ref(g) for g in groups], "_bucket").orderBy(ref(order)).rowsBetween(*upto)
    out = bucketed.join(offsets, match, "inner")
    for v in values:
        out = out.withColumn(v + suffix,
                             F.col(f"_o_{v}") + F.sum(ref(v)).over(inner) - ref(v))
    return out.drop("_bucket", "_ob", *[f"_o_{v}" for v in values],
                    *[f"_g{i}" for i in range(len(groups))])
