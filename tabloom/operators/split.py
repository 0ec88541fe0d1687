"""Reproducible splits, folds and samples of exact size, without a global sort.

Rows are ordered by a seeded digest of their unique key. To cut off the first k rows of a class
only the digest buckets are counted; rows are ranked in the single bucket the cut falls into.
Tagging the table is then a comparison with that one digest: a map-only pass.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import LIMITS
from ..functions.columns import ref
from ..functions.ordering import (MAX_RANGES, bucket_offsets, digest_fraction, range_bucket,
                                  range_splits, seeded_digest)
from ..functions.scratch import settle

_EXACT = "decimal(38,0)"
SPLIT_PREFIX = 4  # hex digits that buckets start with: 65,536 of them


def test_sizes(classes: DataFrame, rows: int, test_size: float) -> DataFrame:
    """(cls, n, k): k test rows per class so that train shares are proportional.

    The train part gets its exact proportional floor; what is left goes to the largest remainders.
    """
    n_train = rows - math.ceil(test_size * rows)
    product = F.col("n").cast(_EXACT) * F.lit(n_train).cast(_EXACT)
    parts = classes.withColumn("rest", (product % F.lit(rows).cast(_EXACT)).cast("long")).withColumn(
        "floor", ((product - F.col("rest")) / F.lit(rows)).cast("long"))
    left = n_train - (parts.agg(F.sum("floor")).first()[0] or 0)
    lucky = parts.orderBy(F.desc("rest"), F.asc("cls")).limit(max(left, 0)).select(
        F.col("cls").alias("_lucky"))
    return parts.join(lucky, F.col("cls").eqNullSafe(F.col("_lucky")), "left").select(
        "cls", "n",
        (F.col("n") - F.col("floor") - F.col("_lucky").isNotNull().cast("long")).alias("k"))


def _class_of(target: str | None):
    return ref(target).cast("string") if target else F.lit("all")


def _bucket_counts(tagged: DataFrame, row_key: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows as (cls, digest, bucket), and their counts per class and bucket (written once)."""
    keyed = tagged.select(F.col("_cls").alias("cls"),
                          seeded_digest(ref(row_key), seed).alias("digest")).withColumn(
        "bucket", F.substring("digest", 1, SPLIT_PREFIX))
    return keyed, settle(keyed.groupBy("cls", "bucket").agg(F.count(F.lit(1)).alias("n")), "buckets")


def can_stratify(classes: DataFrame, rows: int, test_size: float) -> bool:
    """Every class needs two rows, and both parts room for one row of each class."""
    s = classes.agg(F.min("n").alias("low"), F.count(F.lit(1)).alias("classes")).first()
    n_test = math.ceil(test_size * rows)
    return bool(s["classes"]) and s["low"] >= 2 and min(n_test, rows - n_test) >= s["classes"]


def train_test_split(df: DataFrame, row_key: str, target: str | None = None,
                     test_size: float = 0.2, seed: int = 42, name: str = "split") -> DataFrame:
    """Adds `split` = train | test, stratified by `target` when the classes allow it.

    Three scans: bucket counts, the rows of the cut buckets, and the tagging itself. The small
    tables between them are written once, so no scan is repeated.
    """
    tagged = df.withColumn("_cls", _class_of(target))
    keyed, counts = _bucket_counts(tagged, row_key, seed)
    classes = counts.groupBy("cls").agg(F.sum("n").alias("n"))
    totals = classes.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).first()
    rows = totals["rows"] or 0
    if rows == 0:
        return df.withColumn(name, F.lit("train"))
    if target and not can_stratify(classes, rows, test_size):
        return train_test_split(df, row_key, None, test_size, seed, name)

    wanted = test_sizes(classes, rows, test_size).select("cls", "k")
    # written, so its size is known and Catalyst broadcasts it only when it is small
    cuts = settle(_cut_digests(keyed, counts, wanted), "cuts").select(
        F.col("cls").alias("_cut_cls"), F.col("digest").alias("_cut"))
    digest = seeded_digest(ref(row_key), seed)
    out = tagged.join(cuts, F.col("_cls").eqNullSafe(F.col("_cut_cls")), "left")
    return out.withColumn(name, F.when(digest <= F.col("_cut"), "test").otherwise("train")).drop(
        "_cls", "_cut_cls", "_cut")


def _cut_digests(keyed: DataFrame, counts: DataFrame, wanted: DataFrame, most: int = LIMITS.rows_per_bucket) -> DataFrame:
    """(cls, k, digest): the digest of the k-th row of a class, for each wanted (cls, k).

    Only buckets that hold a wanted row are ranked. A bucket of more than `most` rows is counted again by four more
    digits of the digest, as often as it takes, so what one task ranks does not grow with the table.
    """
    def placed(counted: DataFrame, groups: list[str], found: DataFrame, same) -> DataFrame:
        """The bucket that holds each wanted row, and the row's place in it."""
        at = bucket_offsets(counted, groups).join(found, same).where(
            (F.col("before") < F.col("_need")) & (F.col("_need") <= F.col("before") + F.col("n")))
        return settle(at.select(F.col("cls").alias("_lc"), F.col("bucket").alias("_lb"), "k",
                                (F.col("_need") - F.col("before")).alias("_need"), F.col("n").alias("_n")), "located")

    first = wanted.select(F.col("cls").alias("_w"), "k", F.col("k").alias("_need"))
    located = placed(counts, ["cls"], first, F.col("cls").eqNullSafe(F.col("_w")))
    digits = SPLIT_PREFIX
    while digits < 32 and (located.agg(F.max("_n")).first()[0] or 0) > most:
        # the wanted buckets' rows alone are counted anew
        inner = F.col("cls").eqNullSafe(F.col("_lc")) & (F.substring("digest", 1, digits) == F.col("_lb"))
        parent, digits = digits, digits + 4
        rows = keyed.join(located.select("_lc", "_lb").distinct(), inner, "left_semi")
        finer = settle(rows.groupBy("cls", F.substring("digest", 1, parent).alias("parent"), F.substring("digest", 1, digits).alias(
            "bucket")).agg(F.count(F.lit(1)).alias("n")), "buckets")
        located = placed(finer, ["cls", "parent"], located.drop("_n"),
                         F.col("cls").eqNullSafe(F.col("_lc")) & (F.col("parent") == F.col("_lb")))
    here = F.col("cls").eqNullSafe(F.col("_lc")) & (F.substring("digest", 1, digits) == F.col("_lb"))
    w = W.partitionBy("cls", F.substring("digest", 1, digits)).orderBy("digest")
    ranked = keyed.join(located.select("_lc", "_lb").distinct(), here, "left_semi").withColumn(
        "_rn", F.row_number().over(w))
    return ranked.join(located, here & (F.col("_rn") == F.col("_need"))).select("cls", "k", "digest")


def fast_split(df: DataFrame, row_key: str, test_size: float = 0.2, seed: int = 42,
               name: str = "split") -> DataFrame:
    """Map-only split with approximate sizes: digest below the test share."""
    share = digest_fraction(seeded_digest(ref(row_key), seed))
    return df.withColumn(name, F.when(share < test_size, "test").otherwise("train"))


def split_sizes(split: DataFrame, target: str, name: str = "split") -> DataFrame:
    return split.groupBy(ref(target).alias("label"), ref(name).alias("split")).agg(
        F.count(F.lit(1)).alias("n"))


# --- folds -------------------------------------------------------------------------------

def comparison_folds(folds: int, rows: int) -> int:
    return min(folds, max(3, rows // 20))


def single_folds(folds: int, rows: int) -> int:
    return min(folds, rows // 10)


def search_folds(folds: int, rows: int) -> int:
    return min(folds, rows // 10, 5)


def assign_folds(df: DataFrame, row_key: str, k: int, target: str | None = None, seed: int = 42,
                 exact: bool = True, name: str = "fold") -> DataFrame:
    """Adds a fold number 0..k-1, per class of `target` if given.

    `exact` cuts each class, in digest order, into k blocks whose sizes differ by at most one; as
    with the split, the table itself is only compared with the few cut digests, never shuffled.
    Otherwise folds come from the digest alone: sizes are equal on average and nothing is counted.
    """
    digest = seeded_digest(ref(row_key), seed)
    if not exact:
        return df.withColumn(name, F.floor(digest_fraction(digest) * k).cast("int"))
    tagged = df.withColumn("_cls", _class_of(target))
    keyed, counts = _bucket_counts(tagged, row_key, seed)
    i = F.col("i")
    size, extra = F.floor(F.col("n") / k), F.col("n") % k
    ends = counts.groupBy("cls").agg(F.sum("n").alias("n")).withColumn(
        "i", F.explode(F.sequence(F.lit(1), F.lit(max(k - 1, 1))))).select(
        "cls", (size * i + F.least(extra, i)).cast("long").alias("k")).where("k > 0")
    # at most k - 1 digests per class
    cuts = settle(_cut_digests(keyed, counts, ends).groupBy("cls").agg(
        F.sort_array(F.collect_list("digest")).alias("_cuts")), "folds").select(
        F.col("cls").alias("_cut_cls"), "_cuts")
    passed = F.size(F.filter("_cuts", lambda c: c < digest))
    return tagged.join(cuts, F.col("_cls").eqNullSafe(F.col("_cut_cls")), "left").withColumn(
        name, F.coalesce(passed, F.lit(0)).cast("int")).drop("_cls", "_cut_cls", "_cuts")


# --- even-stride sample ------------------------------------------------------------------

def stride_sample(df: DataFrame, order: str, limit: int = 140) -> DataFrame:
    """At most `limit` rows at equal steps along a numeric unique key; all rows if fewer.

    Kept are the positions floor(i * rows / limit). Whether a position is one of them is plain
    arithmetic, so only the value ranges that hold one are ranked, each in its own task.
    """
    rows = df.count()
    if rows <= limit:
        return df

    def first_kept(position: str):
        """The first kept position at or after the given one."""
        return F.expr(f"(({position} * {limit}L + {rows}L - 1) div {rows}L) * {rows}L div {limit}L")

    buckets = min(MAX_RANGES, math.ceil(rows / LIMITS.rows_per_bucket))
    bucketed = range_bucket(df, order, range_splits(df, order, buckets), "_bucket")
    counts = bucketed.groupBy(F.col("_bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    ranges = bucket_offsets(counts, []).where(
        first_kept("before") < F.least(F.col("before") + F.col("n"), F.lit(rows))).select(
        F.col("bucket").alias("_range"), F.col("before").alias("_before"))
    w = W.partitionBy("_bucket").orderBy(ref(order))
    # at most MAX_RANGES rows are broadcast
    placed = bucketed.join(F.broadcast(ranges), F.col("_bucket") == F.col("_range")).withColumn(
        "_position", F.col("_before") + F.row_number().over(w) - 1)
    return placed.where(first_kept("_position") == F.col("_position")).drop(
        "_bucket", "_range", "_before", "_position")
