"""Small Column and schema helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T


def ref(name: str) -> Column:
    """Column reference that survives dots, hyphens and backticks in names."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in skip]


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or (
        isinstance(dtype, T.DecimalType) and dtype.scale == 0)


def share_true(cond: Column) -> Column:
    """Aggregate: fraction of rows where `cond` holds (null counts as not held)."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def count_true(cond: Column) -> Column:
    """Aggregate: number of rows where `cond` holds; 0 on no rows."""
    return F.count(F.when(cond, 1))


def any_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def distinct_sketch(c: Column, log_buckets: int = 12) -> Column:
    """Aggregate: estimated distinct count (about 2 % error) from one small binary sketch.

    While a column has few values the sketch holds their hashes, so it never counts too many.
    """
    hashed = F.when(c.isNotNull(), F.xxhash64(c))
    return F.hll_sketch_estimate(F.hll_sketch_agg(hashed, F.lit(log_buckets)))


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, null when den is zero (ANSI mode would raise)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        rounded(ref(f.name), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else ref(f.name)
        for f in df.schema.fields
    ])


def to_long(one_row: DataFrame, rows: Sequence[dict[str, Column]]) -> DataFrame:
    """Turn the columns of a one-row aggregate into one row per entry of `rows`."""
    structs = [F.struct(*[c.alias(k) for k, c in r.items()]) for r in rows]
    return one_row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def unpivot_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, value) with every value as text."""
    entries = [F.struct(F.lit(c).alias("column"), ref(c).cast("string").alias("value"))
               for c in columns]
    return df.select(*[ref(k) for k in keep], F.explode(F.array(*entries)).alias("e")).select(
        *[ref(k) for k in keep], "e.column", "e.value")


def distinct_hashes(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Distinct present values of each column, counted on 64-bit digests.

    (column, digest) pairs are combined before their one shuffle, so neither whole rows nor long
    texts are expanded or sent.
    """
    if not columns:
        return {}
    pairs = [F.when(ref(c).isNotNull(), F.struct(F.lit(i).alias("i"), F.xxhash64(ref(c)).alias("h")))
             for i, c in enumerate(columns)]
    each = df.select(F.explode(F.array(*pairs)).alias("p")).where(F.col("p").isNotNull())
    found = each.groupBy("p.i", "p.h").agg(F.lit(1)).groupBy("i").agg(F.count(F.lit(1)).alias("d"))
    got = {r["i"]: r["d"] for r in found.collect()}
    return {c: got.get(i, 0) for i, c in enumerate(columns)}


def normalize_name(name: str) -> str:
    """Lower-case name with every other character run turned into one underscore."""
    out, gap = [], False
    for ch in str(name).strip().lower():
        if ch.isascii() and ch.isalnum():
            if gap and out:
                out.append("_")
            out.append(ch)
            gap = False
        else:
            gap = True
    return "".join(out)


def normalize_text(c: Column) -> Column:
    """The same rule as `normalize_name` on data values."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), F.lit("_"))
