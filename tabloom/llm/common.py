"""What the corpus operators share: words, tables, and how Python tasks find this package."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every text contract: space and U+0009 to U+000D.
BLANKS = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Maximal runs of anything but white space, as an array; null gives an empty array."""
    flat = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(flat, " "), "")


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python tasks import this package from the driver's path (a cluster gets it by --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])
    return spark


#: A side of at most so many rows is broadcast; callers count it first.
BROADCAST_ROWS, SALTS = 20_000, 32


def join_counted(rows: DataFrame, side: DataFrame, key: str, side_rows: int, how: str = "inner") -> DataFrame:
    """Joins a table with one row per key, of a counted size: broadcast, or with every key split by salt.

    The salt spreads a key that holds much of `rows`, and leaves `rows` unpartitioned by the key alone, so that
    an aggregate behind the join sums partially before its shuffle."""
    if side_rows <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side), key, how)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    copies = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return salted.join(copies, [key, "salt"], how).drop("salt")


def slices(batch, names: list[str], text: str = "text", most: int = 4 << 20):
    """Parts of an Arrow batch with about `most` bytes of text each, so that a task's memory stays bounded."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = batch.column(names.index(text))
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield batch.slice(start)
