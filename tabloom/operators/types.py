"""Semantic column types, task type, and identifier tests, from fused aggregates over whole columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..config import BOOLEAN_WORDS, CODE_PATTERN, DIGITS_PATTERN, IDENTIFIER_NAMES, PrepareConfig
from ..functions.columns import (column_type, count_true, distinct_hashes, distinct_sketch,
                                 is_integral, normalize_name, ref, to_long)

# With few distinct values the sketch holds their hashes, so an estimate above this proves that a
# column has more than 20 distinct values; below it they are counted exactly.
SKETCH_SURE_MANY = 64

# fixed values: text layouts tried, after ISO, when a string might be a date
DATE_LAYOUTS = ("M/d/yyyy", "M/d/yyyy H:mm", "yyyy/M/d", "d-MMM-yyyy", "MMM d, yyyy", "d.M.yyyy")


# the sign that a value of each layout holds; a value that lacks it, or does not end in a digit, has not that shape
LAYOUT_SIGNS = dict(zip(DATE_LAYOUTS, ("/", ":", "/", "-", ",", ".")))


def parse_timestamp(c: Column) -> Column:
    """ISO first; a layout is tried only on values of its shape, because a parse that fails costs an exception."""
    ends_in_digit = F.substring(c, -1, 1).between("0", "9")
    return F.coalesce(c.try_cast("timestamp_ntz"), *[
        F.when(ends_in_digit & c.contains(sign), F.try_to_timestamp(c, F.lit(p)).cast("timestamp_ntz"))
        for p, sign in LAYOUT_SIGNS.items()])


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


@dataclass
class ColumnFacts:
    """Per-column counts every decision reads."""

    rows: int
    present: dict[str, int] = field(default_factory=dict)
    low: dict[str, Any] = field(default_factory=dict)
    high: dict[str, Any] = field(default_factory=dict)
    sketch: dict[str, int] = field(default_factory=dict)
    beyond: dict[str, int] = field(default_factory=dict)  # values other than low and high

    def two_valued(self, c: str) -> bool:
        return self.present[c] > 0 and self.beyond[c] == 0

    def constant(self, c: str) -> bool:
        return self.present[c] > 0 and self.low[c] == self.high[c]


def column_facts(df: DataFrame, columns: Iterable[str] | None = None) -> ColumnFacts:
    """Two scans, no shuffle of rows: counts, ends and a distinct sketch; then the rest count."""
    cols = list(columns if columns is not None else df.columns)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        aggs += [F.count(ref(c)).alias(f"n{i}"), F.min(ref(c)).alias(f"lo{i}"),
                 F.max(ref(c)).alias(f"hi{i}"),
                 distinct_sketch(ref(c)).alias(f"d{i}")]
    row = df.agg(*aggs).first()
    facts = ColumnFacts(row["rows"])
    for i, c in enumerate(cols):
        facts.present[c], facts.sketch[c] = row[f"n{i}"], row[f"d{i}"] or 0
        facts.low[c], facts.high[c] = row[f"lo{i}"], row[f"hi{i}"]
        facts.beyond[c] = 0 if facts.sketch[c] <= SKETCH_SURE_MANY else facts.present[c]
    unsure = [c for c in cols if facts.present[c] and facts.sketch[c] <= SKETCH_SURE_MANY]
    if unsure:
        row = df.agg(*[count_true((ref(c) != F.lit(facts.low[c])) & (ref(c) != F.lit(facts.high[c])))
                       .alias(f"b{i}") for i, c in enumerate(unsure)]).first()
        for i, c in enumerate(unsure):
            facts.beyond[c] = row[f"b{i}"]
    return facts


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Exact distinct counts (nulls not counted) of the few columns a decision hangs on."""
    return distinct_hashes(df, columns)


def at_most(df: DataFrame, facts: ColumnFacts, columns: Sequence[str], limit: int) -> list[str]:
    """Columns with at most `limit` (<= 20) distinct values; only sketch-unsure ones are counted."""
    unsure = [c for c in columns if facts.sketch[c] <= SKETCH_SURE_MANY]
    exact = distinct_counts(df, unsure)
    return [c for c in unsure if exact[c] <= limit]


# --- shares of text layouts --------------------------------------------------------------

def text_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column over all present values: their number, share of digits-only, of dates, of codes.

    One aggregate for all columns. A share over a prefix would be cheaper, but a table's first rows
    are one day or one tenant.
    """
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column string, present long, digits_share double, date_share double, code_share double")
    aggs = []
    for i, c in enumerate(columns):
        v = ref(c).cast("string")
        aggs += [F.count(v).alias(f"n{i}"),
                 F.avg(v.rlike(DIGITS_PATTERN).cast("double")).alias(f"g{i}"),
                 F.avg(F.when(v.isNotNull(), parse_timestamp(v).isNotNull().cast("double"))).alias(f"t{i}"),
                 F.avg(v.rlike(CODE_PATTERN).cast("double")).alias(f"k{i}")]
    return to_long(df.agg(*aggs), [{
        "column": F.lit(c), "present": F.col(f"n{i}"), "digits_share": F.col(f"g{i}"),
        "date_share": F.col(f"t{i}"), "code_share": F.col(f"k{i}")} for i, c in enumerate(columns)])


# --- decisions ---------------------------------------------------------------------------

def datetime_like(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    cols = list(columns if columns is not None else df.columns)
    typed = [c for c in cols if is_temporal(column_type(df, c))]
    text = [c for c in cols if isinstance(column_type(df, c), T.StringType)]
    found = set(typed)
    for r in text_shares(df, text).collect():
        if r["present"] >= 3 and r["digits_share"] <= 0.9 and r["date_share"] >= 0.8:
            found.add(r["column"])
    return [c for c in cols if c in found]


def binary_like(df: DataFrame, facts: ColumnFacts, columns: Sequence[str]) -> list[str]:
    """Two distinct values at most, numeric or both from the boolean vocabulary."""
    def words(c):
        return {str(facts.low[c]).strip().lower(), str(facts.high[c]).strip().lower()}

    out = []
    for c in columns:
        dtype = column_type(df, c)
        if isinstance(dtype, T.BooleanType):
            out.append(c)
        elif facts.two_valued(c) and (isinstance(dtype, T.NumericType)
                                      or words(c) <= set(BOOLEAN_WORDS)):
            out.append(c)
    return out


def detect_types(df: DataFrame, columns: Sequence[str] | None = None,
                 facts: ColumnFacts | None = None) -> dict[str, str]:
    """{column: datetime | binary | numeric | categorical}, tested in that order."""
    cols = list(columns if columns is not None else df.columns)
    facts = facts or column_facts(df, cols)
    dates = set(datetime_like(df, cols))
    pairs = set(binary_like(df, facts, [c for c in cols if c not in dates]))

    def kind(c):
        if c in dates:
            return "datetime"
        if c in pairs:
            return "binary"
        return "numeric" if isinstance(column_type(df, c), T.NumericType) else "categorical"

    return {c: kind(c) for c in cols}


def task_type(df: DataFrame, target: str, divisor: int = 10) -> str:
    """classification for text, boolean or few-valued integers; `divisor` is 10 or 5."""
    dtype = column_type(df, target)
    if not isinstance(dtype, T.NumericType):
        return "classification"
    if not is_integral(dtype):
        return "regression"
    row = df.agg(F.count(ref(target)).alias("n"),
                 distinct_sketch(ref(target)).alias("d")).first()
    if row["n"] == 0 or (row["d"] or 0) > SKETCH_SURE_MANY:
        return "regression"
    distinct = distinct_counts(df, [target])[target]
    return "classification" if distinct <= min(20, max(2, row["n"] // divisor)) else "regression"


def sequential_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, is_sequential): whole numbers that fill min..max once each, in any order."""
    aggs = []
    for i, c in enumerate(columns):
        v = ref(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), (F.max(v) - F.min(v) + 1).alias(f"w{i}"),
                 F.coalesce(F.max((v != F.round(v)).cast("int")), F.lit(1)).alias(f"f{i}")]
    row = df.agg(*aggs).first()
    # only a column whose width equals its count can be one, and only that one is counted
    fits = [c for i, c in enumerate(columns)
            if row[f"n{i}"] >= 5 and row[f"f{i}"] == 0 and row[f"w{i}"] == row[f"n{i}"]]
    distinct = distinct_hashes(df, fits)
    number = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    return df.sparkSession.createDataFrame(
        [(c, c in distinct and distinct[c] == number[c]) for c in columns],
        "column string, is_sequential boolean")


def identifier_name(name: str) -> str | None:
    """Why a name alone marks an identifier, or None."""
    n = normalize_name(name)
    if n.startswith("unnamed"):
        return "looks like an imported index column"
    if n in IDENTIFIER_NAMES or n.endswith("_id") or "uuid" in n or "guid" in n:
        return "name strongly suggests an identifier column"
    return None


def index_like_name(name: str) -> bool:
    n = name.strip().lower()
    return n.startswith("unnamed") or n in ("index", "row_id") or n.endswith("_id")


def identifier_columns(df: DataFrame, cfg: PrepareConfig = PrepareConfig(),
                       columns: Sequence[str] | None = None,
                       facts: ColumnFacts | None = None) -> dict[str, str]:
    """{column: detail} for columns that identify rows, by name or by near-unique codes."""
    cols = list(columns if columns is not None else df.columns)
    facts = facts or column_facts(df, cols)
    named = {c: identifier_name(c) for c in cols if facts.present[c]}
    found = {c: why for c, why in named.items() if why}
    # the sketch is within a few per cent, so only columns near the unique share need counting
    maybe = [c for c in cols if c not in found and facts.rows >= 20
             and facts.sketch[c] >= 0.8 * cfg.identifier_unique_fraction * max(facts.present[c], 1)
             and (is_integral(column_type(df, c)) or isinstance(column_type(df, c), T.StringType)
                  or isinstance(column_type(df, c), T.NumericType))]
    if maybe:
        distinct = distinct_counts(df, maybe)
        codeable = [c for c in maybe if isinstance(column_type(df, c), T.StringType)
                    or is_integral(column_type(df, c))]
        codes = {r["column"] for r in text_shares(df, codeable).collect()
                 if r["code_share"] >= 0.9}
        for c in maybe:
            n, d = facts.present[c], distinct[c]
            if d < max(20, int(facts.rows * 0.5)) or d / max(n, 1) < cfg.identifier_unique_fraction:
                continue
            runs = (isinstance(column_type(df, c), T.NumericType) and n >= 5 and d == n
                    and float(facts.high[c]) - float(facts.low[c]) + 1 == n
                    and float(facts.low[c]).is_integer())
            if c in codes or runs:
                found[c] = "values are near-unique and look like record identifiers"
    return {c: found[c] for c in cols if c in found}
