"""Column transforms. Each `fit_*` reads one split and returns a small plan; `apply_*` is a select."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..config import LIMITS, PrepareConfig
from ..functions.columns import (column_type, count_true, distinct_sketch, ref, to_long,
                                 unpivot_values)
from ..functions.lookups import lookup, value_counts
from ..functions.quantiles import exact_quantiles
from ..functions.scratch import settle
from .types import SKETCH_SURE_MANY, distinct_counts, is_temporal, parse_timestamp


def replace_columns(df: DataFrame, changed: Mapping[str, Column]) -> DataFrame:
    """One projection that rewrites some columns and keeps the order."""
    return df.select(*[changed[c].alias(c) if c in changed else ref(c) for c in df.columns])


# --- dates -------------------------------------------------------------------------------

def _date_parts(t: Column) -> dict[str, Column]:
    return {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t),
            "dayofweek": F.weekday(t), "hour": F.hour(t), "minute": F.minute(t)}


def _as_time(df: DataFrame, c: str) -> Column:
    return ref(c).cast("timestamp_ntz") if is_temporal(column_type(df, c)) else \
        parse_timestamp(ref(c))


def fit_dates(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """{column: parts to keep}: parts that vary; clock parts only if any clock is non-zero."""
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        t = _as_time(df, c)
        for p, e in _date_parts(t).items():
            aggs.append((F.min(e) < F.max(e)).alias(f"{p}{i}"))
        aggs.append(F.max(((F.hour(t) != 0) | (F.minute(t) != 0) | (F.second(t) != 0))
                          .cast("int")).alias(f"clock{i}"))
    row = df.agg(*aggs).first()
    plan = {}
    for i, c in enumerate(columns):
        usable = ["year", "month", "day", "dayofweek"]
        if row[f"clock{i}"] == 1:
            usable += ["hour", "minute"]
        plan[c] = [p for p in usable if row[f"{p}{i}"]] or ["ordinal"]
    return plan


def apply_dates(df: DataFrame, plan: Mapping[str, Sequence[str]]) -> DataFrame:
    """Replaces each date column by `<column>__<part>` doubles, after the other columns."""
    out = [ref(c) for c in df.columns if c not in plan]
    for c, parts in plan.items():
        t = _as_time(df, c)
        known = _date_parts(t)
        known["ordinal"] = F.date_diff(t.cast("date"), F.lit("0001-01-01").cast("date")) + 1
        out += [known[p].cast("double").alias(f"{c}__{p}") for p in parts]
    return df.select(*out)


# --- numbers -----------------------------------------------------------------------------

def to_number(c: Column) -> Column:
    return c.try_cast("double")


def fit_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Medians of the columns that miss values; 0.0 where nothing is present."""
    if not columns:
        return {}
    row = df.agg(*[count_true(ref(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    gaps = [c for i, c in enumerate(columns) if row[f"m{i}"]]
    numbers = df.select(*[to_number(ref(c)).alias(c) for c in gaps]) if gaps else df
    found = exact_quantiles(numbers, gaps, [0.5])
    return {c: found[c][0] if found[c][0] is not None else 0.0 for c in gaps}


def fit_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent text of the columns that miss values; smallest on ties, `missing` if none."""
    if not columns:
        return {}
    row = df.agg(*[count_true(ref(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    gaps = [c for i, c in enumerate(columns) if row[f"m{i}"]]
    if not gaps:
        return {}
    found = {r["column"]: r["value"] for r in column_modes(df, gaps).collect()}
    return {c: found.get(c, "missing") for c in gaps}


def column_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): counts are combined before the shuffle, then one row per column."""
    counts = (unpivot_values(df, columns).where(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy("column").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("value"))).alias("b"))
    return best.select("column", F.col("b.value").alias("value"), (-F.col("b.neg")).alias("n"))


def apply_cleaning(df: DataFrame, numeric: Sequence[str], text: Sequence[str],
                   medians: Mapping[str, float], modes: Mapping[str, str]) -> DataFrame:
    """Numbers coerced and filled, text filled and kept as text."""
    changed = {}
    for c in numeric:
        v = to_number(ref(c))
        changed[c] = F.coalesce(v, F.lit(float(medians[c]))) if c in medians else v
    for c in text:
        v = ref(c).cast("string")
        changed[c] = F.coalesce(v, F.lit(modes[c])) if c in modes else v
    return replace_columns(df, changed)


# --- rare levels -------------------------------------------------------------------------

@dataclass
class RareLevels:
    """Levels to merge into `Other`: inline when few, otherwise the table to look them up in."""

    column: str
    inline: list[str] | None
    table: DataFrame


def level_shares(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share) over present values. Counted once and written: look-ups read it again."""
    counts = settle(value_counts(df, column).where(F.col("value").isNotNull()), "levels")
    total = counts.agg(F.sum("n")).first()[0] or 1
    return counts.select("value", "n", (F.col("n") / F.lit(float(total))).alias("share"))


def fit_rare(df: DataFrame, column: str, cfg: PrepareConfig = PrepareConfig()) -> RareLevels | None:
    counts = settle(value_counts(df, column).where(F.col("value").isNotNull()), "levels")
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return None
    is_rare = F.col("n") / F.lit(float(total)) < cfg.rare_category_fraction
    s = counts.agg(F.count(F.lit(1)).alias("levels"), count_true(is_rare).alias("rare"),
                   F.sum(F.when(is_rare, F.col("n")).otherwise(0)).alias("rare_rows")).first()
    if (s["levels"] < cfg.rare_category_min_levels or s["rare"] < 2
            or s["rare_rows"] / total > cfg.rare_category_max_group_fraction):
        return None
    rare = counts.where(is_rare)
    inline = None
    if s["rare"] <= LIMITS.inline_levels:  # counted just above
        inline = sorted(r["value"] for r in rare.select("value").collect())
    return RareLevels(column, inline, rare)


def apply_rare(df: DataFrame, plans: Sequence[RareLevels]) -> DataFrame:
    small = {p.column: F.when(ref(p.column).isin(*p.inline), "Other").otherwise(ref(p.column))
             for p in plans if p.inline is not None}
    out = replace_columns(df, small) if small else df
    for p in plans:
        if p.inline is None:
            order = out.columns
            hit = lookup(out, p.column, p.table.withColumn("stat", F.lit("Other")),
                         ref(p.column), "_level")
            out = hit.withColumn(p.column, F.col("_level")).select(*[ref(c) for c in order])
    return out


# --- skew --------------------------------------------------------------------------------

def adjusted_skew(c: Column) -> Column:
    """Aggregate: bias-adjusted skewness, null for fewer than three values or no spread."""
    n = F.count(c).cast("double")
    g1 = F.when(F.var_pop(c) > 0, F.skewness(c))
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def skew_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    aggs = []
    for i, c in enumerate(columns):
        v = ref(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), adjusted_skew(v).alias(f"s{i}"), F.min(v).alias(f"lo{i}"),
                 distinct_sketch(v).alias(f"d{i}")]
    return to_long(df.agg(*aggs), [
        {"column": F.lit(c), "n": F.col(f"n{i}"), "skew": F.col(f"s{i}"), "low": F.col(f"lo{i}"),
         "sketch": F.coalesce(F.col(f"d{i}"), F.lit(0))} for i, c in enumerate(columns)])


def skewed_columns(df: DataFrame, columns: Sequence[str], threshold: float = 1.0) -> list[str]:
    """Non-negative columns with at least 8 values, more than 5 distinct, and strong skew."""
    if not columns:
        return []
    stats = {r["column"]: r for r in skew_stats(df, columns).collect()}
    fit = [c for c in columns if stats[c]["n"] >= 8 and stats[c]["skew"] is not None
           and stats[c]["skew"] >= threshold and stats[c]["low"] >= 0]
    exact = distinct_counts(df, [c for c in fit if stats[c]["sketch"] <= SKETCH_SURE_MANY])
    return [c for c in fit if exact.get(c, SKETCH_SURE_MANY) > 5]


def log_floor(c: Column) -> Column:
    """log1p of the value floored at zero; null stays null."""
    v = c.cast("double")
    return F.when(v.isNotNull(), F.log1p(F.greatest(v, F.lit(0.0))))


def apply_logs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return replace_columns(df, {c: log_floor(ref(c)) for c in columns})


def fit_shifted_logs(df: DataFrame, columns: Sequence[str],
                     threshold: float = 1.0) -> dict[str, float]:
    """{column: shift} for columns with skew above the threshold."""
    if not columns:
        return {}
    stats = skew_stats(df, columns).where(F.col("skew") > threshold).collect()
    return {r["column"]: abs(r["low"]) + 1.0 if r["low"] <= -1.0 else 0.0 for r in stats}


def apply_shifted_logs(df: DataFrame, shifts: Mapping[str, float]) -> DataFrame:
    return replace_columns(df, {c: F.log1p(ref(c).cast("double") + F.lit(s))
                                for c, s in shifts.items()})


def min_max(df: DataFrame, column: str, name: str) -> DataFrame:
    """Scales one column to [0, 1] by its ends; a constant column becomes 0.5."""
    ends = df.agg(F.min(ref(column)).cast("double"), F.max(ref(column)).cast("double")).first()
    low, high = ends
    if low is None or low == high:
        scaled = F.when(ref(column).isNotNull(), F.lit(0.5))
    else:
        scaled = (ref(column).cast("double") - F.lit(low)) / F.lit(high - low)
    return df.withColumn(name, scaled)
