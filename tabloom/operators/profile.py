"""Dataset profile: fused single-scan statistics, reported as small long tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..config import LIMITS, NUMERIC_SENTINELS, TEXT_SENTINELS
from ..functions.columns import (any_of, column_type, count_true, distinct_hashes, numeric_columns,
                                 ratio, ref, share_true, text_columns, to_long)
from ..functions.quantiles import exact_quantiles


# --- summaries ---------------------------------------------------------------------------

def shape_counts(df: DataFrame, target: str | None = None) -> DataFrame:
    width = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(width).cast("long").alias("column_count"),
        F.lit(width - (1 if target else 0)).cast("long").alias("feature_count"))


def missing_ratio(df: DataFrame) -> DataFrame:
    one = df.agg(*[share_true(ref(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    return to_long(one, [{"column": F.lit(c), "missing_ratio": F.col(f"m{i}")}
                         for i, c in enumerate(df.columns)])


def high_missing(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    return missing_ratio(df).where(F.col("missing_ratio") > threshold)


def missing_overview(df: DataFrame) -> DataFrame:
    """Cells, rows and columns with missing values in one pass."""
    nulls = [ref(c).isNull() for c in df.columns]
    counts = [count_true(n).alias(f"n{i}") for i, n in enumerate(nulls)]
    one = df.agg(F.count(F.lit(1)).alias("n"), count_true(any_of(nulls)).alias("rows"), *counts)
    cells = sum((F.col(f"n{i}") for i in range(len(nulls))), F.lit(0))
    cols = sum((F.when(F.col(f"n{i}") > 0, 1).otherwise(0) for i in range(len(nulls))), F.lit(0))
    share = F.col("rows") / F.greatest(F.col("n"), F.lit(1))
    return one.select(
        cells.cast("long").alias("total_missing_cells"),
        F.col("rows").alias("rows_with_missing"),
        F.round(share * 100, 2).alias("missing_rows_pct"),
        share.alias("rows_with_missing_fraction"),
        cols.cast("long").alias("missing_columns_count"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical group; nulls compare equal.

    Rows are grouped by two digests of all columns and their null marks, 128 bits together, so the
    shuffle carries 16 bytes a row whatever its width.
    """
    marked = [x for c in df.columns for x in (ref(c).isNull(), ref(c))]
    digests = df.select(F.xxhash64(*marked).alias("_a"),
                        F.xxhash64(F.lit("again"), *reversed(marked)).alias("_b"))
    groups = digests.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
    one = groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
                     F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))
    return one.select("duplicate_rows", F.round(
        F.col("duplicate_rows") / F.greatest(F.col("n"), F.lit(1)) * 100, 2).alias("duplicate_pct"))


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles, max and the missing ratio per numeric column."""
    cols = list(columns or numeric_columns(df))
    cuts = exact_quantiles(df, cols, (0.25, 0.5, 0.75))
    aggs = []
    for i, c in enumerate(cols):
        v = ref(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"),
                 F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
                 share_true(v.isNull()).alias(f"m{i}")]
    rows = []
    for i, c in enumerate(cols):
        q25, q50, q75 = (F.lit(q).cast("double") for q in cuts[c])
        rows.append({"column": F.lit(c), "count": F.col(f"n{i}"), "mean": F.col(f"a{i}"),
                     "std": F.col(f"s{i}"), "min": F.col(f"lo{i}"), "q25": q25, "q50": q50,
                     "q75": q75, "max": F.col(f"hi{i}"), "missing_ratio": F.col(f"m{i}")})
    return to_long(df.agg(*aggs), rows)


def column_catalogue(df: DataFrame) -> DataFrame:
    """Per column: type group and missing share, with the averages over all columns beside."""
    numeric = set(numeric_columns(df))
    one = df.agg(*[share_true(ref(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    mean = sum((F.col(f"m{i}") for i in range(len(df.columns))), F.lit(0.0)) / len(df.columns)
    return to_long(one, [{
        "column": F.lit(c), "dtype": F.lit(column_type(df, c).simpleString()),
        "is_numeric": F.lit(c in numeric), "missing_pct": F.col(f"m{i}"),
        "average_missing": mean, "numeric_count": F.lit(len(numeric)).cast("long"),
        "categorical_count": F.lit(len(df.columns) - len(numeric)).cast("long"),
    } for i, c in enumerate(df.columns)])


def column_profile(df: DataFrame, max_columns: int | None = None, approximate: bool = False) -> DataFrame:
    """Missing share and distinct count of all columns, or the first ones (sketch if `approximate`)."""
    cols = df.columns[:max_columns]
    numeric = set(numeric_columns(df))
    sketches = [F.approx_count_distinct(ref(c)).alias(f"d{i}") for i, c in enumerate(cols)]
    exact = {} if approximate else distinct_hashes(df, cols)
    one = df.agg(*[share_true(ref(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)],
                 *(sketches if approximate else []))
    return to_long(one, [{
        "column": F.lit(c), "is_numeric": F.lit(c in numeric), "missing_pct": F.col(f"m{i}"),
        "unique_values": F.col(f"d{i}") if approximate else F.lit(exact[c]).cast("long")}
        for i, c in enumerate(cols)])


def preview(df: DataFrame, row_key: str, rows: int = 5) -> DataFrame:
    """First rows by key as text, nulls blank; row count clamped to 1..20."""
    return df.orderBy(ref(row_key)).limit(max(1, min(rows, 20))).select(
        *[F.coalesce(ref(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


# --- correlation -------------------------------------------------------------------------

@dataclass(frozen=True)
class Centers:
    """Column means, and which columns miss values; centring keeps the sums below stable."""

    mean: dict[str, float]
    gaps: frozenset[str]
    rows: int = 0


def column_centers(df: DataFrame, columns: Sequence[str]) -> Centers:
    """One light aggregate."""
    cols = list(dict.fromkeys(columns))
    row = df.agg(F.count(F.lit(1)).alias("n"), *[e for i, c in enumerate(cols) for e in (
        F.avg(ref(c).cast("double")).alias(f"a{i}"), F.count(ref(c)).alias(f"n{i}"))]).first()
    return Centers({c: row[f"a{i}"] or 0.0 for i, c in enumerate(cols)},
                   frozenset(c for i, c in enumerate(cols) if row[f"n{i}"] < row["n"]), row["n"])


class CoMoments:
    """Plain centred sums from which pairwise-complete correlations follow.

    Complete columns share their own sums across all pairs, so a pair costs one sum of products;
    only pairs with gaps need sums restricted to the rows where both values are present. Spark
    computes the sums in one aggregate; what remains is arithmetic on one row.
    """

    def __init__(self, centers: Centers, pairs: Sequence[tuple[str, str]], tag: str = "k"):
        self.centers, self.pairs, self.tag = centers, list(dict.fromkeys(pairs)), tag
        self._keys: dict[tuple, int] = {}
        for a, b in self.pairs:
            for kind in ("n", "s", "q"):
                self._place((kind, a, self._mask(a, b)))
                self._place((kind, b, self._mask(b, a)))
            self._place(("p", a, b))

    def _mask(self, c: str, other: str) -> str | None:
        return other if other in self.centers.gaps and other != c else None

    def _place(self, key: tuple) -> int:
        return self._keys.setdefault(key, len(self._keys))

    def sums(self) -> list[Column]:
        x = {c: ref(c).cast("double") - F.lit(m) for c, m in self.centers.mean.items()}

        def value(kind: str, c: str, other: str | None) -> Column:
            if kind == "p":
                return F.sum(x[c] * x[other])
            seen = F.when(ref(other).isNotNull(), x[c]) if other else x[c]
            return F.count(seen) if kind == "n" else F.sum(seen if kind == "s" else seen * seen)

        return [value(*k).alias(f"{self.tag}{i}") for k, i in self._keys.items()]

    def solve(self, row) -> dict[tuple[str, str], float | None]:
        """r per pair from the aggregated row; None where a side does not vary."""
        got = {k: row[f"{self.tag}{i}"] for k, i in self._keys.items()}

        def side(c: str, other: str) -> tuple[int, float, float]:
            mask = self._mask(c, other)
            n, s, q = (got[kind, c, mask] for kind in ("n", "s", "q"))
            spread = (q or 0.0) - (s or 0.0) ** 2 / n if n else 0.0
            # what rounding leaves of a constant column is not spread
            return n, s or 0.0, spread if spread > (q or 0.0) * 1e-13 else 0.0

        out = {}
        for a, b in self.pairs:
            n, sa, va = side(a, b)
            _, sb, vb = side(b, a)
            if va > 0 and vb > 0:
                r = (got["p", a, b] - sa * sb / n) / (math.sqrt(va) * math.sqrt(vb))
                out[a, b] = max(-1.0, min(1.0, r))
            else:
                out[a, b] = None
        return out


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]], batch: int = 200,
                 at_least: float | None = None) -> dict[tuple[str, str], float | None]:
    """r per pair on the driver: one light scan for the means, then one scan for all pairs.

    Up to `batch` pairs are plain sums; more come from tiles. With `at_least`, pairs of a smaller |r| or none are left
    out, before anything is collected.
    """
    if not pairs:
        return {}
    centers = column_centers(df, [c for p in pairs for c in p])
    if len(pairs) > batch:
        found = tile_correlations(df, centers, tiles_of_pairs(pairs))
        if at_least is not None:
            found = found.where(F.abs("r") >= at_least)
        return {(x["col_a"], x["col_b"]): x["r"] for x in found.collect()}
    m = CoMoments(centers, pairs)
    out = m.solve(df.agg(*m.sums()).first())
    return out if at_least is None else {p: r for p, r in out.items() if r is not None and abs(r) >= at_least}


@dataclass(frozen=True)
class Tile:
    """Left against right columns; `wanted` tells which of their pairs are asked for (all if None)."""

    left: tuple[str, ...]
    right: tuple[str, ...]
    wanted: np.ndarray | None = None


TILE = 256


def tiles_of_columns(cols: Sequence[str], diagonal: bool = False) -> list[Tile]:
    """Every pair of the columns once, earlier column first; with itself too if `diagonal`."""
    blocks = [tuple(cols[i:i + TILE]) for i in range(0, len(cols), TILE)]
    own = [Tile(b, b, np.triu(np.ones((len(b), len(b)), bool), 0 if diagonal else 1)) for b in blocks]
    return own + [Tile(a, b) for a, b in combinations(blocks, 2)]


def tiles_of_pairs(pairs: Sequence[tuple[str, str]]) -> list[Tile]:
    """Pairs by the blocks of their columns: pairs with one target make narrow tiles, a product of vectors."""
    place = {c: i for i, c in enumerate(dict.fromkeys(c for p in pairs for c in p))}
    groups: dict[tuple[int, int], list] = {}
    for a, b in dict.fromkeys(pairs):
        groups.setdefault((place[a] // TILE, place[b] // TILE), []).append((a, b))
    out = []
    for group in groups.values():
        left, right = (list(dict.fromkeys(p[k] for p in group)) for k in (0, 1))
        at_left, at_right = ({c: i for i, c in enumerate(side)} for side in (left, right))
        wanted = np.zeros((len(left), len(right)), bool)
        for a, b in group:
            wanted[at_left[a], at_right[b]] = True
        out.append(Tile(tuple(left), tuple(right), wanted))
    return out


def tile_correlations(df: DataFrame, centers: Centers, tiles: Sequence[Tile], cells: int = 16_000_000) -> DataFrame:
    """(col_a, col_b, r): pairwise-complete r of the pairs of all tiles; r is null where a side does not vary.

    A task adds up the products of its rows per tile; tiles are summed by number, first in several tasks each, and
    solved where their sum ends, so that nothing of the size of the pairs comes to the driver. A tile of complete columns
    holds their own sums and one product matrix; one with gaps, six matrices of the rows where both values are
    present. A scan reads the columns of as many tiles as fit `cells` numbers in a task.
    """
    scans, room = [], 0
    for t in tiles:
        size = len(t.left) * len(t.right) * (6 if centers.gaps.intersection(t.left + t.right) else 1)
        if not scans or room + size > cells:
            scans.append([])
            room = 0
        scans[-1].append(t)
        room += size
    if not scans:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, r double")
    return reduce(DataFrame.unionAll, [_scan_tiles(df, centers, s) for s in scans])


def _scan_tiles(df: DataFrame, centers: Centers, tiles: Sequence[Tile]) -> DataFrame:
    cols = list(dict.fromkeys(c for t in tiles for c in t.left + t.right))
    place = {c: i for i, c in enumerate(cols)}
    shift = np.array([float(centers.mean[c]) for c in cols])
    sides = [([place[c] for c in t.left], [place[c] for c in t.right]) for t in tiles]
    names = [(t.left, t.right, t.wanted) for t in tiles]
    gappy = [bool(centers.gaps.intersection(t.left + t.right)) for t in tiles]

    def products(batches):
        sums = [None] * len(names)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns], 1) - shift
            mark = ~np.isnan(x)
            m, v = mark.astype(np.float64), np.where(mark, x, 0.0)
            q = v * v
            total, square = v.sum(0), q.sum(0)
            for k, (a, b) in enumerate(sides):
                va, vb = v[:, a], v[:, b]
                if gappy[k]:
                    ma, mb = m[:, a], m[:, b]
                    part = [ma.T @ mb, va.T @ mb, q[:, a].T @ mb, ma.T @ vb, ma.T @ q[:, b], va.T @ vb]
                else:
                    part = [np.array([len(v)]), total[a], square[a], total[b], square[b], va.T @ vb]
                flat = np.concatenate([y.ravel() for y in part])
                sums[k] = flat if sums[k] is None else sums[k] + flat
        yield from told({k: y for k, y in enumerate(sums) if y is not None})

    def told(sums):
        for k, y in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([y], pa.list_(pa.float64()))],
                                             names=["tile", "sums"])

    def summed(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, k in enumerate(batch.column(0).to_pylist()):
                y = batch.column(1)[i].values.to_numpy(zero_copy_only=False)
                sums[k] = sums[k] + y if k in sums else np.array(y)
        return sums

    def added(batches):
        yield from told(summed(batches))

    def solved(batches):
        for k, y in summed(batches).items():
            left, right, wanted = names[k]
            w, h = len(left), len(right)
            if gappy[k]:
                n, sa, qa, sb, qb, p = (z.reshape(w, h) for z in np.split(y, 6))
            else:
                n, sa, qa, sb, qb, p = np.split(y, np.cumsum([1, w, w, h, h]))
                sa, qa, p = sa[:, None], qa[:, None], p.reshape(w, h)
            with np.errstate(divide="ignore", invalid="ignore"):
                spread = [q - s * s / n for s, q in ((sa, qa), (sb, qb))]
                # what rounding leaves of a constant column is not spread
                varies = (n > 0) & (spread[0] > qa * 1e-13) & (spread[1] > qb * 1e-13)
                r = np.clip((p - sa * sb / n) / (np.sqrt(spread[0]) * np.sqrt(spread[1])), -1.0, 1.0)
            i, j = np.nonzero(np.ones((w, h), bool) if wanted is None else wanted)
            varies = np.broadcast_to(varies, (w, h))[i, j]
            yield pa.RecordBatch.from_arrays(
                [pa.array([left[x] for x in i], pa.string()), pa.array([right[x] for x in j], pa.string()),
                 pa.array(r[i, j], pa.float64(), mask=~varies)], names=["col_a", "col_b", "r"])

    numbers = df.select(*[ref(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    schema = "tile int, sums array<double>"
    parts = (numbers.mapInArrow(products, schema).withColumn("salt", F.spark_partition_id() % 16)
             .repartition("tile", "salt"))
    found = parts.mapInArrow(added, schema).repartition("tile").mapInArrow(solved, "col_a string, col_b string, r double")
    if not centers.rows:  # no row told of any tile
        empty = [(a, b, None) for left, right, wanted in names for i, a in enumerate(left) for j, b in enumerate(right)
                 if wanted is None or wanted[i, j]]
        return df.sparkSession.createDataFrame(empty, "col_a string, col_b string, r double")
    return found


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None,
                      pairs: Sequence[tuple[str, str]] | None = None, diagonal: bool = False,
                      batch: int = 200) -> DataFrame:
    """(col_a, col_b, r) for each pair, pairwise complete: the given pairs or all of the columns (with themselves if
    `diagonal`). More than `batch` pairs stay in a DataFrame throughout."""
    cols = list(columns or numeric_columns(df)) if pairs is None else []
    count = len(pairs) if pairs is not None else len(cols) * (len(cols) - 1) // 2 + len(cols) * diagonal
    if count > batch:
        tiles = tiles_of_columns(cols, diagonal) if pairs is None else tiles_of_pairs(pairs)
        return tile_correlations(df, column_centers(df, cols or [c for p in pairs for c in p]), tiles)
    todo = list(pairs) if pairs is not None else list(combinations(cols, 2)) + [(c, c) for c in cols if diagonal]
    return df.sparkSession.createDataFrame(
        [(a, b, r) for (a, b), r in correlations(df, todo, batch).items()],
        "col_a string, col_b string, r double")


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Full matrix in long form: both triangles and the diagonal."""
    cols = list(columns or numeric_columns(df))
    if len(cols) < 2:
        return correlation_pairs(df, pairs=[])
    upper = correlation_pairs(df, cols, diagonal=True)
    both = F.when(F.col("col_a") == F.col("col_b"), F.array(F.struct("col_a", "col_b"))).otherwise(
        F.array(F.struct("col_a", "col_b"),
                F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"))))
    return upper.select(F.explode(both).alias("p"), "r").select("p.col_a", "p.col_b", "r")


def high_correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None,
                           threshold: float = 0.8) -> DataFrame:
    return correlation_pairs(df, columns).where(F.abs("r") > threshold)


# --- target ------------------------------------------------------------------------------

def class_distribution(df: DataFrame, target: str, keep_null: bool = False) -> DataFrame:
    rows = df if keep_null else df.where(ref(target).isNotNull())
    return rows.groupBy(ref(target).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("n"))


def target_stats(df: DataFrame, target: str) -> DataFrame:
    median = exact_quantiles(df, [target], [0.5])[target][0]
    v = ref(target).cast("double")
    return df.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
                  F.stddev_samp(v).alias("std")).select(
        "*", F.lit(median).cast("double").alias("median"))


def imbalance(df: DataFrame, target: str) -> DataFrame:
    """Largest over smallest class (nulls are a class) with its severity band."""
    ends = class_distribution(df, target, keep_null=True).agg(
        F.min("n").alias("min_count"), F.max("n").alias("max_count"))
    r = ratio(F.col("max_count"), F.col("min_count"))
    severity = (F.when(r >= 10, "severe").when(r >= 3, "moderate").when(r >= 1.5, "mild")
                .otherwise("none"))
    return ends.select("min_count", "max_count", r.alias("imbalance_ratio"),
                       severity.alias("imbalance_severity"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    return class_distribution(df, target).agg(
        F.coalesce(ratio(F.min("n"), F.max("n")), F.lit(1.0)).alias("class_balance"))


# --- outliers and placeholder values -----------------------------------------------------

def tukey_bounds(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    bounds = {}
    for c, (q1, q3) in exact_quantiles(df, columns, (0.25, 0.75)).items():
        if q1 is not None:
            reach = 1.5 * (q3 - q1)
            bounds[c] = (q1 - reach, q3 + reach)
    return bounds


def outlier_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count and share of rows outside the Tukey fences; only columns that have any."""
    bounds = tukey_bounds(df, list(columns or numeric_columns(df)))
    if not bounds:
        return df.sparkSession.createDataFrame(
            [], "column string, outlier_count long, outlier_pct double")
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, (c, (lo, hi)) in enumerate(bounds.items()):
        v = ref(c).cast("double")
        aggs.append(count_true((v < lo) | (v > hi)).alias(f"o{i}"))
    return to_long(df.agg(*aggs), [
        {"column": F.lit(c), "outlier_count": F.col(f"o{i}"),
         "outlier_pct": ratio(F.col(f"o{i}"), F.col("n")) * 100}
        for i, c in enumerate(bounds)]).where(F.col("outlier_count") > 0)


def outlier_rollup(outliers: DataFrame) -> DataFrame:
    return outliers.agg(
        F.count(F.lit(1)).alias("outlier_columns_count"),
        F.round(F.coalesce(F.max("outlier_pct"), F.lit(0.0)), 2).alias("max_outlier_pct"))


def high_cardinality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns with more distinct values than max(50, half the rows)."""
    cols = list(columns or text_columns(df))
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.approx_count_distinct(ref(c)).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    limit = max(50, int(row["n"] * 0.5))
    # the sketch errs by a few per cent: only columns it cannot rule out are counted exactly
    exact = distinct_hashes(df, [c for i, c in enumerate(cols) if row[f"d{i}"] > 0.7 * limit])
    return df.sparkSession.createDataFrame([(c, d) for c, d in exact.items() if d > limit],
                                           "column string, distinct_count long")


def numeric_sentinel_share(column: str) -> Column:
    """Aggregate: largest share any one numeric sentinel has among present values."""
    return F.greatest(*[F.avg((ref(column) == F.lit(s)).cast("double"))
                        for s in NUMERIC_SENTINELS])


def text_sentinel_share(column: str) -> Column:
    return F.avg(F.lower(F.trim(ref(column))).isin(*TEXT_SENTINELS).cast("double"))


def numeric_placeholders(df: DataFrame, columns: Sequence[str] | None = None,
                         share: float = 0.05) -> DataFrame:
    """Numeric columns where one sentinel fills more than `share` of the present values."""
    cols = list(columns or numeric_columns(df))
    one = df.agg(*[numeric_sentinel_share(c).alias(f"s{i}") for i, c in enumerate(cols)])
    return to_long(one, [{"column": F.lit(c), "placeholder_share": F.col(f"s{i}")}
                         for i, c in enumerate(cols)]).where(F.col("placeholder_share") > share)


def text_placeholders(df: DataFrame, columns: Sequence[str] | None = None,
                      share: float = 0.05) -> DataFrame:
    cols = list(columns or text_columns(df))
    one = df.agg(*[text_sentinel_share(c).alias(f"s{i}") for i, c in enumerate(cols)])
    return to_long(one, [{"column": F.lit(c), "placeholder_share": F.col(f"s{i}")}
                         for i, c in enumerate(cols)]).where(F.col("placeholder_share") > share)


def leaky_names(columns: Sequence[str], target: str) -> list[str]:
    """Columns whose flattened name contains the target's, or is contained in it."""
    def flat(name: str) -> str:
        return name.lower().replace(" ", "_")

    goal = flat(target)
    return [c for c in columns if c != target and (goal in flat(c) or flat(c) in goal)]


def leakage_signals(df: DataFrame, target: str, threshold: float = 0.995) -> DataFrame:
    """(column, signal): a name contained in the target's (or around it), or near-perfect r."""
    spark = df.sparkSession
    named = leaky_names(df.columns, target)
    result = spark.createDataFrame([(c, "name") for c in named], "column string, signal string")
    rest = [c for c in numeric_columns(df, exclude=[target]) if c not in named]
    if target in numeric_columns(df) and rest:
        near = correlation_pairs(df, pairs=[(c, target) for c in rest]).where(
            F.abs("r") > threshold)
        result = result.unionByName(near.select(F.col("col_a").alias("column"),
                                                F.lit("correlation").alias("signal")))
    return result
