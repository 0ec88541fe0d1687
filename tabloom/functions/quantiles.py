"""Exact interpolated quantiles that never hold a whole column in one task.

Spark's `percentile` keeps every distinct value of a column in the final task. That is fine
for a measured small row count and is what we use there. Above the limit we narrow instead:
one scan counts the values between some thousand cuts for all columns and ranks together, each
wanted rank keeps the smallest and the largest value of its interval as its new ends, and the
step repeats until few values are left, which are then read. Cuts divide the bits of a double,
so every scan narrows by a fixed factor; a heavy value is an interval of its own at once. What
a scan gives back is one row per interval, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..config import LIMITS
from .columns import ref
from .workers import importable

_CUTS = 1 << 15     # of all columns in one scan
_READ = 100_000     # values that the driver reads in the end


@dataclass
class _RankSearch:
    """Where the value of 0-based rank `rank` can still be: `inside` rows whose bits lie in [lo, hi]."""

    column: int
    rank: int
    lo: int
    hi: int
    inside: int
    below: int = 0


def _bits(values: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers of the same order, NaN last; both zeros are one."""
    raw = np.where(np.isnan(values), np.nan, values + 0.0).view(np.int64)
    return np.where(raw < 0, raw ^ np.int64(0x7FFF_FFFF_FFFF_FFFF), raw)


def _double(bits: int) -> float:
    raw = np.int64(bits) if bits >= 0 else np.int64(bits) ^ np.int64(0x7FFF_FFFF_FFFF_FFFF)
    return float(raw.view(np.float64))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    limit: int = LIMITS.exact_quantile_values,
) -> dict[str, list[float | None]]:
    """{column: [quantile per prob]}, linear interpolation, nulls ignored.

    `limit` bounds the values one task may hold over all columns together.
    """
    cols = list(dict.fromkeys(columns))
    if not cols:
        return {}
    names = [f"c{i}" for i in range(len(cols))]
    base = df.select(*[ref(c).cast("double").alias(n) for c, n in zip(cols, names)])
    if base.count() * len(cols) <= limit:
        at = F.array(*[F.lit(float(p)) for p in probs])
        row = base.agg(*[F.percentile(n, at).alias(n) for n in names]).first()
        found = [list(row[n]) if row[n] is not None else [None] * len(probs) for n in names]
    else:
        found = _by_narrowing(base, names, probs, limit)
    return dict(zip(cols, found))


def _by_narrowing(base: DataFrame, names: list[str], probs: Sequence[float], limit: int):
    importable(base.sparkSession)
    ends = base.agg(*[f(n).alias(f"{n}_{k}") for n in names
                      for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    searches: dict[tuple[str, int], _RankSearch] = {}
    for i, n in enumerate(names):
        size = ends[f"{n}_n"]
        if size:
            lo, hi = _bits(np.array([ends[f"{n}_lo"], ends[f"{n}_hi"]], float)).tolist()
        for p in probs:
            low = math.floor(p * (size - 1)) if size else 0
            for rank in {low, min(low + 1, size - 1)} if size else ():
                searches[n, rank] = _RankSearch(i, rank, lo, hi, size)

    while open_ := [s for s in searches.values() if s.lo < s.hi]:
        boxes = {(s.column, s.lo, s.hi): s.inside for s in open_}
        if sum(boxes.values()) <= min(limit, _READ):
            found = _values_inside(base, boxes)
            for s in open_:
                s.lo = s.hi = int(found[s.column, s.lo, s.hi][s.rank - s.below])
            break
        _narrow_once(base, open_, boxes)

    result = []
    for n in names:
        size, values = ends[f"{n}_n"], []
        for p in probs:
            if not size:
                values.append(None)
                continue
            pos = p * (size - 1)
            low = math.floor(pos)
            a, b = (_double(searches[n, r].lo) for r in (low, min(low + 1, size - 1)))
            values.append(a if a == b else a + (b - a) * (pos - low))
        result.append(values)
    return result


def _columns(batch) -> list[np.ndarray]:
    """The bits of each column's values, nulls left out."""
    return [_bits(c.drop_null().to_numpy(zero_copy_only=False)) for c in batch.columns]


def _narrow_once(base: DataFrame, searches: list[_RankSearch], boxes: dict) -> None:
    parts = max(2, _CUTS // len(boxes))
    cuts = {}
    for c in sorted({c for c, _, _ in boxes}):
        own = set()
        for col, lo, hi in boxes:
            if col == c:
                own |= {lo + (hi - lo) * j // parts for j in range(parts)} | {hi, hi + 1}
        cuts[c] = np.array(sorted(own), np.int64)

    def run(batches):
        import pyarrow as pa

        top = np.iinfo(np.int64)
        sums = {c: (np.zeros(len(x) + 1, np.int64), np.full(len(x) + 1, top.max), np.full(len(x) + 1, top.min)) for c, x in cuts.items()}
        for batch in batches:
            columns = _columns(batch)
            for c, x in cuts.items():
                n, lo, hi = sums[c]
                at = np.searchsorted(x, columns[c], side="right")
                n += np.bincount(at, minlength=len(n))
                np.minimum.at(lo, at, columns[c])
                np.maximum.at(hi, at, columns[c])
        for c, (n, lo, hi) in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(at.astype(np.int32)),
                                              *[pa.array(x[at]) for x in (n, lo, hi)]], names=["c", "at", "n", "lo", "hi"])

    # at most two rows per cut
    rows = base.mapInArrow(run, "c int, at int, n long, lo long, hi long").groupBy("c", "at").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("c", "at").collect()
    own = {c: [r for r in rows if r["c"] == c] for c in cuts}
    before = {c: np.cumsum([r["n"] for r in x]) for c, x in own.items()}
    for s in searches:
        at = int(np.searchsorted(before[s.column], s.rank, side="right"))
        r = own[s.column][at]
        s.lo, s.hi, s.inside, s.below = r["lo"], r["hi"], r["n"], int(before[s.column][at]) - r["n"]


def _values_inside(base: DataFrame, boxes: dict) -> dict:
    """The sorted bits of all values in each box."""
    lows = {c: np.array(sorted(lo for col, lo, _ in boxes if col == c), np.int64) for c in {c for c, _, _ in boxes}}
    highs = {c: np.array(sorted(hi for col, _, hi in boxes if col == c), np.int64) for c in lows}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            columns = _columns(batch)
            for c in lows:
                # boxes of a column do not overlap
                at = np.searchsorted(lows[c], columns[c], side="right") - 1
                kept = columns[c][(at >= 0) & (columns[c] <= highs[c][np.maximum(at, 0)])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), c, np.int32)), pa.array(kept)], names=["c", "v"])

    found: dict[int, list[int]] = {c: [] for c in lows}
    for r in base.mapInArrow(run, "c int, v long").collect():
        found[r["c"]].append(r["v"])
    values = {c: np.sort(np.array(v, np.int64)) for c, v in found.items()}
    return {(c, lo, hi): values[c][np.searchsorted(values[c], lo):np.searchsorted(values[c], hi, side="right")] for c, lo, hi in boxes}
