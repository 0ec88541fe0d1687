"""Histogram trees: boosting and forests, many fits over rows that are binned once.

Rows are binned by quantile edges and written as blocks. A tree grows level by level: a level needs, for each of its
nodes, feature and bin, the number of rows and the sums of gradients and hessians; the best split of a node follows
from the running sums over bins. Gradients are whole numbers (units of 2^-20), so sums do not depend on the order of
rows, and the same trees come out however the rows lie.

A batch of fits (trials, folds, classes) shares its passes. Where the binned rows, classes in a byte each and weights of 1 left
out, are measured to fit a task (`LIMITS.tree_block_bytes`), they are sent to every task, and each task grows whole fits. Where they are not, rows
stay where they are: one aggregate per level sums the cells of all fits, keyed by (fit, tree, node, feature, bin), so
the number of jobs is rounds x depth (depth for a forest), not fits x rounds x depth. Both ways call the same functions.
Beyond the limit with labels and weights in full, rows with the same bins, class, weight and fold are put together (`group_rows`), because a tree cannot tell them
apart. Where the distinct ones are measured to fit a task, tasks grow whole boosted fits or whole trees over them, and the rows are
read once, for the draws of the forests. Counts make the same trees as rows do; with squared loss the gradient of a group is the sum
of its rounded labels less its rounded margin, which is within a unit a row of the sum of rounded differences.

Growth by leaves (`leaves` > 0) takes the splits with the greatest gain first. A split is taken before another if the
least gain on its path is greater, so levels are grown as far as such a path can still be among the best.

Boosting: squared loss, logistic loss or softmax (one tree per class and round), starting from the mean or the log
odds; leaf = rate * soft(G, l1) / (H + l2). Forests: bootstrap counts from the row's hash, columns drawn per node,
leaves hold the mean label or the class shares. Missing values go right of every edge.
"""

from __future__ import annotations

import json
import math
import threading
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import LIMITS
from ..functions.columns import ref
from ..functions.quantiles import exact_quantiles
from ..functions.scratch import settle
from ..functions.workers import importable

BINS, UNIT, BLOCK = 32, 1 << 20, 65_536
CHUNK = 1 << 15  # rows that are worked on at a time
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


@dataclass(frozen=True)
class TreeParams:
    boosted: bool
    trees: int
    depth: int
    rate: float = 1.0
    leaves: int = 0             # most leaves of a tree, those with the greatest gain first; 0: no limit
    rows: float = 1.0           # share of rows that a boosted tree sees
    columns: float | str = 1.0  # columns to choose from, as a share, "sqrt" or "log2": per tree if boosted, else per node
    l1: float = 0.0
    l2: float = 0.0
    least_rows: int = 1         # of a leaf
    least_weight: float = 0.0   # hessian of a leaf
    least_gain: float = 0.0
    seed: int = 42

    def check(self) -> None:
        if self.trees < 1 or self.depth < 1:
            raise ValueError(f"a tree model needs trees and depth, got {self.trees} and {self.depth}")


@dataclass(frozen=True)
class Fit:
    """One model to fit: its name, its settings, and the fold that is held out (none: -1)."""

    tag: str
    params: TreeParams
    held: int = -1


@dataclass
class Trees:
    """All trees of a model as flat arrays; children of node i are left[i] and left[i] + 1."""

    root: np.ndarray       # first node of each tree
    output: np.ndarray     # class that a tree speaks for (0 unless softmax)
    feature: np.ndarray    # -1 at leaves
    bin: np.ndarray        # rows with a bin up to this go left
    left: np.ndarray
    value: np.ndarray      # nodes x outputs of a tree
    gain: np.ndarray
    rows: np.ndarray

    def route(self, tree: int, bins: np.ndarray) -> np.ndarray:
        """The leaf that each row of `bins` (features x rows) reaches."""
        first = int(self.root[tree])
        last = int(self.root[tree + 1]) if tree + 1 < len(self.root) else len(self.feature)
        inner = self.feature[first:last] >= 0
        own = np.arange(last - first)
        n = bins.shape[1]
        # a leaf is its own left child, and no bin lies beyond its edge
        at = np.where(inner, self.feature[first:last], 0) * n
        edge = np.where(inner, self.bin[first:last], 255).astype(np.uint8)
        left = np.where(inner, self.left[first:last] - first, own)
        if not inner.any() or not n:
            return np.full(n, first)
        flat, rows, node = np.ascontiguousarray(bins).ravel(), np.arange(n), np.zeros(n, np.int64)
        while True:
            to = left[node] + (flat[at[node] + rows] > edge[node])
            if np.array_equal(to, node):
                return node + first
            node = to


# --- rows --------------------------------------------------------------------------------

@dataclass
class Block:
    """Some rows: bins (features x rows), label, weight (one for all rows where it has one value), fold and a hash of the row key."""

    bins: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    fold: np.ndarray
    hash: np.ndarray

    @staticmethod
    def read(row, features: int, packed: bool = False) -> Block:
        """`packed`: labels stored in a byte stay in a byte, and a weight of 1 stays one number."""
        n = len(row["fold"]) // 4
        label = np.frombuffer(row["label"], np.uint8 if len(row["label"]) == n else np.float64)
        weight = np.frombuffer(row["weight"]) if row["weight"] else np.ones(1 if packed else n)
        return Block(np.frombuffer(row["bins"], np.uint8).reshape(features, n), label if packed else label.astype(np.float64),
                     weight, np.frombuffer(row["fold"], np.int32), np.frombuffer(row["hash"], np.uint64))

    def take(self, at: np.ndarray) -> Block:
        one = len(self.weight) < len(self.fold)
        bins = np.empty((len(self.bins), len(at)), self.bins.dtype)
        for f, own in enumerate(self.bins):
            bins[f] = own[at]
        return Block(bins, self.label[at], self.weight if one else self.weight[at], self.fold[at], self.hash[at])

    def part(self, first: int, last: int) -> Block:
        """The rows from `first` to `last`, not copied."""
        weight = self.weight if len(self.weight) < len(self.fold) else self.weight[first:last]
        return Block(self.bins[:, first:last], self.label[first:last], weight, self.fold[first:last], self.hash[first:last])


@dataclass(frozen=True)
class Binned:
    """Blocks of binned rows, and what binning found out about them."""

    blocks: DataFrame
    edges: list[np.ndarray]
    rows: int
    classes: int            # 0: the label is a number
    center: float           # of a numeric label, which is scaled to spread 1
    spread: float
    shares: list[float]     # of the classes
    label_bytes: int = 8    # of a row; a class takes one
    weight_bytes: int = 8   # of a row; weights that are all 1 take none
    sent: list = field(default_factory=list, compare=False, repr=False)  # the rows as tasks hold them, once they are sent

    @property
    def bytes(self) -> int:
        return self.rows * (len(self.edges) + 28)

    @property
    def packed(self) -> int:
        """Bytes of the rows as blocks and a task hold them."""
        return self.rows * (len(self.edges) + 12 + self.label_bytes + self.weight_bytes)

    def share(self):
        """The rows as one block for every task, sent once; only for a table measured to fit a task."""
        with _SENDING:
            if not self.sent:
                self.sent.append(self.blocks.sparkSession.sparkContext.broadcast(_sent_block(self)))
            return self.sent[0]

    def release(self) -> None:
        """Tasks need not hold the rows any longer."""
        with _SENDING:
            while self.sent:
                self.sent.pop().unpersist()


_SENDING = threading.Lock()


def find_edges(data: DataFrame, features: int, bins: int = BINS) -> list[np.ndarray]:
    """Per feature, the quantiles that divide its values into at most `bins` bins."""
    wide = data.select(vector_to_array("features").alias("v")).select(
        *[F.nanvl(F.col("v")[i], F.lit(None).cast("double")).alias(f"f{i}") for i in range(features)])
    names = [f"f{i}" for i in range(features)]
    found = exact_quantiles(wide, names, [k / bins for k in range(1, bins)]) if names else {}
    return [np.unique(np.array([q for q in found[n] if q is not None], float)) for n in names]


def bin_values(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Rows x features of values, to features x rows of bins; missing values lie behind the last edge."""
    out = np.empty(values.shape[::-1], np.uint8)
    for i, e in enumerate(edges):
        out[i] = np.searchsorted(e, values[:, i], side="left")
    return out


def bin_rows(data: DataFrame, row_key: str, task: str, bins: int = BINS) -> Binned:
    """`data` holds the row key, label, features and perhaps fold and weight; rows without label are left out."""
    import pyarrow as pa

    have = set(data.columns)
    data = data.where(F.col("label").isNotNull())
    importable(data.sparkSession)
    first = data.select("features").first()
    features = first["features"].size if first else 0
    edges = find_edges(data, features, bins)
    facts = data.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("mean"), F.stddev_pop("label").alias("spread"),
                     F.max("label").alias("top")).first()
    classes = int(facts["top"] or 0) + 1 if task == "classification" else 0
    shares, small = [0.0] * classes, 0 < classes <= 256
    if classes:
        for r in data.groupBy("label").count().collect():  # as many rows as classes
            shares[int(r["label"])] = r["count"] / facts["n"]
            small &= r["label"] == abs(int(r["label"]))
    kinds = (np.uint8 if small else np.float64, np.float64, np.int32, np.int64)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            for at in range(0, n, BLOCK):
                part = batch.slice(at, BLOCK)
                column = part.column(4)
                values = column.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, features)
                rows = [bin_values(values, edges).tobytes()]
                for k, kind in enumerate(kinds):
                    own = part.column(k).to_numpy(zero_copy_only=False).astype(kind)
                    rows.append(b"" if k == 1 and "weight" not in have else own.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.binary()) for r in rows],
                                                 names=["bins", "label", "weight", "fold", "hash"])

    rows = data.select(
        F.col("label").cast("double"), (F.col("weight") if "weight" in have else F.lit(1.0)).cast("double").alias("weight"),
        (F.col("fold") if "fold" in have else F.lit(-2)).cast("int").alias("fold"),
        F.xxhash64(ref(row_key).cast("string")).alias("hash"), vector_to_array("features").alias("v"))
    blocks = settle(rows.mapInArrow(run, "bins binary, label binary, weight binary, fold binary, hash binary"), "blocks")
    return Binned(blocks, edges, facts["n"], classes, facts["mean"] or 0.0, facts["spread"] or 1.0, shares,
                  1 if small else 8, 8 if "weight" in have else 0)


def _mix(x: np.ndarray, *seeds: int) -> np.ndarray:
    x = np.asarray(x).astype(np.uint64)
    for s in seeds:
        x = (x ^ np.uint64(s * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
        x = x ^ x >> np.uint64(29)
    return x


def _uniform(x: np.ndarray, *seeds: int) -> np.ndarray:
    return (_mix(x, *seeds) >> np.uint64(11)).astype(float) / (1 << 53)


def drawn(params: TreeParams, tree: int, hashes: np.ndarray) -> np.ndarray:
    """How often each row counts in a tree, from the row's hash alone."""
    out = np.ones(len(hashes), np.int64)
    if params.boosted and params.rows >= 1:
        return out
    for a in range(0, len(hashes), CHUNK):
        u = _uniform(hashes[a:a + CHUNK], params.seed, tree + 1)
        if params.boosted:
            out[a:a + CHUNK] = u < params.rows
        else:  # searchsorted(_POISSON, u, side="right"), by as many comparisons as are needed
            times, top = np.zeros(len(u), np.uint8), u.max(initial=0.0)
            for edge in _POISSON:
                if edge > top:
                    break
                times += u >= edge
            out[a:a + CHUNK] = times
    return out


def chosen(params: TreeParams, tree: int, places: np.ndarray, features: int) -> np.ndarray | None:
    """Features that the nodes at `places` may split on (nodes x k, ascending); None for all."""
    named = {"sqrt": math.sqrt, "log2": math.log2}
    k = max(1, int(named[params.columns](features)) if params.columns in named else math.ceil(params.columns * features - 1e-9))
    if k >= features:
        return None
    places = np.zeros(1, np.int64) if params.boosted else places
    turn = _mix(places[:, None] * np.int64(features) + np.arange(features), params.seed, 7, tree + 1)
    own = np.sort(np.argsort(turn, axis=1, kind="stable")[:, :k], axis=1)
    return own


# --- one level ---------------------------------------------------------------------------

@dataclass
class Cells:
    """Sums of rows by (node, feature, bin), ascending; `key` is (node * features + feature) * BINS + bin."""

    key: np.ndarray
    n: np.ndarray
    h: np.ndarray
    g: np.ndarray          # channels x cells

    @staticmethod
    def merged(parts: Sequence[Cells]) -> Cells:
        key = np.concatenate([p.key for p in parts])
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        add = lambda x: np.add.reduceat(x[..., order], at, axis=-1) if len(at) else x
        return Cells(key[at], add(np.concatenate([p.n for p in parts])), add(np.concatenate([p.h for p in parts])),
                     add(np.concatenate([p.g for p in parts], axis=-1)))


def count_cells(bins: np.ndarray, node: np.ndarray, nodes: int, own: np.ndarray | None, times: np.ndarray, h: np.ndarray,
                g: np.ndarray) -> Cells:
    """Sums over rows: `bins` is features x rows, `node` the place of each row's node, `own` its features."""
    features, n = bins.shape
    if nodes * BINS <= max(n, BINS):
        sums = Sums.of(times, h, g)
        return _cells(_tables(Rows(bins), node, nodes, own, sums.loads), own, features, sums)
    # many nodes, few rows each: only the cells there are
    if own is None:
        key = (node * np.int64(features * BINS))[None, :] + (np.arange(features) * BINS)[:, None] + bins
    else:
        f = own[node if len(own) > 1 else np.zeros(n, np.int64)].T
        key = (node * np.int64(features))[None, :] + f
        key = key * BINS + bins[f, np.arange(n)[None, :]]
    k = key.shape[0]
    at, flat = np.unique(key.ravel(), return_inverse=True)
    total = lambda x: np.rint(np.bincount(flat, np.tile(x, k), len(at))).astype(np.int64)
    return Cells(at, total(times), total(h), np.stack([total(x) for x in g]))


@dataclass(frozen=True)
class Rows:
    """Some rows of binned ones: `at` holds their columns in `bins` (None: all). `pairs` holds two features in a number, b + BINS * b'
    for the features 2j and 2j + 1, so that one pass sums up both."""

    bins: np.ndarray
    at: np.ndarray | None = None
    pairs: np.ndarray | None = None

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.bins), self.bins.shape[1] if self.at is None else len(self.at)

    def part(self, first: int, last: int) -> np.ndarray | slice:
        """The columns of the rows from `first` to `last`; a slice where they lie together."""
        if self.at is None:
            return slice(first, last)
        at = self.at[first:last]
        return slice(at[0], at[-1] + 1) if len(at) and at[-1] - at[0] + 1 == len(at) else at


def pair_up(bins: np.ndarray) -> np.ndarray:
    """The bins of features 2j and 2j + 1 as one number."""
    out = bins[::2].astype(np.uint16)
    out[:len(bins) // 2] += bins[1::2].astype(np.uint16) * np.uint16(BINS)
    return out


@dataclass
class Sums:
    """What is summed up over rows, as few numbers a row (`loads`, None for ones), and how rows, hessians and gradients follow from it."""

    loads: list[np.ndarray | None]
    rate: float | None = None    # the hessian of a row that counts once, if there is one for all
    counted: bool = True         # False: rows are not counted, a cell's hessians tell that it has some
    hits: int = 0                # classes whose rows are counted, two in a number; their gradients are rows x rate
    whole: bool = False          # every row is a hit of one class
    loads_once: bool = False     # every row counts once

    @staticmethod
    def of(times: np.ndarray, h: np.ndarray, g: np.ndarray, counted: bool = True) -> Sums:
        once = bool((times == 1).all())
        rate = float(h[0]) / float(times[0]) if len(h) and times[0] else 0.0
        even = rate.is_integer() and np.array_equal(h, times * rate)
        first = [None if once else np.asarray(times, float)] if even or counted else []
        return Sums([*first, *([] if even else [np.asarray(h, float)]), *[np.asarray(x, float) for x in g]], rate if even else None,
                    even or counted, loads_once=once)

    @staticmethod
    def of_classes(times: np.ndarray, marks: Sequence[np.ndarray], hits: int, rate: float, whole: bool) -> Sums:
        """Of a forest whose rows have one weight; `marks` from `class_marks`."""
        return Sums([times * m for m in marks], rate, True, hits, whole)

    def split(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, hessians and gradients (channels x cells) of summed loads."""
        if self.hits:
            each = np.stack([sums & (_HALF - 1), sums >> _HALF_BITS], 1).reshape(-1, sums.shape[1])
            n = each[:self.hits].sum(0) if self.whole else each[0]
            g = each[:self.hits] if self.whole else each[1:self.hits + 1]
            return n, n * int(self.rate), g * int(self.rate)
        if self.rate is not None:
            return sums[0], sums[0] * int(self.rate), sums[1:]
        return (sums[0], sums[1], sums[2:]) if self.counted else (sums[0], sums[0], sums[1:])


_HALF_BITS = 26  # two numbers of rows below 2^26 fit a double
_HALF = 1 << _HALF_BITS


def class_marks(hit: Sequence[np.ndarray], whole: bool) -> list[np.ndarray]:
    """For each row what it adds to the numbers of rows and of hits of each class (rows left out if every row is a hit), two in a number."""
    each = [x.astype(float) for x in hit] if whole else [np.ones(len(hit[0])), *[x.astype(float) for x in hit]]
    each += [np.zeros(len(hit[0]))] * (len(each) % 2)
    return [a + _HALF * b for a, b in zip(each[::2], each[1::2])]


def _tables(rows: Rows, node: np.ndarray, nodes: int, own: np.ndarray | None, loads: Sequence[np.ndarray | None]) -> np.ndarray:
    """Sums of the loads over rows as loads x nodes x features of a node x bins. `loads` are those of all rows of `rows.bins`, `node` is
    that of the given ones. Whole numbers add up exactly as doubles, so that it does not matter what is added up first."""
    features, n = rows.shape
    k = features if own is None else own.shape[1]
    out = np.zeros((len(loads), nodes, k, BINS), np.int64)
    same = own is None or len(own) == 1
    paired = nodes * BINS * BINS <= max(n, BINS * BINS)
    slots = np.arange(features) if own is None else own[0]
    if same and paired and rows.pairs is not None:
        items = sorted(set((slots // 2).tolist()))
        cells = [min(2, features - 2 * j) for j in items]
    elif not same and paired:
        items = list(range(0, k, 2))
        cells = [min(2, k - j) for j in items]
    else:
        items, cells = list(range(k)), [1] * k
    size = [nodes * BINS ** c for c in cells]
    sums = [[0] * len(loads) for _ in items]
    step = max(CHUNK, 2 * max(size, default=1))
    flat, width = rows.bins.ravel(), rows.bins.shape[1]
    place = None if same else (own * width).astype(np.int64)
    for first in range(0, n, step):
        at, of = rows.part(first, first + step), node[first:first + step]
        given = [None if x is None else x[at] for x in loads]
        start = {c: of * np.int64(BINS ** c) if nodes > 1 else None for c in set(cells)}
        at_all = None if same else at if not isinstance(at, slice) else np.arange(at.start, min(at.stop, width))
        for i, (item, c) in enumerate(zip(items, cells)):
            if not same:
                bin_ = flat[place[:, item][of] + at_all]
                if c == 2:
                    bin_ = bin_ + flat[place[:, item + 1][of] + at_all] * np.uint16(BINS)
            elif c == 2 or paired and rows.pairs is not None:
                bin_ = rows.pairs[item][at]
            else:
                bin_ = rows.bins[slots[item]][at]
            key = bin_ if nodes == 1 else start[c] + bin_
            for x, w in enumerate(given):
                sums[i][x] = sums[i][x] + np.bincount(key, w, size[i])
    for i, (item, c) in enumerate(zip(items, cells)):
        for x in range(len(loads)):
            if not n:
                continue
            found = np.rint(sums[i][x]).astype(np.int64).reshape(nodes, *[BINS] * c)
            both = [found] if c == 1 else [found.sum(1), found.sum(2)]
            if same and paired and rows.pairs is not None:
                for side, own_sums in enumerate(both):
                    slot = np.searchsorted(slots, 2 * item + side)
                    if slot < k and slots[slot] == 2 * item + side:
                        out[x, :, slot] = own_sums
            else:
                for side, own_sums in enumerate(both):
                    out[x, :, item + side] = own_sums
    return out


def _cells(tables: np.ndarray, own: np.ndarray | None, features: int, sums: Sums) -> Cells:
    """The cells of `_tables` that hold rows."""
    flat = tables.reshape(len(tables), -1)
    at = np.flatnonzero(flat.any(0) if sums.whole else flat[0])
    key = at
    if own is not None:
        k = own.shape[1]
        node, slot = np.divmod(at // BINS, k)
        key = (node * features + own[node if len(own) > 1 else 0, slot]) * BINS + at % BINS
    return Cells(key, *sums.split(flat[:, at]))


def _score(g: np.ndarray, h: np.ndarray, p: TreeParams) -> np.ndarray:
    g = g / UNIT
    if p.l1:
        g = np.sign(g) * np.maximum(np.abs(g) - p.l1, 0)
    return (g * g).sum(0) / np.maximum(h / UNIT + p.l2, 1e-12)


@dataclass
class Splits:
    """For each node of a level (by place): its sums, and its best split (feature -1: none) with both sides' sums."""

    node: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    gain: np.ndarray
    n: np.ndarray          # 3 x nodes: all, left, right
    h: np.ndarray          # 3 x nodes
    g: np.ndarray          # channels x 3 x nodes


def best_splits(cells: Cells, features: int, p: TreeParams) -> Splits:
    """The best split of every node in `cells`; the smaller feature, then bin, on ties."""
    seg = cells.key // BINS
    node = seg // features
    starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    size = np.diff(np.append(starts, len(seg)))
    tops = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))

    def sides(x):
        run = np.cumsum(x, axis=-1)
        base = (run - x)[..., starts]
        whole = np.add.reduceat(x, starts, axis=-1)
        left = run - np.repeat(base, size, axis=-1)
        return left, np.repeat(whole, size, axis=-1)

    (ln, tn), (lh, th), (lg, tg) = sides(cells.n), sides(cells.h), sides(cells.g)
    rn, rh, rg = tn - ln, th - lh, tg - lg
    gain = _score(lg, lh, p) + _score(rg, rh, p) - _score(tg, th, p)
    least = p.least_weight * UNIT
    good = (rn > 0) & (np.minimum(ln, rn) >= p.least_rows) & (np.minimum(lh, rh) >= least) & (gain > max(p.least_gain, 1e-9))
    gain = np.where(good, gain, -1.0)
    top = np.maximum.reduceat(gain, tops)
    width = np.diff(np.append(tops, len(node)))
    where = np.where(gain == np.repeat(top, width), np.arange(len(node)), len(node))
    at = np.minimum.reduceat(where, tops)
    found = top > 0
    return Splits(node[tops], np.where(found, seg[at] % features, -1), np.where(found, cells.key[at] % BINS, 0), np.maximum(top, 0),
                  np.stack([tn[at], ln[at], rn[at]]), np.stack([th[at], lh[at], rh[at]]), np.stack([tg[:, at], lg[:, at], rg[:, at]], 1))


class Growth:
    """A tree while it grows: its nodes so far and the open ones of the current level."""

    def __init__(self, params: TreeParams, tree: int, features: int, channels: int):
        self.p, self.tree, self.features, self.channels = params, tree, features, channels
        self.feature, self.bin, self.left = np.array([-1]), np.array([0]), np.array([-1])
        self.gain, self.path = np.array([0.0]), np.array([math.inf])
        self.n, self.h, self.g = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((channels, 1), np.int64)
        self.open = np.zeros(1, np.int64)       # node numbers of the level
        self.place = np.zeros(1, np.int64)      # their places in a full tree, for the draw of columns
        self.depth = 0

    @property
    def own(self) -> np.ndarray | None:
        return chosen(self.p, self.tree, self.place, self.features)

    def take(self, s: Splits) -> np.ndarray:
        """Adds a level of splits; for each open node its split's number (-1: it is a leaf)."""
        step = np.full(len(self.open), -1, np.int64)
        if not self.depth and len(s.node):
            self.n, self.h, self.g = s.n[0, :1].copy(), s.h[0, :1].copy(), s.g[:, 0, :1].copy()
        k = np.flatnonzero(s.feature >= 0)
        at = s.node[k]
        node = self.open[at]
        self.feature[node], self.bin[node], self.gain[node] = s.feature[k], s.bin[k], s.gain[k]
        self.path[node] = np.minimum(self.path[node], self.gain[node])
        self.depth += 1
        worth = -math.inf
        if self.p.leaves:
            known = np.sort(self.path[self.feature >= 0])[::-1]
            if len(known) >= self.p.leaves - 1:
                worth = known[self.p.leaves - 2] if self.p.leaves > 1 else math.inf
        left = len(self.feature) + 2 * np.arange(len(k))
        self.left[node] = left
        new, both = 2 * len(k), lambda x: np.stack([x[..., 1, k], x[..., 2, k]], -1).reshape(*x.shape[:-2], -1)
        self.feature, self.left = (np.append(x, np.full(new, -1)) for x in (self.feature, self.left))
        self.bin, self.gain = np.append(self.bin, np.zeros(new, np.int64)), np.append(self.gain, np.zeros(new))
        self.path = np.append(self.path, np.repeat(self.path[node], 2))
        self.n, self.h = np.append(self.n, both(s.n)), np.append(self.h, both(s.h))
        self.g = np.concatenate([self.g, both(s.g)], axis=1)
        go = np.flatnonzero(self.path[node] >= worth) if self.depth < self.p.depth else np.empty(0, np.int64)
        step[at[go]] = np.arange(len(go))
        self.open = (left[go][:, None] + np.arange(2)).ravel()
        self.place = (2 * self.place[at[go]][:, None] + np.arange(1, 3)).ravel()
        return step

    def finish(self, forest: bool) -> dict[str, np.ndarray]:
        """The tree's arrays, with the splits beyond the limit of leaves taken back."""
        feature = self.feature.copy()
        if self.p.leaves:
            inner = np.flatnonzero(feature >= 0)
            feature[inner[np.lexsort((inner, -self.path[inner]))][self.p.leaves - 1:]] = -1
        h, g = self.h / UNIT, self.g.T / UNIT
        if self.p.l1 and not forest:
            g = np.sign(g) * np.maximum(np.abs(g) - self.p.l1, 0)
        below = h + (0 if forest else self.p.l2)
        rate = 1.0 if forest else self.p.rate
        value = np.where(below[:, None] > 0, rate * g / np.maximum(below, 1e-12)[:, None], 0.0)
        return {"feature": feature, "bin": self.bin, "left": self.left, "value": value,
                "gain": np.where(feature >= 0, self.gain, 0.0), "rows": self.n}


def _joined(parts: Sequence[dict], output: Sequence[int], channels: int) -> Trees:
    size = [len(p["feature"]) for p in parts]
    root = (np.cumsum(size) - size).astype(np.int64)
    cat = lambda name, kind: np.concatenate([p[name] for p in parts]).astype(kind) if parts else np.empty(0, kind)
    left = cat("left", np.int64) + np.repeat(root, size)
    value = np.concatenate([p["value"] for p in parts]) if parts else np.empty((0, channels))
    return Trees(root, np.array(output, np.int64), cat("feature", np.int64), cat("bin", np.int64), left, value, cat("gain", float),
                 cat("rows", np.int64))


# --- losses ------------------------------------------------------------------------------

@dataclass(frozen=True)
class Goal:
    """What the trees of a fit predict: a number (classes 0) or classes; `outputs` margins per row."""

    classes: int
    center: float = 0.0
    spread: float = 1.0
    start: tuple[float, ...] = (0.0,)

    @staticmethod
    def of(binned: Binned) -> Goal:
        clip = [min(max(s, 1e-6), 1 - 1e-6) for s in binned.shares]
        if binned.classes > 2:
            start = tuple(math.log(s) for s in clip)
        else:
            start = (math.log(clip[1] / (1 - clip[1])),) if len(clip) == 2 else (0.0,)
        return Goal(binned.classes, binned.center, binned.spread, start)

    @property
    def outputs(self) -> int:
        return self.classes if self.classes > 2 else 1

    def margins(self, params: TreeParams, n: int) -> np.ndarray:
        start = np.array(self.start if params.boosted else [0.0] * self.outputs)
        return np.repeat(start[:, None], n, axis=1)

    def gradients(self, params: TreeParams, block: Block, margins: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Negative gradients and hessians (outputs x rows) in units, before draws. A forest has the labels themselves."""
        y, w = block.label, np.rint(block.weight * UNIT)
        if not params.boosted:
            if not self.classes:
                return np.rint((y - self.center) / self.spread * UNIT * block.weight)[None], w
            if self.outputs == 1:
                return (y == 1)[None] * w, w
            return (y[None] == np.arange(self.classes)[:, None]) * w, w
        if not self.classes:
            return np.rint(((y - self.center) / self.spread - margins) * UNIT), np.full((1, len(y)), float(UNIT))
        p = self.shares(margins)
        if self.outputs == 1:
            p = p[1:]
            hit = (y == 1)[None]
        else:
            hit = y[None] == np.arange(self.classes)[:, None]
        return np.rint((hit - p) * UNIT), np.maximum(np.rint(p * (1 - p) * UNIT), 1)

    def shares(self, margins: np.ndarray) -> np.ndarray:
        """Class probabilities (classes x rows) of boosted margins."""
        if self.outputs == 1:
            p = 1 / (1 + np.exp(-np.clip(margins, -700, 700)))
            return np.concatenate([1 - p, p])
        e = np.exp(margins - margins.max(0))
        return e / e.sum(0)

    def outcome(self, params: TreeParams, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """(prediction, class probabilities as classes x rows) of margins."""
        if not self.classes:
            return self.center + self.spread * margins[0], None
        if params.boosted:
            p = self.shares(margins)
        else:
            p = np.concatenate([1 - margins, margins]) if self.outputs == 1 else margins
        if self.classes == 1:
            p = p[:1] * 0 + 1
        return p.argmax(0).astype(float), p

    def loss(self, label: np.ndarray, margins: np.ndarray) -> np.ndarray:
        """Per row: squared error, or minus the log of the label's probability."""
        if not self.classes:
            return (label - self.center - self.spread * margins[0]) ** 2
        if self.classes == 1:
            return np.zeros(len(label))
        p = self.shares(margins)
        return -np.log(np.maximum(p[label.astype(int), np.arange(len(label))], 1e-15))


# --- fits in one task --------------------------------------------------------------------

class Routed:
    """Rows on their way down a tree: `at` their columns, `node` the nodes that they have reached."""

    def __init__(self, bins: np.ndarray, at: np.ndarray, leaf: np.ndarray | None):
        self.flat, self.width, self.leaf = bins.ravel(), bins.shape[1], leaf
        self.at, self.node = at, np.zeros(len(at), np.int64)

    def turn(self, first: np.ndarray, edge: np.ndarray, left: np.ndarray) -> None:
        """On to the children. For each node `first` is where its feature's row of bins begins; one that is not split is its own left
        child, and its edge is beyond all bins."""
        to = np.empty(len(self.at), np.int64)
        for a in range(0, len(self.at), CHUNK):
            node, at = self.node[a:a + CHUNK], self.at[a:a + CHUNK]
            right = self.flat[first[node] + at] > edge[node] if len(first) > 3 else self.flat[first[0] + at] > edge[0]
            np.add(left[node], right.view(np.uint8), out=to[a:a + CHUNK])
        self.node = to

    def thin(self, going: np.ndarray) -> None:
        """Leaves the rows whose nodes are not `going` where they are."""
        if self.leaf is not None:
            self.leaf[self.at] = self.node
        stay = np.flatnonzero(going[self.node])
        self.at, self.node = self.at[stay], self.node[stay]


def _grow(growth: Growth, bins: np.ndarray, times: np.ndarray, h: np.ndarray, g: np.ndarray, pairs: np.ndarray | None = None,
          sums: Sums | None = None, leaf: np.ndarray | None = None, others: np.ndarray | None = None) -> None:
    """Grows a tree over rows that are all here; `times` says how often the first columns of `bins` count, and `h` and `g` are sums over
    these times. Where `sums` says what to sum up, `h` and `g` are those of a row that counts once. `leaf` gets the node that each row
    ends in, `others` (more columns) included.

    Where both children of a node choose from the same features, only the one with fewer rows is counted; the other's sums are
    the node's less those, exact as whole numbers."""
    use, given = np.flatnonzero(times), sums is not None
    # a boosted row's hessian is at least 1, so that where no leaf needs a number of rows, hessians tell which cells have some
    sums = sums or Sums.of(times, h, g, not growth.p.boosted or growth.p.least_rows > 1)
    learn, alike = Routed(bins, use, leaf), growth.p.boosted or growth.own is None
    packs = [learn] + ([Routed(bins, others, leaf)] if others is not None and leaf is not None else [])
    rows, going, above = np.array([len(use)]), np.ones(1, bool), None  # above: sums of the nodes that were split, in the order of their children
    while len(growth.open) and rows[growth.open].any():
        was, own, nodes = growth.open, growth.own, len(growth.open)
        alive = rows[was].sum()
        if alive < len(learn.at) * (0.6 if above is not None and nodes * BINS <= alive else 1):
            for p in packs:
                p.thin(going)
        place = np.zeros(len(going), np.int64)
        place[was] = np.arange(nodes)
        tables = None
        if above is not None and nodes * BINS <= alive:
            pair = rows[was].reshape(-1, 2)
            less = np.arange(0, nodes, 2) + (pair[:, 1] < pair[:, 0])
            few = np.zeros(len(going), bool)
            few[was[less]] = True
            pick = np.flatnonzero(few[learn.node])
            tables = np.empty((len(above), nodes, *above.shape[2:]), np.int64)
            # the counted children alone, in the order of their parents
            tables[:, less] = _tables(Rows(bins, learn.at[pick], pairs), place[learn.node[pick]] >> 1, nodes // 2, own, sums.loads)
            tables[:, less ^ 1] = above - tables[:, less]
        elif nodes * BINS <= max(alive, BINS):
            tables = _tables(Rows(bins, learn.at, pairs), place[learn.node], nodes, own, sums.loads)
        if tables is not None:
            cells = _cells(tables, own, growth.features, sums)
        else:
            at, w = learn.at, times[learn.at] if given else 1
            cells = count_cells(bins[:, at], place[learn.node], nodes, own, times[at], h[at] * w, g[:, at] * w)
        s = best_splits(cells, growth.features, growth.p)
        step, known = growth.take(s), len(growth.feature)
        feature = growth.feature[was]
        split = was[feature >= 0]
        first, edge, left = np.zeros(known, np.int64), np.full(known, 255, np.uint8), np.arange(known)
        first[split], edge[split], left[split] = growth.feature[split] * np.int64(bins.shape[1]), growth.bin[split], growth.left[split]
        if leaf is not None or len(growth.open) or not sums.counted:
            learn.turn(first, edge, left)
            rows = np.bincount(learn.node, minlength=known)
        if not sums.counted:
            made = (growth.left[split][:, None] + np.arange(2)).ravel()
            n = rows if sums.loads_once else np.rint(np.bincount(learn.node, times[learn.at], known)).astype(np.int64)
            growth.n[made] = n[made]
            if not split.size or was[0] == 0:
                growth.n[0] = times.sum()
        for p in packs[1:]:
            p.turn(first, edge, left)
        going = np.zeros(known, bool)
        going[growth.open] = True
        above = tables[:, np.flatnonzero(step >= 0)] if tables is not None and alike and len(growth.open) else None
    for p in packs if leaf is not None else []:
        leaf[p.at] = p.node


def _ends(made: dict[str, np.ndarray]) -> np.ndarray:
    """For each node of a tree the node that its rows end in, where splits below it were taken back."""
    end = np.arange(len(made["feature"]))
    for i in np.flatnonzero((made["feature"] < 0) & (made["left"] >= 0)).tolist():
        end[made["left"][i]:made["left"][i] + 2] = end[i]
    return end


def fit_block(block: Block, fit: Fit, goal: Goal, first: int = 0, count: int = 0, keep: bool = True,
              score: bool = True) -> tuple[Trees, np.ndarray]:
    """The trees of one fit, and the margins of all rows (outputs x rows). Held rows are scored, not learnt from.

    Trees of a forest do not depend on each other, so `count` of them from `first` on can be grown alone (0: all). Without `keep` the
    trees are not kept, and only margins of held rows are meant; without `score` margins are not meant."""
    p, features = fit.params, block.bins.shape[0]
    own = block.fold != fit.held
    seen, held = np.flatnonzero(own), np.flatnonzero(~own)
    order = np.concatenate([seen, held]) if len(held) else None
    part, n = block if order is None else block.take(order), len(seen)
    if not score:
        part = part.take(np.arange(n)) if order is not None else part
    learnt, rows, pairs = part if n == len(part.label) else part.part(0, n), len(part.label), pair_up(part.bins)
    margins = goal.margins(p, rows)
    parts, output = [], []
    forest = None if p.boosted else _forest_sums(p, goal, learnt)
    g, h = np.empty((goal.outputs, n)), np.empty((goal.outputs, n))
    leaf = np.empty(rows, np.int64) if score or p.boosted else None
    everyone = np.arange(rows)
    for t in range(first, min(first + (count or p.trees), p.trees)):
        times = drawn(p, t, learnt.hash)
        scored = everyone[n:] if not keep and not p.boosted else np.concatenate([np.flatnonzero(times == 0), everyone[n:]])
        if p.boosted:
            for a in range(0, n, CHUNK):
                b = min(a + CHUNK, n)
                g[:, a:b], h[:, a:b] = goal.gradients(p, learnt.part(a, b), margins[:, a:b])
            grown = [(k, h[k], g[k:k + 1], None, Growth(p, t * goal.outputs + k, features, 1)) for k in range(goal.outputs)]
        else:
            grown = [(0, *forest(times), Growth(p, t, features, goal.outputs))]
        for k, own_h, own_g, sums, growth in grown:
            _grow(growth, part.bins, times, own_h, own_g, pairs, sums, leaf, scored)
            made = growth.finish(not p.boosted)
            if leaf is not None:
                value = made["value"][_ends(made)]
                if p.boosted:
                    margins[k] += value[leaf, 0]
                elif keep:
                    margins += value[leaf].T / p.trees
                else:
                    margins[:, n:] += value[leaf[n:]].T / p.trees
            if keep:
                parts.append(made)
                output.append(k)
    if order is not None and score:
        back = np.empty_like(margins)
        back[:, order] = margins
        margins = back
    return _joined(parts, output, 1 if p.boosted else goal.outputs), margins


def _forest_sums(p: TreeParams, goal: Goal, block: Block):
    """(h, g, sums) of a forest's rows for the times that a tree draws them; without sums, h and g are for all times."""
    n = len(block.label)
    g, h = goal.gradients(p, block, None)
    g, h = np.broadcast_to(g, (goal.outputs, n)), np.broadcast_to(h, n)
    marks: list[np.ndarray] = []
    whole = goal.outputs > 1
    if goal.classes and n and h[0] > 0 and (h == h[0]).all():
        hit = [block.label == k for k in range(goal.classes)] if whole else [block.label == 1]
        if not whole or (np.sum(hit, axis=0) == 1).all():
            marks = class_marks(hit, whole)

    def of(times: np.ndarray):
        if marks and times.sum() < _HALF:
            return h, g, Sums.of_classes(times, marks, goal.outputs, float(h[0]), whole)
        return h * times, g * times, None

    return of


# --- fits over blocks that stay where they are -------------------------------------------

def _levels(binned: Binned, state: DataFrame, fits: Sequence[Fit], goal: Goal, first: int, count: int) -> list[list[Growth]]:
    """Grows trees `first`.. of every fit over all blocks: one aggregate a level. `state` has the blocks' columns and
    `margins` (fits x outputs x rows, doubles) of boosted fits."""
    import pyarrow as pa

    features, outputs = len(binned.edges), goal.outputs
    growing: dict[int, Growth] = {}
    owner: list[tuple[int, int, int]] = []      # fit, tree, output of each growing tree
    for i, fit in enumerate(fits):
        for t in range(first, min(first + count, fit.params.trees)):
            for k in range(outputs if fit.params.boosted else 1):
                growing[len(owner)] = Growth(fit.params, t * outputs + k if fit.params.boosted else t, features,
                                             1 if fit.params.boosted else outputs)
                owner.append((i, t, k))
    channels = max([g.channels for g in growing.values()], default=1)
    names = [f"g{c}" for c in range(channels)]
    while any(len(g.open) for g in growing.values()):
        level = {j: (owner[j], _joined([_so_far(g)], [0], 1), g.open, g.own) for j, g in growing.items() if len(g.open)}
        sent = state.sparkSession.sparkContext.broadcast((level, list(fits), goal))

        def count_run(batches, sent=sent):
            level, fits, goal = sent.value
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block.read(row, features)
                    n = len(block.label)
                    margins = np.frombuffer(row["margins"]).reshape(len(fits), outputs, n) if row["margins"] else None
                    cache: dict = {}
                    for j, ((i, t, k), tree, nodes, own) in level.items():
                        p = fits[i].params
                        if (i, t) not in cache:
                            times = drawn(p, t, block.hash) * (block.fold != fits[i].held)
                            cache[i, t] = times, *goal.gradients(p, block, margins[i] if margins is not None else None)
                        times, g, h = cache[i, t]
                        if p.boosted:
                            g, h = g[k:k + 1], h[k]
                        at = tree.route(0, block.bins)
                        place = np.searchsorted(nodes, at)
                        use = np.flatnonzero((times > 0) & (nodes[np.minimum(place, len(nodes) - 1)] == at))
                        if not len(use):
                            continue
                        w = times[use]
                        cells = count_cells(block.bins[:, use], place[use], len(nodes), own, w, h[use] * w, g[:, use] * w)
                        none = np.zeros(len(cells.key), np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(cells.key), j)), pa.array(cells.key), pa.array(cells.n), pa.array(cells.h),
                             *[pa.array(cells.g[c] if c < len(cells.g) else none) for c in range(channels)]],
                            names=["tree", "key", "n", "h", *names])

        def split_run(batches, sent=sent):
            level, fits, goal = sent.value
            held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
            if not held:
                return
            table = pa.concat_tables(held)
            tree = table.column("tree").to_numpy()
            for j in np.unique(tree).tolist():
                own = table.filter(pa.array(tree == j))
                p = fits[level[j][0][0]].params
                col = lambda c: own.column(c).to_numpy()
                c = 1 if p.boosted else outputs
                cells = Cells(col("key"), col("n"), col("h"), np.stack([col(x) for x in names[:c]]))
                order = np.argsort(cells.key, kind="stable")
                s = best_splits(Cells(cells.key[order], cells.n[order], cells.h[order], cells.g[:, order]), features, p)
                yield pa.RecordBatch.from_pylist([{
                    "tree": j, "node": int(s.node[x]), "feature": int(s.feature[x]), "bin": int(s.bin[x]), "gain": float(s.gain[x]),
                    "sums": np.concatenate([s.n[:, x], s.h[:, x], s.g[:, :, x].ravel()]).astype(np.int64).tolist()}
                    for x in range(len(s.node))], schema)

        schema = pa.schema([("tree", pa.int64()), ("node", pa.int64()), ("feature", pa.int64()), ("bin", pa.int64()),
                            ("gain", pa.float64()), ("sums", pa.list_(pa.int64()))])
        cells = state.mapInArrow(count_run, "tree long, key long, n long, h long, " + ", ".join(f"{x} long" for x in names))
        summed = cells.groupBy("tree", "key").agg(*[F.sum(x).alias(x) for x in ("n", "h", *names)])
        node = F.floor(F.col("key") / (features * BINS))
        # a task holds the nodes dealt to it: features x bins cells each
        found = summed.repartition("tree", node).mapInArrow(
            split_run, "tree long, node long, feature long, bin long, gain double, sums array<long>").collect()
        by: dict[int, list] = {}
        for r in found:
            by.setdefault(r["tree"], []).append(r)
        for j, rows in by.items():
            rows.sort(key=lambda r: r["node"])
            sums = np.array([r["sums"] for r in rows], np.int64).T
            c = growing[j].channels
            growing[j].take(Splits(np.array([r["node"] for r in rows]), np.array([r["feature"] for r in rows]),
                                   np.array([r["bin"] for r in rows]), np.array([r["gain"] for r in rows]), sums[:3], sums[3:6],
                                   sums[6:].reshape(c, 3, len(rows))))
        for j in level:
            if j not in by:  # no rows reached its open nodes
                growing[j].open = np.empty(0, np.int64)
        sent.unpersist()
    out: list[list[Growth]] = [[] for _ in fits]
    for j, (i, _, _) in enumerate(owner):
        out[i].append(growing[j])
    return out


def _so_far(growth: Growth) -> dict[str, np.ndarray]:
    n = len(growth.feature)
    return {"feature": np.array(growth.feature), "bin": np.array(growth.bin), "left": np.array(growth.left), "value": np.zeros((n, 1)),
            "gain": np.zeros(n), "rows": np.zeros(n, np.int64)}


def _with_margins(binned: Binned, state: DataFrame, fits: Sequence[Fit], goal: Goal, grown: Sequence[Trees] | None) -> DataFrame:
    """The blocks with every fit's margins: at the start, or with the given trees added."""
    import pyarrow as pa

    features, columns = len(binned.edges), ["bins", "label", "weight", "fold", "hash"]
    sent = state.sparkSession.sparkContext.broadcast((list(fits), goal, grown))

    def run(batches):
        fits, goal, grown = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row, features)
                n = len(block.label)
                if grown is None:
                    margins = np.stack([goal.margins(f.params, n) for f in fits])
                else:
                    margins = np.frombuffer(row["margins"]).reshape(len(fits), goal.outputs, n).copy()
                    for i, trees in enumerate(grown):
                        for t in range(len(trees.root)):
                            gone = trees.value[trees.route(t, block.bins)]
                            if fits[i].params.boosted:
                                margins[i, trees.output[t]] += gone[:, 0]
                            else:
                                margins[i] += gone.T / fits[i].params.trees
                yield pa.RecordBatch.from_arrays([pa.array([row[c]], pa.binary()) for c in columns]
                                                 + [pa.array([margins.tobytes()], pa.binary())], names=[*columns, "margins"])

    return state.mapInArrow(run, ", ".join(f"{c} binary" for c in [*columns, "margins"]))


def _fit_spread(binned: Binned, fits: Sequence[Fit], goal: Goal) -> tuple[list[Trees], DataFrame]:
    """Trees of every fit, and the blocks with their margins."""
    boosted = [f.params.boosted for f in fits]
    if any(boosted) and not all(boosted):
        raise ValueError("one batch holds boosted fits or forests, not both")
    state = settle(_with_margins(binned, binned.blocks, fits, goal, None), "margins")
    done: list[list[Growth]] = [[] for _ in fits]
    top = max(f.params.trees for f in fits)
    step = 1 if any(boosted) else top
    for first in range(0, top, step):
        grown = _levels(binned, state, fits, goal, first, step)
        new = [_trees(g, goal) for g in grown]
        for own, g in zip(done, grown):
            own += g
        state = settle(_with_margins(binned, state, fits, goal, new), "margins")
    return [_trees(g, goal) for g in done], state


def _trees(growths: Sequence[Growth], goal: Goal) -> Trees:
    if not growths:
        return _joined([], [], 1)
    boosted = growths[0].p.boosted
    return _joined([g.finish(not boosted) for g in growths], [g.tree % goal.outputs if boosted else 0 for g in growths],
                   1 if boosted else goal.outputs)


# --- fits over equal rows put together ---------------------------------------------------

@dataclass
class Groups:
    """Distinct rows in the order of their keys: bins (features x groups), label (0 if it is a number), weight, fold, rows of the
    group, and the sum of their numeric labels in units."""

    key: np.ndarray
    bins: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    fold: np.ndarray
    count: np.ndarray
    total: np.ndarray


def _units(label: np.ndarray, goal: Goal) -> np.ndarray:
    return np.rint((label - goal.center) / goal.spread * UNIT).astype(np.int64)


def _keys(block: Block, goal: Goal) -> np.ndarray:
    """What tells rows apart for a tree, as bytes; whole-number labels are classes."""
    label = block.label if goal.classes else np.zeros(len(block.label))
    parts = [np.ascontiguousarray(x).view(np.uint8).reshape(len(label), -1) for x in (label, block.weight, block.fold)]
    whole = np.ascontiguousarray(np.concatenate([block.bins.T, *parts], axis=1))
    return whole.view(f"V{whole.shape[1]}").ravel()


def group_rows(binned: Binned, goal: Goal, limit: int) -> Groups | None:
    """The distinct rows, or None where they do not fit a task either."""
    import pyarrow as pa

    features = len(binned.edges)
    width = features + 20

    def keyed(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row, features)
                n = len(block.label)
                key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(_keys(block, goal).tobytes())])
                total = np.zeros(n, np.int64) if goal.classes else _units(block.label, goal)
                yield pa.RecordBatch.from_arrays([key.cast(pa.binary()), pa.array(total)], names=["key", "total"])

    def packed(batches):
        for batch in batches:
            if batch.num_rows:
                rows = [b"".join(batch.column(0).to_pylist()),
                        *[batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in (1, 2)]]
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.binary()) for r in rows], names=["key", "count", "total"])

    rows = binned.blocks.mapInArrow(keyed, "key binary, total long")
    size = width + 16
    about = rows.agg(F.approx_count_distinct("key")).first()[0]
    if about * size > 1.2 * limit:
        return None
    found = rows.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.sum("total").alias("total"))
    parts = found.mapInArrow(packed, "key binary, count binary, total binary").collect()  # measured to be small
    key = np.frombuffer(b"".join(r["key"] for r in parts), f"V{width}")
    if len(key) * size > limit:
        return None
    order = np.argsort(key, kind="stable")
    key = key[order]
    raw = key.view(np.uint8).reshape(len(key), width)
    cut = lambda a, b, kind: np.ascontiguousarray(raw[:, a:b]).view(kind).ravel()
    count, total = (np.frombuffer(b"".join(r[c] for r in parts), np.int64)[order] for c in ("count", "total"))
    return Groups(key, np.ascontiguousarray(raw[:, :features].T), cut(features, features + 8, np.float64),
                  cut(features + 8, features + 16, np.float64), cut(features + 16, features + 20, np.int32), count, total)


def _boost_groups(groups: Groups, fit: Fit, goal: Goal) -> Trees:
    """The trees of a boosted fit that sees all rows outside its fold."""
    p = fit.params
    seen = np.flatnonzero(groups.fold != fit.held)
    bins, count, total = groups.bins[:, seen], groups.count[seen], groups.total[seen]
    part = Block(bins, groups.label[seen], groups.weight[seen], groups.fold[seen], seen)
    margins = goal.margins(p, len(seen))
    parts, output = [], []
    for t in range(p.trees):
        if goal.classes:
            g, h = (x * count for x in goal.gradients(p, part, margins))
        else:
            g, h = total - count * np.rint(margins * UNIT), (count * float(UNIT))[None]
        for k in range(goal.outputs):
            growth = Growth(p, t * goal.outputs + k, bins.shape[0], 1)
            _grow(growth, bins, count, h[k], g[k:k + 1])
            made = growth.finish(False)
            one = _joined([made], [k], 1)
            margins[k] += one.value[one.route(0, bins)][:, 0]
            parts.append(made)
            output.append(k)
    return _joined(parts, output, 1)


def _drawn_groups(binned: Binned, sent, count: int, goal: Goal, seed: int, trees: int) -> DataFrame:
    """(tree, ids, n, g): how often the rows of each group are drawn by a tree of a forest, and the sum of their numeric labels."""
    import pyarrow as pa

    features, params = len(binned.edges), TreeParams(False, trees, 1, seed=seed)

    def numbered(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row, features)
                at = np.searchsorted(sent.value.key, _keys(block, goal))
                label = np.zeros(len(at), np.int64) if goal.classes else np.rint(
                    (block.label - goal.center) / goal.spread * UNIT * block.weight).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(block.hash.view(np.int64)), pa.array(label)],
                                                 names=["id", "hash", "label"])

    def chunks(batches, most=1 << 20):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield pa.Table.from_batches(held)
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held)

    def run(batches):
        for table in chunks(batches):
            ids, place = np.unique(table.column("id").to_numpy(), return_inverse=True)
            hashes, label = table.column("hash").to_numpy().view(np.uint64), table.column("label").to_numpy()
            order = np.argsort(place, kind="stable")
            place, hashes, label = place[order], hashes[order], label[order]
            starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            for t in range(trees):
                times = drawn(params, t, hashes)
                n = np.add.reduceat(times, starts)
                g = b"" if goal.classes else np.add.reduceat(times * label, starts)[n > 0].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t], pa.int32()), *[pa.array([x], pa.binary()) for x in (
                        ids[n > 0].astype(np.int32).tobytes(), n[n > 0].astype(np.int64).tobytes(), g)]], names=["tree", "ids", "n", "g"])

    spark = binned.blocks.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-binned.rows // (1 << 20)))
    salt = max(1, min(tasks, (1 << 20) // max(1, count)))  # a large group is read by several tasks
    rows = binned.blocks.mapInArrow(numbered, "id int, hash long, label long")
    return rows.repartition(tasks, "id", F.pmod("hash", F.lit(salt))).mapInArrow(run, "tree int, ids binary, n binary, g binary")


def _forest_groups(binned: Binned, sent, count: int, fits: Sequence[tuple[int, Fit]], goal: Goal) -> dict[int, Trees]:
    """Forests of one seed: a task grows the same tree of every fit, from one set of draws."""
    import pickle

    import pyarrow as pa

    trees = max(f.params.trees for _, f in fits)

    def grow(table):
        groups, t = sent.value, table.column("tree")[0].as_py()
        times, label = np.zeros(len(groups.count), np.int64), np.zeros(len(groups.count), np.int64)
        for r in table.to_pylist():  # a few partial sums; ids do not repeat within one
            ids = np.frombuffer(r["ids"], np.int32)
            times[ids] += np.frombuffer(r["n"], np.int64)
            if not goal.classes:
                label[ids] += np.frombuffer(r["g"], np.int64)
        weight = np.rint(groups.weight * UNIT) * times
        if goal.classes:
            sums = weight * (groups.label == 1)[None] if goal.outputs == 1 else weight * (groups.label[None] == np.arange(goal.classes)[:, None])
        else:
            sums = label[None].astype(float)
        out = []
        for i, fit in fits:
            if t < fit.params.trees:
                growth = Growth(fit.params, t, groups.bins.shape[0], goal.outputs)
                _grow(growth, groups.bins, times * (groups.fold != fit.held), weight, sums)
                out.append({"fit": i, "tree": t, "made": pickle.dumps(growth.finish(True))})
        return pa.Table.from_pylist(out, pa.schema([("fit", pa.int32()), ("tree", pa.int32()), ("made", pa.binary())]))

    draws = _drawn_groups(binned, sent, count, goal, fits[0][1].params.seed, trees)
    made: dict[int, dict[int, dict]] = {i: {} for i, _ in fits}
    for r in draws.repartition(trees, "tree").groupBy("tree").applyInArrow(grow, "fit int, tree int, made binary").collect():
        made[r["fit"]][r["tree"]] = pickle.loads(r["made"])
    return {i: _joined([own[t] for t in sorted(own)], [0] * len(own), goal.outputs) for i, own in made.items()}


def _fit_groups(binned: Binned, groups: Groups, fits: Sequence[Fit], goal: Goal) -> dict[int, Trees]:
    """Trees of the fits that learn from groups, by place: forests, and boosted fits that see every row."""
    import pickle

    spark = binned.blocks.sparkSession
    sent, out = importable(spark).sparkContext.broadcast(groups), {}
    boosted = [(i, f) for i, f in enumerate(fits) if f.params.boosted and f.params.rows >= 1]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                trees = _boost_groups(sent.value, _job(row), goal)
                yield pa.RecordBatch.from_pylist([{"job": row["job"], "held": row["held"], "trees": pickle.dumps(trees)}])

    if boosted:
        made = {(r["job"], r["held"]): pickle.loads(r["trees"]) for r in _dealt(
            spark, [(f, 0, 0) for _, f in boosted], run, "job string, held long, trees binary").collect()}
        out |= {i: made[_named(f), f.held] for i, f in boosted}
    forests: dict[int, list[tuple[int, Fit]]] = {}
    for i, f in enumerate(fits):
        if not f.params.boosted:
            forests.setdefault(f.params.seed, []).append((i, f))
    for own in forests.values():
        out |= _forest_groups(binned, sent, len(groups.count), own, goal)
    sent.unpersist()
    return out


# --- models ------------------------------------------------------------------------------

class _Weights:
    """Feature importances in the form that Spark's models give them."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def toArray(self) -> np.ndarray:  # noqa: N802
        return self.values


@dataclass
class TreeModel:
    """A fitted forest or boosted model; `transform` adds prediction and, for classes, probability."""

    params: TreeParams
    goal: Goal
    edges: list[np.ndarray]
    trees: Trees

    def margins(self, values: np.ndarray) -> Iterator[np.ndarray]:
        """Margins (outputs x rows) after each round of boosting, or once for a forest."""
        bins = bin_values(values, self.edges)
        out = self.goal.margins(self.params, len(values))
        for t in range(len(self.trees.root)):
            gone = self.trees.value[self.trees.route(t, bins)]
            if self.params.boosted:
                out[self.trees.output[t]] += gone[:, 0]
                if self.trees.output[t] == self.goal.outputs - 1:
                    yield out
            else:
                out += gone.T / len(self.trees.root)
        if not self.params.boosted:
            yield out

    def outputs(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        last = self.goal.margins(self.params, len(values))
        for last in self.margins(values):
            pass
        return self.goal.outcome(self.params, last)

    def transform(self, df: DataFrame) -> DataFrame:
        import pandas as pd

        sent = df.sparkSession.sparkContext.broadcast(self)
        classes, width = self.goal.classes, len(self.edges)

        def told(vectors):
            if not len(vectors):
                return pd.Series([], dtype=object)
            values = np.concatenate([np.asarray(v, float) for v in vectors]).reshape(len(vectors), width)
            prediction, p = sent.value.outputs(values)
            rows = prediction[:, None] if p is None else np.concatenate([prediction[:, None], p.T], axis=1)
            return pd.Series(list(rows))

        importable(df.sparkSession)
        told.__annotations__ = {"vectors": pd.Series, "return": pd.Series}
        udf = F.pandas_udf(told, "array<double>")
        out = df.withColumn("_told", udf(vector_to_array("features"))).withColumn("prediction", F.col("_told")[0])
        if classes:
            out = out.withColumn("probability", array_to_vector(F.slice("_told", 2, max(classes, 1))))
        return out.drop("_told")

    @property
    def featureImportances(self) -> _Weights:  # noqa: N802
        """Total gain by feature, as shares."""
        total = np.zeros(len(self.edges))
        inner = self.trees.feature >= 0
        np.add.at(total, self.trees.feature[inner], self.trees.gain[inner])
        return _Weights(total / total.sum() if total.sum() > 0 else total)

    @property
    def rounds(self) -> int:
        return len(self.trees.root) // self.goal.outputs if self.params.boosted else 0

    def losses(self, df: DataFrame) -> list[float]:
        """Mean loss after each round, in one pass over the rows."""
        import pyarrow as pa

        sent = df.sparkSession.sparkContext.broadcast(self)
        width = len(self.edges)

        def run(batches):
            for batch in batches:
                model, n = sent.value, batch.num_rows
                if not n:
                    continue
                label = batch.column(0).to_numpy(zero_copy_only=False)
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, width)
                sums = [float(model.goal.loss(label, m).sum()) for m in model.margins(values)]
                yield pa.RecordBatch.from_arrays([pa.array(range(1, len(sums) + 1), pa.int64()), pa.array(sums),
                                                  pa.array([n] * len(sums), pa.int64())], names=["round", "loss", "n"])

        rows = df.where(F.col("label").isNotNull()).select(F.col("label").cast("double"), vector_to_array("features").alias("v"))
        found = rows.mapInArrow(run, "round long, loss double, n long").groupBy("round").agg(
            F.try_divide(F.sum("loss"), F.sum("n")).alias("loss")).orderBy("round").collect()
        return [r["loss"] for r in found]

    # storage: settings as JSON, nodes as a table
    def save(self, spark: SparkSession, path: str) -> None:
        told = {"params": asdict(self.params), "goal": asdict(self.goal), "edges": [e.tolist() for e in self.edges],
                "outputs": self.trees.output.tolist(), "roots": self.trees.root.tolist()}
        spark.createDataFrame([(json.dumps(told),)], "model string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")
        t = self.trees
        rows = list(zip(range(len(t.feature)), t.feature.tolist(), t.bin.tolist(), t.left.tolist(), t.value.tolist(), t.gain.tolist(),
                        t.rows.tolist()))
        spark.createDataFrame(rows, _NODES).write.mode("overwrite").parquet(f"{path}/nodes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TreeModel:
        told = json.loads(spark.read.text(f"{path}/settings", wholetext=True).first()[0])
        rows = spark.read.parquet(f"{path}/nodes").orderBy("node").collect()
        col = lambda c, kind: np.array([r[c] for r in rows], kind)
        goal = Goal(**{**told["goal"], "start": tuple(told["goal"]["start"])})
        width = 1 if told["params"]["boosted"] else goal.outputs
        return TreeModel(TreeParams(**told["params"]), goal, [np.array(e, float) for e in told["edges"]],
                         Trees(np.array(told["roots"], np.int64), np.array(told["outputs"], np.int64), col("feature", np.int64),
                               col("bin", np.int64), col("left", np.int64), col("value", float).reshape(-1, width), col("gain", float),
                               col("rows", np.int64)))


_NODES = "node long, feature long, bin long, left long, value array<double>, gain double, rows long"


# --- batches of fits ---------------------------------------------------------------------

def _sent_block(binned: Binned) -> Block:
    """All rows as one block; only for a table measured to fit a task. In order of the hash, however the rows lay."""
    parts = [Block.read(r, len(binned.edges), packed=True) for r in binned.blocks.collect()]
    if not parts:
        return Block(np.empty((len(binned.edges), 0), np.uint8), *(np.empty(0, k) for k in (float, float, np.int32, np.uint64)))
    whole = Block(*(np.concatenate([getattr(p, f) for p in parts], axis=-1) for f in ("bins", "label", "weight", "fold", "hash")))
    if not binned.weight_bytes:
        whole.weight = whole.weight[:1]
    return whole.take(np.lexsort((whole.label, whole.hash)))


def _dealt(spark: SparkSession, jobs: Sequence[tuple[Fit, int, int]], run, schema: str) -> DataFrame:
    """Runs `run` in one task per job: a fit, its first tree, and how many."""
    # long jobs first
    order = sorted(jobs, key=lambda j: -(j[2] or j[0].params.trees) * 2 ** min(j[0].params.depth, 8))
    frame = importable(spark).createDataFrame([(k, _named(f), f.held, first, count) for k, (f, first, count) in enumerate(order)],
                                              "rank int, job string, held int, first int, count int")
    return frame.repartitionByRange(max(1, len(jobs)), "rank").mapInArrow(run, schema)


def _named(fit: Fit) -> str:
    return json.dumps(asdict(fit.params)) + "\n" + fit.tag


def _appended(parts: Sequence[Trees]) -> Trees:
    """Trees of several parts as one model."""
    size = np.array([len(p.feature) for p in parts])
    at = np.cumsum(size) - size
    cat = lambda name: np.concatenate([getattr(p, name) for p in parts])
    return Trees(np.concatenate([p.root + a for p, a in zip(parts, at)]), cat("output"), cat("feature"), cat("bin"),
                 np.concatenate([p.left + a for p, a in zip(parts, at)]), cat("value"), cat("gain"), cat("rows"))


def _job(row) -> Fit:
    settings, tag = row["job"].split("\n", 1)
    return Fit(tag, TreeParams(**json.loads(settings)), row["held"])


def fit_models(binned: Binned, fits: Sequence[Fit], limit: int = LIMITS.tree_block_bytes) -> list[TreeModel]:
    """A model for each fit, in order."""
    for f in fits:
        f.params.check()
    goal, out = Goal.of(binned), {}
    if binned.bytes > limit:
        groups = group_rows(binned, goal, limit)
        out = _fit_groups(binned, groups, fits, goal) if groups is not None else {}
    left = [i for i in range(len(fits)) if i not in out]
    if left and binned.packed <= limit:
        out |= dict(zip(left, _fit_sent(binned, [fits[i] for i in left], goal)))
    elif left:
        for kind in (True, False):
            own = [i for i in left if fits[i].params.boosted == kind]
            if own:
                out |= dict(zip(own, _fit_spread(binned, [fits[i] for i in own], goal)[0]))
    return [TreeModel(f.params, goal, binned.edges, out[i]) for i, f in enumerate(fits)]


def _fit_sent(binned: Binned, fits: Sequence[Fit], goal: Goal) -> list[Trees]:
    """Trees of every fit; all rows go to every task, and a task grows a fit or some trees of a forest."""
    import pickle

    spark, sent = binned.blocks.sparkSession, binned.share()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                trees, _ = fit_block(sent.value, _job(row), goal, row["first"], row["count"], score=False)
                yield pa.RecordBatch.from_pylist([{"job": row["job"], "held": row["held"], "first": row["first"], "trees": pickle.dumps(trees)}])

    # few fits leave tasks idle, so that forests are cut into parts
    share = max(1, spark.sparkContext.defaultParallelism // max(1, len(fits)))
    jobs = []
    for f in fits:
        step = f.params.trees if f.params.boosted else max(5, -(-f.params.trees // share))
        jobs += [(f, first, step) for first in range(0, f.params.trees, step)]
    parts: dict[tuple, list] = {}
    for r in _dealt(spark, jobs, run, "job string, held long, first long, trees binary").collect():
        parts.setdefault((r["job"], r["held"]), []).append((r["first"], pickle.loads(r["trees"])))
    found = {k: _appended([t for _, t in sorted(v, key=lambda p: p[0])]) for k, v in parts.items()}
    return [found[_named(f), f.held] for f in fits]


def held_out(binned: Binned, fits: Sequence[Fit], limit: int = LIMITS.tree_block_bytes) -> DataFrame:
    """(tag, fold, label, prediction, n) for classes, (tag, fold, n, mean, spread, mse) for numbers: what each fit makes of
    the rows of its fold. No trees and no rows leave the tasks."""
    for f in fits:
        f.params.check()
    goal, spark, features = Goal.of(binned), binned.blocks.sparkSession, len(binned.edges)
    schema = "tag string, fold long, label double, prediction double, n long" if goal.classes else \
        "tag string, fold long, n long, s double, q double, e double"

    def told(fit: Fit, label: np.ndarray, margins: np.ndarray) -> list[dict]:
        prediction, _ = goal.outcome(fit.params, margins)
        if goal.classes:
            cells, n = np.unique(np.stack([label, prediction]), axis=1, return_counts=True)
            return [{"tag": fit.tag, "fold": fit.held, "label": float(a), "prediction": float(b), "n": int(c)}
                    for (a, b), c in zip(cells.T, n)]
        d = label - goal.center  # sums about the mean of all rows
        return [{"tag": fit.tag, "fold": fit.held, "n": len(label), "s": float(d.sum()), "q": float((d * d).sum()),
                 "e": float(((label - prediction) ** 2).sum())}]

    if binned.packed <= limit:
        sent = binned.share()

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for row in batch.to_pylist():
                    fit, block = _job(row), sent.value
                    _, margins = fit_block(block, fit, goal, keep=False)
                    own = block.fold == fit.held
                    if own.any():
                        yield pa.RecordBatch.from_pylist(told(fit, block.label[own], margins[:, own]))

        rows = _dealt(spark, [(f, 0, 0) for f in fits], run, schema)
    else:
        parts = []
        for kind in (True, False):
            own = [f for f in fits if f.params.boosted == kind]
            if not own:
                continue
            state = _fit_spread(binned, own, goal)[1]

            def each(batches, own=own):
                import pyarrow as pa

                for batch in batches:
                    for row in batch.to_pylist():
                        block = Block.read(row, features)
                        margins = np.frombuffer(row["margins"]).reshape(len(own), goal.outputs, len(block.label))
                        out = [x for i, f in enumerate(own) if (block.fold == f.held).any()
                               for x in told(f, block.label[block.fold == f.held], margins[i][:, block.fold == f.held])]
                        if out:
                            yield pa.RecordBatch.from_pylist(out)

            parts.append(state.mapInArrow(each, schema))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if goal.classes:
        return rows.groupBy("tag", "fold", "label", "prediction").agg(F.sum("n").alias("n"))
    sums = rows.groupBy("tag", "fold").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q", "e")])
    mean = F.col("s") / F.col("n")
    return sums.select("tag", "fold", "n", F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean).alias("spread"),
                       (F.col("e") / F.col("n")).alias("mse"))


@dataclass(frozen=True)
class TreeLearner:
    """An estimator for one fit: `fit` bins the rows it is given."""

    params: TreeParams
    task: str

    def fit(self, data: DataFrame) -> TreeModel:
        self.params.check()
        # rows are told apart by their key columns, or where there are none by what they hold
        keys = [c for c in data.columns if c not in ("label", "features", "fold", "weight", "split")]
        own = [ref(c) for c in keys] or ["label", vector_to_array("features")]
        keyed = data if len(keys) == 1 else data.withColumn("_key", F.xxhash64(*own))
        binned = bin_rows(keyed, keys[0] if len(keys) == 1 else "_key", self.task)
        model = self.fit_binned(binned)
        binned.release()
        return model

    def fit_binned(self, binned: Binned) -> TreeModel:
        """The same from rows that are binned already, whatever their folds."""
        return fit_models(binned, [Fit("fit", self.params)])[0]
