"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most `distance` bits agree in at least 8 - distance of their 8
positional bytes. Distinct fingerprints are listed in an inverted index; pairs that meet in a list have
their shared positional bytes tallied, those below the guaranteed minimum are dropped, the rest are
verified by counting differing bits.

A list of one positional byte holds 1/256 of everything, so its pairs grow with the square of the input. Lists are
therefore kept for byte combinations: of 5 shared bytes at least 3 lie in the same half of the fingerprint, so the
8 combinations of 3 bytes within a half meet every pair (with a smaller distance the same lists suffice).
A list longer than `block` is cut into blocks and every two blocks are compared in one task, so no task holds
a whole long list; a task returns only the links of a spanning forest, so links stay linear where
pairs are not. Links then become components by alternating large-star and small-star steps.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; equal texts
share a fingerprint and so a component; repeated rows keep one row each; rows of null doc_id keep their
fingerprint and take part, but are never a component's id unless all its ids are null; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scratch import settle

from .common import ready, slices

#: Byte combinations that index a fingerprint.
LISTS = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) < shingle:
        grams = [b" ".join(parts)]
    else:
        grams = map(b" ".join, zip(*(parts[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, seed) for g in grams], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and the columns of `keep`. bytes.lower and bytes.split follow the
    ASCII rules."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, ["doc_id", "text"]):
                fps = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(fps.view(np.int64)), *[part.column(2 + i) for i in range(len(keep))]],
                    names=["doc_id", "fp", *keep])

    ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text", *keep)
    return rows.mapInArrow(run, "doc_id long, fp long" + "".join(f", `{c}` {t}" for c, t in rows.dtypes[2:]))


def forest(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which links form a spanning forest of the graph they make (indices of links)."""
    names, flat = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = flat[:len(left)], flat[len(left):]
    root, keep = list(range(len(names))), []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            keep.append(i)
    return np.array(keep, np.int64)


def close_pairs(fps: np.ndarray, distance: int, rows: int = 512):
    """Links among the fingerprints of one group: tally of shared bytes, count filter, bit check."""
    least = 8 - distance
    found = []
    for at in range(0, len(fps), rows):
        differ = fps[at:at + rows, None] ^ fps[None, :]
        shared = (differ.view(np.uint8).reshape(*differ.shape, 8) == 0).sum(2, dtype=np.uint8)
        i, j = np.nonzero(shared >= least)
        i += at
        later = i < j
        i, j = i[later], j[later]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= distance
        i, j = i[near], j[near]
        if len(i):
            keep = forest(i, j)
            found.append(np.stack([i[keep], j[keep]], 1))
    if not found:
        return np.empty((0, 2), np.int64)
    found = np.concatenate(found)
    return found[forest(found[:, 0], found[:, 1])]


def _equal_size_links(sizes, offsets, values, distance):
    """Links of many small groups at once: groups of the same size form one array."""
    for size in np.unique(sizes):
        starts = offsets[sizes == size]
        if size > 24:
            for s in starts:
                own = values[s:s + size]
                found = close_pairs(own, distance)
                yield own[found[:, 0]], own[found[:, 1]]
            continue
        a, b = np.triu_indices(size, 1)
        step = max(1, 2_000_000 // max(1, len(a)))
        for at in range(0, len(starts), step):
            own = values[starts[at:at + step, None] + np.arange(size)]
            x, y = own[:, a].ravel(), own[:, b].ravel()
            differ = x ^ y
            shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)
            near = (shared >= 8 - distance) & (np.bitwise_count(differ) <= distance)
            yield x[near], y[near]


def links(distinct: DataFrame, distance: int = 3, block: int = 1024) -> DataFrame:
    """Links (a < b as signed longs) that connect what pairs within `distance` connect. `distinct` has fp."""
    packed = [sum((F.shiftleft(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)), 8 * k)
                   for k, p in enumerate(c)), F.lit(n << 24)) for n, c in enumerate(LISTS)]
    listed = distinct.select("fp", F.explode(F.array(*packed)).alias("list"))
    # lists of one entry hold no pair; the others learn how many blocks they are cut into
    counts = (listed.groupBy("list").count().where("count > 1")
              .select("list", F.ceil(F.col("count") / block).alias("blocks")))
    met = listed.join(counts, "list")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    dealt = met.withColumn("own", own).select(
        "fp", "list", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    groups = (dealt.groupBy("list", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
              .agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps"))

    def run(batches):
        for batch in batches:
            column = batch.column(0)
            offsets = column.offsets.to_numpy().astype(np.int64)
            values = column.values.to_numpy().view(np.uint64)
            found = list(_equal_size_links(np.diff(offsets), offsets[:-1], values, distance))
            x = np.concatenate([f[0] for f in found]).view(np.int64) if found else np.empty(0, np.int64)
            y = np.concatenate([f[1] for f in found]).view(np.int64) if found else np.empty(0, np.int64)
            if len(x):
                keep = forest(x, y)
                x, y = x[keep], y[keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    ready(distinct.sparkSession)
    return groups.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node -> component (the smallest node reachable), for the nodes of `edges` (a, b).

    Large star: a node's larger neighbours are hung on its smallest neighbour. Small star: its smaller
    neighbours and itself are. Both keep the connections; when nothing changes, every node hangs on its root.
    Each round is written, so a lost executor costs at most that round."""
    edges = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
                   .distinct(), "links")
    mark = None
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # larger neighbours of u go to u's minimum; edges already say who they are: (larger, u)
        large = (edges.join(low.select(F.col("u").alias("v"), "m"), "v").select("u", F.col("m").alias("v"))
                 .where("u <> v").distinct())
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(small_low, "u")
                 .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
                 .select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        edges = settle(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def labelled(docs: DataFrame, shingle: int = 3, distance: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `keep`, fp, root (a name of the component) and component_id (its smallest doc_id)."""
    prints = settle(fingerprints(docs, shingle, keep), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    edges = settle(links(classes.select("fp"), distance), "fingerprint-links")
    hung = components(edges)
    # the component's name is the smallest doc_id of all its fingerprints
    rooted = classes.join(hung, classes["fp"] == hung["node"], "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # one row per fingerprint; only fingerprints in links need the detour over their root
    labels = rooted.join(named, "root").select("fp", "root", "component_id")
    return prints.join(labels, "fp").select("doc_id", *keep, "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable)."""
    return labelled(docs, shingle, distance).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
