"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: its lines, and a line further after those words (one in four) that the eight
bytes before their end choose, so that a changed word touches one or two paragraphs and none behind it moves.
A paragraph's digest counts its repeats, which makes a text a set of digests. A sketch adds each digest to
three cells, one in each third; a cell holds a count, the sum of digests and the sum of their check values. Two
sketches of one size subtract cell by cell, and what both texts have is gone. Peeling then takes a cell that holds one
digest, takes this digest out of its other cells, and goes on: the differing digests of both sides are recovered. If cells
remain, both texts are sketched again four times larger, with other cells. So two texts whose difference is small
compare by small sketches, whatever their length. Likeness is Dice's: twice the shared digests over all of both.

The fingerprint is the smallest sketch, 12 cells in base64: equal texts have equal ones.

`with_edits` compares each document with its edited text and with the next document. Documents are dealt to slots
by quantiles of doc_id (an id that fills several slots is split by text hash), one shuffle of the texts, sorted in
each slot and read as a stream; a slot's last document finds the next slot's first as an extra row behind it.

Defined cases: a null text is empty; two empty texts have likeness 1; null doc_ids come first; rows of one doc_id
go by text hash, then text; repeated rows stay, and are each other's next; one document alone is its own next; texts of any
length are read whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scratch import settle

from .common import ready

CELLS, GROWTH = 12, 4
_SPREAD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mix(x: np.ndarray, turn: int) -> np.ndarray:
    x = (x ^ np.uint64(turn * _SPREAD[0] & (1 << 64) - 1)) * np.uint64(_SPREAD[1])
    x = (x ^ x >> np.uint64(31)) * np.uint64(_SPREAD[2])
    return x ^ x >> np.uint64(29)


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(digests, text number) of all paragraphs, repeats told apart."""
    import xxhash

    pad = bytes(8)
    data = b"".join(x for t in texts for x in (pad, t))
    own = np.frombuffer(data, np.uint8)
    ends = np.cumsum([len(t) + 8 for t in texts])
    starts = np.concatenate([[0], ends[:-1]]) + 8
    blank = np.flatnonzero((own == 32) | (own - np.uint8(9) < 5))
    before = np.ndarray(len(own) - 7 if len(own) > 7 else 0, "<u8", data, 0, (1,))[blank - 8] if len(blank) else np.empty(0, np.uint64)
    cut = blank[(own[blank] == 10) | (_mix(before, 0) >> np.uint64(62) == 0)] + 1
    bounds = np.unique(np.concatenate([cut, starts, ends]))
    lows, highs = bounds[:-1], bounds[1:]
    text = np.searchsorted(starts, lows, side="right") - 1
    real = (text >= 0) & (lows < ends[np.maximum(text, 0)])
    lows, highs, text = lows[real], highs[real], text[real]
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    keys = np.fromiter((digest(view[a:b]) for a, b in zip(lows.tolist(), highs.tolist())), np.uint64, len(lows))
    order = np.lexsort((keys, text))
    k, t = keys[order], text[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    at = np.arange(len(k))
    rank = at - np.maximum.accumulate(np.where(new, at, 0))
    return _mix(k + rank.astype(np.uint64) * np.uint64(_SPREAD[0]), 1), t


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    """The three cells of each digest in a sketch of `cells` cells; another size has other cells."""
    third = np.uint64(cells // 3)
    return np.stack([((_mix(keys, 16 * cells + j) >> np.uint64(32)) * third >> np.uint64(32)).astype(np.int64) + j * (cells // 3)
                     for j in range(3)])


def _check(keys: np.ndarray) -> np.ndarray:
    return _mix(keys, 7)


class Sketches:
    """Sketches of equal size, one for each of `groups` texts or differences of texts."""

    def __init__(self, groups: int, cells: int):
        self.groups, self.cells = groups, cells
        self.count = np.zeros(groups * cells, np.int64)
        self.keys, self.checks = np.zeros(groups * cells, np.uint64), np.zeros(groups * cells, np.uint64)

    def add(self, keys: np.ndarray, group: np.ndarray, sign: np.ndarray | int = 1) -> np.ndarray:
        """Adds (or with sign -1 takes out) digests; the cells it touched."""
        at = (_places(keys, self.cells) + group * self.cells).ravel()
        sign = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        turn = sign.astype(np.uint64)  # sums wrap, so -1 is the largest value
        np.add.at(self.count, at, np.tile(sign, 3))
        np.add.at(self.keys, at, np.tile(keys * turn, 3))
        np.add.at(self.checks, at, np.tile(_check(keys) * turn, 3))
        return at

    def __sub__(self, other: Sketches) -> Sketches:
        out = Sketches(self.groups, self.cells)
        out.count, out.keys, out.checks = self.count - other.count, self.keys - other.keys, self.checks - other.checks
        return out

    def take(self, groups: np.ndarray) -> Sketches:
        out = Sketches(len(groups), self.cells)
        for name in ("count", "keys", "checks"):
            setattr(out, name, getattr(self, name).reshape(self.groups, -1)[groups].ravel())
        return out

    def peel(self, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(digest, group, sign) of what is recovered, and which groups are empty afterwards."""
        found, at = [], np.arange(len(self.count))
        for _ in range(rounds):
            at = at[np.abs(self.count[at]) == 1]
            turn = self.count[at].astype(np.uint64)
            key = self.keys[at] * turn
            pure = _check(key) * turn == self.checks[at]
            at, key = at[pure], key[pure]
            if not len(at):
                break
            group, sign = at // self.cells, self.count[at]
            order = np.lexsort((key, group))
            group, key, sign = group[order], key[order], sign[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
            group, key, sign = group[new], key[new], sign[new]
            found.append((key, group, sign))
            at = np.unique(self.add(key, group, -sign))
        found = found or [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
        key, group, sign = (np.concatenate(x) for x in zip(*found))
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        return key, group, sign, ~left.reshape(self.groups, self.cells).any(1)

    def names(self) -> list[str]:
        """Each sketch as text: per cell a count and a check value of 4 bytes, and the 8 bytes of the sum."""
        cell = np.dtype([("count", "<i4"), ("check", "<u4"), ("keys", "<u8")])
        out = np.empty(len(self.count), cell)
        out["count"], out["check"], out["keys"] = self.count, self.checks >> np.uint64(32), self.keys
        return [base64.b64encode(row.tobytes()).decode() for row in out.reshape(self.groups, self.cells)]


def sketch(keys: np.ndarray, text: np.ndarray, texts: int, cells: int = CELLS) -> Sketches:
    out = Sketches(texts, cells)
    out.add(keys, text)
    return out


def compare(keys: np.ndarray, text: np.ndarray, texts: int, pairs: np.ndarray, base: Sketches | None = None
            ) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Likeness of each pair of text numbers, and (pair, digest) of what only the first and only the second has.

    `text` is ascending. `base` holds the smallest sketches, if they are there already."""
    count = np.bincount(text, minlength=texts)
    first = np.concatenate([[0], np.cumsum(count)])
    one, two = count[pairs[:, 0]], count[pairs[:, 1]]
    alone = np.zeros(len(pairs), np.int64)
    sides: list[list] = [[], []]
    left, cells = np.arange(len(pairs)), CELLS
    while len(left):
        # a difference is at least that of the numbers, so a sketch below it is not worth a try
        fit = np.abs(one[left] - two[left]) <= cells
        now, wait = left[fit], left[~fit]
        if len(now):
            if cells == CELLS and base is not None:
                gap = base.take(pairs[now, 0]) - base.take(pairs[now, 1])
            else:
                made = []
                for side in (0, 1):
                    n = count[pairs[now, side]]
                    at = np.repeat(first[pairs[now, side]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    made.append(sketch(keys[at], np.repeat(np.arange(len(now)), n), len(now), cells))
                gap = made[0] - made[1]
            key, group, sign, whole = gap.peel()
            ours = whole[group]
            for side, mark in ((0, 1), (1, -1)):
                mine = ours & (sign == mark)
                sides[side].append((now[group[mine]], key[mine]))
            np.add.at(alone, now[group[ours]], 1)
            wait = np.concatenate([wait, now[~whole]])
        left, cells = np.sort(wait), cells * GROWTH
    total = one + two
    likeness = np.where(total > 0, (total - alone) / np.maximum(total, 1), 1.0)
    return likeness, [tuple(np.concatenate(x) for x in zip(*side)) if side else (np.empty(0, np.int64), np.empty(0, np.uint64))
                      for side in sides]


# --- versions ----------------------------------------------------------------------------

def differences(versions: DataFrame) -> DataFrame:
    """doc_id, fingerprints and likeness of `text` and `other`, and the digests that only one of them has.

    `versions` holds doc_id, text, other; a paragraph's digest is a signed 64-bit number."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [(t or "").encode() for c in (1, 2) for t in part.column(c).to_pylist()]
                n = part.num_rows
                keys, text = digests(texts)
                base = sketch(keys, text, 2 * n)
                pairs = np.stack([np.arange(n), np.arange(n) + n], 1)
                likeness, sides = compare(keys, text, 2 * n, pairs, base)
                names = base.names()
                lists = []
                for pair, key in sides:
                    order = np.lexsort((key, pair))
                    key, ends = key[order].view(np.int64), np.searchsorted(pair[order], np.arange(n + 1))
                    lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names[:n]), pa.array(names[n:]), pa.array(likeness), *lists],
                    names=["doc_id", "fingerprint", "other_fingerprint", "likeness", "removed", "added"])

    ready(versions.sparkSession)
    return versions.select(F.col("doc_id").cast("long"), "text", "other").mapInArrow(
        run, "doc_id long, fingerprint string, other_fingerprint string, likeness double, removed array<long>, added array<long>")


def _found(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most `value`, by halving steps."""
    size = 1
    while size <= len(bounds):
        size *= 2
    padded = F.lit([*bounds, *[(1 << 63) - 1] * (size - 1 - len(bounds))]) if size > 1 else None
    steps = [F.lit(1 << k) for k in range(size.bit_length() - 2, -1, -1)]
    if not steps:
        return F.lit(0)
    return F.aggregate(F.array(*steps), F.lit(0), lambda at, s: F.when(
        F.element_at(padded, at + s) <= value, at + s).otherwise(at))


def _slots(docs: DataFrame, per_slot: int) -> tuple[DataFrame, int]:
    """doc_id, text, hash and slot: slots ascend with (doc_id, hash) and hold about `per_slot` rows each.

    At most 10,000 quantiles and as many counts come to the driver."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    n = rows.count()
    parts = max(1, min(10_000, -(-n // per_slot)))
    target = max(per_slot, -(-n // parts))
    shares = [i / parts for i in range(1, parts)]
    bounds = rows.agg(F.percentile_approx("doc_id", shares, 10 * parts + 1000)).first()[0] if shares else None
    bounds = bounds or []
    # an id that is several quantiles gets slots of its own
    bounds = sorted({*bounds, *(b + 1 for b, after in zip(bounds, bounds[1:]) if b == after < (1 << 63) - 1)})
    parts = len(bounds) + 1
    wide = F.when(F.col("doc_id").isNull(), 0).otherwise(1 + _found(F.col("doc_id"), bounds))
    facts = {r["slot"]: r for r in rows.select(wide.alias("slot"), "doc_id").groupBy("slot").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()}
    # a slot of one id alone can be split, by text hash
    split = [-(-facts[s]["n"] // target) if s in facts and facts[s]["low"] == facts[s]["high"] else 1 for s in range(parts + 1)]
    starts = [0, *np.cumsum(split).tolist()][:-1]
    told = hashed.withColumn("wide", wide)
    slot = F.element_at(F.lit(starts), F.col("wide") + 1).cast("int")
    if max(split) > 1:
        share = F.shiftrightunsigned(F.col("hash").bitwiseXOR(F.lit(-1 << 63)), 33) * F.element_at(F.lit(split), F.col("wide") + 1)
        slot = slot + F.shiftright(share, 31).cast("int")
    lows = [facts[s]["low"] if s in facts else None for s in range(parts + 1)]
    least = F.element_at(F.lit([x if x is not None else 0 for x in lows]), F.col("wide") + 1)
    head = F.col("doc_id").isNull() | (F.col("doc_id") == least)
    return told.select("doc_id", "text", "hash", slot.alias("slot"), head.alias("head")), sum(split)


def with_edits(docs: DataFrame, per_slot: int = 4096) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A document's edited text has its last quarter of characters replaced by the first as many of the next document."""
    rows, slots = _slots(docs, per_slot)
    firsts = settle(rows.where("head").groupBy("slot").agg(F.min(F.struct("hash", "text")).alias("f")).select(
        "slot", F.col("f.text").alias("text")), "slot-heads")
    full = sorted(r["slot"] for r in firsts.select("slot").collect())
    before = dict(zip(full, [*full[-1:], *full[:-1]]))
    back = F.element_at(F.lit([before.get(s, 0) for s in range(slots)]), F.col("slot") + 1)
    behind = firsts.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("hash"),
                           back.alias("slot"), F.lit(1).alias("kind"))
    streams = rows.select("doc_id", "text", "hash", "slot", F.lit(0).alias("kind")).unionByName(behind).repartitionById(
        slots, "slot").sortWithinPartitions("kind", F.asc_nulls_first("doc_id"), "hash", "text")

    def told(ids: list, texts: list[str]):
        """Rows of documents whose texts are followed by one more."""
        import hashlib

        import pyarrow as pa

        n = len(ids)
        counts = [len(t) for t in texts[:n]]
        edited = [(t[:c - c // 4] + after[:c // 4]).encode() for t, c, after in zip(texts, counts, texts[1:])]
        keys, text = digests([t.encode() for t in texts] + edited)
        base = sketch(keys, text, 2 * n + 1)
        own = np.arange(n)
        likeness, _ = compare(keys, text, 2 * n + 1, np.concatenate([
            np.stack([own, own + n + 1], 1), np.stack([own, own + 1], 1)]), base)
        names = base.names()
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
             pa.array(names[:n]), pa.array(names[n + 1:]), pa.array(likeness[:n]), pa.array(likeness[n:])],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        ids, texts, held = [], [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                text = batch.column(1)[at].as_py()
                texts.append(text)
                held += len(text)
                if batch.column(2)[at].as_py():
                    yield told(ids, texts)
                    ids, texts, held = [], [], 0
                    continue
                if held > 2 << 20 and ids:
                    yield told(ids, texts)
                    ids, texts, held = [], texts[-1:], len(text)
                ids.append(batch.column(0)[at].as_py())

    ready(docs.sparkSession)
    return streams.select("doc_id", "text", "kind").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
