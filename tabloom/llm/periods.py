"""Periodic runs of words, found by recompression and grammar extension queries.

The words of a slice of texts are numbered and laid end to end, with a separator of its own after each text.
Recompression turns the row into a run-length grammar: block compression replaces each maximal block of one letter by
a letter for (letter, length), pair compression replaces the pairs whose first letter falls in one half of the
alphabet and whose second in the other; both alternate until every text is one letter. Equal letters stand for
equal words, since every level names its blocks and pairs exactly. An extension query compares two places letter by
letter: it climbs while both stand at the edge of equal parents, takes whole equal letters (of two blocks of one
letter the shorter), and goes down where letters differ, until words differ. Queries are answered many at a time.

A run with period q and at least 4q words has 3q neighbouring places whose words recur q later, so a grid of step 3q meets
it (for q = 1 the least length is 6, and the step 5). Grid places with equal words are extended both ways, exactly.
Of the periods found for one stretch the smallest is its period: all others are its multiples.

Texts travel once, in Arrow batches cut into slices of some megabytes; there is no shuffle, and a task holds one slice
or one text. Words are `[^\\x20\\x09-\\x0D]+` of the UTF-8 bytes, which is the same as of the characters.

Defined cases: null, empty and blank texts have no words, no runs, the hash of the empty string twice; texts of any
length are read whole; repeated rows give a row each; equal exponents go to the smaller start, then period; a null
doc_id is never planted; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, slices

LEAST, TIMES = 6, 4


@dataclass
class Level:
    """One row of letters; `up` is the parent's place in the next level, `down` the first child's in the last."""

    letters: np.ndarray
    size: np.ndarray          # words under a letter
    down: np.ndarray | None
    blocks: bool              # whether the children of a letter are one block
    up: np.ndarray | None = None


def _parents(level: Level, first: np.ndarray, letters: np.ndarray, blocks: bool) -> Level:
    """The next level, whose letters begin at the places `first`."""
    n = len(level.letters)
    mark = np.zeros(n, np.int32)
    mark[first] = 1
    level.up = np.cumsum(mark, dtype=np.int32) - np.int32(1)
    sums = np.concatenate([[0], np.cumsum(level.size, dtype=np.int64)])
    size = (sums[np.append(first[1:], n)] - sums[first]).astype(np.int32)
    return Level(letters.astype(np.int32), size, first.astype(np.int32), blocks)


def _block_level(level: Level, named: int) -> tuple[Level, int]:
    """Each maximal block of one letter becomes a letter; blocks of one stay the letter that they are."""
    own = level.letters
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    if len(first) == len(own):
        return level, named
    length = np.diff(np.append(first, len(own)))
    letters = own[first].astype(np.int64)
    long = np.flatnonzero(length > 1)
    _, name = np.unique(letters[long] << 32 | length[long], return_inverse=True)
    letters[long] = named + name
    return _parents(level, first, letters, True), named + int(name.max()) + 1


def _pair_level(level: Level, named: int, turn: int) -> tuple[Level, int]:
    """Pairs of a letter of the left half and a letter of the right half become letters. Separators are below zero."""
    own = level.letters
    mixed = (own.astype(np.int64) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64((0xBF58476D1CE4E5B9 + 0x632BE59BD9B4E01A * turn) & (1 << 64) - 1)
    half = mixed >> np.uint64(63)
    pair = (own[:-1] >= 0) & (own[1:] >= 0) & (half[:-1] == 0) & (half[1:] == 1)
    at = np.flatnonzero(pair)
    if not len(at):
        return level, named
    begins = np.ones(len(own), bool)
    begins[at + 1] = False
    _, name = np.unique(own[at].astype(np.int64) << 32 | own[at + 1], return_inverse=True)
    letters = own.astype(np.int64)
    letters[at] = named + name
    first = np.flatnonzero(begins)
    return _parents(level, first, letters[first], False), named + int(name.max()) + 1


def grammar(words: np.ndarray) -> list[Level]:
    """The levels over word numbers (0 and more) with separators (each its own number below zero)."""
    levels = [Level(words.astype(np.int32), np.ones(len(words), np.int32), None, False)]
    named, texts, turn = int(words.max(initial=-1)) + 1, int((words < 0).sum()), 0
    while len(levels[-1].letters) > 2 * texts + 1 or turn == 0:
        for make in (lambda at: _block_level(at, named), lambda at: _pair_level(at, named, turn)):
            above, named = make(levels[-1])
            if above is not levels[-1]:
                levels.append(above)
        turn += 1
        own = levels[-1].letters
        if not ((own[:-1] >= 0) & (own[1:] >= 0)).any():  # every text is one letter
            break
    return levels


class Extensions:
    """Longest common extensions of places of the word row, answered for arrays of places at once."""

    def __init__(self, levels: list[Level]):
        sizes = [len(x.letters) for x in levels]
        self.base = np.cumsum([0, *sizes])[:-1]
        self.letters = np.concatenate([x.letters for x in levels])
        self.size = np.concatenate([x.size for x in levels])
        self.n = np.array(sizes)
        up = [x.up + b if x.up is not None else np.full(s, -1) for x, b, s in zip(levels, [*self.base[1:], 0], sizes)]
        self.up = np.concatenate(up).astype(np.int64)
        down = [x.down + b if x.down is not None else np.full(s, -1) for x, b, s in zip(levels, [0, *self.base[:-1]], sizes)]
        self.first = np.concatenate(down).astype(np.int64)
        ends = [np.append(d[1:], b + s) - 1 if x.down is not None else d for x, d, b, s in zip(
            levels, down, [0, *self.base[:-1]], [0, *sizes[:-1]])]
        self.last = np.concatenate(ends).astype(np.int64)
        self.blocks = np.concatenate([np.full(s, x.blocks) for x, s in zip(levels, sizes)])
        # a place's level ends before this; places beyond the ends of a row match nothing
        self.low = np.repeat(self.base, sizes)
        self.high = np.repeat(self.base + self.n, sizes)

    def extend(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """Equal words from places a and b on (or, backward, up to and with them). a and b differ."""
        out = np.zeros(len(a), np.int64)
        x, y = a.astype(np.int64), b.astype(np.int64)
        live = np.flatnonzero((x >= 0) & (y >= 0) & (x < self.n[0]) & (y < self.n[0]))
        x, y = x[live], y[live]
        edge = self.first if forward else self.last
        while len(live):
            same = self.letters[x] == self.letters[y]
            # climb while both letters are the edge of their parents and the parents are equal
            while True:
                p, q = self.up[x], self.up[y]
                can = same & (p >= 0) & (q >= 0)
                can[can] = (edge[p[can]] == x[can]) & (edge[q[can]] == y[can]) & (self.letters[p[can]] == self.letters[q[can]])
                if not can.any():
                    break
                x, y = np.where(can, p, x), np.where(can, q, y)
            take = np.where(same, self.size[x], 0)
            step = np.ones(len(x), np.int64)
            # of two blocks of one letter the shorter is taken whole, whatever their parents
            p, q = self.up[x], self.up[y]
            runs = same & (p >= 0) & (q >= 0)
            runs[runs] = self.blocks[p[runs]]
            if runs.any():
                r = np.flatnonzero(runs)
                left = np.minimum(self._rest(x[r], p[r], forward), self._rest(y[r], q[r], forward))
                step[r] = left
                take[r] = left * self.size[x[r]]
            out[live] += take
            move = step if forward else -step
            deeper = ~same & (self.first[x] >= 0) & (self.first[y] >= 0)
            on = same.copy()
            nx, ny = x + move, y + move
            inside = (nx >= self.low[x]) & (nx < self.high[x]) & (ny >= self.low[y]) & (ny < self.high[y])
            on &= inside
            x, y = np.where(on, nx, x), np.where(on, ny, y)
            if deeper.any():
                x, y = np.where(deeper, edge[x], x), np.where(deeper, edge[y], y)
            stay = on | deeper
            live, x, y = live[stay], x[stay], y[stay]
        return out

    def _rest(self, place: np.ndarray, parent: np.ndarray, forward: bool) -> np.ndarray:
        """Letters of the parent's block from a place on, this one included."""
        return self.last[parent] - place + 1 if forward else place - self.first[parent] + 1




def find_runs(words: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run. Texts of `counts` words begin at `starts`, longest first."""
    none = (np.empty(0, np.int64),) * 3
    longest = int(counts.max(initial=0))
    if longest < LEAST:
        return none
    found_at, found_q = [], []
    most = longest // TIMES
    # texts are in descending order of length, so those long enough for a period are a prefix of the row
    reach = starts + counts
    enough = np.searchsorted(-counts, -np.maximum(TIMES * np.arange(most + 1), LEAST), side="right")
    for q in range(1, most + 1):
        texts = enough[q]
        if not texts:
            break
        end = int(reach[texts - 1]) - q
        step = max(LEAST, TIMES * q) - q
        at = np.flatnonzero(words[0:end:step] == words[q:end + q:step]) * step
        if len(at):
            found_at.append(at)
            found_q.append(np.full(len(at), q))
    if not found_at:
        return none
    at, q = np.concatenate(found_at), np.concatenate(found_q)
    lce = Extensions(grammar(words))
    parts = []
    for s in range(0, len(at), 1 << 18):
        a, p = at[s:s + (1 << 18)], q[s:s + (1 << 18)]
        ahead = lce.extend(a, a + p, True)
        behind = lce.extend(a - 1, a + p - 1, False)
        start, end = a - behind, a + ahead + p
        good = end - start >= np.maximum(LEAST, TIMES * p)
        parts.append(np.unique(np.stack([start[good], end[good], p[good]], 1), axis=0))
    runs = np.unique(np.concatenate(parts), axis=0)
    # one stretch, several periods: the first is the smallest
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return tuple(runs[new].T)


def plant(parts: list[bytes], crc: int | None) -> list[bytes]:
    """The words after the contract's planting, decided by crc32 of the doc_id."""
    n = len(parts)
    if crc is None or crc % 10 or not n:
        return parts
    g = crc // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit, left = parts[a:a + p], n - a
    return parts[:a] + (unit * (left // p + 1))[:left]


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def describe(texts: list[list[bytes]]) -> list[dict]:
    """The result columns of each text, given as words. All texts share one grammar."""
    import hashlib

    counts = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-counts, kind="stable")
    name = _Numbers().__getitem__
    row = np.empty(int(counts.sum()) + len(texts), np.int32)
    starts, at = np.empty(len(texts), np.int64), 0
    for k, i in enumerate(order):
        n = len(texts[i])
        row[at:at + n] = np.fromiter(map(name, texts[i]), np.int32, n)
        row[at + n] = -1 - k
        starts[k], at = at, at + n + 1
    start, end, period = find_runs(row, starts, counts[order])
    owner = np.searchsorted(starts, start, side="right") - 1
    # one pass over the runs in order of text, start and period
    ranked = np.lexsort((period, start, owner))
    out: list[dict] = [None] * len(texts)
    bounds = np.searchsorted(owner[ranked], np.arange(len(texts) + 1))
    for k, i in enumerate(order):
        own = ranked[bounds[k]:bounds[k + 1]]
        parts = texts[i]
        best = (None,) * 4
        lines = b""
        if len(own):
            runs = [(int(start[r] - starts[k]), int(end[r] - start[r]), int(period[r])) for r in own]
            top = runs[0]
            for r in runs[1:]:  # exact: lengths over periods by cross product
                if r[1] * top[2] > top[1] * r[2]:
                    top = r
            best = (*top, 1000 * top[1] // top[2])
            lines = b"".join(b"%d,%d,%d\n" % r for r in runs)
            steps = np.zeros(len(parts) + 1, np.int64)
            for s, length, q in runs:
                steps[s + q] += 1
                steps[s + length] -= 1
            kept = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
            parts = [parts[j] for j in kept.tolist()]
        out[i] = {"n_runs": len(own), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": best[3],
                  "runs_sha256": hashlib.sha256(lines).hexdigest(), "collapsed": b" ".join(parts)}
    return out


RESULT = ("n_runs", "start", "length", "period", "exponent_milli")


def periodic_runs(docs: DataFrame, planted: bool = False, as_text: bool = False) -> DataFrame:
    """doc_id, n_runs, the run with the greatest exponent, runs_sha256, and collapsed_sha256 of the words without the
    repetitions (the words themselves as `collapsed` with `as_text`)."""
    last = "collapsed" if as_text else "collapsed_sha256"

    def run(batches):
        import hashlib

        def told(rows):
            own = describe([plant(t, c) for _, t, c in rows])
            columns = [pa.array([r[0] for r in rows], pa.int64())]
            columns += [pa.array([d[c] for d in own], pa.int64()) for c in RESULT]
            columns.append(pa.array([d["runs_sha256"] for d in own], pa.string()))
            columns.append(pa.array([d["collapsed"].decode() if as_text else hashlib.sha256(d["collapsed"]).hexdigest()
                                     for d in own], pa.string()))
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", *RESULT, "runs_sha256", last])

        for batch in batches:
            for part in slices(batch, ["doc_id", "text", "crc"]):
                texts = part.column(1).cast(pa.binary()).to_pylist()
                yield told([(d, (t or b"").split(), c) for d, t, c in zip(
                    part.column(0).to_pylist(), texts, part.column(2).to_pylist())])

    ready(docs.sparkSession)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) if planted else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long"), "text", crc.alias("crc")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} long" for c in RESULT) + f", runs_sha256 string, {last} string")
