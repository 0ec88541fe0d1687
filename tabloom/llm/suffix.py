"""Suffix-array dedup: removes every byte covered by a string of `length` bytes that also starts elsewhere.

A full suffix array sorts a suffix for each byte of the corpus. This one is sparse, yet exact:

1. Anchors. Each string of 200 bytes has an anchor inside, the 32-byte gram with the least digest (the
   leftmost of equals). Equal strings have equal anchors at equal places. Neighbouring strings share
   anchors, so a text falls into blocks: the consecutive strings of one anchor. There is about one block per 85
   bytes; it travels as two 64-bit digests from two polynomials, of its gram and of its whole content.
2. About eight neighbouring blocks, cut where a gram's digest says so, make a chunk. Chunks whose content occurs twice
   (two digests) are repeated throughout, in each of their places; only one place of each content goes on, and counts as
   two. So copies and near copies travel once, but for the chunks that differ. Of the blocks that go on, those
   whose gram occurs once hold nothing repeated, and those whose content occurs twice (two digests) are
   repeated throughout. All are aggregates with partial sums, so frequent passages are no hot spot.
3. What is left, blocks whose gram is repeated but whose content is not, are sorted as suffixes: starting
   at the anchor, one per distinct content, by mergesort. A comparison finds the common extension of two
   suffixes by binary search over prefix polynomial hashes, so it takes logarithmic time. Neighbours in
   that order, extended to the left in the same way, give repeated strings. Strings that
   neighbours leave open (a longer match to the left may belong to a suffix further away) are compared by
   their hashes. Every match found by hash is verified byte by byte.
4. A gram with more than `hot` distinct contents is not sorted in one task: its strings are counted one by one
   by an aggregate over their 128-bit digests, which is linear in their number.

Texts are known by two 64-bit hashes, so equal texts share their spans, which are found once. Text moves once, to meet its
spans; matches never cross documents. Equality of whole chunks and blocks (step 2) and of strings of step 4 rests on
128 bits of polynomial digests; matches of the suffix sort (step 3) are compared byte by byte.

Defined cases: a null text is empty; texts shorter than `length` lose nothing; repeated rows (also with the
same doc_id) are repetitions of each other; null doc_id is a value like any other; an empty table gives an empty
result; columns to carry along are named by `keep`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scratch import scratch_path, scratch_scope, settle

from .common import ready, slices

LENGTH, GRAM = 200, 32
#: Odd bases of the two polynomials over 64-bit words, and the mixer of their values.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
CHUNKS = ("did long, th long, at int, m int, cg long, ch long, lo array<int>, n array<int>, off array<int>, kg array<long>, "
          "bh array<long>")

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        ones = np.ones(size, np.uint64)
        up, down = ones.copy(), ones.copy()
        up[1:], down[1:] = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        have = _tables[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have[0][:n], have[1][:n]


class Prefix:
    """Prefix polynomial hashes of a byte string: any substring's digest in constant time."""

    def __init__(self, data: np.ndarray, base: int):
        up, self.down = powers(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def digest(self, at, end):
        h = (self.sums[end] - self.sums[at]) * self.down[at]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        return h


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    m, span = v, 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = width - span
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def blocks_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Per block: its text, first string (lo), number of strings (n), anchor from lo (off), and two digests."""
    return _cut(texts, length, gram)[:6]


def _cut(texts: list[bytes], length: int, gram: int):
    """blocks_of, and chunks: the place of each one's first block, and two digests of its content."""
    keep = [i for i, t in enumerate(texts) if len(t) >= length]
    none = np.empty(0, np.int64)
    if not keep:
        void = none.astype(np.uint64)
        return none, none, none, none, void, void, none, void, void
    data = np.frombuffer(b"".join(texts[i] for i in keep), np.uint8)
    sizes = np.array([len(texts[i]) for i in keep], np.int64)
    starts = np.cumsum(sizes) - sizes
    grams, whole = Prefix(data, BASES[0]), Prefix(data, BASES[1])
    at = np.arange(len(data) - gram + 1)
    g = grams.digest(at, at + gram)
    order = (g & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    anchor = (sliding_min(order, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.empty(len(anchor), bool)
    new[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
    new[starts] = True
    lo = np.nonzero(new)[0]
    text = np.searchsorted(starts, lo, "right") - 1
    last = starts[text] + sizes[text] - length
    hi = np.minimum(np.append(lo[1:], len(data)) - 1, last)
    ok = lo <= last  # strings that would run into the next text are none
    lo, hi, text = lo[ok], hi[ok], text[ok]
    a = anchor[lo]
    begins = np.ones(len(lo), bool)
    # an anchor has a small digest, so the choice takes its low bits
    begins[1:] = (text[1:] != text[:-1]) | (g[a][1:] & np.uint64(7) == 0)
    head = np.flatnonzero(begins)
    stop = hi[np.append(head[1:], len(lo)) - 1] + length
    return (np.array(keep)[text], lo - starts[text], hi - lo + 1, a - lo, g[a], whole.digest(lo, hi + length),
            head, grams.digest(lo[head], stop), whole.digest(lo[head], stop))


def _chunks(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """A row per chunk: its first string (at), its number of strings (m), two digests, and its blocks as lists."""
    def run(batches):
        for batch in batches:
            # the search for anchors takes some hundred bytes for each byte of text
            for part in slices(batch, ["did", "th", "text"], most=1 << 18):
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(2).to_pylist()]
                text, lo, n, off, kg, bh, head, cg, ch = _cut(texts, length, gram)
                own = pa.array(text[head])
                ends = pa.array(np.append(head, len(lo)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (
                    *(v.astype(np.int32) for v in (lo, n, off)), kg.view(np.int64), bh.view(np.int64))]
                strings = np.add.reduceat(n, head) if len(head) else n
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(own), part.column(1).take(own), pa.array(lo[head].astype(np.int32)),
                     pa.array(strings.astype(np.int32)), pa.array(cg.view(np.int64)), pa.array(ch.view(np.int64)), *lists],
                    names=["did", "th", "at", "m", "cg", "ch", "lo", "n", "off", "kg", "bh"])

    return docs.select("did", "th", "text").mapInArrow(run, CHUNKS)


class Suffixes:
    """Some suffixes of a byte string, bounded by [begin, end), with comparisons through prefix hashes."""

    def __init__(self, data: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.data, self.at, self.begin, self.end = data, at, begin, end
        self.hash = Prefix(data, BASES[0])

    def _search(self, i, j, most, same):
        low, high = np.zeros(len(i), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            ok = same(mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low

    def right(self, i, j):
        """Common extension to the right of the suffixes i and j."""
        x, y = self.at[i], self.at[j]
        return self._search(i, j, np.minimum(self.end[i] - x, self.end[j] - y),
                            lambda m: self.hash.digest(x, x + m) == self.hash.digest(y, y + m))

    def left(self, i, j):
        x, y = self.at[i], self.at[j]
        return self._search(i, j, np.minimum(x - self.begin[i], y - self.begin[j]),
                            lambda m: self.hash.digest(x - m, x) == self.hash.digest(y - m, y))

    def after(self, i, j):
        """Whether suffix i sorts after suffix j; a suffix that ends first sorts first."""
        k = self.right(i, j)
        x, y = self.at[i] + k, self.at[j] + k
        gone_i, gone_j = x >= self.end[i], y >= self.end[j]
        top = len(self.data) - 1
        return np.where(gone_i | gone_j, gone_j & ~gone_i, self.data[np.minimum(x, top)] > self.data[np.minimum(y, top)])

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order by group, then suffix: a bottom-up mergesort whose merges rank one run in the other."""
        order = np.argsort(group, kind="stable")
        ids = group[order]
        first = np.concatenate([[0], np.nonzero(ids[1:] != ids[:-1])[0] + 1]) if len(ids) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(ids)))
        base, count = np.repeat(first, size), np.repeat(size, size)
        place = np.arange(len(ids)) - base
        width = 1
        while len(size) and width < size.max():
            run = place // width
            other = (run ^ 1) * width                           # where the run to merge with begins in its group
            live = np.nonzero(other < count)[0]
            lo = base[live] + other[live]
            hi = np.minimum(lo + width, base[live] + count[live])
            start, end = lo.copy(), hi
            odd = (run[live] & 1).astype(bool)
            while (open_ := lo < hi).any():                     # rank of each element in the other run
                mid = (lo + hi) >> 1
                pick = np.nonzero(open_)[0]
                own, against = order[live[pick]], order[mid[pick]]
                # an element of the second run stands behind equals of the first
                beyond = np.where(odd[pick], ~self.after(against, own), self.after(own, against))
                lo[pick] = np.where(beyond, mid[pick] + 1, lo[pick])
                hi = hi.copy()
                hi[pick] = np.where(beyond, hi[pick], mid[pick])
            rank = lo - start
            to = base[live] + (place[live] // (2 * width)) * 2 * width + place[live] % width + rank
            merged = order.copy()
            merged[to] = order[live]
            order = merged
            width *= 2
        return order


def verified(data, x, y, size, step: int = 1 << 14) -> np.ndarray:
    """Whether data[x:x+size] equals data[y:y+size], byte by byte, for arrays of places."""
    out = np.ones(len(x), bool)
    for at in range(0, len(x), step):
        a, b, n = x[at:at + step], y[at:at + step], size[at:at + step]
        k = np.arange(int(n.max()) if len(n) else 0)
        inside = k < n[:, None]
        top = len(data) - 1
        same = data[np.minimum(a[:, None] + k, top)] == data[np.minimum(b[:, None] + k, top)]
        out[at:at + step] = (same | ~inside).all(1)
    return out


def repeated_strings(data, begin, end, off, n, group, many, length: int = LENGTH) -> np.ndarray:
    """For blocks laid out in `data`, which of their strings (n each, flat) occur in two places.

    `group` is equal where the anchor's gram is; `many` marks contents known to occur more than once."""
    total = np.cumsum(n)
    base = total - n
    dup = np.zeros(int(total[-1]) if len(n) else 0, bool)
    if not len(n):
        return dup
    s = Suffixes(data, begin + off, begin, end)
    order = s.sort(group)
    i, j = order[:-1], order[1:]
    mates = group[i] == group[j]
    i, j = i[mates], j[mates]
    right, left = s.right(i, j), s.left(i, j)
    true = verified(data, s.at[i] - left, s.at[j] - left, left + right)
    for at in np.nonzero(~true)[0]:  # a collision: extend by comparing bytes
        x, y = int(s.at[i[at]]), int(s.at[j[at]])
        r = l = 0
        while x + r < end[i[at]] and y + r < end[j[at]] and data[x + r] == data[y + r]:
            r += 1
        while x - l > begin[i[at]] and y - l > begin[j[at]] and data[x - l - 1] == data[y - l - 1]:
            l += 1
        right[at], left[at] = r, l
    mark = np.zeros(len(dup) + 1, np.int64)
    for own in (i, j):
        # strings whose anchor lies o bytes in, with length - right <= o <= left
        p0 = np.maximum(off[own] - left, 0)
        p1 = np.minimum(off[own] - (length - right), n[own] - 1)
        ok = p0 <= p1
        np.add.at(mark, base[own[ok]] + p0[ok], 1)
        np.add.at(mark, base[own[ok]] + p1[ok] + 1, -1)
    dup |= np.cumsum(mark[:-1]) > 0
    owner = np.repeat(np.arange(len(n)), n)
    dup[many[owner]] = True
    # what neighbours leave open matters in groups of three or more only
    size = np.bincount(np.unique(group, return_inverse=True)[1])
    inverse = np.unique(group, return_inverse=True)[1]
    best = np.zeros(len(n), np.int64)
    np.maximum.at(best, i, right)
    np.maximum.at(best, j, right)
    o = off[owner] - (np.arange(len(dup)) - base[owner])
    unsure = ~dup & (size[inverse][owner] > 2) & (length - o <= best[owner])
    if unsure.any():
        asked = np.zeros(len(size), bool)
        asked[inverse[owner[unsure]]] = True
        w = np.nonzero(asked[inverse[owner]])[0]
        p = begin[owner[w]] + w - base[owner[w]]
        h = s.hash.digest(p, p + length)
        by = np.lexsort((h, inverse[owner[w]]))
        same = (h[by][1:] == h[by][:-1]) & (inverse[owner[w[by]]][1:] == inverse[owner[w[by]]][:-1])
        same[same] = verified(data, p[by[1:][same]], p[by[:-1][same]], np.full(int(same.sum()), length), 1 << 12)
        hit = np.zeros(len(by), bool)
        hit[1:] |= same
        hit[:-1] |= same
        dup[w[by[hit]]] = True
    return dup


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The blocks of `wanted` with their bytes."""
    listed = wanted.groupBy("did", "th").agg(F.collect_list(F.struct("lo", "n", "off", "kg", "many", "hot")).alias("own"))
    schema = "did long, th long, lo int, n int, off int, kg long, many boolean, hot boolean, bytes binary"

    def run(batches):
        for batch in batches:
            for part in slices(batch, ["did", "th", "text", "own"], most=1 << 20):
                rows = part.to_pylist()
                cols: list[list] = [[] for _ in range(9)]
                for r in rows:
                    t = (r["text"] or "").encode("utf-8", "surrogatepass")
                    for b in r["own"]:
                        for c, v in zip(cols, (r["did"], r["th"], b["lo"], b["n"], b["off"], b["kg"], b["many"], b["hot"],
                                               t[b["lo"]:b["lo"] + b["n"] - 1 + length])):
                            c.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(),
                         pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 names=["did", "th", "lo", "n", "off", "kg", "many", "hot", "bytes"])

    # one of the rows of equal texts; the join has sorted them
    return docs.select("did", "th", "text").join(listed, ["did", "th"]).dropDuplicates(["did", "th"]).mapInArrow(run, schema)


def _runs(dup, base, n):
    """Runs of repeated strings: block, first and last string."""
    flags = np.zeros(len(dup) + 1, bool)
    flags[:-1] = dup
    edge = np.zeros(len(dup) + 1, bool)
    edge[base] = True
    begin = np.nonzero(flags[:-1] & (edge[:-1] | np.concatenate([[True], ~flags[:-2]])))[0]
    stop = np.nonzero(flags[:-1] & (np.append(edge[1:-1], True) | ~flags[1:]))[0]
    owner = np.searchsorted(base, begin, "right") - 1
    return owner, begin - base[owner], stop - base[owner]


def _sorted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Spans found by the suffix sort; rows come grouped by gram, a group is never split over two calls."""

    def solve(rows: pa.Table):
        blobs = rows.column("bytes").to_pylist()
        sizes = np.array([len(b) for b in blobs], np.int64)
        data = np.frombuffer(b"".join(blobs), np.uint8)
        end = np.cumsum(sizes)
        col = lambda c: rows.column(c).to_numpy()
        n, many = col("n").astype(np.int64), rows.column("many").to_numpy(zero_copy_only=False)
        dup = repeated_strings(data, end - sizes, end, col("off").astype(np.int64), n, col("kg"), many, length)
        base = np.cumsum(n) - n
        dup[many[np.repeat(np.arange(len(n)), n)]] = False  # those are spans already
        owner, first, last = _runs(dup, base, n)
        lo = col("lo").astype(np.int64)[owner]
        return pa.RecordBatch.from_arrays(
            [pa.array(col("did")[owner]), pa.array(col("th")[owner]), pa.array(lo + first), pa.array(lo + last + length)],
            names=["did", "th", "start", "stop"])

    def run(batches):
        held = None
        for part in (b.slice(at, 2048) for b in batches for at in range(0, b.num_rows, 2048)):
            t = pa.Table.from_batches([part])
            t = t if held is None else pa.concat_tables([held, t])
            if not len(t):
                continue
            kg = t.column("kg").to_numpy()
            cut = int(np.searchsorted(kg, kg[-1]))  # the last group may go on in the next batch
            held = t.slice(cut)
            if cut:
                yield solve(t.slice(0, cut).combine_chunks())
        if held is not None and len(held):
            yield solve(held.combine_chunks())

    # every gram has at most `hot` rows here; the count of partitions follows the session's
    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return (contexts.where(~F.col("hot")).drop("hot").repartition(parts, "kg").sortWithinPartitions("kg")
            .mapInArrow(run, "did long, th long, start long, stop long"))


def _counted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of grams with very many contents: each string is counted by its two digests."""

    def run(batches):
        for batch in batches:
            step = 2048
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                blobs = rows.column(rows.schema.names.index("bytes")).to_pylist()
                col = lambda c: rows.column(rows.schema.names.index(c)).to_numpy(zero_copy_only=False)  # noqa: E731,B023
                sizes = np.array([len(b) for b in blobs], np.int64)
                data = np.frombuffer(b"".join(blobs), np.uint8)
                n = col("n").astype(np.int64)
                owner = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                p = (np.cumsum(sizes) - sizes)[owner] + place
                h = [Prefix(data, b).digest(p, p + length).view(np.int64) for b in BASES]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[0]), pa.array(h[1]), pa.array(col("did")[owner]), pa.array(col("th")[owner]),
                     pa.array(col("lo").astype(np.int64)[owner] + place), pa.array(col("many")[owner])],
                    names=["h0", "h1", "did", "th", "start", "many"])

    strings = settle(contexts.where("hot").mapInArrow(
        run, "h0 long, h1 long, did long, th long, start long, many boolean"), "strings")
    twice = (strings.groupBy("h0", "h1").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("c"))
             .where("c > 1").select("h0", "h1"))
    return strings.where(~F.col("many")).join(twice, ["h0", "h1"]).select(
        "did", "th", "start", (F.col("start") + length).alias("stop"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = 4096) -> DataFrame:
    """did, th, start, stop: byte spans of repeated strings. `docs` has did, th (two hashes of a text) and text."""
    ready(docs.sparkSession)
    chunks = settle(_chunks(docs, length, gram), "chunks")
    place = F.xxhash64("did", "th", "at")
    places = chunks.select("did", "th", "at", "m", "cg", "ch")
    twice = settle(places.groupBy("cg", "ch").agg(F.count("*").alias("c"), F.min(place).alias("one")).where("c > 1").drop("c"),
                   "repeated-chunks")
    whole = places.join(twice.drop("one"), ["cg", "ch"], "left_semi").select(
        "did", "th", F.col("at").cast("long").alias("start"), (F.col("at") + F.col("m") - 1 + length).cast("long").alias("stop")).distinct()
    firsts = chunks.join(twice, ["cg", "ch"], "left").where(F.col("one").isNull() | (F.col("one") == place))
    blocks = settle(firsts.select("did", "th", F.col("one").isNotNull().alias("copied"),
                                  F.explode(F.arrays_zip("lo", "n", "off", "kg", "bh")).alias("b")).select("did", "th", "copied", "b.*"),
                    "blocks")
    weight = F.when(F.col("copied"), 2).otherwise(1)
    # written, so that the join shuffles both sides anew and Spark may split a frequent gram
    grams = settle(blocks.groupBy("kg").agg(F.sum(weight).alias("c")).where("c > 1").select("kg"), "repeated-grams")
    hits = settle(blocks.join(grams, "kg", "left_semi"), "repeated-blocks")
    kinds = settle(hits.groupBy("kg", "bh").agg(
        F.sum(weight).alias("c"), F.min(F.struct("did", "th", "lo", "n", "off")).alias("one")), "block-kinds")
    known = hits.where(~F.col("copied")).join(kinds.where("c > 1").select("kg", "bh"), ["kg", "bh"], "left_semi").select(
        "did", "th", F.col("lo").cast("long").alias("start"), (F.col("lo") + F.col("n") - 1 + length).cast("long").alias("stop"))
    mixed = settle(kinds.groupBy("kg").agg(F.count("*").alias("kinds"), F.min("c").alias("least"))
                   .where("kinds > 1 and least = 1").select("kg", (F.col("kinds") > hot).alias("hot")), "mixed-grams")
    wanted = kinds.join(mixed, "kg").select("one.*", "kg", (F.col("c") > 1).alias("many"), "hot")
    contexts = settle(_contexts(docs, wanted, length), "block-contexts")
    return whole.unionByName(known).unionByName(_sorted_spans(contexts, length)).unionByName(_counted_spans(contexts, length))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = 4096,
                   keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), and the columns of `keep`.

    `as_text`: kept is a string; a character that a cut went through is left out, the rest of it too."""
    own = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.xxhash64(F.lit(1), own).alias("did"), F.xxhash64(own).alias("th"), "text",
                        F.col("doc_id").cast("long").alias("doc_id"), *keep)
    # only the spans outlive the search for them
    path = scratch_path(docs.sparkSession, "spans")
    with scratch_scope(docs.sparkSession):
        repeated_spans(keyed, length, gram, hot).write.parquet(path)
    spans = docs.sparkSession.read.schema("did long, th long, start long, stop long").parquet(path).groupBy("did", "th").agg(
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    joined = keyed.join(spans, ["did", "th"], "left").drop("did", "th")
    names = [c for c in joined.columns if c not in ("text", "spans")]
    schema = ", ".join(f"`{c}` {t}" for c, t in joined.select(*names).dtypes)
    schema += ", n_bytes long, n_removed long, n_spans long, kept " + ("string" if as_text else "binary")

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.schema.names, most=2 << 20):
                at = part.schema.names.index
                sizes, removed, runs, kept = [], [], [], []
                for text, own in zip(part.column(at("text")).to_pylist(), part.column(at("spans")).to_pylist()):
                    data, out, end, gone, count = (text or "").encode("utf-8", "surrogatepass"), [], 0, 0, 0
                    for s in own or ():
                        if s["start"] > end or not count:
                            out.append(data[end:s["start"]])
                            gone += s["stop"] - s["start"]
                            count += 1
                            end = s["stop"]
                        elif s["stop"] > end:
                            gone += s["stop"] - end
                            end = s["stop"]
                    out.append(data[end:])
                    sizes.append(len(data))
                    removed.append(gone)
                    runs.append(count)
                    rest = b"".join(out)
                    kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(at(c)) for c in names], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(runs, pa.int64()),
                     pa.array(kept, pa.string() if as_text else pa.binary())],
                    names=[*names, "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, schema)


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
