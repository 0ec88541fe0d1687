"""The document operators against brute force, with every odd case of conftest."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import binpack, curriculum, outliers, simhash, suffix, textcnn
from tabloom.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, *cols):
    return sorted(([r[c] for c in cols] for r in df.collect()), key=repr)


# suffix dedup -------------------------------------------------------------------------------------------------

def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[p:p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = True
        gone = gone[:len(b)]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length, gram, hot", [(200, 32, 4096), (200, 32, 2), (24, 8, 4096), (24, 8, 3)])
def test_suffix_dedup_equals_brute_force(spark, odd_docs, length, gram, hot):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = sorted(([i, *v] for (i, _), v in zip(docs, brute_repeats([t for _, t in docs], length))), key=repr)
    got = suffix.digests(suffix.remove_repeats(odd_docs, length, gram, hot))
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_suffix_dedup_of_nothing(no_docs):
    assert suffix.remove_repeats(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=60), min_size=1, max_size=8))
def test_repeated_strings_equals_brute_force(texts):
    """The kernel on texts over two letters, where matches overlap and periods abound."""
    length, gram = 12, 4
    data = [t.encode() for t in texts]
    text, lo, n, off, kg, bh = suffix.blocks_of(data, length, gram)
    kinds, first, inverse, count = np.unique(np.stack([kg, bh]), axis=1, return_index=True, return_inverse=True, return_counts=True)
    blobs = [data[text[i]][lo[i]:lo[i] + n[i] - 1 + length] for i in first]
    sizes = np.array([len(b) for b in blobs], np.int64)
    end = np.cumsum(sizes)
    dup = suffix.repeated_strings(np.frombuffer(b"".join(blobs), np.uint8), end - sizes, end, off[first], n[first],
                                  kg[first], count > 1, length)
    base = np.cumsum(n[first]) - n[first]
    seen = collections.Counter(b[p:p + length] for b in data for p in range(len(b) - length + 1))
    places = 0
    for i in range(len(text)):
        k = inverse.reshape(-1)[i]
        for p in range(n[i]):
            string = data[text[i]][lo[i] + p:lo[i] + p + length]
            assert dup[base[k] + p] == (seen[string] > 1)
            places += 1
    assert places == sum(max(0, len(b) - length + 1) for b in data)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.binary(min_size=1, max_size=12)), min_size=1, max_size=40))
def test_mergesort_orders_suffixes(items):
    blobs = [bytes(b % 3 for b in x) for _, x in items]
    sizes = np.array([len(b) for b in blobs])
    end = np.cumsum(sizes)
    group = np.array([g for g, _ in items])
    s = suffix.Suffixes(np.frombuffer(b"".join(blobs), np.uint8), end - sizes, end - sizes, end)
    order = s.sort(group)
    assert [(group[i], blobs[i]) for i in order] == sorted((g, b) for g, b in zip(group, blobs))


# statistics and outliers --------------------------------------------------------------------------------------

def base_stats(text):
    t = text or ""
    w = WORD.findall(t)
    grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    again = {k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
    return [len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(again), failed]


def test_base_statistics(odd_docs):
    want = sorted(([r.doc_id, *base_stats(r.text)] for r in odd_docs.collect()), key=repr)
    got = outliers.reject_outliers(odd_docs)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert not [r for r in got.collect() if r.base_failed and r.kept]


def test_outliers_of_nothing(no_docs):
    assert outliers.reject_outliers(no_docs).count() == 0


def test_outliers_rejects_planted_junk(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in outliers.reject_outliers(docs).collect()}
    known = [(r.quality, got[r.doc_id]) for r in labels.collect()]
    junk = [g.kept for q, g in known if q == 0]
    clean = [g.kept for q, g in known if q == 1 and not g.base_failed]
    assert sum(junk) <= 0.1 * len(junk) and sum(clean) >= 0.97 * len(clean)


def test_mcd_agrees_with_numpy(spark):
    """Estimates on clean clusters with a fifth of outliers: distances as numpy has them from the same texts."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (400, 5)) * 2 + 3
    x[:80] += 40
    df = spark.createDataFrame([("p", *map(float, r)) for r in x], "pool string, x0 double, x1 double, x2 double, x3 double, x4 double")
    near = outliers._moments(df.where("x0 < 20"))
    got = np.sort([r.d2 for r in outliers._distances(df, near, 1).collect()])
    y = x[x[:, 0] < 20]
    cov = np.cov(y.T, bias=True) + np.diag(np.square(outliers.FLOORS))
    d = x - y.mean(0)
    assert np.allclose(got, np.sort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)))
    assert np.allclose(np.sort([r.d2 for r in outliers._distances(df, near, 10 ** 6).collect()]), got)  # the salted join
    nearest = outliers._nearest(outliers._distances(df, near, 1), 0.75, 1)
    assert 300 <= nearest.count() <= 308


# curriculum ---------------------------------------------------------------------------------------------------

def water_fill(sizes, weights, budget, most):
    target, rest, open_ = {}, budget * sum(sizes.values()), set(sizes)
    while open_:
        total = sum(weights[k] for k in open_)
        target |= {k: rest * weights[k] / total for k in open_}
        over = [k for k in open_ if target[k] > most * sizes[k] + 1e-9]
        if not over:
            break
        for k in over:
            target[k] = most * sizes[k]
            rest -= target[k]
            open_.discard(k)
    return target


def test_mix_meets_targets(odd_docs):
    docs = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in odd_docs.collect()]
    sizes = collections.Counter()
    for _, s, n in docs:
        sizes[s] += n
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = water_fill(dict(sizes), {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5, 2.0)
    plan = curriculum.plan(odd_docs, bucket_rows=4, keep=("source",)).collect()
    assert len(plan) == len(docs)
    taken = collections.Counter()
    for r in plan:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1.001 for s in sizes)


def test_mix_is_ordered_and_repeatable(odd_docs):
    first, again = curriculum.mix(odd_docs).collect(), curriculum.mix(odd_docs.repartition(3)).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again))
    at = [r.position for r in first if r.position is not None]
    assert at == sorted(at) and all(0 <= p <= 1 for p in at)


def test_schedule_inverse(spark):
    """The position at which the integral of the weights reaches a share of its total."""
    for knots in curriculum.SCHEDULES:
        t = np.linspace(0, 1, 20001)
        w = np.interp(t, [k[0] for k in knots], [k[1] for k in knots])
        area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(t))])
        shares = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
        df = spark.createDataFrame([(s,) for s in shares], "s double")
        got = [r[0] for r in df.select(curriculum.invert(df.s, knots)).collect()]
        assert np.allclose(got, np.interp(shares, area / area[-1], t), atol=1e-3)


def test_mixed_rows_carry_the_words_taken(odd_docs):
    taken = sum(r.taken for r in curriculum.plan(odd_docs).collect())
    rows = curriculum.mixed(odd_docs)
    assert rows.columns == odd_docs.columns
    assert sum(len(WORD.findall(r.text)) for r in rows.collect()) == taken


def test_mix_of_nothing(no_docs):
    assert curriculum.mix(no_docs).count() == 0 and curriculum.mixed(no_docs).count() == 0


# simhash ------------------------------------------------------------------------------------------------------

def brute_components(ids, fps, distance):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            best[find(i)] = min(best.get(find(i), ids[i]), ids[i])
    return [best.get(find(i)) for i in range(len(fps))]


def test_fingerprint_is_the_contract(spark):
    t = "The  quick\tBrown fox\njumps"
    w = t.lower().split()
    df = spark.createDataFrame([(" ".join(w[i:i + 3]),) for i in range(3)], "g string")
    hashes = [r[0] & (1 << 64) - 1 for r in df.selectExpr("xxhash64(g)").collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 3)
    assert simhash.fingerprint(t) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("É B") == simhash.fingerprint("É b") != simhash.fingerprint("é b")


def test_components_equal_brute_force(odd_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    fps = [simhash.fingerprint(t) for _, t in docs]
    want = sorted(([i, f"{f:016x}", c] for (i, _), f, c in zip(docs, fps, brute_components([i for i, _ in docs], fps, 3))), key=repr)
    assert rows_of(simhash.near_duplicates(odd_docs), "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("block", [4, 1000])
def test_links_keep_every_connection(spark, block):
    """Chains and clouds of close fingerprints, in lists much longer than a block."""
    rng = np.random.default_rng(2)
    fps = set()
    for _ in range(12):
        x = int(rng.integers(0, 1 << 62))
        for _ in range(60):
            fps.add(x)
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(b)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, block)
    hung = {r.node: r.component for r in simhash.components(edges).collect()}
    got = collections.defaultdict(set)
    for f in signed:
        got[hung.get(f, f)].add(f)
    want = collections.defaultdict(set)
    for f, c in zip(signed, brute_components(list(range(len(fps))), fps, 3)):
        want[c].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_of_nothing(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


# quality network ----------------------------------------------------------------------------------------------

def test_layout_covers_whole_texts():
    texts = [b"", b"x" * 256, b"y" * 257, bytes(range(256)) * 5]
    blocks, counts = textcnn.layout(texts)
    assert counts.tolist() == [1, 1, 2, 5]
    at = 0
    for t, n in zip(texts, counts):
        assert blocks[at:at + n, :256].tobytes().rstrip(b"\0") == t.rstrip(b"\0")
        assert not blocks[at + n - 1, 256:].any()
        at += n


def test_responses_and_pooling_equal_plain_loops():
    rng = np.random.default_rng(0)
    m = textcnn.TextCNN(rng.normal(0, 1, (6, 256, 3)).astype(np.float32), np.array([0.1, -0.2, 0.3], np.float32),
                        rng.normal(0, 1, 6).astype(np.float32), 0.2)
    for t in (b"", b"short", bytes(rng.integers(0, 256, 700, dtype=np.uint8))):
        padded = t + b"\0" * (-len(t) % 256 if t else 256) + b"\0" * 5
        act = np.array([sum(m.filters[j, padded[p + j]] for j in range(6)) for p in range(len(padded) - 5)])
        peaks = np.maximum(act.reshape(-1, 256, 3).max(1) + m.bias, 0)
        chunks = np.array([np.maximum(peaks[i], peaks[min(i + 1, len(peaks) - 1)]) for i in range(max(1, len(peaks) - 1))])
        z = np.concatenate([chunks.max(0), chunks.mean(0)]) @ m.out + m.shift
        assert np.allclose(textcnn.probabilities(m, [b"other", t])[1], 1 / (1 + np.exp(-z)), atol=1e-5)


def test_training_lowers_the_loss_by_the_gradient():
    texts = [b"good words here " * 8, b"bad%%% junk### " * 8] * 10
    y = np.array([1, 0] * 10, np.float32)
    m = textcnn.train(texts, y, np.ones(20, np.float32), n_filters=4, least_steps=60)
    p = textcnn.probabilities(m, texts)
    assert p[y == 1].min() > 0.9 and p[y == 0].max() < 0.1


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in textcnn.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    out = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(q == p for q, p in out) >= 0.93 * len(out)


def test_classifier_on_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, 0), (3, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    got = textcnn.classify(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    scores = {r.doc_id: r.score for r in got}
    assert scores[30] == scores[31]  # null and empty
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert textcnn.classify(no_docs, labels).count() == 0
    alone = textcnn.classify(odd_docs, labels.where("quality = 1")).collect()
    assert len({r.score for r in alone}) == 1


# packing ------------------------------------------------------------------------------------------------------

def test_packing_round_trip(odd_docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    pieces = binpack.pack_documents(odd_docs, tokenizer_path()).collect()
    by_doc = collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    want = collections.Counter()
    for r in odd_docs.collect():
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        for s in range(0, len(ids), 2048):
            own = ids[s:s + 2048]
            want[(r.doc_id, s, len(own), zlib.crc32(own.tobytes()), len(ids))] += 1
    assert collections.Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == want
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048 and len(s) <= 64


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(0, 50)), min_size=0, max_size=60))
def test_fill_keeps_every_limit(items):
    length = np.array([a for a, _ in items], np.int64)
    loss = np.array([min(a, b) for a, b in items], np.int64)
    seq, offset = binpack.fill(length, loss, 50, 4, 50)
    for s in set(seq.tolist()):
        own = seq == s
        assert length[own].sum() <= 50 and own.sum() <= 4 and loss[own].sum() <= 50
        assert sorted(offset[own]) == sorted((np.cumsum(length[own][np.argsort(offset[own])]) - length[own][np.argsort(offset[own])]))


def test_encoder_equals_the_files_own_library():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(tokenizer_path()), binpack.encoder(tokenizer_path())
    for t in ("", "Hello, world's  end\n\n\t x", "naïve ünïcödé 中文 🙂 123,456", " \n", "'ll 'LL\u00a0x\u2003y", "a" * 500):
        assert enc.encode_ordinary(t) == tok.encode(t, add_special_tokens=False).ids


def test_padding_is_little(spark):
    got = binpack.pack_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), tokenizer_path())
    used = got.groupBy("sequence_id").sum("length").collect()
    assert sum(2048 - r[1] for r in used) <= 0.01 * 2048 * len(used)


def test_packing_of_nothing(no_docs):
    assert binpack.pack_documents(no_docs, tokenizer_path()).count() == 0
