"""Vectors, urls, conversations and archives, with nulls, ties, repeated rows and empty tables."""

import collections
import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabloom.llm import ann, chat, merkle, urltree


# neighbours ---------------------------------------------------------------------------------------------------

def brute_nearest(rows, k, every):
    sound = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v
             and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, q in sound:
        if i % every == 0:
            ranked = sorted((-float(np.dot(q, v)), j) for j, v in sound if j != i)
            out[i] = [j for _, j in ranked[:k]]
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 8) * rng.uniform(0.5, 2)]) for i in range(900)]
    rows += [(900 + i, rows[5][1]) for i in range(300)]                      # one very common vector
    rows += [(2000, None), (2001, []), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [1.0, None] + [1.0] * 6),
             (2080, [float("inf")] * 8), (None, [1.0] * 8)]
    return rows, spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")


def test_recall_and_exact_scores(vectors):
    rows, df = vectors
    want, got = brute_nearest(rows, 20, 20), collections.defaultdict(list)
    value = dict(rows)
    for r in ann.nearest(df, shard_rows=300, degree=16).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r.query_id]) + 1 and r.vec_id != r.query_id
        assert r.score == pytest.approx(float(np.dot(np.array(value[r.query_id]), np.array(value[r.vec_id]))), rel=1e-12)
        got[r.query_id].append(r.vec_id)
    assert set(got) == set(want) and all(len(set(v)) == 20 for v in got.values())
    hits = [len(set(want[q]) & set(got[q])) for q in want]
    assert sum(hits) >= 0.95 * 20 * len(want)
    # ties: the common vector's neighbours of equal score come by id
    assert got[900] == want[900]


def test_few_and_no_vectors(spark, vectors):
    _, df = vectors
    few = df.where("vec_id in (0, 1, 2, 3, 2000)")
    assert [r.vec_id for r in ann.nearest(few).collect()].__len__() == 3
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.where("vec_id = 20")).count() == 0


# urls ---------------------------------------------------------------------------------------------------------

def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def plain_rule(host, path):
    fit = [r for r in urltree.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max((r.name for r in fit), key=len, default=None)


def brute_judge(urls, purity=0.8, smoothing=4.0, z=2.58, many=8):
    """The template tree in plain Python."""
    parts = [plain_parts(u) for u in urls]
    verdict = {r.name: r.verdict for r in urltree.RULES}
    rules = [plain_rule(*p) for p in parts]
    segs = [[s for s in p.split("/") if s] for _, p in parts]
    trail = [[""] for _ in urls]
    over = [not s for s in segs]
    for level in range(max((len(s) for s in segs), default=0)):
        kids, paths = collections.defaultdict(collections.Counter), collections.defaultdict(set)
        for (h, p), s, t, o in zip(parts, segs, trail, over):
            if not o:
                kids[h, t[-1]][s[level]] += 1
                paths[h, t[-1]].add(p)
        wild = {k for k, c in kids.items() if len(c) > many and sum(c.values()) ** 2 > many * sum(n * n for n in c.values())}
        for i, ((h, _), s, t) in enumerate(zip(parts, segs, trail)):
            if not over[i]:
                alone = len(paths[h, t[-1]]) == 1
                over[i] = alone or len(s) == level + 1
                t.append(t[-1] + "/" + ("/".join(s[level:]) if alone else "*" if (h, t[-1]) in wild else s[level]))
    lab, bad = collections.Counter(), collections.Counter()
    nodes, parent = set(), {}
    for (h, _), t, r in zip(parts, trail, rules):
        for d, node in enumerate(t):
            nodes.add((h, d, node))
            parent[h, d, node] = t[d - 1] if d else None
            lab[h, d, node] += r is not None
            bad[h, d, node] += r is not None and verdict[r] == "block"
    pure = {}
    for h, d, node in sorted(nodes, key=lambda x: x[1]):
        if d == 0:
            pure[h, d, node] = bad[h, d, node] / (lab[h, d, node] + smoothing)
            continue
        sib = [x for x in nodes if x[0] == h and x[1] == d and parent[x] == parent[h, d, node]]
        al, ab = sum(lab[x] for x in sib), sum(bad[x] for x in sib)

        def apart(x):
            n, m = lab[x], al - lab[x]
            if not n or not m:
                return False
            share = ab / al
            spread = share * (1 - share) * (1 / n + 1 / m)
            return spread > 0 and abs(bad[x] / n - (ab - bad[x]) / m) > z * spread ** 0.5

        me = (h, d, node)
        group = [me] if apart(me) else [x for x in sib if not apart(x)]
        k, n = sum(bad[x] for x in group), sum(lab[x] for x in group)
        pure[me] = (k + smoothing * pure[h, d - 1, parent[me]]) / (n + smoothing)
    out = []
    for p, t, r in zip(parts, trail, rules):
        q = pure[p[0], len(t) - 1, t[-1]]
        out.append((*p, r, verdict[r] if r else "block" if q >= purity else "allow", t[-1], round(q, 6)))
    return out


def test_urls_equal_brute_force(spark):
    urls = [None, "", "no scheme/de/1", "http://", "HTTP://WWW.Example.COM/de/1?x#y", "x://a.org", "x://a.org/", "x://a.org?/q", "x://ÄB.org/é//z",
            "http://notexample.org/es/1", "http://example.org/es/1", "http://a.example.org/en/12", "http://a.example.org/en/2",
            "http://a.org/x?u=http://b.com/de/", "http://com/fr/a", "http://com/de"]
    urls += [f"https://shop.com/de/{i}" for i in range(40)] + [f"https://shop.com/es/{i}.html" for i in range(12)]
    urls += [f"https://bad.example.org/es/{i}/deep/{i % 3}" for i in range(30)] * 2 + ["https://bad.example.org/xx/1"] * 3
    urls += [f"https://net.net/p{i % 4}/{i}" for i in range(30)]
    df = spark.createDataFrame([(i, u, 5, 6) for i, u in enumerate(urls)], "page_id long, url string, host int, n int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 6)) for r in urltree.judge(df).collect()}
    want = dict(enumerate(brute_judge(urls)))
    assert got == want
    assert any(w[3] == "block" and w[2] is None for w in want.values())


def test_wildcards_do_not_follow_the_number_of_urls_or_the_depth(spark):
    for times in (1, 2, 6):
        urls = [f"https://h.net/es/{i}" for i in range(60)] * times + [f"https://h.net/{'a/' * 12}{i}/x/{'y' * i}" for i in range(20)] * times
        urls += ["https://h.net/main"] * 400 + [f"https://k.net/{s}" for s in "abcdefghijkl"] + ["https://k.net/a"] * 90
        df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        got = {r.page_id: r.template for r in urltree.judge(df).collect()}
        assert got == {i: t[4] for i, t in enumerate(brute_judge(urls))}
        assert got[0] == "/es/*" and got[60 * times].startswith("/a" * 12 + "/*/x")
        assert got[len(urls) - 1] == "/a"  # one child holds most, so segments are names


def test_a_long_and_deep_url(spark):
    urls = ["https://h.net/" + "/".join(f"s{i}" for i in range(5000)), "https://h.net/" + "q" * 500_000, "https://h.net/s0/s1/other"]
    got = {r.page_id: r.template for r in urltree.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got == {0: urls[0][13:], 1: urls[1][13:], 2: "/s0/s1/other"}


def test_urls_of_nothing(spark):
    assert urltree.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


# conversations ------------------------------------------------------------------------------------------------

PIECES = st.sampled_from([*chat.CONTROL, "\\", "<", "[", "a", "\n", "INST]", "é", "<\\s>", "[\\\\INST]", ""])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["user", "assistant", "system", None, "<s>", "assistant\n"]),
                          st.one_of(st.none(), st.lists(PIECES, max_size=8).map("".join))), min_size=1, max_size=12))
def test_chat_round_trip(spark, turns):
    df = spark.createDataFrame([(1, t, r, x, 0) for t, r, x in turns], "conv_id long, turn long, role string, text string, blocks int")
    row = chat.loss_text(chat.read_back(chat.format_chats(df))).collect()[0]
    plain = [(t, r or "", x or "") for t, r, x in turns]
    # rows of equal turn follow role, then text, as they are written
    got = [(t["role"], t["text"]) for t in row.turns]
    assert sorted(got) == sorted((r, x) for _, r, x in plain)
    if len({t for t, *_ in plain}) == len(plain):
        assert got == [(r, x) for _, r, x in sorted(plain)]
    assert row.loss_text == "".join(x for r, x in got if r == "assistant")


def test_chat_digests(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "assistant", None),
            (None, 0, None, "x"), (2, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = rows[0][3]
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\nassistant\n\n")
    assert got[1].loss_sha256 == sha(said) and got[1].loss_chars == len(said)
    assert got[None].turns_sha256 == sha("\nx\n") and got[2].loss_sha256 == sha("")
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_chat_output_has_only_its_own_controls(spark):
    df = spark.createDataFrame([(1, 0, "user", "".join(chat.CONTROL)), (1, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).collect()[0].formatted
    assert out.count(chat.START) == out.count(chat.BODY) == out.count(chat.END) == out.count(chat.SEP) == 1
    assert not [c for c in chat.CONTROL[4:] if c in out]


# archives -----------------------------------------------------------------------------------------------------

def archive(spark, rows):
    return spark.createDataFrame([(f, o, b, 0) for f, o, b in rows], "file long, offset long, record binary, node int")


def test_audit_finds_exactly_the_damage(spark):
    rng = np.random.default_rng(8)
    rows, at = [], 0
    for i in range(400):
        b = rng.bytes(int(rng.integers(0, 900)))
        rows.append((i % 3, at, b))
        at += len(b) + 1
    rows += [(None, 5, b"x"), (1, None, b"y"), (2, 7, None), (2, 7, None)]
    hurt = list(rows)
    hurt[17] = (*rows[17][:2], rows[17][2] + b"!")
    hurt[250] = (*rows[250][:2], b"")
    del hurt[399]
    hurt[-1] = (2, 7, b"z")
    hurt += [(9, 0, b"new file"), (0, 10 ** 9, b"behind the end")]
    a, b = merkle.hashed(archive(spark, rows)), merkle.hashed(archive(spark, hurt))
    got = {(r.file, r.offset, r.status) for r in merkle.audit(a, b, span=1024, fanout=4).collect()}
    want = {(*rows[17][:2], "changed"), (*rows[399][:2], "missing"), (2, 7, "changed"), (9, 0, "extra"), (0, 10 ** 9, "extra")}
    if rows[250][2]:
        want.add((*rows[250][:2], "changed"))
    assert got == want
    assert merkle.audit(a, a, span=1024).count() == 0
    empty = a.limit(0)
    assert merkle.audit(empty, empty).count() == 0
    assert merkle.audit(a, empty).where("status = 'missing'").count() == a.select("file", "offset").distinct().count()


def test_read_warc_plain_and_zipped(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>é\r\n\r\n</p>"), (2, None, None), (3, "u", "x" * 1000)], "page_id long, url string, html string")
    records = [bytes(r.record) for r in merkle.warc_records(pages).orderBy("page_id").collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(merkle.zipped, records)))
    got = merkle.read_warc(spark, f"file://{tmp_path}").orderBy("file", "offset").collect()
    assert [bytes(r.record) for r in got] == records * 2
    laid = [r.offset for r in merkle.laid_out(merkle.warc_records(pages)).orderBy("offset").collect()]
    assert laid == [r.offset for r in got[:3]]
    assert merkle.hashed(merkle.read_warc(spark, f"file://{tmp_path}").where(F.col("file") == "a.warc")).count() == 3
