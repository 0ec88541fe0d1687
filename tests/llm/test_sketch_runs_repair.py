import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tabloom.llm import convfix, periods, sketches
from tabloom.llm.common import table
from tabloom.llm.queries import op11_lookup_sketch, op12_periodic_runs, op13_repair

EMPTY = hashlib.sha256(b"").hexdigest()


# --- sketches ----------------------------------------------------------------------------

def _dice(a: bytes, b: bytes) -> float:
    keys, text = sketches.digests([a, b])
    one, two = (set(keys[text == i].tolist()) for i in (0, 1))
    return 2 * len(one & two) / (len(one) + len(two)) if one or two else 1.0


def _expected_edits(rows):
    """(id, text) rows in the operator's order, to the columns that need no sketch."""
    out = []
    for i, (doc, text) in enumerate(rows):
        after, n = rows[(i + 1) % len(rows)][1], len(text)
        edited = text[:n - n // 4] + after[:n // 4]
        out.append((doc, n, hashlib.sha256(edited.encode()).hexdigest(), _dice(text.encode(), edited.encode()),
                    _dice(text.encode(), after.encode())))
    return out


def _edits(rows):
    return [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in rows]


def test_edits_equal_brute_force_on_the_table(spark, sf):
    docs = table(spark, sf, "documents")
    got = op11_lookup_sketch(spark, sf).collect()
    want = _expected_edits(sorted((r["doc_id"], r["text"] or "") for r in docs.collect()))
    assert sorted(_edits(got)) == sorted(want)
    by_text = {}
    for r, name in zip(sorted(got, key=lambda r: r["doc_id"]), sorted((r["doc_id"], r["text"] or "") for r in docs.collect())):
        assert by_text.setdefault(name[1], r["fingerprint"]) == r["fingerprint"]
    assert len({*by_text.values()}) == len(by_text)
    assert np.median([r["near_edited"] for r in got]) > 0.6 > 0.2 > np.median([r["near_next"] for r in got])


@pytest.mark.parametrize("per_slot", [2, 5, 10_000])
def test_edits_of_odd_rows(spark, odd_docs, per_slot):
    got = sketches.with_edits(odd_docs, per_slot).collect()
    hashes = {r["text"]: r["h"] for r in odd_docs.selectExpr("coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()}
    rows = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]], r[1]))
    key = lambda r: (r[0] is not None, *map(str, r))
    assert sorted(_edits(got), key=key) == sorted(_expected_edits(rows), key=key)


def test_one_id_in_many_slots(spark):
    rows = [(7, f"text {i} of one id, word {i * i}") for i in range(300)] + [(i, f"own {i}") for i in range(8, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts, slots = sketches._slots(docs, 20)
    assert parts.groupBy("slot").count().agg({"count": "max"}).first()[0] < 60
    hashes = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    rows.sort(key=lambda r: (r[0], hashes[r[1]]))
    assert sorted(_edits(sketches.with_edits(docs, 20).collect())) == sorted(_expected_edits(rows))


def test_edits_of_one_and_no_document(spark, no_docs):
    assert sketches.with_edits(no_docs).collect() == []
    row = sketches.with_edits(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and row["near_next"] == 1.0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=60), min_size=2, max_size=8), st.integers(0, 3))
def test_peeling_recovers_differences(lists, seed):
    texts = [b"\n".join(b"line %d" % x for x in own) for own in lists]
    keys, text = sketches.digests(texts)
    pairs = np.array([(a, b) for a in range(len(texts)) for b in range(len(texts))])
    likeness, sides = sketches.compare(keys, text, len(texts), pairs)
    sets = [set(keys[text == i].tolist()) for i in range(len(texts))]
    for k, (a, b) in enumerate(pairs):
        assert set(sides[0][1][sides[0][0] == k].tolist()) == sets[a] - sets[b]
        assert set(sides[1][1][sides[1][0] == k].tolist()) == sets[b] - sets[a]
        assert likeness[k] == (2 * len(sets[a] & sets[b]) / (len(sets[a]) + len(sets[b])) if sets[a] or sets[b] else 1.0)


def test_versions_give_differing_digests(spark):
    long = "\n".join(f"line number {i}" for i in range(3000))
    rows = [(1, long, long.replace("line number 1500\n", "")), (2, None, ""), (3, "a b", None), (4, long, long)]
    got = {r["doc_id"]: r for r in sketches.differences(spark.createDataFrame(rows, "doc_id long, text string, other string")).collect()}
    assert got[1]["added"] == [] and 1 <= len(got[1]["removed"]) <= 3 and got[1]["likeness"] > 0.999
    assert got[2]["likeness"] == 1.0 and got[3]["likeness"] == 0.0
    assert got[4]["removed"] == got[4]["added"] == [] and got[4]["fingerprint"] == got[4]["other_fingerprint"]


# --- runs --------------------------------------------------------------------------------

def _runs(words):
    """Every run by trying every period: (start, length, period)."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if i > start and length >= max(6, 4 * q):
                own = words[start:start + length]
                if not any(own[p:] == own[:-p] for p in range(1, q)):
                    out.append((start, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _expected_runs(doc_id, text, planted):
    words = (text or "").encode().split()
    if planted and doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = _runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def _order(rows):
    return sorted(map(tuple, rows), key=str)


def test_runs_equal_brute_force_on_the_table(spark, sf):
    want = [_expected_runs(r["doc_id"], r["text"], True) for r in table(spark, sf, "documents").collect()]
    assert _order(op12_periodic_runs(spark, sf).collect()) == _order(want)
    assert sum(w[1] > 0 for w in want) >= 10


def test_runs_of_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    assert _order(periods.periodic_runs(odd_docs).collect()) == _order(_expected_runs(r["doc_id"], r["text"], False) for r in rows)
    assert periods.periodic_runs(no_docs).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 12)), min_size=1, max_size=6))
def test_runs_and_extensions(parts):
    texts = [b" ".join(b"%d" % x for x in unit * times).split() for unit, times in parts] + [[]]
    texts.append([w for t in texts for w in t])
    for words, got in zip(texts, periods.describe(texts)):
        want = _runs(words)
        assert got["n_runs"] == len(want)
        assert got["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
    row = np.array([x for k, t in enumerate(texts) for x in [*map(int, t), -1 - k]], np.int32)
    rng = np.random.default_rng(len(row))
    a, b = rng.integers(-1, len(row) + 1, (2, 40))
    a, b = a[a != b], b[a != b]
    lce = periods.Extensions(periods.grammar(row))
    for step in (1, -1):
        for x, y, n in zip(a, b, lce.extend(a, b, step > 0)):
            k = 0
            while 0 <= x < len(row) and 0 <= y < len(row) and row[x] == row[y]:
                x, y, k = x + step, y + step, k + 1
            assert k == n


def test_a_long_text_of_one_run():
    got = periods.describe([[b"a", b"b", b"c"] * 50_000 + [b"a"], [b"x"] * 200_000])
    assert [(g["n_runs"], g["start"], g["length"], g["period"]) for g in got] == [(1, 0, 150_001, 3), (1, 0, 200_000, 1)]
    assert [g["collapsed"] for g in got] == [b"a b c", b"x"]


# --- repair ------------------------------------------------------------------------------

def _cheapest(rows):
    """(cost, audit) by a table over suffixes: every way from every state, ties by the audit."""
    n, wanted = len(rows), {"": "u", "s": "u", "u": "a", "a": "u"}
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = None
    for i in range(n, -1, -1):
        own = {}
        for state in follows:
            ways = [(0, "")] if i == n and state in ("", "a") else []
            if i < n:
                letter, must, cut = rows[i]
                ways.append((2 + best[state][0], "D" + best[state][1]))
                if not must:
                    if letter and letter in follows[state]:
                        ways.append((5 * cut + best[letter][0], "K" + best[letter][1]))
                    to = wanted[state]
                    ways.append((1 + 5 * cut + best[to][0], "R" + best[to][1]))
            own[state] = min(ways, default=(10 ** 9, ""))
        for _ in range(3):
            own = {s: min(own[s], (5 + own[wanted[s]][0], "I" + own[wanted[s]][1])) for s in own}
        best = own
    return best[""]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["", "s", "u", "a"]), st.booleans(), st.booleans()), max_size=14))
def test_repairs_are_cheapest_and_least(rows):
    rows = [(letter, must, cut and not must) for letter, must, cut in rows]
    lattice = convfix.Lattice(bytes(" sua".index(r[0] or " ") for r in rows), bytes(r[1] for r in rows), bytes(r[2] for r in rows))
    assert lattice.cheapest() == _cheapest(rows)


def test_a_long_conversation():
    rng = random.Random(5)
    rows = [(rng.choice("suax").replace("x", ""), rng.random() < 0.1, False) for _ in range(3000)]
    lattice = convfix.Lattice(bytes(" sua".index(r[0] or " ") for r in rows), bytes(r[1] for r in rows), bytes(3000))
    assert lattice.cheapest() == _cheapest(rows)


def _expected_repairs(conversations, digest):
    """Every column for rows (conv_id, turn, role, text) after damage."""
    out, by = [], {}
    for conv, turn, role, text in conversations:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r[1], r[2])))
        seen, faults = set(), []
        for _, role, text in rows:
            last = text.strip(" \t\n\x0b\x0c\r")[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
            seen.add((role, text))
        turns = {r[0] for r in rows} - {None}
        letters = [r[1][:1] for r in rows]
        cost, audit = _cheapest([(x if x in "sua" else "", f in ("blank", "duplicate"), f == "truncated") for x, f in zip(letters, faults)])
        fixed, at, before = [], 0, ""
        for edit in audit:
            want = "assistant" if before.startswith("u") else "user"
            if edit == "I":
                fixed.append((want, ""))
            else:
                _, role, text = rows[at]
                at += 1
                if edit != "D":
                    fixed.append((role if edit == "K" else want, text))
            before = fixed[-1][0] if fixed else ""
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                    faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])), cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()))
    return out


def _digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_repairs_on_the_table(spark, sf):
    rows = []
    for conv, turn, role, text in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect():
        fault = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = {1: "", 2: text.translate(str.maketrans("", "", ".!?"))}.get(fault, text)
        rows += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    want = {r[0]: r for r in _expected_repairs(rows, _digest)}
    got = op13_repair(spark, sf).select(*COLUMNS).collect()
    every = {r[0] for r in table(spark, sf, "conversations").select("conv_id").collect()}
    assert {r["conv_id"] for r in got} == every and len(got) == len(every)
    for r in got:
        assert tuple(r) == want.get(r["conv_id"], (r["conv_id"], 0, 0, 0, 0, 0, 0, "", EMPTY))


@pytest.fixture(scope="module")
def odd_turns(spark):
    rng = random.Random(2)
    says = ["Yes.", "No!", "", None, " \n", "cut", "A longer answer.", "x" * 50_000 + "."]
    rows = [(rng.choice([1, 2, 3, 4, None]), rng.choice([0, 1, 2, 3, 5, None]), rng.choice(["user", "assistant", "system", "tool", "", None]),
             rng.choice(says), 9, "x") for _ in range(150)]
    rows += [(8, None, "user", "Hi.", 9, "x"), (8, None, "assistant", "Ho.", 9, "x"), (9, 1, "user", "", 9, "x")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost long, audit string")


def test_repairs_of_odd_rows(spark, odd_turns):
    rows = [tuple(r)[:4] for r in odd_turns.collect()]
    got = convfix.report(odd_turns, odd_turns).select(*COLUMNS).collect()
    assert _order(got) == _order(_expected_repairs(rows, _digest))
    told = {r["conv_id"]: r for r in got}
    assert told[8]["gaps"] == 0 and told[9]["audit"] == "D" and told[9]["repaired_sha256"] == EMPTY
    fixed = convfix.repaired(odd_turns, convfix.audits(odd_turns)).collect()
    for conv, r in told.items():
        own = sorted((f for f in fixed if f["conv_id"] == conv), key=lambda f: f["position"])
        assert hashlib.sha256("\n".join(f"{f['role']}:{f['text']}" for f in own).encode()).hexdigest() == r["repaired_sha256"]
        letters = "".join(f["role"][:1] for f in own).removeprefix("s")
        assert letters == "ua" * (len(letters) // 2) and (letters or not own)


def test_damage_and_no_conversations(spark, odd_turns):
    none = odd_turns.limit(0)
    assert convfix.report(none, convfix.damage(none)).collect() == []
    whole = convfix.report(odd_turns, convfix.damage(odd_turns))
    assert {r["conv_id"] for r in whole.collect()} == {r[0] for r in odd_turns.select("conv_id").collect()}
    lost = convfix.report(odd_turns, odd_turns.where("conv_id = 1")).where("conv_id = 2").first()
    assert (lost["cost"], lost["audit"], lost["repaired_sha256"]) == (0, "", EMPTY)
