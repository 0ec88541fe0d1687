"""Conversation structure repair: the cheapest edits, found by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows read, state), where the state is what the repaired roles end in so far: nothing, the
system row, a user row, an assistant row. Edges are the edits: Keep, Rerole and Delete read a row, Insert reads none.
From a node every edit leads to one node only, since the wanted roles are `(s?(ua)+)?`; so an audit, the string of
edit initials, names one path. A forward and a reverse heap grow from both ends, until their tops together exceed the
best meeting, so that every crossing of equal cost is finished. Edges on cheapest paths are then walked from the start,
always along the least initial that still reaches a crossing; this gives the ASCII-least audit in linear time.

Two shuffles by conversation. The first carries facts (a role's initial, blank and cut flags, a 256-bit digest of role
and text), sorted in each partition and read as a stream; it gives one row per conversation with its audit. The
second sends the audit ahead of the conversation's rows, again sorted, so that the rows are edited or hashed while they
pass. No task holds the texts of a conversation; it holds some hundred bytes per row of one conversation. One
conversation is read by one task, because its edits and its hash depend on each other in order.

Defined cases: a null role or text is one space; null turns come first; rows of equal turn go by role, then
digest, so repeated rows are neighbours; null conv_id is a conversation of its own; an empty text is blank; texts of
any length are read whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ready

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Sentence ends that a complete row closes with.
ENDS = ".!?"
NONE, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
_NEXT = (USER, USER, ASSISTANT, USER)                 # the role wanted after a state
_BEFORE = ((), (NONE,), (NONE, SYSTEM, ASSISTANT), (USER,))
_FAR = 1 << 60


class Lattice:
    """Rows as three byte strings: initial (a state, 0 if it is none of s, u, a), must go, cut short."""

    def __init__(self, initial: bytes, must: bytes, cut: bytes):
        self.initial, self.must, self.cut, self.n = initial, must, cut, len(initial)

    def after(self, node: int) -> Iterator[tuple[str, int, int]]:
        """(initial, node, cost) of the edits that leave a node, in ascending order of the initial."""
        i, state = divmod(node, 4)
        if i < self.n:
            yield "D", node + 4, DELETE
        yield "I", 4 * i + _NEXT[state], INSERT
        if i < self.n and not self.must[i]:
            extra, role = CUT * self.cut[i], self.initial[i]
            if role and state in _BEFORE[role]:
                yield "K", 4 * i + 4 + role, KEEP + extra
            yield "R", 4 * i + 4 + _NEXT[state], REROLE + extra

    def before(self, node: int) -> Iterator[tuple[int, int]]:
        """(node, cost) of the edits that lead to a node."""
        i, state = divmod(node, 4)
        if i:
            yield node - 4, DELETE
        for s in _BEFORE[state]:
            if state != SYSTEM:
                yield 4 * i + s, INSERT
            if i and not self.must[i - 1]:
                extra = CUT * self.cut[i - 1]
                if self.initial[i - 1] == state:
                    yield 4 * i - 4 + s, KEEP + extra
                if state != SYSTEM:
                    yield 4 * i - 4 + s, REROLE + extra

    def search(self) -> tuple[list[int], list[int], int, int]:
        """Distances from the start and to the ends, the reach of the forward search, and the least cost."""
        size = 4 * self.n + 4
        ends = (size - 4 + NONE, size - 4 + ASSISTANT)
        there, back = [_FAR] * size, [_FAR] * size
        there[0] = 0
        ahead, behind = [(0, 0)], [(0, e) for e in ends]
        for e in ends:
            back[e] = 0
        best = back[0]
        while True:
            for heap, dist in ((ahead, there), (behind, back)):
                while heap and heap[0][0] > dist[heap[0][1]]:
                    heapq.heappop(heap)
            top, low = (h[0][0] if h else _FAR for h in (ahead, behind))
            if top + low > best:
                return there, back, top, best
            forward = top <= low
            heap, dist, other = (ahead, there, back) if forward else (behind, back, there)
            d, u = heapq.heappop(heap)
            steps = ((v, w) for _, v, w in self.after(u)) if forward else self.before(u)
            for v, w in steps:
                if d + w < dist[v]:
                    dist[v] = d + w
                    heapq.heappush(heap, (d + w, v))
                best = min(best, d + w + other[v])

    def cheapest(self) -> tuple[int, str]:
        """The least cost and its ASCII-least audit."""
        there, back, reach, best = self.search()
        last = {4 * self.n + NONE, 4 * self.n + ASSISTANT}

        def crosses(u: int, v: int, w: int) -> bool:
            return there[v] >= reach and there[u] + w + back[v] == best

        # nodes of the forward side from which a crossing, or an end, is reached at the least cost
        todo = [u for u in range(len(there)) if there[u] < reach and (
            (u in last and there[u] == best) or any(crosses(u, v, w) for _, v, w in self.after(u)))]
        good = set(todo)
        while todo:
            v = todo.pop()
            for u, w in self.before(v):
                if u not in good and there[u] + w == there[v]:
                    good.add(u)
                    todo.append(u)
        node, audit = 0, []
        while node in good and not (node in last and there[node] == best):
            for edit, v, w in self.after(node):
                if (v in good and there[node] + w == there[v]) or crosses(node, v, w):
                    break
            audit.append(edit)
            node = v
        while node not in good and not (node in last and back[node] == 0):
            edit, node = next((e, v) for e, v, w in self.after(node) if back[node] == w + back[v])
            audit.append(edit)
        return best, "".join(audit)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of `conversations` rows with faults planted by crc32 of `conv_id:turn`."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                    F.coalesce(F.col("turn").cast("string"), blank))
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    told = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("fault"))
    times = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return told.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(1), times)).alias("once")).drop("once")


ORDER = ("conv_id", "kind", "turn", "role", "digest")  # nulls come first


def _facts(rows: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    told = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", blank).alias("role"),
                       F.coalesce("text", blank).alias("text"))
    name = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return told.withColumn("digest", F.unhex(F.sha2(name, 256))).withColumn("kind", F.lit(1))


def _stripped(text: Column) -> Column:
    return F.rtrim(text, F.lit(" " + BLANKS))


def _groups(batches, names: tuple[str, ...]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """(conv_id, its rows as a stream) of batches sorted by conv_id; each stream is to be read to its end."""
    from itertools import groupby

    rows = (row for b in batches for row in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names)))
    yield from groupby(rows, key=lambda r: r[0])


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit."""
    kinds = {"": NONE, "s": SYSTEM, "u": USER, "a": ASSISTANT}

    def run(batches):
        import pyarrow as pa

        out = []
        for conv, stream in _groups(batches, ("conv_id", "turn", "initial", "digest", "blank", "cut")):
            initial, must, cut, seen = bytearray(), bytearray(), bytearray(), set()
            low = high = before = None
            turns = blank = double = short = illegal = 0
            for _, turn, letter, digest, is_blank, is_cut in stream:
                if turn is not None and turn != high:
                    low, high, turns = turn if low is None else low, turn, turns + 1
                again = digest in seen
                seen.add(digest)
                blank += is_blank
                double += again and not is_blank
                is_cut = is_cut and not again and not is_blank
                short += is_cut
                illegal += before is not None and before + letter not in ("su", "ua", "au")
                before = letter
                initial.append(kinds.get(letter, NONE))
                must.append(is_blank or again)
                cut.append(is_cut)
            cost, audit = Lattice(bytes(initial), bytes(must), bytes(cut)).cheapest()
            out.append((conv, high - low + 1 - turns if turns else 0, blank, double, short, illegal, cost, audit))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
                out = []
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    import pyarrow as pa

    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in counts), ("audit", pa.string())])
    stripped = _stripped(F.col("text"))
    told = _facts(rows).select(
        "conv_id", "kind", "turn", "role", F.substring("role", 1, 1).alias("initial"), "digest", (stripped == "").alias("blank"),
        ((stripped != "") & ~F.substring(stripped, -1, 1).isin(*ENDS)).alias("cut"))
    ready(rows.sparkSession)
    return told.repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(
        run, "conv_id long, " + ", ".join(f"{c} long" for c in counts) + ", audit string")


def _edited(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each repaired row."""
    state = NONE
    for edit in audit:
        if edit == "I":
            state = _NEXT[state]
            yield edit, NAMES[state], ""
            continue
        role, text = next(rows)
        if edit == "R":
            state = _NEXT[state]
            yield edit, NAMES[state], text
        elif edit == "K":
            state = SYSTEM if role[0] == "s" else _NEXT[state]
            yield edit, role, text


def _behind(rows: DataFrame, told: DataFrame) -> DataFrame:
    """Each conversation's audit ahead of its rows, in partitions by conversation."""
    ahead = told.withColumn("kind", F.lit(0))
    both = ahead.unionByName(_facts(rows), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(*ORDER)


def repaired(rows: DataFrame, told: DataFrame) -> DataFrame:
    """conv_id, position (from 0), edit, role, text of every repaired row. `told` is audits(rows)."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()),
                            ("text", pa.string())])
        out, held = [], 0
        for conv, stream in _groups(batches, ("conv_id", "audit", "role", "text")):
            audit = next(stream)[1]
            for at, (edit, role, text) in enumerate(_edited(((r[2], r[3]) for r in stream), audit)):
                out.append({"conv_id": conv, "position": at, "edit": edit, "role": role, "text": text})
                held += len(text)
                if len(out) >= 4096 or held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, schema)

    ready(rows.sparkSession)
    return _behind(rows, told).select("conv_id", "audit", "role", "text").mapInArrow(
        run, "conv_id long, position long, edit string, role string, text string")


def digests(rows: DataFrame, told: DataFrame) -> DataFrame:
    """`told` with repaired_sha256: of the repaired `role:text`, joined by newlines, hashed as the rows pass."""
    names = [c for c in told.columns if c != "conv_id"]
    kinds = dict(told.dtypes)

    def run(batches):
        import hashlib

        import pyarrow as pa

        spare = []
        for conv, stream in _groups(batches, ("conv_id", *names, "role", "text")):
            head = next(stream)
            facts = dict(zip(("conv_id", *names), head))
            own, first = hashlib.sha256(), True
            for _, role, text in _edited((r[-2:] for r in stream), facts["audit"]):
                own.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False
            spare.append(facts | {"repaired_sha256": own.hexdigest()})
            if len(spare) >= 4096:
                yield pa.RecordBatch.from_pylist(spare, schema)
                spare = []
        yield pa.RecordBatch.from_pylist(spare, schema)

    import pyarrow as pa

    schema = pa.schema([("conv_id", pa.int64()), *((n, pa.string() if kinds[n] == "string" else pa.int64()) for n in names),
                        ("repaired_sha256", pa.string())])
    ready(rows.sparkSession)
    return _behind(rows, told).select("conv_id", *names, "role", "text").mapInArrow(
        run, "conv_id long, " + ", ".join(f"{n} {kinds[n]}" for n in names) + ", repaired_sha256 string")


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """digests() of `rows`, with a row of zeros for each conversation of `conversations` that `rows` has lost."""
    found = digests(rows, audits(rows)).withColumnRenamed("conv_id", "own")
    every = conversations.select(F.col("conv_id").cast("long")).distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left").drop("own")
    nothing = {c: F.lit(0).cast("long") for c, kind in joined.dtypes if kind == "bigint" and c != "conv_id"}
    nothing |= {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return joined.select("conv_id", *[F.coalesce(c, e).alias(c) for c, e in nothing.items()])


#: crc32 by its rule: eight shifts for each byte.
_CRC = """xor(4294967295::bigint, list_reduce(
    list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def crc32_sql(text: str) -> str:
    """crc32 of an ASCII string that is not empty, in DuckDB."""
    return _CRC.format(text=text)


def _state_sql(state: int) -> str:
    """The cheapest way from a state before row f to the end, without an insert before that row."""
    def step(cost: str, letter: str, to: int, line: str) -> str:
        return (f"{{'cost': s{to}.cost + {cost}, 'audit': '{letter}' || s{to}.audit, "
                f"'body': {line + f' || s{to}.body' if line else f's{to}.body'}}}")

    ways = [step(str(DELETE), "D", state, "")]
    for role in (SYSTEM, USER, ASSISTANT):
        if state in _BEFORE[role]:
            ways.append(f"CASE WHEN NOT must AND initial = '{' sua'[role]}' THEN "
                        + step(f"{CUT} * cut", "K", role, "chr(10) || role || ':' || text") + " END")
    to = _NEXT[state]
    ways.append("CASE WHEN NOT must THEN " + step(f"{REROLE} + {CUT} * cut", "R", to, f"chr(10) || '{NAMES[to]}:' || text") + " END")
    return f"list_sort([{', '.join(ways)}], 'ASC', 'NULLS LAST')[1]"


def repair_sql() -> str:
    """The query's rows in DuckDB: a recursion over rows, last to first, holding the best way from each state."""
    def inserted(state: int, base: str) -> str:
        to = _NEXT[state]
        return (f"list_sort([{base}{state}, {{'cost': {base}{to}.cost + {INSERT}, 'audit': 'I' || {base}{to}.audit, "
                f"'body': chr(10) || '{NAMES[to]}:' || {base}{to}.body}}])[1]")

    name = "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"
    order = "turn NULLS FIRST, role, sha256(length(role)::varchar || ':' || role || text), once"
    end, far = "{'cost': 0::bigint, 'audit': '', 'body': ''}", f"{{'cost': {1 << 40}::bigint, 'audit': '', 'body': ''}}"
    return f"""
WITH RECURSIVE own AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(name)} % 20 AS fault FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS once FROM own),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY {order}) AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
         left(role, 1) AS initial, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY {order}) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS open FROM damaged),
facts AS (
  SELECT *, blank OR again AS must, (open AND NOT blank AND NOT again)::bigint AS cut,
         coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial NOT IN ('su', 'ua', 'au'), false) AS odd FROM seen),
ways AS (
  SELECT conv_id, n + 1 AS pos, {end} AS s0, {{'cost': {2 * INSERT}::bigint, 'audit': 'II', 'body': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s1,
         {{'cost': {INSERT}::bigint, 'audit': 'I', 'body': chr(10) || 'assistant:'}} AS s2, {end} AS s3 FROM (SELECT DISTINCT conv_id, n FROM facts)
  UNION ALL
  SELECT conv_id, pos, {', '.join(f"{inserted(s, 'v')} AS s{s}" for s in (0, 1))}, v2 AS s2, v3 AS s3 FROM (
    SELECT conv_id, pos, b0 AS v0, b1 AS v1, {inserted(2, 'b')} AS v2, {inserted(3, 'b')} AS v3 FROM (
      SELECT w.conv_id, f.pos, {', '.join(f"{_state_sql(s)} AS b{s}" for s in range(4))}
      FROM ways w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos - 1))),
best AS (SELECT conv_id, s0.cost AS cost, s0.audit AS audit, sha256(substr(s0.body, 2)) AS repaired_sha256 FROM ways WHERE pos = 1),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::int) AS blank,
         sum((again AND NOT blank)::int) AS duplicate, sum(cut) AS truncated, sum(odd::int) AS illegal FROM facts GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate,
       coalesce(truncated, 0)::bigint AS truncated, coalesce(illegal, 0)::bigint AS illegal, coalesce(cost, 0)::bigint AS cost,
       coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id"""
