"""Nearest neighbours by inner product on robust-pruned directed graphs, one per shard.

Distinct vectors are dealt by digest into shards of a bounded size. In each shard a graph is built in
batches: a greedy beam search over the graph so far proposes neighbours for each point, relaxed distance
pruning keeps those that no kept neighbour is much closer to (so the edges point in diverse directions),
and reverse edges are added and pruned alike. Two passes are made, the second with relaxation. A vector is extended
by one component that gives all vectors of a shard the same norm; nearest by distance is then nearest by
inner product. Queries travel in blocks to every shard, where a beam search collects candidates; their
inner products are computed anew in double precision on the original vectors, and the best are kept per
query over all shards.

Equal vectors are one node. A node carries its k + 1 smallest ids, which is all that a list of k without
the query's own id can need, so a vector that a third of all rows share is neither a hot node nor a loss.

Defined cases: vectors that are null, zero, hold null or non-finite components, or have another length than most,
take no part, nor do null ids; rows with the same id and vector count once; ties go to the smaller id; fewer
candidates than k are all returned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.scratch import settle

from .common import ready

NONE = np.float32(-np.inf)


class Graph:
    """Vectors of equal norm with at most `degree` out-edges each; a missing edge points to the row behind."""

    def __init__(self, vectors: np.ndarray, degree: int, start: int | None = None, edges: np.ndarray | None = None):
        self.n, self.degree = len(vectors), degree
        self.rows = np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)]).astype(np.float32)
        self.edges = np.full((self.n, degree), self.n, np.int32) if edges is None else edges
        self.start = int(np.argmax(self.rows[:-1] @ vectors.mean(0))) if start is None else start

    def search(self, queries: np.ndarray, beam: int, wide: int = 4):
        """The beam of each query, best first: node numbers (n where there is none) and inner products."""
        m = len(queries)
        seen = np.zeros((m, self.n + 1), bool)
        seen[:, self.n] = seen[:, self.start] = True
        ids = np.full((m, beam), self.n, np.int32)
        score = np.full((m, beam), NONE, np.float32)
        done = np.ones((m, beam), bool)
        ids[:, 0], score[:, 0], done[:, 0] = self.start, queries @ self.rows[self.start], False
        while True:
            live = np.nonzero(~done.all(1))[0]
            if not len(live):
                return ids, score
            # the best entries that are not expanded yet; the beam is kept sorted
            pick = np.argsort(done[live], axis=1, kind="stable")[:, :wide]
            fresh = ~np.take_along_axis(done[live], pick, 1)
            node = np.where(fresh, np.take_along_axis(ids[live], pick, 1), self.n)
            state = done[live]
            np.put_along_axis(state, pick, True, 1)
            done[live] = state
            ring = np.vstack([self.edges, np.full((1, self.degree), self.n, np.int32)])[node].reshape(len(live), -1)
            ring = np.sort(ring, axis=1)
            new = ~seen[live[:, None], ring]
            new[:, 1:] &= ring[:, 1:] != ring[:, :-1]
            ring = np.where(new, ring, self.n)
            seen[live[:, None], ring] = True
            most = int(new.sum(1).max())
            if most == 0:
                continue
            ring = np.take_along_axis(ring, np.argsort(~new, axis=1, kind="stable")[:, :most], 1)
            near = np.matmul(self.rows[ring], queries[live][:, :, None])[:, :, 0]
            near[ring == self.n] = NONE
            all_score = np.concatenate([score[live], near], 1)
            best = np.argsort(-all_score, axis=1, kind="stable")[:, :beam]
            score[live] = np.take_along_axis(all_score, best, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], ring], 1), best, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ring == self.n], 1), best, 1)

    def prune(self, points: np.ndarray, candidates: np.ndarray, relax: float, step: int = 256) -> np.ndarray:
        """Out-edges for the points: nearest first, each dropping what it is `relax` times closer to."""
        out = np.full((len(points), self.degree), self.n, np.int32)
        for at in range(0, len(points), step):
            p, c = points[at:at + step], np.sort(candidates[at:at + step], axis=1)
            c[:, 1:][c[:, 1:] == c[:, :-1]] = self.n
            c[c == p[:, None]] = self.n
            v = self.rows[c]
            norm = float(self.rows[p[0]] @ self.rows[p[0]]) if len(p) else 0.0
            far = 2 * (norm - np.matmul(v, self.rows[p][:, :, None])[:, :, 0])
            far[c == self.n] = np.inf
            order = np.argsort(far, axis=1, kind="stable")
            c, far, v = np.take_along_axis(c, order, 1), np.take_along_axis(far, order, 1), v[np.arange(len(p))[:, None], order]
            between = 2 * (norm - np.matmul(v, v.transpose(0, 2, 1)))
            alive, row = np.isfinite(far), np.arange(len(p))
            for k in range(self.degree):
                first = alive.argmax(1)
                some = alive[row, first]
                if not some.any():
                    break
                out[at:at + step][some, k] = c[row, first][some]
                drop = relax * relax * between[row, first] <= far
                alive &= ~(drop & some[:, None])
                alive[row, first] = False
        return out

    def build(self, beam: int, relax: float, batch: int = 512, seed: int = 5) -> "Graph":
        rng = np.random.default_rng(seed)
        for alpha in (1.0, relax):
            order = rng.permutation(self.n)
            size = 1 if alpha == 1.0 else batch
            at = 0
            while at < self.n:
                own = order[at:at + size]
                at += size
                size = min(batch, 2 * size)  # a young graph takes few points at a time
                found, _ = self.search(self.rows[own], beam)
                self.edges[own] = self.prune(own, np.concatenate([found, self.edges[own]], 1), alpha)
                self._reverse(own, alpha)
        return self

    def _reverse(self, own: np.ndarray, alpha: float) -> None:
        target, source = self.edges[own].ravel(), np.repeat(own, self.degree)
        source, target = source[target < self.n], target[target < self.n]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        while len(target):
            # up to `degree` new edges of each target at a time
            first = np.searchsorted(target, target)
            place = np.arange(len(target)) - first
            now = place < self.degree
            node, row = np.unique(target[now], return_inverse=True)
            extra = np.full((len(node), self.degree), self.n, np.int32)
            extra[row, place[now]] = source[now]
            both = np.sort(np.concatenate([self.edges[node], extra], 1), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = self.n
            both.sort(axis=1)
            full = (both < self.n).sum(1) > self.degree
            self.edges[node[~full]] = both[~full, :self.degree]
            if full.any():
                self.edges[node[full]] = self.prune(node[full], both[full], alpha)
            source, target = source[~now], target[~now]


def level(vectors: np.ndarray) -> np.ndarray:
    """Vectors extended to equal norm."""
    sq = (vectors.astype(np.float64) ** 2).sum(1)
    return np.concatenate([vectors, np.sqrt(np.maximum(sq.max() - sq, 0))[:, None]], 1).astype(np.float32)


def usable(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id and v (array<float>) of the rows that take part."""
    v = F.col(column)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).where(sound).select(
        F.col(id_col).cast("long").alias("id"), v.cast("array<float>").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["d"] if sizes else 0))


def build_index(rows: DataFrame, k: int, shard_rows: int = 4096, degree: int = 32, beam: int = 64,
                relax: float = 1.2) -> tuple[DataFrame, int]:
    """One row per shard: its vectors, their ids and its graph. `rows` has id and v."""
    # a limit on ranks is applied before the shuffle, so a frequent vector sends k + 1 ids per task
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("at") <= k + 1)
    nodes = settle(ranked.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")), "ann-nodes")
    shards = max(1, -(-nodes.count() // shard_rows))

    def one(table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks()
        x = v.values.to_numpy(zero_copy_only=False).reshape(len(table), -1).astype(np.float32)
        order = np.lexsort(x.T[::-1])  # the graph shall not depend on the order of arrival
        x = x[order]
        ids = table.column("ids").combine_chunks().take(pa.array(order))
        g = Graph(level(x), min(degree, max(1, len(x) - 1)))
        g.build(beam, relax)
        counts = np.diff(ids.offsets.to_numpy()).astype(np.int32)
        return pa.table({
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "dim": pa.array([x.shape[1]], pa.int32()),
            "degree": pa.array([g.degree], pa.int32()), "start": pa.array([g.start], pa.int32()),
            "vectors": [x.tobytes()], "edges": [g.edges.tobytes()], "counts": [counts.tobytes()],
            "ids": [ids.flatten().to_numpy().astype(np.int64).tobytes()]})

    ready(rows.sparkSession)
    schema = ("shard int, dim int, degree int, start int, vectors binary, edges binary, counts binary, ids binary")
    index = (nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
             .groupBy("shard").applyInArrow(one, schema))
    return settle(index, "ann-index"), shards


def search(index: DataFrame, shards: int, queries: DataFrame, k: int, beam: int = 96, block: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query but its own id. `queries` has id and v."""
    blocks = max(1, -(-queries.count() // block))
    asked = (queries.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
             .agg(F.sort_array(F.collect_set(F.struct("id", "v"))).alias("asked"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["vectors"], np.float32).reshape(-1, r["dim"])
                counts, ids = np.frombuffer(r["counts"], np.int32), np.frombuffer(r["ids"], np.int64)
                g = Graph(level(x), r["degree"], r["start"], np.frombuffer(r["edges"], np.int32).reshape(len(x), -1))
                first = np.cumsum(counts) - counts
                qid = np.array([a["id"] for a in r["asked"]], np.int64)
                q = np.array([a["v"] for a in r["asked"]], np.float32)
                out = []
                for at in range(0, len(q), block):
                    own = q[at:at + block]
                    found, _ = g.search(np.concatenate([own, np.zeros((len(own), 1), np.float32)], 1), max(beam, k + 1))
                    who, col = np.nonzero(found < len(x))
                    node = found[who, col]
                    score = np.einsum("ij,ij->i", own[who].astype(np.float64), x[node].astype(np.float64))
                    n = counts[node]
                    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    vec = ids[np.repeat(first[node], n) + place]
                    who, score = np.repeat(who, n), np.repeat(score, n)
                    other = vec != qid[at + who]
                    who, score, vec = who[other], score[other], vec[other]
                    order = np.lexsort((vec, -score, who))
                    who, score, vec = who[order], score[order], vec[order]
                    top = np.arange(len(who)) - np.searchsorted(who, who) < k
                    out.append((qid[at + who[top]], vec[top], score[top]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)],
                                                     names=["query_id", "vec_id", "score"])

    ready(queries.sparkSession)
    found = asked.join(index, "shard").mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, shard_rows: int = 4096, degree: int = 32,
            beam: int = 96) -> DataFrame:
    """Queries are the rows whose id is divisible by `every`; candidates are all rows but the query's own."""
    rows = settle(usable(vectors), "ann-vectors")
    index, shards = build_index(rows, k, shard_rows, degree)
    return search(index, shards, rows.where(F.pmod("id", F.lit(every)) == 0), k, beam)
