"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are laid out in blocks of 256; two neighbouring blocks make a chunk, so chunks overlap
by half and cover the whole document. Learned filters over 6 bytes respond at every position, their largest
response counts per chunk, and a document is described by each filter's maximum and mean over its chunks. A
logistic layer makes one probability of that. Filters, biases and the last layer are trained together
by Adam; the gradient of a maximum goes to the position that won.

Training takes at most `per_class` labelled documents of each class, the first by a digest of their id, and
weighs them back to the classes' true shares. The fitted weights (about 100 kB, whatever the input) go to
the tasks; scoring is one pass over the documents with no shuffle.

Defined cases: a null or empty text is one block of padding and gets that block's score; repeated rows
get equal scores; a label that is null or conflicts is dropped or taken at its minimum; without labels of both
classes every score is the share of label 1 (0.5 if there are none); an empty table gives an empty
result; further columns are ignored; a null doc_id counts as empty text for the hold-out rule.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, slices

WIDTH, BLOCK = 6, 256


@dataclass
class TextCNN:
    filters: np.ndarray    # (WIDTH, 256, n) float32: response of byte b at place j
    bias: np.ndarray       # (n,)
    out: np.ndarray        # (2 n,) for maxima, then means
    shift: float

    def pair_tables(self) -> list[np.ndarray]:
        """Responses of two neighbouring bytes together, so that a position costs WIDTH / 2 look-ups."""
        w = self.filters
        return [(w[j][:, None, :] + w[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, WIDTH, 2)]


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (rows of BLOCK + WIDTH - 1 bytes, each running into the next) and how many each text has."""
    counts = np.array([max(1, -(-len(t) // BLOCK)) for t in texts], np.int64)
    ends = np.cumsum(counts)
    flat = np.zeros(int(ends[-1]) * BLOCK if len(texts) else 0, np.uint8)
    for t, end, n in zip(texts, ends, counts):
        at = int(end - n) * BLOCK
        flat[at:at + len(t)] = np.frombuffer(t, np.uint8)
    body = flat.reshape(-1, BLOCK)
    tail = np.zeros((len(body), WIDTH - 1), np.uint8)
    tail[:-1] = body[1:, :WIDTH - 1]
    tail[ends - 1] = 0  # the next text does not reach into the last block
    return np.concatenate([body, tail], 1), counts


def respond(blocks: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """(blocks, BLOCK, filters) responses, bias not included."""
    pairs = (blocks[:, :-1].astype(np.uint16) << 8) | blocks[:, 1:]
    out = tables[0][pairs[:, :BLOCK]]
    for k, t in enumerate(tables[1:], 1):
        out += t[pairs[:, 2 * k:2 * k + BLOCK]]
    return out


def chunk_rows(counts: np.ndarray):
    """For each chunk its first block, its second (the same for a lone block), and its text."""
    chunks = np.maximum(counts - 1, 1)
    text = np.repeat(np.arange(len(counts)), chunks)
    place = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    first = np.repeat(np.cumsum(counts) - counts, chunks) + place
    return first, first + (np.repeat(counts, chunks) > 1), text, chunks


def pooled(peaks: np.ndarray, counts: np.ndarray):
    """Per text the maxima and means over its chunks, and per chunk its value and winning block."""
    first, second, text, chunks = chunk_rows(counts)
    a, b = peaks[first], peaks[second]
    values = np.maximum(a, b)
    starts = np.cumsum(chunks) - chunks
    return (np.maximum.reduceat(values, starts, axis=0), np.add.reduceat(values, starts, axis=0) / chunks[:, None],
            values, np.where(a >= b, first[:, None], second[:, None]), text, chunks)


def probabilities(model: TextCNN, texts: list[bytes], tables=None, step: int = 512) -> np.ndarray:
    tables = tables or model.pair_tables()
    if not texts:
        return np.empty(0)
    blocks, counts = layout(texts)
    peaks = np.concatenate([respond(blocks[i:i + step], tables).max(1) for i in range(0, len(blocks), step)])
    top, mean, *_ = pooled(np.maximum(peaks + model.bias, 0), counts)
    z = np.concatenate([top, mean], 1) @ model.out + model.shift
    return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, n_filters: int = 16, epochs: int = 10,
          batch: int = 64, rate: float = 0.01, least_steps: int = 400, seed: int = 7) -> TextCNN:
    """Weighted logistic loss; small samples are gone through more often, until `least_steps` steps."""
    rng = np.random.default_rng(seed)
    model = TextCNN(rng.normal(0, 0.1, (WIDTH, 256, n_filters)).astype(np.float32), np.zeros(n_filters, np.float32),
                    rng.normal(0, 0.1, 2 * n_filters).astype(np.float32), 0.0)
    state: dict[str, list] = {}

    def adam(name, value, grad, t):
        m, v = state.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        pace = rate * 0.5 * (1 + np.cos(np.pi * min(1.0, t / total)))
        return (value - pace * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-7)).astype(value.dtype)

    rounds = max(1, -(-len(texts) // batch))
    epochs = max(epochs, -(-least_steps // rounds))
    total, t = epochs * rounds, 0
    shift = np.zeros(1, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            own = order[at:at + batch]
            t += 1
            blocks, counts = layout([texts[i] for i in own])
            tables, peaks, where = model.pair_tables(), [], []
            for i in range(0, len(blocks), 256):
                act = respond(blocks[i:i + 256], tables)
                w = act.argmax(1)
                where.append(w)
                peaks.append(np.take_along_axis(act, w[:, None, :], 1)[:, 0])
            raw, where = np.concatenate(peaks) + model.bias, np.concatenate(where)
            top, mean, values, winner, text, chunks = pooled(np.maximum(raw, 0), counts)
            feats = np.concatenate([top, mean], 1)
            p = 1 / (1 + np.exp(-np.clip(feats @ model.out + shift[0], -30, 30)))
            g = ((p - labels[own]) * weights[own] / len(own)).astype(np.float32)
            g_feats = g[:, None] * model.out
            # a chunk passes on its share of the mean and, where it holds the text's maximum, of that
            holds = values == top[text]
            first_held = np.zeros_like(holds)
            idx = np.where(holds, np.arange(len(holds))[:, None], len(holds))
            starts = np.cumsum(chunks) - chunks
            lead = np.minimum.reduceat(idx, starts, axis=0)
            np.put_along_axis(first_held, lead, True, 0)
            g_chunk = g_feats[text, n_filters:] / chunks[text][:, None] + first_held * g_feats[text, :n_filters]
            f = np.broadcast_to(np.arange(n_filters), winner.shape)
            live = values > 0
            g_live, block, filt = g_chunk[live], winner[live], f[live]
            pos = where[block, filt]
            grad = np.zeros_like(model.filters)
            for j in range(WIDTH):
                flat = blocks[block, pos + j].astype(np.int64) * n_filters + filt
                grad[j] = np.bincount(flat, g_live, 256 * n_filters).reshape(256, n_filters)
            bias_grad = np.bincount(filt, g_live, n_filters).astype(np.float32)
            out_grad = feats.T @ g + 1e-4 * model.out
            model.filters = adam("filters", model.filters, grad + 1e-5 * model.filters, t)
            model.bias = adam("bias", model.bias, bias_grad, t)
            model.out = adam("out", model.out, out_grad, t)
            shift = adam("shift", shift, np.array([g.sum()], np.float32), t)
    model.shift = float(shift[0])
    return model


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, **training) -> TextCNN:
    """A model from a bounded sample of the labelled documents that are not held out."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    shares = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    parts = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    # 2 * per_class ids at most, so this side is small by its construction
    chosen = F.broadcast(parts[0].union(parts[1]))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "quality", "text")
    found = sorted({r["doc_id"]: (r["quality"], r["text"] or "") for r in rows.toLocalIterator()}.items())
    got = {q: sum(1 for _, (k, _t) in found if k == q) for q in (0, 1)}
    if not got[0] or not got[1]:
        n = sum(shares.values())
        p = min(max(shares.get(1, 0) / n, 1e-6), 1 - 1e-6) if n else 0.5
        return TextCNN(np.zeros((WIDTH, 256, 1), np.float32), np.zeros(1, np.float32), np.zeros(2, np.float32),
                       float(np.log(p / (1 - p))))
    y = np.array([k for _, (k, _t) in found], np.float32)
    n = sum(shares.values())
    w = np.where(y == 1, shares[1] / n / (got[1] / len(y)), shares[0] / n / (got[0] / len(y))).astype(np.float32)
    return train([t.encode("utf-8", "surrogatepass") for _, (_k, t) in found], y, w, **training)


def score(docs: DataFrame, model: TextCNN, threshold: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted for every document; `keep` names columns to carry along."""
    kept = list(dict.fromkeys(["doc_id", *keep]))

    def run(batches):
        tables = model.pair_tables()
        for batch in batches:
            for part in slices(batch, batch.schema.names, most=1 << 20):
                at = part.schema.names.index
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(at("text")).to_pylist()]
                p = probabilities(model, texts, tables)
                yield pa.RecordBatch.from_arrays([*[part.column(at(c)) for c in kept], pa.array(p)],
                                                 names=[*kept, "cnn_score"])

    ready(docs.sparkSession)
    sent = docs.select(*dict.fromkeys([*kept, "text"]))
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*kept).dtypes) + ", cnn_score double"
    p = F.col("cnn_score")
    return sent.mapInArrow(run, schema).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), p.alias("score"),
        (p >= threshold).cast("int").alias("predicted"), *[c for c in kept if c != "doc_id"])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    return score(docs, fit(docs, labels), threshold, keep)
