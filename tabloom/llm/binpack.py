"""Vector bin packing of token pieces: tokens, segments and loss-bearing tokens are limited at once.

Documents are tokenised where they lie and cut into pieces of at most `capacity` tokens: full pieces and
one remainder. Only the pieces' sizes and checksums travel. They are dealt by digest into groups of a
bounded number of pieces, and each group fills one sequence after the other: of the pieces that still
fit, it takes the one whose demand has the largest dot product with the sequence's free capacity, every
dimension weighed by its mean demand. Equal demands are one class with a count, so a step costs at
most `capacity` comparisons whatever the group's size.

A token bears loss unless a piece starts with it. Where `loss_spans` names a column of spans (start, length in characters, as
op6 writes them), a token also needs to start inside one of its document's spans; a null list has none.

Added tokens of the tokenizer file are recognised inside a text, as its own library does.

Defined cases: a null or empty text is one piece holding only the end id; a null doc_id stays null;
repeated rows are packed once each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scratch import settle

from .common import ready, slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
END_ID = 1

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The byte-level BPE of a tokenizer file, run by the faster of the two installed libraries.

    The ids equal those of the library that the file is made for (tests compare them)."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # bytes are written as printable characters: those that are printable stand for themselves
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with matching rules of their own are not supported")
        ranks = {bytes(byte_of[c] for c in token): i
                 for token, i in spec["model"]["vocab"].items() if token not in special}
        _encoders[path] = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN,
                                            mergeable_ranks=ranks, special_tokens=special)
        _encoders[path].path = path
    return _encoders[path]


#: A text with so long a run of blanks, or without any, goes to the file's own library: the faster one runs out of stack on
#: the first and takes quadratic time over the second. Both give the same ids.
LONG = 5_000
_LONG_RUN = re.compile(rf"\s{{{LONG}}}|\S{{{LONG}}}")
_libraries: dict[str, object] = {}


def ids_of(enc, text: str) -> np.ndarray:
    """The text's ids and the end id."""
    if len(text) >= LONG and _LONG_RUN.search(text):
        if enc.path not in _libraries:
            from tokenizers import Tokenizer

            _libraries[enc.path] = Tokenizer.from_file(enc.path)
        return np.array([*_libraries[enc.path].encode(text, add_special_tokens=False).ids, END_ID], "<u4")
    return np.append(enc.encode_to_numpy(text, allowed_special="all", disallowed_special=()), END_ID).astype("<u4")


def under_loss(enc, text: str, ids: np.ndarray, spans) -> np.ndarray:
    """Which ids start inside a span of (start, length) characters; the end id is in none."""
    size = [len(enc.decode_single_token_bytes(int(i))) for i in ids[:-1]]
    starts = np.cumsum([0, *size])[:len(size)]
    # the byte that each character starts at, and the text's end
    lead = np.frombuffer(text.encode("utf-8") + b" ", np.uint8)
    at = np.flatnonzero((lead & 0xC0) != 0x80)
    bears = np.zeros(len(ids), bool)
    for s in spans or ():
        low, high = (min(max(int(v), 0), len(at) - 1) for v in (s["start"], s["start"] + s["length"]))
        bears[:-1] |= (starts >= at[low]) & (starts < at[high])
    return bears


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, loss_spans: str | None = None) -> DataFrame:
    """One row per piece of each document: where it starts, its length, checksum and loss-bearing tokens.

    A piece's first token is predicted from nothing, so it bears no loss."""

    def run(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, ["doc_id", "text"]):
                rows = []
                spans = part.column(2).to_pylist() if loss_spans else [None] * part.num_rows
                for doc_id, text, own_spans in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), spans):
                    ids = ids_of(enc, text or "")
                    bears = under_loss(enc, text or "", ids, own_spans) if loss_spans else None
                    for s in range(0, len(ids), capacity):
                        own = ids[s:s + capacity]
                        loss = len(own) - 1 if bears is None else int(bears[s + 1:s + capacity].sum())
                        rows.append((doc_id, s, len(own), zlib.crc32(own.tobytes()), len(ids), loss))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss"])

    ready(docs.sparkSession)
    extra = [F.col(loss_spans)] if loss_spans else []
    return docs.select(F.col("doc_id").cast("long"), "text", *extra).mapInArrow(run, PIECES)


def fill(length: np.ndarray, loss: np.ndarray, capacity: int, segments: int, loss_cap: int):
    """Sequence number and offset of each piece of one group, by the dot-product rule."""
    n = len(length)
    kinds, kind_of, left = np.unique(np.stack([length, loss], 1), axis=0, return_inverse=True, return_counts=True)
    kind_of = kind_of.reshape(-1)
    size, cost = kinds[:, 0].astype(np.int64), kinds[:, 1].astype(np.int64)
    if n and (size.max() > capacity or cost.max() > loss_cap):
        raise ValueError("a piece is larger than a sequence")
    # weights: mean demand as a share of the limit, so that the scarce dimension counts most
    w = np.array([length.mean() / capacity ** 2, (1 / segments) / segments, loss.mean() / loss_cap ** 2]) if n else None
    members = np.argsort(kind_of, kind="stable")
    first = np.concatenate([[0], np.cumsum(left)])
    taken = np.zeros(len(left), np.int64)
    seq, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    done, at = 0, 0
    while done < n:
        room, free, bearing = capacity, segments, loss_cap
        while free:
            score = np.where((left > 0) & (size <= room) & (cost <= bearing),
                             w[0] * size * room + w[1] * free + w[2] * cost * bearing, -1.0)
            k = int(score.argmax())
            if score[k] < 0:
                break
            i = members[first[k] + taken[k]]
            seq[i], offset[i] = at, capacity - room
            taken[k] += 1
            left[k] -= 1
            done += 1
            room, free, bearing = room - int(size[k]), free - 1, bearing - int(cost[k])
        at += 1
    return seq, offset


def pack(pieces: DataFrame, capacity: int = 2048, segments: int = 64, loss_cap: int = 2048,
         group_pieces: int = 8192) -> DataFrame:
    """Adds sequence_id and offset. `pieces` must be cheap to read twice (a written table)."""
    groups = max(1, -(-pieces.count() // group_pieces))

    def one(pdf):
        pdf = pdf.sort_values(["doc_id", "start"], kind="stable", na_position="last")
        length = pdf["length"].to_numpy(np.int64)
        seq, offset = fill(length, pdf["loss"].to_numpy(np.int64), capacity, segments, loss_cap)
        group = int(pdf["packing_group"].iloc[0])
        return pdf.drop(columns=["loss", "packing_group"]).assign(sequence_id=(group << 32) + seq, offset=offset)

    ready(pieces.sparkSession)
    # the group number is 0, 1, 2 ...; its digest would not spread a few groups evenly over tasks
    digest = F.xxhash64("doc_id", "start", "ids_crc32")
    return (pieces.withColumn("packing_group", F.pmod(digest, F.lit(groups)))
            .groupBy("packing_group").applyInPandas(one, PACKED))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, segments: int = 64,
                   loss_cap: int = 2048, loss_spans: str | None = None) -> DataFrame:
    pieces = settle(cut(docs, tokenizer_path, capacity, loss_spans), "pieces")
    return pack(pieces, capacity, segments, loss_cap)
