"""Added tokens inside texts, and loss-bearing tokens given as spans."""

import collections
import zlib

import numpy as np

from tabloom.llm import binpack
from tabloom.llm.queries import tokenizer_path


def test_added_tokens_are_recognised(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>é\n", "<|endoftext|", "plain", "<|ENDOFTEXT|>"]
    got = binpack.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer_path())
    want = {}
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4")
        want[i] = (len(ids), zlib.crc32(ids.tobytes()), len(ids))
    assert {r.doc_id: (r.length, r.ids_crc32, r.doc_tokens) for r in got.collect()} == want


def test_long_runs(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    texts = [" " * 2_000_000 + "word", "a\t\n" * 3 + "\t" * 1_200_000, "ab" * 1_000_000, "=" * 2_000_000, "x " * 4000 + "\u00e9" * 6000 + " end",
             "word" + " " * 4999 + "a" * 4999, " " * 5000]
    enc = binpack.encoder(tokenizer_path())
    for t in texts:
        assert binpack.ids_of(enc, t).tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1]
    packed = binpack.pack_documents(spark.createDataFrame(list(enumerate(texts[:2])), "doc_id long, text string"), tokenizer_path())
    assert {r[0]: r[1] for r in packed.groupBy("doc_id").sum("length").collect()} == {i: len(binpack.ids_of(enc, t)) for i, t in enumerate(texts[:2])}


def test_loss_spans_bind(spark):
    rows = [(i, "é one two three four five <|endoftext|> six", [(2, 7)] if i % 2 else None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start:long,length:long>>")
    enc = binpack.encoder(tokenizer_path())
    ids = binpack.ids_of(enc, rows[0][1])
    bears = binpack.under_loss(enc, rows[0][1], ids, [{"start": 1, "length": 8}])
    assert enc.decode(ids[bears].tolist()) == " one two"
    pieces = {r.doc_id: r.loss for r in binpack.cut(docs, tokenizer_path(), 2048, "spans").collect()}
    assert pieces[0] == 0 and pieces[1] == int(binpack.under_loss(enc, rows[0][1], ids, [{"start": 2, "length": 7}]).sum()) > 0
    packed = binpack.pack_documents(docs, tokenizer_path(), loss_cap=3, loss_spans="spans").collect()
    loss = collections.Counter()
    for r in packed:
        loss[r.sequence_id] += pieces[r.doc_id]
    assert len(packed) == 40 and max(loss.values()) <= 3 < sum(loss.values())
