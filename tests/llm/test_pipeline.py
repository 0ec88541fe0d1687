"""Registered queries against their SQL, and the pipeline stage by stage."""

import collections

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tabloom.functions.scratch import settle
from tabloom.llm import binpack, queries, simhash, suffix
from tools.check_oracles import compare, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_match_sql(spark, sf, name):
    ok, note = compare(spark, connect(sf), sf, name)
    assert ok, note


def test_all_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def _texts(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_stages_on_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = settle(pipeline.quality(spark, docs, sf), "quality")
    assert kept.columns == columns and not _texts(kept) - _texts(docs)
    clean = [r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()]
    assert kept.where(kept.doc_id.isin(clean)).count() >= 0.95 * len(clean)

    single = settle(pipeline.near_dedup(spark, kept, sf), "near")
    groups = {r.component_id for r in simhash.near_duplicates(kept).collect()}
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(groups)

    rest = settle(pipeline.suffix_dedup(spark, single, sf), "suffix")
    want = {r.doc_id: bytes(r.kept).decode("utf-8", "ignore") for r in suffix.remove_repeats(single).collect()}
    assert rest.columns == columns and {r.doc_id: r.text for r in rest.collect()} == want

    mix = settle(pipeline.mixing(spark, rest, sf), "mix")
    assert mix.columns == columns and set(r.doc_id for r in mix.collect()) <= set(want)

    packed = pipeline.packing(spark, mix, sf)
    enc = binpack.encoder(queries.tokenizer_path())
    tokens = sum(len(enc.encode_ordinary(r.text)) + 1 for r in mix.collect())
    assert packed.groupBy().sum("length").first()[0] == tokens


def test_stages_take_odd_rows(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in pipeline.STAGES:
            docs = settle(stage(spark, docs, sf), name)
            docs.count()


def test_near_dedup_tells_texts_of_one_id_apart(spark, sf):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    other = "one quite different text that shares no words at all with what stands above it in this table here"
    rows = [(1, base, "en"), (1, other, "en"), (1, other, "de"), (2, base, "en"), (3, other, "fr"), (4, None, "x"), (5, "", "x")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text or "", r.lang) for r in pipeline.near_dedup(spark, docs, sf).collect())
    assert got == sorted([(1, base, "en"), (1, other, "de"), (4, "", "x")])


def test_near_dedup_keeps_rows_without_id(spark, sf, odd_docs):
    got = pipeline.near_dedup(spark, odd_docs, sf).collect()
    assert sum(r.doc_id is None for r in got) == 2
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert len(ids) == len(set(ids))
