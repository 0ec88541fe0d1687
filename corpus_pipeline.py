"""The corpus pipeline: quality classifier, SimHash near-dedup, suffix-array dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first four return the
columns of `documents`; other columns that docs may have are left behind. The last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.scratch import scratch_path, scratch_scope, settle
from tabloom.llm import binpack, curriculum, simhash, suffix, textcnn
from tabloom.llm.common import table
from tabloom.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network accepts. It learns from `labels` on this stage's own input.

    Texts of any length are scored whole; null and empty texts get the network's score of no bytes; repeated rows get
    equal scores; an empty table gives an empty result."""
    docs = docs.select(*COLUMNS)
    model = textcnn.fit(docs, table(spark, sf_dir, "labels"))
    return textcnn.score(docs, model, keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (3-word shingles, at most 3 differing bits) the document with the smallest id.

    A document is an id with its text: different texts under one id are different documents, and where one id has two
    texts in a component the smaller text hash stays. Rows that repeat id and text are one row, the least by its other
    columns. Rows without id stay. Null, empty and blank texts are near-duplicates of each other; an empty table gives an
    empty result."""
    docs = docs.select(*COLUMNS)
    keyed = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    path = scratch_path(spark, "near-components")
    with scratch_scope(spark):  # only the components outlive the search for them
        simhash.labelled(keyed, keep=("text_hash",)).write.parquet(path)
    found = spark.read.parquet(path)
    named = found.where("doc_id is not null")
    first = named.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    gone = named.join(first, "root").where(F.struct("doc_id", "text_hash") != F.col("first")).select("doc_id", "text_hash").distinct()
    again = named.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")
    left = keyed.join(gone, ["doc_id", "text_hash"], "left_anti")
    single = left.join(again, ["doc_id", "text_hash"], "left_anti").select(*COLUMNS)
    # equal rows are put together before the shuffle
    repeated = left.join(again, ["doc_id", "text_hash"], "left_semi").groupBy("doc_id", "text_hash").agg(
        F.min(F.struct("text", "lang", "source", "n_chars")).alias("one")).select("doc_id", "one.*")
    return single.unionByName(repeated.select(*COLUMNS))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that also occur elsewhere; n_chars follows the text.

    A null text becomes empty; what occurs twice goes in every place, so repeated rows lose their whole texts where these
    reach 200 bytes; an empty table gives an empty result."""
    docs = docs.select(*COLUMNS)
    rest = suffix.remove_repeats(docs, keep=("lang", "source"), as_text=True)
    return rest.select("doc_id", F.col("kept").alias("text"), "lang", "source",
                       F.length("kept").cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The curriculum's mix in training order: documents left out are gone, those taken twice are two rows.

    Texts without words are never taken; the null source is a source; equal positions go by doc_id; repeated rows count
    once each; an empty table gives an empty result."""
    return (curriculum.mixed(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))
            .select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens; rows that repeat an id are documents of their own. A null or
    empty text is its end token alone; an empty table gives an empty result."""
    return binpack.pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mixing", mixing),
          ("packing", packing)]

#: A trained network, hash-compared suffixes and a tokenizer have no SQL form; tests/llm compare each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
