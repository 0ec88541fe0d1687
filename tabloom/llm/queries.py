"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, binpack, chat, convfix, curriculum, merkle, outliers, periods, simhash, sketches, suffix, textcnn,
               urltree)
from tabloom.functions.scratch import settle

from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(suffix.remove_repeats(table(spark, sf_dir, "documents")))


def op3_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.reject_outliers(table(spark, sf_dir, "documents"))


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge(table(spark, sf_dir, "pages"))


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.format_chats(rows))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textcnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as an archive against a replica of it in which some records are damaged or lost.

    By its id, one record in about 300 has its first letter o turned into 0, one in 1,000 is overwritten with nothing
    (its bytes are gone, later records keep their offsets)."""
    kept = merkle.warc_records(table(spark, sf_dir, "pages"))
    archive = settle(merkle.laid_out(kept), "archive")
    turn = F.pmod(F.col("page_id") * 7919, F.lit(1000))
    text = F.decode("record", "UTF-8")
    at = F.locate("o", text)
    hurt = F.when((turn < 3) & (at > 0), F.encode(F.overlay(text, F.lit("0"), at, F.lit(1)), "UTF-8")).otherwise(F.col("record"))
    damaged = kept.withColumn("record", hurt).select("file", "page_id", F.sha2("record", 256).alias("own"))
    replica = settle(archive.select("file", "page_id", "offset", "length").join(damaged, ["file", "page_id"])
                     .where(F.coalesce(turn != 500, F.lit(True)))
                     .select("file", "offset", "length", F.col("own").alias("digest")), "replica")
    return merkle.audit(archive.select("file", "offset", "length", "digest"), replica)


def op11_lookup_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.with_edits(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic_runs(table(spark, sf_dir, "documents"), planted=True)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return convfix.report(rows, convfix.damage(rows))


QUERIES = {f.__name__: f for f in (op1_pruned_graph, op2_suffix_dedup, op3_mcd_outliers, op4_url_templates, op5_curriculum_mix, op6_chat_format, op7_simhash,
                                  op8_quality_cnn, op9_vector_packing, op10_merkle_fixity, op11_lookup_sketch,
                                  op12_periodic_runs, op13_repair)}


def _chat_sql() -> str:
    text_escape = chat.ESCAPE[0].replace("'", "''")
    return f"""
WITH own AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
                                  (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
told AS (
  SELECT *, length(regexp_replace(role, '{text_escape}', '\\1\\\\\\2\\3', 'g')) AS role_chars,
         length(regexp_replace(text, '{text_escape}', '\\1\\\\\\2\\3', 'g')) AS text_chars,
         coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS joined
  FROM own)
SELECT conv_id, count(*)::bigint AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::bigint AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(text_chars + CASE WHEN joined THEN {len(chat.SEP)}
           ELSE role_chars + {len(chat.START) + len(chat.BODY) + len(chat.END)} END)::bigint AS formatted_chars
FROM told GROUP BY conv_id"""


MERKLE_SQL = """
WITH records AS (
  SELECT floor(page_id / 1000)::bigint AS file, page_id,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
         || page_id::varchar || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
         || 'Content-Length: ' || strlen(coalesce(html, ''))::varchar || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
placed AS (
  SELECT file, page_id, record, (sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id ROWS UNBOUNDED PRECEDING)
         - strlen(record))::bigint AS "offset", (page_id * 7919) % 1000 AS turn FROM records)
SELECT file, "offset", CASE WHEN turn = 500 THEN 'missing' ELSE 'changed' END AS status, sha256(record) AS expected,
       CASE WHEN turn <> 500 THEN sha256(left(record, instr(record, 'o') - 1) || '0'
                                         || substr(record, instr(record, 'o') + 1)) END AS found
FROM placed WHERE turn = 500 OR (turn < 3 AND contains(record, 'o'))"""

ORACLES = {"op10_merkle_fixity": MERKLE_SQL, "op5_curriculum_mix": curriculum.mix_sql(), "op6_chat_format": _chat_sql(),
           "op13_repair": convfix.repair_sql()}
