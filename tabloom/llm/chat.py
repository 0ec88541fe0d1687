"""Chat formatting as relational expressions: sorted turn structs, merged by an array fold, concatenated.

A conversation's rows are collected as structs and sorted by turn. A fold merges neighbours of the same role into
one block that keeps its rows' texts apart. Each block is written as

    <|im_start|> role <|im_body|> text { <|im_sep|> text } <|im_end|>

without the spaces. Control strings, those above and those of other templates, may also stand inside a text
or role. There the writer puts a backslash after their first character, and one more if backslashes stand
there already; the reader takes one away. So no control string survives inside a text, and reading back gives
the rows exactly. The loss mask is a list of spans over the output, one for each assistant text.

Defined cases: a null text or role is empty; rows with equal turn are ordered by role, then text; repeated
rows stay; null conv_id is a conversation of its own; an empty table gives an empty result; further
columns are ignored. A conversation is one value, so its rows meet in one task; its size is what bounds that.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, BODY, SEP, END = "<|im_start|>", "<|im_body|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of this template and of other common ones; all begin with < or [.
CONTROL = (START, BODY, SEP, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")

_RESTS = "|".join(re.escape(c[1:]) for c in CONTROL)
ESCAPE = (rf"([<\[])(\\*)({_RESTS})", r"$1\\$2$3")
UNESCAPE = (rf"([<\[])\\(\\*)({_RESTS})", "$1$2$3")


def escape(col):
    return F.regexp_replace(col, F.lit(ESCAPE[0]), F.lit(ESCAPE[1]))


def unescape(col):
    return F.regexp_replace(col, F.lit(UNESCAPE[0]), F.lit(UNESCAPE[1]))


def format_chats(rows: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, and loss_spans: (start, length) in characters of `formatted`, from 0."""
    empty = F.lit("")
    turns = (rows.select("conv_id", F.struct(
        "turn", escape(F.coalesce("role", empty)).alias("role"), escape(F.coalesce("text", empty)).alias("text"))
        .alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns")))
    block = "array<struct<role:string,texts:array<string>>>"
    merged = turns.withColumn("blocks", F.expr(f"""
        aggregate(turns, cast(array() as {block}), (done, t) ->
          if(size(done) > 0 and element_at(done, -1).role = t.role,
             concat(slice(done, 1, size(done) - 1),
                    array(named_struct('role', t.role, 'texts', concat(element_at(done, -1).texts, array(t.text))))),
             concat(done, array(named_struct('role', t.role, 'texts', array(t.text))))))"""))
    spans = "struct<at:long,spans:array<struct<start:long,length:long>>>"
    written = merged.withColumn("formatted", F.expr(f"""
        array_join(transform(blocks, b ->
          concat('{START}', b.role, '{BODY}', array_join(b.texts, '{SEP}'), '{END}')), '')"""))
    # a fold over the blocks, and within a block over its texts, keeps the place reached so far
    role = trained_role.replace("'", "''")
    return written.select("conv_id", "formatted", F.expr(f"""
        aggregate(blocks, cast(named_struct('at', 0L, 'spans', array()) as {spans}), (o, b) ->
          aggregate(b.texts,
            cast(named_struct('at', o.at + {len(START)} + length(b.role) + {len(BODY)}, 'spans', o.spans) as {spans}),
            (i, x) -> cast(named_struct('at', i.at + length(x) + {len(SEP)}, 'spans', if(b.role = '{role}',
              concat(i.spans, array(named_struct('start', i.at, 'length', cast(length(x) as long)))), i.spans)) as {spans}),
            i -> cast(named_struct('at', i.at - {len(SEP)} + {len(END)}, 'spans', i.spans) as {spans})),
          o -> o.spans)""").alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds `turns` (role, text structs, one per original row) parsed from the output alone."""
    blocks = F.expr(f"""
        flatten(transform(filter(split(formatted, '\\\\Q{END}\\\\E'), b -> b <> ''), b ->
          transform(split(split(substring(b, {len(START) + 1}), '\\\\Q{BODY}\\\\E')[1], '\\\\Q{SEP}\\\\E'), x ->
            named_struct('role', split(substring(b, {len(START) + 1}), '\\\\Q{BODY}\\\\E')[0], 'text', x))))""")
    return formatted.withColumn("turns", F.transform(
        blocks, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))))


def loss_text(formatted: DataFrame) -> DataFrame:
    """Adds `loss_text`: the unescaped text under the mask, nothing between the spans."""
    return formatted.withColumn("loss_text", F.array_join(F.transform(
        "loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"),
                                                     s["length"].cast("int")))), ""))


def digests(formatted: DataFrame) -> DataFrame:
    told = loss_text(read_back(formatted))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
