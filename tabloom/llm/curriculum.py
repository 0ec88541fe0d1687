"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

1. Sources, ordered by code point with null last, get repeating weights and share `budget` times all
   words. No target exceeds `most` times its source; what exceeds is shared out again by weight. That is
   the level L with sum(min(cap, weight * L)) = budget: sorted by cap / weight, a prefix stands at its
   cap, so L comes from running sums over the table of sources.
2. Documents of a source stand in the order of a digest of their id and text. Counting words along it gives each
   document the interval of demand it meets, in a first pass over the source and, above one pass, in a
   second. The document that a target ends in is taken in part.
3. A source's weight schedule is a list of (time, weight) knots. Its integral is the cumulative demand;
   inverting it (a quadratic between two knots) turns demand met so far into a training position between
   0 and 1. Documents are then range-sorted by position.

A running sum never gathers a source in one task: digests are cut into buckets of a bounded number of rows,
bucket totals are summed first (a small table), then rows within their bucket.

Defined cases: a null or empty text has size 0 and takes 0 words; the null source is a source; repeated rows
count once each, in any order among each other; an empty table gives an empty result; a document that
is not taken has a null position and comes last; other columns are carried only by `mix`'s `keep`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.scratch import settle

from .common import words

#: Shapes of the weight over training time, as (time, weight) knots; sources take them in turn.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),               # fades out
    ((0.0, 1.0), (1.0, 1.0)),               # constant
    ((0.0, 0.4), (0.5, 0.8), (1.0, 2.0)),   # comes in late
)


def source_targets(sizes: DataFrame, weights=(3, 1, 2), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: source_size, place in order, weight and target. `sizes` has source and size."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    alone = Window.orderBy("reach", "place")
    per = per.withColumn("place", F.row_number().over(order) - 1)
    per = (per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                 (F.col("place") % len(weights) + 1).cast("int")))
           .withColumn("cap", most * F.col("source_size")).withColumn("reach", F.col("cap") / F.col("weight")))
    whole = Window.partitionBy()
    before = alone.rowsBetween(Window.unboundedPreceding, -1)
    onward = alone.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = (per.withColumn("level", (budget * F.sum("source_size").over(whole)
                                    - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                          / F.sum("weight").over(onward))
           # sources behind the first that stays below its cap give smaller levels
           .withColumn("level", F.max(F.when(F.col("level") <= F.col("reach"), F.col("level"))).over(whole)))
    return per.select("source", "source_size", "place", "weight",
                      F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def invert(share: Column, knots) -> Column:
    """The time at which a schedule's integral reaches this share of its total."""
    areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:])]
    total, out, passed = sum(areas), None, 0.0
    for ((t0, a), (t1, b)), area in zip(zip(knots, knots[1:]), areas):
        need = share * total - passed
        slope = (b - a) / (t1 - t0)
        step = need / a if slope == 0 else (F.sqrt(F.greatest(a * a + 2 * slope * need, F.lit(0.0))) - a) / slope
        at = F.lit(t0) + step
        passed += area
        out = at if out is None else F.when(share * total > passed - area, at).otherwise(out)
    return F.least(F.lit(float(knots[-1][0])), out)


def sized(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"),
                       *[c for c in keep if c not in ("doc_id", "source")])


def plan(docs: DataFrame, weights=(3, 1, 2), budget: float = 1.5, most: float = 2.0, schedules=SCHEDULES,
         bucket_rows: int = 4096, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document with its target, the words taken in each pass, and its training positions.

    Sizes are written; the columns of `keep` are not, they are read again and go through one shuffle, by bucket."""
    told = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"),
                          F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    digested = sized(docs.withColumn("mix_digest", told), ("mix_digest", *keep)).withColumnRenamed("mix_digest", "digest")
    rows = settle(digested.select("doc_id", "source", "size", "digest"), "sizes")
    n = rows.count()
    bits = max(1, min(28, (max(n // bucket_rows, 1)).bit_length()))
    bucket = F.shiftright(F.conv(F.substring("digest", 1, 7), 16, 10).cast("long"), 28 - bits)
    full = digested.withColumn("bucket", bucket) if keep else rows.withColumn("bucket", bucket)
    rows = rows.withColumn("bucket", bucket)
    # a null-safe key for joins: the source's place in code-point order
    targets = source_targets(rows, weights, budget, most)
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (totals.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(along), F.lit(0)))
              .alias("b").join(targets.alias("t"), F.expr("b.source <=> t.source"))
              .selectExpr("b.source as at_source", "bucket as at_bucket", "bucket_start", "source_size", "place",
                          "weight", "target"))
    inside = (Window.partitionBy("source", "bucket").orderBy("digest", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = full.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, (F.col("source").eqNullSafe(F.col("at_source")))
                         & (F.col("bucket") == F.col("at_bucket")))
    begin = F.col("bucket_start") + F.col("inside")
    demand = F.floor(F.col("target") + 1e-6)
    first = F.greatest(F.lit(0), F.least(F.col("size"), demand - begin))
    second = F.greatest(F.lit(0), F.least(F.col("size"), demand - F.col("source_size") - begin))
    placed = placed.withColumns({"begin": begin, "first_words": first, "second_words": second})

    def position(done: Column) -> Column:
        share = F.least(F.lit(1.0), F.try_divide(done, F.col("target")))
        shape = F.col("place") % len(schedules)
        out = invert(share, schedules[-1])
        for i, knots in enumerate(schedules[:-1]):
            out = F.when(shape == i, invert(share, knots)).otherwise(out)
        return F.round(out, 9)

    taken = F.col("first_words") + F.col("second_words")
    return placed.select(
        "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"),
        F.when(F.col("first_words") > 0, position(F.col("begin"))).alias("position"),
        F.when(F.col("second_words") > 0, position(F.col("begin") + F.col("source_size"))).alias("again_position"),
        "first_words", "second_words", *[c for c in keep if c != "doc_id"])


def mix(docs: DataFrame, **options) -> DataFrame:
    """The plan of all documents, range-sorted by position."""
    return (plan(docs, **options).drop("first_words", "second_words")
            .orderBy(F.col("position").asc_nulls_last(), "doc_id"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix in training order, with their columns: one row per pass that takes them.

    Where a pass takes only some words of a document (the one its source's target ends in), the row's
    text is those first words, joined by blanks."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    carried = docs.select("*", F.struct("source", *others).alias("mix_row"))
    chosen = plan(carried, keep=("mix_row",), **options).where("taken > 0")
    taken = chosen.withColumn("mix_pass", F.explode(F.filter(F.array(
        F.struct(F.col("position").alias("at"), F.col("first_words").alias("n")),
        F.struct(F.col("again_position").alias("at"), F.col("second_words").alias("n"))), lambda p: p["n"] > 0)))
    text = F.col("mix_row.text")
    part = F.array_join(F.slice(words(text), 1, F.col("mix_pass.n").cast("int")), " ")
    cut = F.when(F.col("mix_pass.n") < F.col("size"), part).otherwise(text)
    return taken.orderBy("mix_pass.at", "doc_id").select(*[
        F.col("doc_id") if c == "doc_id" else cut.alias(c) if c == "text" else F.col(f"mix_row.`{c}`").alias(c) for c in docs.columns])


def mix_sql(weights=(3, 1, 2), budget: float = 1.5, most: float = 2.0, schedules=SCHEDULES) -> str:
    """The same rows in plain SQL, for the check against another engine."""

    def inverse(share: str, knots) -> str:
        areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:])]
        total, out, passed = sum(areas), "", 0.0
        for ((t0, a), (t1, b)), area in zip(zip(knots, knots[1:]), areas):
            need, slope = f"({share} * {total} - {passed})", (b - a) / (t1 - t0)
            step = f"{need} / {a}" if slope == 0 else \
                f"(sqrt(greatest({a}::double * {a} + 2 * {slope}::double * {need}, 0)) - {a}) / {slope}::double"
            at = f"({t0} + {step})"
            out = at if not out else f"CASE WHEN {share} * {total} > {passed} THEN {at} ELSE {out} END"
            passed += area
        return f"least(1.0, {out})"

    def position(done: str) -> str:
        share = f"least(1.0::double, ({done}) / target)"
        cases = " ".join(f"WHEN {i} THEN {inverse(share, k)}" for i, k in enumerate(schedules))
        return f"round(CASE place % {len(schedules)} {cases} END, 9)"

    listed = ", ".join(f"{float(w)}::double" for w in weights)
    return f"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size
  FROM documents),
per AS (
  SELECT source, sum(size)::bigint AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1 AS place
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, {most}::double * source_size AS cap, list_extract([{listed}], (place % {len(weights)} + 1)::int) AS weight
  FROM per),
levels AS (
  SELECT *, cap / weight AS reach,
         ({budget}::double * sum(source_size) OVER ()
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own
  FROM weighed),
targets AS (
  SELECT source, source_size, place,
         least(cap, coalesce(weight * max(CASE WHEN own <= reach THEN own END) OVER (), cap)) AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.place, floor(t.target + 1e-6)::bigint AS demand,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.doc_id, s.size
                            ROWS UNBOUNDED PRECEDING) - s.size)::bigint AS begin_at
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
cut AS (
  SELECT *, greatest(0, least(size, demand - begin_at)) AS first_words,
         greatest(0, least(size, demand - source_size - begin_at)) AS second_words FROM placed)
SELECT doc_id, size::bigint AS size, source_size, target, (first_words + second_words)::bigint AS taken,
       CASE WHEN first_words > 0 THEN {position('begin_at')} END AS position,
       CASE WHEN second_words > 0 THEN {position('begin_at + source_size')} END AS again_position
FROM cut"""
