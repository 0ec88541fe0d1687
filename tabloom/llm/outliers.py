"""Quality rules: robust multivariate outliers by minimum covariance determinant, in DataFrame operations only.

Each text becomes a vector of transformed statistics: log words, log mean word length, log symbols per
thousand characters, log repeated lines, share of repeated words. Per language and source, the estimator
looks for the `share` of texts whose covariance has the smallest determinant. It has three deterministic
starts, each a scatter about the medians in units of the absolute deviations: none (plain distances), that of
hyperbolic tangents, and that of directions. From the texts nearest by a start it alternates between their
mean and covariance and the texts nearest by the Mahalanobis distance these give (concentration steps) until
the log determinant moves by less than `still`, or `steps` are done. Of a pool's starts the one that ends at the
smallest determinant is kept. Texts beyond a chi-square quantile, with the consistency factor for the share
used, are rejected.

Most texts have no symbols and no repeats, so those variances would be 0: each dimension has a floor, added
to the covariance's diagonal, which says how far a text may stray where its peers do not vary at all. Sources with
fewer than `least` texts are pooled per language, languages still smaller in one pool.

The nearest texts of a group are found by counting distances in fine logarithmic classes, so neither a sort nor
a group's rows meet in one task; a third of all rows may share a source. The statistics are written once; every
step is one aggregate over that narrow table.

Defined cases: a null or empty text has no words, fails the base rules and takes no part in estimates; null
language or source is a group like any other; repeated rows count each; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.scratch import settle

from .common import BLANKS, join_counted, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Standard deviation at least, per dimension of the vector.
FLOORS = (0.6, 0.15, 0.6, 0.4, 0.05)
P = len(FLOORS)
STARTS = ("plain", "tanh", "sign")


def below5(x: float) -> float:
    """Probability that chi-square with 5 degrees of freedom is below x."""
    return math.erf(math.sqrt(x / 2)) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)


def quantile5(p: float) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below5(mid) < p else (low, mid)
    return high


def consistency(share: float) -> float:
    """How much too small the covariance of the nearest `share` is if texts are normal: share / P(chi-square with 7 degrees is
    below the quantile of share with 5)."""
    if share >= 1:
        return 1.0
    x = quantile5(share)
    return share / (below5(x) - math.sqrt(2 / math.pi) * x ** 2.5 * math.exp(-x / 2) / 15)


def window_digests(w: str) -> Column:
    """A digest of each window of five words; `w` names the array of words."""
    return F.expr(f"""
        transform(if(size({w}) < {WINDOW}, cast(array() as array<int>), sequence(0, size({w}) - {WINDOW})),
          i -> xxhash64({', '.join(f'get({w}, i + {k})' for k in range(WINDOW))}))""")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    solid = F.translate(text, " " + BLANKS, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rtrim(F.translate(x, BLANKS, " " * len(BLANKS))) != "")
    rows = docs.select(
        "doc_id", "lang", "source", words(F.col("text")).alias("w"), lines.alias("lines"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length(solid) - F.length(F.translate(solid, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    rows = rows.withColumn("h", window_digests("w"))
    # only texts with a repeated window need the windows' places
    rows = rows.withColumn("places", F.expr("""
        if(size(array_distinct(h)) = size(h), cast(array() as array<struct<h:bigint,i:int>>),
           sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i))))"""))
    rows = rows.withColumn("again", F.expr("""
        sort_array(transform(filter(places, (x, k) ->
          x.h <=> get(places, k - 1).h or x.h <=> get(places, k + 1).h), x -> x.i))"""))
    covered = F.expr(f"""
        aggregate(again, named_struct('n', 0L, 'end', 0),
          (a, i) -> named_struct('n', a.n + i + {WINDOW} - greatest(i, a.end), 'end', i + {WINDOW}), a -> a.n)""")
    return rows.select(
        "doc_id", "lang", "source", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vector() -> dict[str, Column]:
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "x0": F.log1p(n), "x1": F.log(F.try_divide(chars, F.greatest(n, F.lit(1))) + 1e-9),
        "x2": F.log1p(F.coalesce(F.try_divide(1000.0 * F.col("n_symbols"), chars), F.lit(0.0))),
        "x3": F.log1p("n_dup_lines"),
        "x4": F.coalesce(F.try_divide(F.col("n_repeat_words").cast("double"), n), F.lit(0.0))}


def _group(stats: DataFrame, least: int) -> DataFrame:
    """Adds `pool`: the language and source, the language, or one for all, by how many texts there are."""
    key = lambda *c: F.to_json(F.array(*[F.coalesce(F.concat(F.lit("v"), x), F.lit("n")) for x in c]))
    stats = stats.withColumn("own", key("lang", "source"))
    fine = settle(stats.groupBy("own", key("lang").alias("of_lang")).count(), "pools")
    big = F.col("count") >= least
    rest = (fine.where(~big).groupBy("of_lang").agg(F.sum("count").alias("rest"))
            .where(F.col("rest") >= least).select("of_lang"))
    pooled = fine.join(rest.withColumn("enough", F.lit(True)), "of_lang", "left").select(
        "own", F.when(big, F.col("own")).when(F.col("enough"), F.col("of_lang")).otherwise(F.lit("all")).alias("pool"))
    return join_counted(stats, pooled, "own", fine.count()).drop("own")


def _moments(rows: DataFrame, floors: Sequence[float] = FLOORS) -> DataFrame:
    """Per pool the mean, the Cholesky factor of the covariance with its floors, and the log of its determinant."""
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    sums = rows.groupBy("pool").agg(
        F.count("*").alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(P)],
        *[F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in pairs])
    out = sums.select("pool", *[f"m{i}" for i in range(P)], *[
        (F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") + (floors[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}")
        for i, j in pairs])
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # the floors keep the factor positive; the bound only guards rounding
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.select("pool", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in pairs],
                      sum((2 * F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0)).alias("log_det"))


def _distances(rows: DataFrame, fitted: DataFrame, pools: int, how: str = "inner") -> DataFrame:
    """Adds d2, the squared Mahalanobis distance by the pool's estimates."""
    out = join_counted(rows, fitted, "pool", pools, how)
    for i in range(P):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return out.withColumn("d2", sum((F.col(f"z{i}") ** 2 for i in range(1, P)), F.col("z0") ** 2)).select(*rows.columns, "d2")


def _class(d2: Column) -> Column:
    """Distances in classes of about 1 % width."""
    return F.floor(F.log(F.greatest(d2, F.lit(1e-6))) * 100).cast("int")


def _nearest(measured: DataFrame, share: float, pools: int) -> DataFrame:
    """The rows of each pool that belong to its nearest `share`."""
    counts = measured.withColumn("step", _class(F.col("d2"))).groupBy("pool", "step").count()
    run = Window.partitionBy("pool").orderBy("step")
    cut = (counts.withColumn("below", F.sum("count").over(run))
           .withColumn("all", F.sum("count").over(Window.partitionBy("pool")))
           .where(F.col("below") >= share * F.col("all")).groupBy("pool").agg(F.min("step").alias("last")))
    return join_counted(measured, cut, "pool", pools).where(_class(F.col("d2")) <= F.col("last")).drop("d2", "last")


def _key(start: Column) -> Column:
    return F.concat(start, F.lit("|"), F.col("pool"))


def _first_distances(sound: DataFrame, pools: int) -> DataFrame:
    """Every row once per start, `pool` naming both, with its distance by the start's scatter."""
    mid = sound.groupBy("pool").agg(*[F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"m{i}") for i in range(P)])
    apart = join_counted(sound, settle(mid, "medians"), "pool", pools)
    wide = apart.groupBy("pool").agg(*[
        F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 1000).alias(f"w{i}") for i in range(P)])
    even = join_counted(apart, settle(wide, "deviations"), "pool", pools).select("pool", *[f"x{i}" for i in range(P)], *[
        ((F.col(f"x{i}") - F.col(f"m{i}")) / F.greatest(1.4826 * F.col(f"w{i}"), F.lit(FLOORS[i]))).alias(f"u{i}") for i in range(P)])
    square = sum((F.col(f"u{i}") ** 2 for i in range(1, P)), F.col("u0") ** 2)
    bent = even.withColumn("start", F.explode(F.array(*[F.lit(s) for s in STARTS[1:]]))).select(
        _key(F.col("start")).alias("pool"),
        *[F.when(F.col("start") == "tanh", F.tanh(f"u{i}")).otherwise(
            F.coalesce(F.try_divide(F.col(f"u{i}"), F.sqrt(square)), F.lit(0.0))).alias(f"x{i}") for i in range(P)])
    scatter = _moments(bent, (0.05,) * P).withColumns({f"m{i}": F.lit(0.0) for i in range(P)})
    rows = even.withColumn("start", F.explode(F.array(*[F.lit(s) for s in STARTS]))).select(
        _key(F.col("start")).alias("pool"), *[F.col(f"u{i}").alias(f"x{i}") for i in range(P)],
        *[F.col(f"x{i}").alias(f"y{i}") for i in range(P)], square.alias("square"))
    # the plain start has no scatter
    measured = _distances(rows, settle(scatter, "scatters"), pools * len(STARTS), "left")
    return measured.select("pool", *[F.col(f"y{i}").alias(f"x{i}") for i in range(P)], F.coalesce("d2", "square").alias("d2"))


def smallest_determinants(sound: DataFrame, pools: int, share: float, steps: int, still: float) -> DataFrame:
    """Per pool the mean and Cholesky factor of the start that ends at the smallest determinant, its name and log determinant.
    `sound` has pool and the vectors."""
    keys = pools * len(STARTS)
    active = settle(_moments(_nearest(_first_distances(sound, pools), share, keys)), "estimates")
    rows = sound.withColumn("start", F.explode(F.array(*[F.lit(s) for s in STARTS]))).withColumn(
        "pool", _key(F.col("start"))).drop("start")
    ended = []
    for _ in range(steps):
        # starts that have ended take no part, because rows meet only active estimates
        found = _moments(_nearest(_distances(rows, active, keys), share, keys))
        found = settle(found.join(active.select("pool", F.col("log_det").alias("before")), "pool"), "estimates")
        calm = F.abs(F.col("log_det") - F.col("before")) < still
        ended.append(found.where(calm).drop("before"))
        active = found.where(~calm).drop("before")
        if active.isEmpty():
            break
    ends = reduce(DataFrame.unionByName, ended, active)
    ends = ends.withColumn("start", F.substring_index("pool", "|", 1)).withColumn("pool", F.expr("substr(pool, instr(pool, '|') + 1)"))
    fitted = [c for c in ends.columns if c not in ("pool", "start", "log_det")]
    return ends.groupBy("pool").agg(F.min(F.struct("log_det", "start", *fitted)).alias("best")).select("pool", "best.*")


def reject_outliers(docs: DataFrame, share: float = 0.75, steps: int = 20, least: int = 64,
                    quantile: float = 0.9999, still: float = 1e-3) -> DataFrame:
    """The base statistics of every document, base_failed, kept, its pool and its robust distance."""
    stats = settle(statistics(docs), "text-statistics").withColumn("base_failed", base_failed())
    vectors = settle(_group(stats.withColumns(vector()), least), "text-vectors")
    sound = vectors.where(~F.col("base_failed")).select("pool", *[f"x{i}" for i in range(P)])
    pools = vectors.select("pool").distinct().count()
    fitted = settle(smallest_determinants(sound, pools, share, steps, still), "determinants")
    limit = consistency(share) * quantile5(quantile)
    plain = vectors.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                           "pool", *[f"x{i}" for i in range(P)])
    # a pool in which every text failed the base rules has no estimate: its rows get no distance
    rows = _distances(plain, fitted, pools, "left")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= limit)).alias("kept"),
                       "pool", F.round("d2", 4).alias("distance"))
