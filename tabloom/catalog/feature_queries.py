"""Queries for interactions, feature filters and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FeatureConfig
from ..functions.columns import ref, round_doubles, rounded
from ..operators import evaluate as V, features as X
from ..operators.profile import correlations
from .registry import query
from .views import ev, li, ord_lab, sql, union

KEY = "o_orderkey"
_BASE = {
    "total": "o_totalprice", "bal": "c_acctbal", "nation": "CAST(c_nationkey AS double)",
    "total_copy": "o_totalprice * 1.001", "bal2": "c_acctbal * 2",
}
_SOURCES = ["total", "bal", "nation"]
_DERIVED = X.interaction_names(_SOURCES, _SOURCES)


def _feats(spark, sf):
    return ord_lab(spark, sf).selectExpr(KEY, "y", *[f"{e} AS {n}" for n, e in _BASE.items()])


def _derived_sql(name):
    if "__mul__" in name:
        a, b = name.split("__mul__")
        return f"{a} * {b}"
    a, b = name.split("__div__")
    return f"CASE WHEN abs({b}) > 1e-6 THEN {a} / {b} ELSE 0.0 END"


_F = ("f", f"SELECT {KEY}, y, {', '.join(f'{e} AS {n}' for n, e in _BASE.items())} FROM ord_lab")
_FI = ("fi", "SELECT *, " + ", ".join(f"{_derived_sql(n)} AS {n}" for n in _DERIVED) + " FROM f")


@query("interactions", sql("ord_lab", f"SELECT {KEY}, " + ", ".join(
    f"round({n}, {4 if '__mul__' in n else 6}) AS {n}" for n in _DERIVED) + " FROM fi", _F, _FI))
def interactions(spark, sf):
    return X.add_derived(_feats(spark, sf), _DERIVED).select(
        KEY, *[rounded(ref(n), 4 if "__mul__" in n else 6).alias(n) for n in _DERIVED])


@query("volume_feature", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount * l_tax, 6) "
                         "AS x__mul__y__mul__z FROM lineitem")
def volume_feature(spark, sf):
    d = li(spark, sf).select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"),
                             F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))
    names = X.interaction_names([], d.columns)
    return round_doubles(X.add_derived(d, names).select("l_orderkey", "l_linenumber", *names))


_M = ["total / 100000", "bal / 10000", "nation / 10"]
_TOP = f"greatest({', '.join(_M)})"
_DEN = "(" + " + ".join(f"exp({m} - {_TOP})" for m in _M) + ")"


@query("softmax", sql("ord_lab", f"SELECT {KEY}, " + ", ".join(
    f"round(exp({m} - {_TOP}) / {_DEN}, 6) AS p{i}" for i, m in enumerate(_M)) +
    ", round(1 / (1 + exp(-bal / 10000)), 6) AS sigmoid FROM f", _F))
def softmax(spark, sf):
    d = _feats(spark, sf).withColumn("m", F.array(*[F.expr(m) for m in _M]))
    p = V.probabilities_from_margins(F.col("m"))
    return d.withColumn("p", p).select(
        KEY, *[rounded(F.col("p")[i]).alias(f"p{i}") for i in range(3)],
        rounded(V.probabilities_from_margin(F.col("bal") / 10000)[1]).alias("sigmoid"))


@query("top_variance", sql("ord_lab", 'SELECT "column", position FROM (SELECT "column", '
                           'row_number() OVER (ORDER BY v DESC, "column") AS position FROM (' + union(
                               [f"SELECT '{c}' AS \"column\", var_pop({c}) AS v FROM f"
                                for c in _BASE]) + ") WHERE v > 0) WHERE position <= 3", _F))
def top_variance(spark, sf):
    top = X.top_variance(X.variances(_feats(spark, sf), list(_BASE)), 3)
    return spark.createDataFrame([(c, i + 1) for i, c in enumerate(top)],
                                 "column string, position long")


@query("corr_filter", sql("ord_lab", union([
    "SELECT 'total_copy' AS \"column\" FROM f HAVING abs(corr(total, total_copy)) > 0.95",
    "SELECT CASE WHEN var_pop(bal) < var_pop(bal2) THEN 'bal' ELSE 'bal2' END FROM f HAVING "
    "abs(corr(bal, bal2)) > 0.95"]), _F))
def corr_filter(spark, sf):
    m = X.moments(_feats(spark, sf), list(_BASE))
    return spark.createDataFrame([(c,) for c in X.redundant_columns(list(_BASE), m)],
                                 "column string")


# --- selection over scores derived from the table ----------------------------------------

_ORDER = _SOURCES + _DERIVED
_SCORES = (
    ("raw", union([f"SELECT '{c}' AS feature, {i} AS position, abs(corr({c}, y)) AS r FROM fi"
                   for i, c in enumerate(_ORDER)])),
    ("sc", "SELECT feature, position, r / sum(r) OVER () AS score FROM raw"),
)
_CTES = (_F, _FI, *_SCORES)
_SPLIT = "unnest(string_split(replace(feature, '__div__', '__mul__'), '__mul__'))"
_IS_DERIVED = "(feature LIKE '%!_!_mul!_!_%' ESCAPE '!' OR feature LIKE '%!_!_div!_!_%' ESCAPE '!')"


def _with_bases(chosen):
    return (f"SELECT feature FROM sc WHERE feature IN (SELECT feature FROM {chosen}) OR feature IN "
            f"(SELECT {_SPLIT} FROM {chosen} WHERE {_IS_DERIVED})")


def _scores(spark, sf):
    """Share of each feature in the summed absolute correlation with y: one aggregate."""
    d = X.add_derived(_feats(spark, sf), _DERIVED)
    r = correlations(d, [(c, "y") for c in _ORDER])
    raw = {c: abs(r[c, "y"] or 0.0) for c in _ORDER}
    return {c: v / sum(raw.values()) for c, v in raw.items()}


def _names(spark, names):
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query("select_by_score", sql("ord_lab", _with_bases("chosen"), *_CTES, (
    "chosen", "SELECT feature FROM sc WHERE score >= 0.12")))
def select_by_score(spark, sf):
    return _names(spark, X.select_by_score(_ORDER, _scores(spark, sf),
                                           FeatureConfig(importance_threshold=0.12)))


@query("select_fallback", sql("ord_lab", _with_bases("chosen"), *_CTES, (
    "chosen", "SELECT feature FROM sc ORDER BY score DESC, feature LIMIT 2")))
def select_fallback(spark, sf):
    return _names(spark, X.select_by_score(_ORDER, _scores(spark, sf), FeatureConfig(
        importance_threshold=2.0, n_features_to_select=2)))


@query("protect_bases", sql("ord_lab", f"SELECT DISTINCT {_SPLIT} AS feature FROM sc WHERE "
                            f"{_IS_DERIVED} AND score >= 0.1", *_CTES))
def protect_bases(spark, sf):
    s = _scores(spark, sf)
    return _names(spark, sorted(X.protected_bases([c for c in _ORDER if s[c] >= 0.1], _ORDER)))


@query("override_features", sql("ord_lab", (
    "SELECT feature FROM (" + _with_bases("chosen") + ") WHERE feature <> 'nation' AND feature NOT "
    "LIKE '%nation%' AND feature <> 'total!_!_div!_!_bal'").replace("!", ""), *_CTES, (
        "chosen", "SELECT feature FROM sc WHERE score >= 0.12 UNION SELECT 'bal__mul__nation' UNION "
                  "SELECT 'total__div__bal'")))
def override_features(spark, sf):
    """Two forced keeps; a raw exclude that takes its interactions along; one forced drop."""
    cfg = FeatureConfig(importance_threshold=0.12, include_features=("total__div__bal",),
                        force_keep_engineered_features=("bal__mul__nation",),
                        exclude_features=("nation",),
                        force_drop_engineered_features=("total__div__bal",))
    chosen = X.select_by_score(_ORDER, _scores(spark, sf), cfg)
    return _names(spark, X.override_selection(chosen, _ORDER, cfg))


@query("selection_cap", sql("ord_lab", _with_bases("best"), *_CTES, (
    "best", "SELECT feature FROM sc ORDER BY score DESC, position, feature LIMIT 3")))
def selection_cap(spark, sf):
    return _names(spark, X.cap_selection(_ORDER, _ORDER, _scores(spark, sf), 3))


@query("feature_rank", sql("ord_lab", "SELECT feature, row_number() OVER (ORDER BY score DESC, feature)"
                           " AS rank, round(score, 6) AS score FROM sc", *_CTES))
def feature_rank(spark, sf):
    s = _scores(spark, sf)
    return round_doubles(spark.createDataFrame(
        [(c, i + 1, s[c]) for i, c in enumerate(X.rank_features(s))],
        "feature string, rank long, score double"))


@query("split_selected", sql("ord_lab", "SELECT feature, 'numeric' AS kind FROM sc WHERE score >= 0.12 "
                             "UNION ALL SELECT 'o_orderpriority', 'categorical'", *_CTES))
def split_selected(spark, sf):
    s = _scores(spark, sf)
    d = X.add_derived(_feats(spark, sf).withColumn("o_orderpriority", F.lit("")), _DERIVED)
    numeric, text = X.split_selected(d, [c for c in _ORDER if s[c] >= 0.12] + [
        "o_orderpriority", "absent"])
    return spark.createDataFrame([(c, "numeric") for c in numeric] + [
        (c, "categorical") for c in text], "feature string, kind string")


_LOG = ("lg", "SELECT event_type AS type, min(first_id) AS seq, list(c) AS columns FROM (SELECT "
              "event_type, concat('col_', CAST(user_id % 50 AS string)) AS c, avg(value) AS v, "
              "min(event_id) AS first_id FROM ev GROUP BY ALL) WHERE v > 50 GROUP BY event_type")


def _log(spark, sf):
    """A transformation log whose steps are event types; a step names the user groups that spend
    more than 50 on average in it."""
    group = F.concat(F.lit("col_"), (F.col("user_id") % 50).cast("string")).alias("c")
    spend = ev(spark, sf).groupBy(F.col("event_type").alias("type"), group).agg(
        F.avg("value").alias("v"), F.min("event_id").alias("first_id")).where("v > 50")
    return spend.groupBy("type").agg(F.min("first_id").alias("seq"),
                                     F.collect_list("c").alias("columns"))


@query("dropped_reasons", sql("ev", 'SELECT c AS "column", arg_max(type, seq) AS reason FROM (SELECT '
                              "type, seq, unnest(columns) AS c FROM lg) GROUP BY c", _LOG))
def dropped_reasons(spark, sf):
    return X.dropped_reasons(_log(spark, sf))


@query("dropped_reason_groups", sql("ev", "SELECT reason, string_agg(c, ',' ORDER BY c) AS features FROM "
                                    "(SELECT c, arg_max(type, seq) AS reason FROM (SELECT type, seq, "
                                    "unnest(columns) AS c FROM lg) GROUP BY c) GROUP BY reason", _LOG))
def dropped_reason_groups(spark, sf):
    return X.reason_groups(X.dropped_reasons(_log(spark, sf)))


@query("feature_why", sql("ev", (
    "SELECT feature, round(score, 6) AS score, reason, CASE WHEN reason IS NULL THEN 'selected' ELSE "
    "'dropped' END AS status FROM (SELECT concat('col_', CAST(user_id % 50 AS string)) AS feature, "
    "avg(value) AS score FROM ev GROUP BY 1) LEFT JOIN (SELECT c, arg_max(type, seq) AS reason FROM "
    "(SELECT type, seq, unnest(columns) AS c FROM lg) GROUP BY c) ON c = feature"), _LOG))
def feature_why(spark, sf):
    from ..operators.explain import feature_why as why
    scores = ev(spark, sf).groupBy(F.concat(F.lit("col_"), (F.col("user_id") % 50).cast("string"))
                                   .alias("feature")).agg(F.avg("value").alias("score"))
    return round_doubles(why(scores, X.dropped_reasons(_log(spark, sf))))
