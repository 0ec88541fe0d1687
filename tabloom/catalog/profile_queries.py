"""Queries for sources, profiling, data quality and target statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.columns import round_doubles, rounded
from ..functions.scratch import scratch_path
from ..operators import profile as P, quality as Q
from ..sources import tables as S
from .registry import query
from .views import (DIRTY_COLUMNS, DIRTY_NUMERIC, DIRTY_TEXT, ev, li, ord_, ord_dirty, ord_dup, sql,
                    table, union)

LI_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
              "l_extendedprice", "l_discount", "l_tax"]
FEATURE_NUMERIC = DIRTY_NUMERIC
FEATURE_TEXT = [c for c in DIRTY_TEXT if c != "target"]


# --- sources -----------------------------------------------------------------------------

_CUSTOMER_SQL = ("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, "
                 "round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer")


def _customer(df):
    return df.select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"),
                     rounded(F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment")


@query("csv_roundtrip", _CUSTOMER_SQL)
def csv_roundtrip(spark, sf):
    src = table(spark, sf, "customer").withColumn("Unnamed: 0", F.col("c_custkey"))
    path = scratch_path(spark, "customer.csv")
    src.write.option("header", True).csv(path)
    return _customer(S.read_csv(spark, path))


@query("json_roundtrip", _CUSTOMER_SQL)
def json_roundtrip(spark, sf):
    src = table(spark, sf, "customer")
    path = scratch_path(spark, "customer.json")
    src.write.json(path)
    return _customer(S.read_json(spark, path, src.schema))


# --- summaries ---------------------------------------------------------------------------

def _miss(c):
    return f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)"


@query("dataset_summary", sql("ord_dirty", union([
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, "
    f"round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min, "
    f"round(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 6) AS q25, "
    f"round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 6) AS q50, "
    f"round(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 6) AS q75, "
    f"round(CAST(max({c}) AS DOUBLE), 6) AS max, "
    f"round({_miss(c)}, 6) AS missing_ratio FROM ord_dirty" for c in DIRTY_NUMERIC])))
def dataset_summary(spark, sf):
    return round_doubles(P.describe_numeric(ord_dirty(spark, sf)))


def _dtype(c):
    return "bigint" if c == "o_orderkey" else "double" if c in DIRTY_NUMERIC else "string"


_AVG_MISSING = "(" + " + ".join(_miss(c) for c in DIRTY_COLUMNS) + f") / {len(DIRTY_COLUMNS)}"


@query("column_catalogue", sql("ord_dirty", union([
    f"SELECT '{c}' AS \"column\", '{_dtype(c)}' AS dtype, {str(c in DIRTY_NUMERIC).lower()} AS "
    f"is_numeric, round({_miss(c)}, 6) AS missing_pct, round({_AVG_MISSING}, 6) AS average_missing,"
    f" CAST({len(DIRTY_NUMERIC)} AS BIGINT) AS numeric_count, "
    f"CAST({len(DIRTY_TEXT)} AS BIGINT) AS categorical_count FROM ord_dirty"
    for c in DIRTY_COLUMNS])))
def column_catalogue(spark, sf):
    return round_doubles(P.column_catalogue(ord_dirty(spark, sf)))


@query("column_profile", sql("ord_dirty", union([
    f"SELECT '{c}' AS \"column\", {str(c in DIRTY_NUMERIC).lower()} AS is_numeric, "
    f"round({_miss(c)}, 6) AS missing_pct, count(DISTINCT {c}) AS unique_values FROM ord_dirty"
    for c in DIRTY_COLUMNS])))
def column_profile(spark, sf):
    return round_doubles(P.column_profile(ord_dirty(spark, sf)))


_PREVIEW = ["o_orderkey", "segment", "priority", "city", "order_code", "flag", "constant_col",
            "near_constant", "order_date", "num_text", "target", "outcome"]


@query("preview", sql("ord_dirty", "SELECT " + ", ".join(
    f"coalesce(CAST({c} AS string), '') AS {c}" for c in _PREVIEW) +
    " FROM (SELECT * FROM ord_dirty ORDER BY o_orderkey LIMIT 20)"))
def preview(spark, sf):
    return P.preview(ord_dirty(spark, sf).select(*_PREVIEW), "o_orderkey", rows=50)


@query("shape_counts", sql("ord_dirty",
       f"SELECT count(*) AS row_count, CAST({len(DIRTY_COLUMNS)} AS BIGINT) AS column_count, "
       f"CAST({len(DIRTY_COLUMNS) - 1} AS BIGINT) AS feature_count FROM ord_dirty"))
def shape_counts(spark, sf):
    return P.shape_counts(ord_dirty(spark, sf), "target")


_MISSING = union([f"SELECT '{c}' AS \"column\", {_miss(c)} AS missing_ratio FROM ord_dirty"
                  for c in DIRTY_COLUMNS])


@query("missing_ratio", sql("ord_dirty", 'SELECT "column", round(missing_ratio, 6) AS '
                            "missing_ratio FROM m", ("m", _MISSING)))
def missing_ratio(spark, sf):
    return round_doubles(P.missing_ratio(ord_dirty(spark, sf)))


@query("high_missing", sql("ord_dirty", 'SELECT "column", round(missing_ratio, 6) AS '
                           "missing_ratio FROM m WHERE missing_ratio > 0.3", ("m", _MISSING)))
def high_missing(spark, sf):
    return round_doubles(P.high_missing(ord_dirty(spark, sf)))


_CELLS = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in DIRTY_COLUMNS)
_ANY = " OR ".join(f"{c} IS NULL" for c in DIRTY_COLUMNS)
_OVERVIEW = (
    f"SELECT CAST(sum({_CELLS}) AS BIGINT) AS total_missing_cells, "
    f"count(*) FILTER (WHERE {_ANY}) AS rows_with_missing, "
    f"round(count(*) FILTER (WHERE {_ANY}) / count(*) * 100, 2) AS missing_rows_pct, "
    f"round(count(*) FILTER (WHERE {_ANY}) / count(*), 6) AS rows_with_missing_fraction, "
    "CAST(" + " + ".join(f"CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END"
                         for c in DIRTY_COLUMNS) + " AS BIGINT) AS missing_columns_count "
    "FROM ord_dirty")


@query("missing_rows", sql("ord_dirty", _OVERVIEW))
def missing_rows(spark, sf):
    return round_doubles(P.missing_overview(ord_dirty(spark, sf)))


_DUPES = ("SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, "
          "round(sum(n - 1) / sum(n) * 100, 2) AS duplicate_pct FROM "
          f"(SELECT count(*) AS n FROM {{}} GROUP BY {', '.join(DIRTY_COLUMNS)})")


@query("duplicate_rows", sql("ord_dup", _DUPES.format("ord_dup")))
def duplicate_rows(spark, sf):
    return P.duplicate_rows(ord_dup(spark, sf))


# --- correlation -------------------------------------------------------------------------

def _corr(view, cols, pairs):
    return union([f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
                  f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END AS r "
                  f"FROM {view}" for a, b in pairs])


@query("corr_matrix", sql("ord_dirty", "SELECT col_a, col_b, round(r, 6) AS r FROM m", (
    "m", _corr("ord_dirty", DIRTY_NUMERIC, [(a, b) for a in DIRTY_NUMERIC for b in DIRTY_NUMERIC]))))
def corr_matrix(spark, sf):
    return round_doubles(P.correlation_matrix(ord_dirty(spark, sf)))


@query("high_corr_pairs", sql("ord_dirty", "SELECT col_a, col_b, round(r, 6) AS r FROM m "
                              "WHERE abs(r) > 0.8", (
                                  "m", _corr("ord_dirty", DIRTY_NUMERIC,
                                             list(combinations(DIRTY_NUMERIC, 2))))))
def high_corr_pairs(spark, sf):
    return round_doubles(P.high_correlation_pairs(ord_dirty(spark, sf)))


@query("corr_pairs_lineitem", sql("li", "SELECT col_a, col_b, round(r, 6) AS r FROM m", (
    "m", _corr("li", LI_NUMERIC, list(combinations(LI_NUMERIC, 2))))))
def corr_pairs_lineitem(spark, sf):
    return round_doubles(P.correlation_pairs(li(spark, sf)))


# --- target ------------------------------------------------------------------------------

@query("class_distribution", sql("ord_dirty", "SELECT target AS label, count(*) AS n FROM "
                                 "ord_dirty WHERE target IS NOT NULL GROUP BY target"))
def class_distribution(spark, sf):
    return P.class_distribution(ord_dirty(spark, sf), "target")


@query("class_distribution_nulls", sql(
    "ord_dirty", "SELECT target AS label, count(*) AS n FROM ord_dirty GROUP BY target"))
def class_distribution_nulls(spark, sf):
    return P.class_distribution(ord_dirty(spark, sf), "target", keep_null=True)


@query("target_stats", sql("ord_dirty", "SELECT min(price) AS min, max(price) AS max, "
                           "round(avg(price), 6) AS mean, round(stddev_samp(price), 6) AS std, "
                           "round(quantile_cont(price, 0.5), 6) AS median FROM ord_dirty"))
def target_stats(spark, sf):
    return round_doubles(P.target_stats(ord_dirty(spark, sf), "price"))


@query("imbalance", sql(
    "ord_dirty", "SELECT min(n) AS min_count, max(n) AS max_count, round(max(n) / min(n), 6) AS "
    "imbalance_ratio, CASE WHEN max(n) / min(n) >= 10 THEN 'severe' WHEN max(n) / min(n) >= 3 THEN "
    "'moderate' WHEN max(n) / min(n) >= 1.5 THEN 'mild' ELSE 'none' END AS imbalance_severity "
    "FROM (SELECT count(*) AS n FROM ord_dirty GROUP BY target)"))
def imbalance(spark, sf):
    return round_doubles(P.imbalance(ord_dirty(spark, sf), "target"))


@query("class_balance", sql(
    "ord_dirty", "SELECT round(min(n) / max(n), 6) AS class_balance FROM "
    "(SELECT count(*) AS n FROM ord_dirty WHERE target IS NOT NULL GROUP BY target)"))
def class_balance(spark, sf):
    return round_doubles(P.class_balance(ord_dirty(spark, sf), "target"))


# --- outliers, placeholders, leakage -----------------------------------------------------

def _outliers(view, cols):
    return union([
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE v < a - 1.5 * (b - a) OR "
        f"v > b + 1.5 * (b - a)) AS outlier_count, count(*) FILTER (WHERE v < a - 1.5 * (b - a) OR "
        f"v > b + 1.5 * (b - a)) / count(*) * 100 AS outlier_pct FROM (SELECT {c} AS v FROM {view}),"
        f" (SELECT CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS a, "
        f"CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS b FROM {view})" for c in cols])


_EV_NUMERIC = ["event_id", "user_id", "value"]


@query("iqr_outliers", sql("ev", 'SELECT "column", outlier_count, round(outlier_pct, 6) AS '
                           "outlier_pct FROM o WHERE outlier_count > 0",
                           ("o", _outliers("ev", _EV_NUMERIC))))
def iqr_outliers(spark, sf):
    return round_doubles(P.outlier_stats(ev(spark, sf)))


@query("outlier_rollup", sql(
    "ord_dirty", "SELECT count(*) AS outlier_columns_count, round(coalesce(max(outlier_pct), 0.0), "
    "2) AS max_outlier_pct FROM o WHERE outlier_count > 0",
    ("o", _outliers("ord_dirty", DIRTY_NUMERIC))))
def outlier_rollup(spark, sf):
    return P.outlier_rollup(P.outlier_stats(ord_dirty(spark, sf)))


def _high_card(view, cols):
    return union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count FROM {view} "
                  f"HAVING count(DISTINCT {c}) > greatest(50, floor(count(*) * 0.5))" for c in cols])


@query("high_cardinality", sql("ord_dirty", _high_card("ord_dirty", DIRTY_TEXT)))
def high_cardinality(spark, sf):
    return P.high_cardinality(ord_dirty(spark, sf))


def _num_place(view, cols):
    parts = []
    for c in cols:
        top = ", ".join(f"avg(CASE WHEN {c} = {s} THEN 1.0 WHEN {c} IS NULL THEN NULL ELSE 0.0 END)"
                        for s in (-1, -999, -9999, -99, 9999, 99999, 0))
        parts.append(f"SELECT '{c}' AS \"column\", greatest({top}) AS placeholder_share FROM {view}")
    return "SELECT * FROM (" + union(parts) + ") WHERE placeholder_share > 0.05"


def _text_place(view, cols):
    words = "'n/a','na','none','null','missing','unknown','-','','?','nan'"
    return "SELECT * FROM (" + union([
        f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN NULL WHEN lower(trim({c})) IN "
        f"({words}) THEN 1.0 ELSE 0.0 END) AS placeholder_share FROM {view}"
        for c in cols]) + ") WHERE placeholder_share > 0.05"


_SHARE = 'SELECT "column", round(placeholder_share, 6) AS placeholder_share FROM p'


@query("numeric_placeholders", sql("ord_dirty", _SHARE, ("p", _num_place("ord_dirty",
                                                                         DIRTY_NUMERIC))))
def numeric_placeholders(spark, sf):
    return round_doubles(P.numeric_placeholders(ord_dirty(spark, sf)))


@query("text_placeholders", sql("ord_dirty", _SHARE, ("p", _text_place("ord_dirty", DIRTY_TEXT))))
def text_placeholders(spark, sf):
    return round_doubles(P.text_placeholders(ord_dirty(spark, sf)))


@query("leakage_signals", sql(
    "ord_dirty", "SELECT 'price_copy' AS \"column\", 'name' AS signal UNION ALL "
    "SELECT c AS \"column\", 'correlation' AS signal FROM (" + union(
        [f"SELECT '{c}' AS c, corr({c}, price) AS r FROM ord_dirty"
         for c in ("o_orderkey", "acctbal", "mostly_missing")]) + ") WHERE abs(r) > 0.995"))
def leakage_signals(spark, sf):
    return P.leakage_signals(ord_dirty(spark, sf), "price")


@query("leakage_by_correlation", sql(
    "ord_dirty", "SELECT c AS \"column\", 'correlation' AS signal FROM (" + union(
        [f"SELECT '{c}' AS c, corr({c}, amount) AS r FROM "
         "(SELECT *, price AS amount FROM ord_dirty)" for c in DIRTY_NUMERIC if c != "price"]) +
    ") WHERE abs(r) > 0.995"))
def leakage_by_correlation(spark, sf):
    return P.leakage_signals(
        ord_dirty(spark, sf).withColumnRenamed("price", "amount"), "amount")


# --- rules over the profile --------------------------------------------------------------

_FT = FEATURE_TEXT
_QUALITY = (
    "SELECT o.total_missing_cells, o.rows_with_missing, o.missing_rows_pct, "
    "o.missing_columns_count, d.duplicate_rows, d.duplicate_pct, "
    "r.outlier_columns_count, r.max_outlier_pct, "
    "(SELECT count(*) FROM hc) AS high_cardinality_count, "
    "(SELECT count(*) FROM np) + (SELECT count(*) FROM tp) AS placeholder_invalid_count, "
    "CAST(0 AS BIGINT) AS leakage_count, "
    "(SELECT count(*) FROM mm WHERE missing_ratio > 0.3) AS high_missing_count, "
    "(SELECT count(*) FROM cc WHERE abs(r) > 0.8) AS high_corr_count FROM ov o, du d, ro r")
_QUALITY_CTES = (
    ("ov", _OVERVIEW.replace("FROM ord_dirty", "FROM ord_dup")),
    ("du", _DUPES.format("ord_dup")),
    ("oo", _outliers("ord_dup", FEATURE_NUMERIC)),
    ("ro", "SELECT count(*) AS outlier_columns_count, round(coalesce(max(outlier_pct), 0.0), 2) AS "
           "max_outlier_pct FROM oo WHERE outlier_count > 0"),
    ("hc", _high_card("ord_dup", _FT)),
    ("np", _num_place("ord_dup", FEATURE_NUMERIC)), ("tp", _text_place("ord_dup", _FT)),
    ("mm", _MISSING.replace("FROM ord_dirty", "FROM ord_dup")),
    ("cc", _corr("ord_dup", FEATURE_NUMERIC, list(combinations(FEATURE_NUMERIC, 2)))),
    ("quality", _QUALITY),
)


def _quality(spark, sf):
    return Q.data_quality(ord_dup(spark, sf), "target")


@query("data_quality", sql("ord_dup", "SELECT * FROM quality", *_QUALITY_CTES))
def data_quality(spark, sf):
    return _quality(spark, sf)


@query("quality_flags", sql("ord_dup", union([
    "SELECT 'duplicate_rows' AS field, CASE WHEN duplicate_pct > 15 THEN 'high' ELSE 'medium' END "
    "AS severity, CAST(duplicate_pct AS DOUBLE) AS amount FROM quality WHERE duplicate_pct > 5",
    "SELECT 'missing_rows_pct', CASE WHEN missing_rows_pct > 50 THEN 'high' ELSE 'medium' END, "
    "missing_rows_pct FROM quality WHERE missing_rows_pct > 20",
    "SELECT 'outliers', 'medium', max_outlier_pct FROM quality WHERE outlier_columns_count >= 3 OR "
    "max_outlier_pct > 10",
    "SELECT 'high_cardinality', 'low', high_cardinality_count FROM quality WHERE "
    "high_cardinality_count > 0",
    "SELECT 'placeholder_invalids', 'medium', placeholder_invalid_count FROM quality WHERE "
    "placeholder_invalid_count > 0",
    "SELECT 'leakage_risk', 'high', leakage_count FROM quality WHERE leakage_count > 0",
]), *_QUALITY_CTES))
def quality_flags(spark, sf):
    return Q.quality_flags(_quality(spark, sf))


@query("recommendations", sql("ord_dup", union([
    "SELECT 'high_missing' AS kind, high_missing_count AS amount FROM quality WHERE "
    "high_missing_count > 0",
    "SELECT 'high_correlation', high_corr_count FROM quality WHERE high_corr_count > 0",
    "SELECT 'outliers', outlier_columns_count FROM quality WHERE outlier_columns_count > 0",
    "SELECT 'class_imbalance', CAST(1 AS BIGINT) FROM (SELECT min(n) AS a, max(n) AS b FROM (SELECT "
    "count(*) AS n FROM ord_dup WHERE target IS NOT NULL GROUP BY target)) WHERE b > 10 * a",
    "SELECT 'looks_good', CAST(0 AS BIGINT) FROM quality WHERE high_missing_count = 0 AND "
    "high_corr_count = 0 AND outlier_columns_count = 0 AND NOT (SELECT max(n) > 10 * min(n) FROM "
    "(SELECT count(*) AS n FROM ord_dup WHERE target IS NOT NULL GROUP BY target))",
]), *_QUALITY_CTES))
def recommendations(spark, sf):
    classes = P.class_distribution(ord_dup(spark, sf), "target")
    return Q.recommendations(_quality(spark, sf), classes)


@query("risk_level", sql(
    "ord_dup", "SELECT CAST(k AS BIGINT) AS issue_count, CASE WHEN k >= 3 THEN 'high' WHEN k >= 1 "
    "THEN 'medium' ELSE 'low' END AS risk_level FROM (SELECT CAST(high_missing_count > 0 AS INT) + "
    "CAST(high_corr_count > 0 AS INT) + CAST(outlier_columns_count > 0 AS INT) AS k FROM quality)",
    *_QUALITY_CTES))
def risk_level(spark, sf):
    return Q.risk_level(_quality(spark, sf))


@query("model_signals", sql(
    "ord_dirty", "SELECT (SELECT round(avg(missing_ratio), 6) FROM mm) AS avg_missing_pct, "
    "(SELECT count(*) FROM mm WHERE missing_ratio > 0.3) AS high_missing_cols, "
    "(SELECT count(*) FROM cc WHERE abs(r) > 0.8) AS high_correlation_count, "
    "(SELECT count(*) FROM cc WHERE abs(r) > 0.8) > 3 AS has_high_correlations, "
    "(SELECT count(*) FROM oo WHERE outlier_count > 0) AS outlier_columns, "
    "(SELECT count(*) FROM oo WHERE outlier_count > 0) > 0 AS has_outliers, "
    f"CAST({len(FEATURE_NUMERIC)} AS BIGINT) AS numeric_count, "
    f"CAST({len(FEATURE_TEXT)} AS BIGINT) AS categorical_count, "
    "CAST(1.0 AS DOUBLE) AS dimensionality_ratio",
    ("mm", _MISSING), ("oo", _outliers("ord_dirty", FEATURE_NUMERIC)),
    ("cc", _corr("ord_dirty", FEATURE_NUMERIC, list(combinations(FEATURE_NUMERIC, 2))))))
def model_signals(spark, sf):
    return round_doubles(Q.model_signals(ord_dirty(spark, sf), "target"))
