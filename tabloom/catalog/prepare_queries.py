"""Queries for type inference, column checks, row filters, splits and column transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import PrepareConfig
from ..functions.columns import normalize_text, numeric_columns, ref, round_doubles, rounded, to_long
from ..functions.lookups import lookup
from ..functions.scratch import settle
from ..operators import checks as C, encode as E, prepare as X, rows as R, scale as Z, split as G
from ..operators import types as T
from .registry import query
from .views import (DIRTY_COLUMNS, DIRTY_NUMERIC, DIRTY_TEXT, ev, li, ord_, ord_dirty, ord_lab, sql,
                    table, union)

KEY = "o_orderkey"


def _bool(x: bool) -> str:
    return "TRUE" if x else "FALSE"


def _flags(spark, name, columns, chosen):
    hit = set(chosen)
    return spark.createDataFrame([(c, c in hit) for c in columns], f"column string, {name} boolean")


# --- semantic types ----------------------------------------------------------------------

_CODE = r"^[A-Za-z0-9\\-_]+$"


def _values(c: str) -> str:
    return f"(SELECT CAST({c} AS string) AS v FROM ord_dirty WHERE {c} IS NOT NULL)"


_SHARES = union([
    f"SELECT '{c}' AS \"column\", (SELECT count(*) FROM {_values(c)}) AS present, "
    f"(SELECT round(avg(CASE WHEN regexp_full_match(v, '[0-9]+') THEN 1.0 ELSE 0.0 END), 6) FROM "
    f"{_values(c)}) AS digits_share, "
    f"(SELECT round(avg(CASE WHEN TRY_CAST(v AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) "
    f"FROM {_values(c)}) AS date_share, "
    f"(SELECT round(avg(CASE WHEN regexp_matches(v, '{_CODE}') THEN 1.0 ELSE 0.0 END), 6) FROM "
    f"{_values(c)}) AS code_share" for c in DIRTY_TEXT])


def _shares(spark, sf):
    return round_doubles(T.text_shares(ord_dirty(spark, sf), DIRTY_TEXT))


@query("datetime_like", sql("ord_dirty", 'SELECT "column", present, digits_share, date_share, '
                            "present >= 3 AND digits_share <= 0.9 AND date_share >= 0.8 AS "
                            "is_datetime FROM s", ("s", _SHARES)))
def datetime_like(spark, sf):
    return _shares(spark, sf).select(
        "column", "present", "digits_share", "date_share",
        ((F.col("present") >= 3) & (F.col("digits_share") <= 0.9)
         & (F.col("date_share") >= 0.8)).alias("is_datetime"))


@query("code_like", sql("ord_dirty", 'SELECT "column", code_share, code_share >= 0.9 AS is_code '
                        "FROM s", ("s", _SHARES)))
def code_like(spark, sf):
    return _shares(spark, sf).select("column", "code_share",
                                     (F.col("code_share") >= 0.9).alias("is_code"))


_WORDS = "'0','1','false','true','n','no','y','yes','f','t'"


def _binary(c):
    words = "TRUE" if c in DIRTY_NUMERIC else f"bool_and(lower(trim({c})) IN ({_WORDS}))"
    return f"count(DISTINCT {c}) BETWEEN 1 AND 2 AND {words}"


@query("binary_columns", sql("ord_dirty", union([
    f"SELECT '{c}' AS \"column\", {_binary(c)} AS is_binary FROM ord_dirty" for c in DIRTY_COLUMNS])))
def binary_columns(spark, sf):
    d = ord_dirty(spark, sf)
    return _flags(spark, "is_binary", d.columns, T.binary_like(d, T.column_facts(d), d.columns))


def _kind(c):
    dt = ("FALSE" if c in DIRTY_NUMERIC else
          f"(SELECT present >= 3 AND digits_share <= 0.9 AND date_share >= 0.8 FROM s WHERE "
          f"\"column\" = '{c}')")
    plain = "numeric" if c in DIRTY_NUMERIC else "categorical"
    return (f"SELECT '{c}' AS \"column\", CASE WHEN {dt} THEN 'datetime' WHEN (SELECT {_binary(c)} "
            f"FROM ord_dirty) THEN 'binary' ELSE '{plain}' END AS kind")


@query("column_types", sql("ord_dirty", union([_kind(c) for c in DIRTY_COLUMNS]), ("s", _SHARES)))
def column_types(spark, sf):
    d = ord_dirty(spark, sf)
    return spark.createDataFrame(list(T.detect_types(d).items()), "column string, kind string")


_TASKS = {"o_orderstatus": "text", "label": "int", "c_nationkey": "int", "o_totalprice": "real",
          "o_orderkey": "int"}


def _task(c, kind, divisor):
    if kind == "text":
        return "'classification'"
    if kind == "real":
        return "'regression'"
    return (f"CASE WHEN count(DISTINCT {c}) <= least(20, greatest(2, count({c}) // {divisor})) THEN "
            "'classification' ELSE 'regression' END")


@query("task_type", sql("ord_lab", union([
    f"SELECT '{c}' AS target, {_task(c, k, 10)} AS task, {_task(c, k, 5)} AS feature_stage_task "
    f"FROM ord_lab" + (" LIMIT 1" if k in ("text", "real") else "")
    if k == "int" else
    f"SELECT '{c}' AS target, {_task(c, k, 10)} AS task, {_task(c, k, 5)} AS feature_stage_task"
    for c, k in _TASKS.items()])))
def task_type(spark, sf):
    d = ord_lab(spark, sf)
    return spark.createDataFrame([(c, T.task_type(d, c), T.task_type(d, c, 5)) for c in _TASKS],
                                 "target string, task string, feature_stage_task string")


def _norm(c):
    return f"trim(regexp_replace(lower(trim({c})), '[^a-z0-9]+', '_', 'g'), '_')"


@query("normalize_names", f"SELECT c_custkey, {_norm('c_name')} AS name, "
                          f"{_norm('c_mktsegment')} AS segment FROM customer")
def normalize_names(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", normalize_text(F.col("c_name")).alias("name"),
        normalize_text(F.col("c_mktsegment")).alias("segment"))


def _identifier(c):
    if c in DIRTY_NUMERIC and c != KEY:
        code = "FALSE"
    else:
        code = (f"(SELECT avg(CASE WHEN regexp_matches(v, '{_CODE}') THEN 1.0 ELSE 0.0 END) >= 0.9 "
                f"FROM {_values(c)})")
    runs = (f"(max({c}) - min({c}) + 1 = count({c}) AND count(DISTINCT {c}) = count({c}) AND "
            f"bool_and({c} = round({c})))" if c in DIRTY_NUMERIC else "FALSE")
    return (f"count(*) >= 20 AND count(DISTINCT {c}) >= greatest(20, floor(count(*) * 0.5)) AND "
            f"count(DISTINCT {c}) / count({c}) >= 0.98 AND ({code} OR {runs})")


@query("identifier_columns", sql("ord_dirty", union([
    f"SELECT '{c}' AS \"column\" FROM ord_dirty HAVING {_identifier(c)}" for c in DIRTY_COLUMNS])))
def identifier_columns(spark, sf):
    found = T.identifier_columns(ord_dirty(spark, sf))
    return spark.createDataFrame([(c,) for c in found], "column string")


@query("sequential_index", sql("ev", union([
    f"SELECT '{c}' AS \"column\", count({c}) >= 5 AND bool_and({c} = round({c})) AND "
    f"max({c}) - min({c}) + 1 = count({c}) AND count(DISTINCT {c}) = count({c}) AS is_sequential "
    "FROM ev" for c in ("event_id", "user_id", "value")])))
def sequential_index(spark, sf):
    return T.sequential_columns(ev(spark, sf), ["event_id", "user_id", "value"])


# --- column checks -----------------------------------------------------------------------

def _variance(c):
    return (f"SELECT '{c}' AS \"column\", CASE WHEN count(*) = 1 THEN 'constant' WHEN max(n) / "
            f"sum(n) >= 0.99 AND count(*) <= 10 THEN 'other' END AS reason FROM (SELECT count(*) AS "
            f"n FROM ord_dirty WHERE {c} IS NOT NULL GROUP BY {c})")


_LOW_VARIANCE = 'SELECT "column", reason FROM (' + union(
    [_variance(c) for c in DIRTY_COLUMNS]) + ") WHERE reason IS NOT NULL"


@query("low_variance", sql("ord_dirty", _LOW_VARIANCE))
def low_variance(spark, sf):
    return C.drops_frame(spark, C.low_variance(ord_dirty(spark, sf))).drop("detail")


_FEATURES = [c for c in DIRTY_COLUMNS if c != "target"]


def _copy_of_target(c):
    return f"bool_and(CAST({c} AS string) IS NOT DISTINCT FROM target)"


@query("target_copy_leak", sql("ord_dirty", union([
    f"SELECT '{c}' AS \"column\", {_copy_of_target(c)} AS repeats_target, FALSE AS similar_name "
    "FROM ord_dirty" for c in _FEATURES])))
def target_copy_leak(spark, sf):
    d = ord_dirty(spark, sf)
    drops, similar = C.target_leakage(d, "target")
    hit = {x.column for x in drops}
    return spark.createDataFrame([(c, c in hit, c in similar) for c in _FEATURES],
                                 "column string, repeats_target boolean, similar_name boolean")


@query("copy_columns", sql("ord_dirty", "SELECT 'price_copy' AS \"column\" FROM ord_dirty HAVING "
                           "abs(corr(price_copy, price)) >= 0.95"))
def copy_columns(spark, sf):
    return spark.createDataFrame([(c,) for c in C.copy_columns(ord_dirty(spark, sf))],
                                 "column string")


_CASES = {
    "all": _FEATURES,
    "few_gaps": ["price_copy", "acctbal", "city", "outcome"],
    "complete": ["price_copy", "acctbal", "city"],
    "sparse_only": ["price_copy", "mostly_missing", "city"],
}


def _strategy(name, cols):
    share = {c: f"(SELECT avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) FROM ord_dirty)"
             for c in cols}
    any_left = " OR ".join(f"({c} IS NULL AND {share[c]} < 0.5)" for c in cols)
    dropped = " + ".join(f"CASE WHEN {share[c]} >= 0.5 THEN 1 ELSE 0 END" for c in cols)
    holes = " + ".join(share.values())
    return (f"SELECT '{name}' AS scenario, CASE WHEN holes = 0 THEN 'none' WHEN dropped > 0 AND "
            "gap > 0 THEN 'mixed' WHEN dropped > 0 THEN 'drop_columns' WHEN rows_ok THEN "
            "'drop_rows' ELSE 'impute' END AS strategy, CAST(dropped AS BIGINT) AS dropped_columns,"
            " rows_ok AS drop_rows, round(gap, 6) AS gap_fraction FROM (SELECT holes, dropped, gap, "
            "n >= 1000 AND gap > 0 AND gap <= 0.04 AS rows_ok FROM (SELECT count(*) AS n, "
            f"avg(CASE WHEN {any_left} THEN 1.0 ELSE 0.0 END) AS gap, {dropped} AS dropped, {holes} "
            "AS holes FROM ord_dirty))")


@query("missing_strategy", sql("ord_dirty", union([_strategy(n, c) for n, c in _CASES.items()])))
def missing_strategy(spark, sf):
    d = ord_dirty(spark, sf)
    rows = []
    for name, cols in _CASES.items():
        s = C.missing_strategy(d, columns=cols)
        rows.append((name, s.strategy, len(s.drop_columns), s.drop_rows,
                     round(s.rows_with_missing_fraction, 6)))
    return spark.createDataFrame(rows, "scenario string, strategy string, dropped_columns long, "
                                       "drop_rows boolean, gap_fraction double")


def _drop_reason(c):
    share = f"(SELECT avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) FROM ord_dirty)"
    return (f"SELECT '{c}' AS \"column\", CASE WHEN (SELECT {_identifier(c)} FROM ord_dirty) THEN "
            f"'identifier' WHEN (SELECT reason FROM lv WHERE \"column\" = '{c}') IS NOT NULL THEN "
            f"(SELECT reason FROM lv WHERE \"column\" = '{c}') WHEN (SELECT {_copy_of_target(c)} FROM "
            f"ord_dirty) THEN 'leakage_risk' WHEN {share} >= 0.5 THEN 'sparse' WHEN '{c}' = "
            "'num_text' THEN 'manual' END AS reason")


@query("drop_plan", sql("ord_dirty", 'SELECT "column", reason FROM (' + union(
    [_drop_reason(c) for c in _FEATURES if c != "near_constant"]) + ") WHERE reason IS NOT NULL",
    ("lv", _LOW_VARIANCE)))
def drop_plan(spark, sf):
    """Identifier, variance, leakage and sparse drops; one forced keep and one forced drop."""
    d = ord_dirty(spark, sf)
    cfg = PrepareConfig(force_keep_columns=("near_constant",), force_drop_columns=("num_text",))
    facts = T.column_facts(d, _FEATURES)
    ids = [C.Drop(c, "identifier", why)
           for c, why in T.identifier_columns(d, cfg, _FEATURES, facts).items()]
    plan = C.merge_drops(
        ids, C.low_variance(d, cfg, _FEATURES, facts), C.target_leakage(d, "target")[0],
        C.sparse_drops(C.missing_strategy(d, cfg, _FEATURES)), keep=cfg.force_keep_columns,
        force=cfg.force_drop_columns, available=_FEATURES)
    return C.drops_frame(spark, plan).drop("detail")


# --- rows and columns --------------------------------------------------------------------

@query("row_filter", sql("ord_dirty", "SELECT o_orderkey, target FROM ord_dirty WHERE target IS NOT "
                         "NULL AND price IS NOT NULL AND segment IS NOT NULL"))
def row_filter(spark, sf):
    return R.modeling_rows(ord_dirty(spark, sf), "target", ["price", "segment"], True).select(
        KEY, "target")


@query("split_target", sql("ord_dirty", f"SELECT target, {len(DIRTY_COLUMNS) - 1} AS features, count(*) AS n FROM ord_dirty GROUP BY target"))
def split_target(spark, sf):
    """The target apart from its features: how often each value occurs, beside the number of features."""
    features, target = R.split_target(ord_dirty(spark, sf), "target")
    return target.groupBy("target").agg(F.lit(len(features.columns)).alias("features"), F.count(F.lit(1)).alias("n"))


@query("missing_target_filter", sql(
    "ord_dirty", "SELECT count(*) FILTER (WHERE target IS NULL) AS rows_removed, "
    "count(target) AS rows_kept FROM ord_dirty"))
def missing_target_filter(spark, sf):
    return R.rows_without_target(ord_dirty(spark, sf), "target")


@query("select_kept", sql("ord_dirty", "SELECT o_orderkey, segment, city FROM ord_dirty"))
def select_kept(spark, sf):
    return R.select_listed(ord_dirty(spark, sf), [KEY, "no_such_column", "segment", "city"])


@query("align_columns", sql("ord_dirty", "SELECT o_orderkey, CAST(0.0 AS DOUBLE) AS extra, flag FROM "
                            "ord_dirty"))
def align_columns(spark, sf):
    return R.align_columns(ord_dirty(spark, sf), [KEY, "extra", "flag"])


@query("numeric_columns", sql("ord_dirty", "SELECT o_orderkey, round(price, 6) AS price, "
                              "round(price_copy, 6) AS price_copy, CAST(acctbal AS DOUBLE) AS "
                              "acctbal, mostly_missing FROM ord_dirty"))
def numeric_columns_(spark, sf):
    d = ord_dirty(spark, sf)
    return round_doubles(d.select(*[ref(c) for c in numeric_columns(d)]))


@query("semi_join_rows", sql("ord", "SELECT o_orderkey, o_orderstatus FROM ord WHERE o_orderkey IN "
                             "(SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"))
def semi_join_rows(spark, sf):
    keys = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias(KEY))
    return R.rows_with_keys(ord_(spark, sf), keys, KEY).select(KEY, "o_orderstatus")


@query("align_blocks", sql("ord", "SELECT o.o_orderkey, round(o.o_totalprice, 6) AS o_totalprice, "
                           "o.c_mktsegment FROM ord o JOIN orders r ON o.o_orderkey = r.o_orderkey"))
def align_blocks(spark, sf):
    left = table(spark, sf, "orders").select(KEY, rounded(F.col("o_totalprice")).alias("o_totalprice"))
    return R.beside(left, ord_(spark, sf).select(KEY, "c_mktsegment"), KEY)


_FREQ = ("SELECT o_orderkey, round(coalesce(n / t, 0.0), 6) AS city__frequency FROM ord_dirty LEFT "
         "JOIN (SELECT city AS v, count(*) AS n FROM ord_dirty WHERE o_orderstatus_ = 'F' GROUP BY "
         "city) ON city = v, (SELECT count(*) AS t FROM ord_dirty WHERE o_orderstatus_ = 'F')")


@query("frequency_lookup", sql("ord_dirty", _FREQ.replace("o_orderstatus_", "outcome")))
def frequency_lookup(spark, sf):
    """Shares fitted on one class, looked up for every row."""
    d = ord_dirty(spark, sf)
    t = E.frequency_table(d.where("outcome = 'F'"), "city")
    return lookup(d, "city", t, F.lit(0.0), "city__frequency").select(
        KEY, rounded(F.col("city__frequency")).alias("city__frequency"))


# --- splits ------------------------------------------------------------------------------

def _split_sql(view, cls):
    return sql(view, "SELECT o_orderkey, cls, CASE WHEN row_number() OVER (PARTITION BY cls ORDER BY "
               "d) <= nc - train THEN 'test' ELSE 'train' END AS split FROM k JOIN b USING (cls)",
               ("k", f"SELECT o_orderkey, {cls} AS cls, md5(concat('42:', CAST(o_orderkey AS "
                     f"string))) AS d FROM {view}"),
               ("n", "SELECT count(*) AS n, count(*) - CAST(ceil(0.2 * count(*)) AS BIGINT) AS "
                     "n_train FROM k"),
               ("c", "SELECT cls, count(*) AS nc, count(*) * any_value(n_train) // any_value(n) AS "
                     "base, count(*) * any_value(n_train) % any_value(n) AS rest FROM k, n "
                     "GROUP BY cls"),
               ("b", "SELECT cls, nc, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, cls) <= "
                     "(SELECT n_train FROM n) - sum(base) OVER () THEN 1 ELSE 0 END AS train FROM c"))


@query("split_stratified", _split_sql("ord", "o_orderstatus"))
def split_stratified(spark, sf):
    return G.train_test_split(ord_(spark, sf), KEY, "o_orderstatus").select(
        KEY, F.col("o_orderstatus").alias("cls"), "split")


@query("split_plain", _split_sql("ord", "'all'").replace("o_orderkey, cls, CASE", "o_orderkey, CASE"))
def split_plain(spark, sf):
    return G.train_test_split(ord_(spark, sf), KEY).select(KEY, "split")


@query("split_sizes", _split_sql("ord", "o_orderstatus").replace(
    "SELECT o_orderkey, cls, CASE", "SELECT cls AS label, split, count(*) AS n FROM (SELECT "
    "o_orderkey, cls, CASE") + ") GROUP BY cls, split")
def split_sizes(spark, sf):
    return G.split_sizes(G.train_test_split(ord_(spark, sf), KEY, "o_orderstatus"), "o_orderstatus")


@query("kfold_assign", sql("ord", "SELECT o_orderkey, CAST(ntile(5) OVER (PARTITION BY o_orderstatus "
                           "ORDER BY md5(concat('42:', CAST(o_orderkey AS string)))) - 1 AS INT) AS fold "
                           "FROM ord"))
def kfold_assign(spark, sf):
    return G.assign_folds(ord_(spark, sf), KEY, 5, "o_orderstatus").select(KEY, "fold")


@query("stride_sample", sql("ev", "SELECT event_id, round(value, 6) AS value FROM (SELECT event_id, "
                            "value, row_number() OVER (ORDER BY event_id) - 1 AS p FROM ev) WHERE p IN "
                            "(SELECT (i * (SELECT count(*) FROM ev)) // 140 FROM range(140) t(i))"))
def stride_sample(spark, sf):
    return G.stride_sample(ev(spark, sf).select("event_id", rounded(F.col("value")).alias("value")),
                           "event_id", 140)


# --- transforms --------------------------------------------------------------------------

@query("datetime_expand", sql("ord_dirty", (
    "SELECT o_orderkey, CAST(year(t) AS DOUBLE) AS order_date__year, CAST(month(t) AS DOUBLE) AS "
    "order_date__month, CAST(day(t) AS DOUBLE) AS order_date__day, CAST(isodow(t) - 1 AS DOUBLE) AS "
    "order_date__dayofweek FROM (SELECT o_orderkey, CAST(order_date AS date) AS t FROM ord_dirty)")))
def datetime_expand(spark, sf):
    d = ord_dirty(spark, sf).select(KEY, "order_date")
    return X.apply_dates(d, X.fit_dates(d, ["order_date"]))


@query("datetime_clock", sql("ev", (
    "SELECT event_id, CAST(day(ts) AS DOUBLE) AS ts__day, "
    "CAST(isodow(ts) - 1 AS DOUBLE) AS ts__dayofweek, CAST(hour(ts) AS DOUBLE) AS ts__hour, "
    "CAST(minute(ts) AS DOUBLE) AS ts__minute FROM ev")))
def datetime_clock(spark, sf):
    d = ev(spark, sf).select("event_id", "ts")
    return X.apply_dates(d, X.fit_dates(d, ["ts"]))


@query("datetime_ordinal", sql("ev", (
    "SELECT event_id, CAST(datediff('day', DATE '0001-01-01', make_date(year(ts), 1, 1)) + 1 AS DOUBLE) "
    "AS period__ordinal FROM ev")))
def datetime_ordinal(spark, sf):
    """A date with no varying part keeps only its day number: here the year of each event."""
    d = ev(spark, sf).select("event_id", F.trunc(F.col("ts").cast("date"), "year").alias("period"))
    return X.apply_dates(d, X.fit_dates(d, ["period"]))


@query("numeric_coerce", sql("ord_dirty", "SELECT o_orderkey, TRY_CAST(num_text AS DOUBLE) AS number "
                             "FROM ord_dirty"))
def numeric_coerce(spark, sf):
    return ord_dirty(spark, sf).select(KEY, X.to_number(F.col("num_text")).alias("number"))


_TRAIN = ("t", "SELECT *, row_number() OVER (ORDER BY md5(concat('42:', CAST(o_orderkey AS string))))"
               " > ceil(0.2 * count(*) OVER ()) AS is_train FROM ord_dirty")


def _split_dirty(spark, sf):
    """The split table is written once: fitting and applying both read it."""
    d = settle(G.train_test_split(ord_dirty(spark, sf), KEY), "split")
    return d, d.where("split = 'train'")


@query("impute_median", sql("ord_dirty", (
    "SELECT o_orderkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM t WHERE "
    "is_train)), 6) AS price, round(coalesce(mostly_missing, (SELECT quantile_cont(mostly_missing, "
    "0.5) FROM t WHERE is_train)), 6) AS mostly_missing FROM t"), _TRAIN))
def impute_median(spark, sf):
    d, train = _split_dirty(spark, sf)
    cols = ["price", "mostly_missing"]
    return round_doubles(X.apply_cleaning(d.select(KEY, *cols), cols, [],
                                          X.fit_medians(train, cols), {}))


def _mode(c, src, where=""):
    return (f"(SELECT {c} FROM {src} WHERE {c} IS NOT NULL {where} GROUP BY {c} ORDER BY count(*) "
            f"DESC, {c} LIMIT 1)")


@query("impute_mode", sql("ord_dirty", (
    f"SELECT o_orderkey, coalesce(segment, {_mode('segment', 't', 'AND is_train')}) AS segment, "
    f"coalesce(outcome, {_mode('outcome', 't', 'AND is_train')}) AS outcome FROM t"), _TRAIN))
def impute_mode(spark, sf):
    d, train = _split_dirty(spark, sf)
    cols = ["segment", "outcome"]
    return X.apply_cleaning(d.select(KEY, *cols), [], cols, {}, X.fit_modes(train, cols))


@query("impute_all", sql("ord_dirty", (
    "SELECT o_orderkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM ord_dirty)), 6)"
    f" AS price, coalesce(segment, {_mode('segment', 'ord_dirty')}) AS segment FROM ord_dirty")))
def impute_all(spark, sf):
    d = ord_dirty(spark, sf).select(KEY, "price", "segment")
    return round_doubles(X.apply_cleaning(d, ["price"], ["segment"], X.fit_medians(d, ["price"]),
                                          X.fit_modes(d, ["segment"])))


_RARE = ("SELECT city FROM (SELECT city, count(*) AS n, sum(count(*)) OVER () AS total FROM ord_dirty "
         "GROUP BY city) WHERE n / total < 0.01")


@query("rare_group", sql("ord_dirty", (
    f"SELECT o_orderkey, CASE WHEN (SELECT count(*) FROM ({_RARE})) >= 2 AND (SELECT count(*) FROM "
    f"ord_dirty WHERE city IN ({_RARE})) <= 0.2 * (SELECT count(*) FROM ord_dirty) AND (SELECT "
    f"count(DISTINCT city) FROM ord_dirty) >= 10 AND city IN ({_RARE}) THEN 'Other' ELSE city END "
    "AS city FROM ord_dirty")))
def rare_group(spark, sf):
    d = ord_dirty(spark, sf).select(KEY, "city")
    plan = X.fit_rare(d, "city")
    return X.apply_rare(d, [plan] if plan else [])


@query("skew", sql("ev", union([
    f"SELECT '{c}' AS \"column\", count({c}) AS n, round(skewness({c}), 6) AS skew, "
    f"round(CAST(min({c}) AS DOUBLE), 6) AS low, count({c}) >= 8 AND count(DISTINCT {c}) > 5 AND "
    f"skewness({c}) >= 1 AND min({c}) >= 0 AS is_skewed FROM ev" for c in
    ("event_id", "user_id", "value")])))
def skew(spark, sf):
    d, cols = ev(spark, sf), ["event_id", "user_id", "value"]
    chosen = X.skewed_columns(d, cols)
    return round_doubles(X.skew_stats(d, cols).drop("sketch").withColumn(
        "is_skewed", F.col("column").isin(*chosen) if chosen else F.lit(False)))


@query("log1p_floor", sql("ord_dirty", "SELECT o_orderkey, round(ln(1 + greatest(acctbal, 0.0)), 6) AS"
                          " acctbal, round(ln(1 + CASE WHEN price IS NULL THEN NULL ELSE "
                          "greatest(price, 0.0) END), 6) AS price FROM ord_dirty"))
def log1p_floor(spark, sf):
    d = ord_dirty(spark, sf).select(KEY, "acctbal", "price")
    return round_doubles(X.apply_logs(d, ["acctbal", "price"]))


@query("log1p_shift", sql("ev", (
    "SELECT event_id, CASE WHEN (SELECT skewness(value) FROM ev) > 1 THEN round(ln(1 + value + CASE "
    "WHEN (SELECT min(value) FROM ev) <= -1 THEN abs((SELECT min(value) FROM ev)) + 1 ELSE 0 END), 6)"
    " ELSE round(value, 6) END AS value, CASE WHEN (SELECT skewness(-exp(-value / 20)) FROM ev) > 1 "
    "THEN NULL ELSE round(-exp(-value / 20), 6) END AS mirrored, round(CASE WHEN (SELECT "
    "skewness(value - 50) FROM ev) > 1 THEN ln(1 + value - 50 + abs((SELECT min(value - 50) FROM ev))"
    " + 1) ELSE value - 50 END, 6) AS below FROM ev")))
def log1p_shift(spark, sf):
    d = ev(spark, sf).select("event_id", "value", (-F.exp(-F.col("value") / 20)).alias("mirrored"),
                             (F.col("value") - 50).alias("below"))
    return round_doubles(X.apply_shifted_logs(
        d, X.fit_shifted_logs(d, ["value", "mirrored", "below"])))


# --- encodings ---------------------------------------------------------------------------

_ENC = ["segment", "priority", "city", "order_code", "order_date"]


@query("encoding_choice", sql("ord_dirty", union([
    f"SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) <= 20 THEN 'onehot' ELSE 'frequency' "
    "END AS strategy FROM ord_dirty" for c in _ENC if c != "priority"]) +
    " UNION ALL SELECT 'flag', 'binary' UNION ALL SELECT 'priority', 'frequency'"))
def encoding_choice(spark, sf):
    cfg = PrepareConfig(encoding_strategy_overrides={"priority": "frequency"})
    plan = E.choose_encodings(ord_dirty(spark, sf), _ENC, ["flag"], cfg)
    return spark.createDataFrame(list(plan.items()), "column string, strategy string")


@query("binary_encode", sql("ord_dirty", "SELECT o_orderkey, CAST(CASE WHEN flag = (SELECT max(flag) "
                            "FROM ord_dirty) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS flag FROM ord_dirty"))
def binary_encode(spark, sf):
    d = ord_dirty(spark, sf)
    return d.select(KEY, E.binary_code(ref("flag"), E.small_levels(d, ["flag"])["flag"]).alias("flag"))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("onehot", sql("ord", "SELECT o_orderkey, " + ", ".join(
    f"CAST(c_mktsegment = '{s}' AS DOUBLE) AS c_mktsegment__{s}" for s in _SEGMENTS) + " FROM ord"))
def onehot(spark, sf):
    d = ord_(spark, sf)
    levels = E.small_levels(d, ["c_mktsegment"])["c_mktsegment"]
    return d.select(KEY, *E.onehot_columns("c_mktsegment", levels))


@query("frequency_encode", sql("ord_dirty", (
    "SELECT o_orderkey, round(coalesce(n / (SELECT count(city) FROM t WHERE is_train), 0.0), 6) AS "
    "city__frequency FROM t LEFT JOIN (SELECT city AS v, count(*) AS n FROM t WHERE is_train GROUP BY "
    "city) ON city = v"), _TRAIN))
def frequency_encode(spark, sf):
    d, train = _split_dirty(spark, sf)
    plan = E.EncodingPlan({"city": "frequency"}, {}, {"city": E.frequency_table(train, "city")})
    return round_doubles(E.apply_encodings(d, plan, [], keep=[KEY]))


@query("ordinal_encode", sql("ord_dirty", (
    "SELECT o_orderkey, coalesce(CAST(a.code AS DOUBLE), -1.0) AS city, coalesce(CAST(b.code AS "
    "DOUBLE), -1.0) AS order_date FROM t LEFT JOIN (SELECT city AS v, row_number() OVER (ORDER BY "
    "city) - 1 AS code FROM (SELECT DISTINCT city FROM t WHERE is_train)) a ON city = a.v LEFT JOIN "
    "(SELECT order_date AS v, row_number() OVER (ORDER BY order_date) - 1 AS code FROM (SELECT "
    "DISTINCT order_date FROM t WHERE is_train)) b ON order_date = b.v"), _TRAIN))
def ordinal_encode(spark, sf):
    d, train = _split_dirty(spark, sf)
    return E.ordinal_encode(d.select(KEY, "city", "order_date"), train, ["city", "order_date"])


@query("target_encode", sql("ord", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY "
                            "o_orderstatus) - 1 AS DOUBLE) AS target_code FROM ord"))
def target_encode(spark, sf):
    d = ord_(spark, sf)
    codes = E.label_codes(d, "o_orderstatus")
    return E.with_label_codes(d, "o_orderstatus", codes, "target_code").select(KEY, "target_code")


# --- scaling -----------------------------------------------------------------------------

def _heavy(view, c):
    return (f"(SELECT count(v) >= 8 AND any_value(q3) > any_value(q1) AND avg(CASE WHEN v < q1 - 1.5 *"
            f" (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0.0 END) >= 0.05 FROM (SELECT {c} "
            f"AS v FROM {view} WHERE {c} IS NOT NULL), (SELECT quantile_cont({c}, 0.25) AS q1, "
            f"quantile_cont({c}, 0.75) AS q3 FROM {view}))")


@query("scaler_choice", sql("ev", (
    f"SELECT 'value' AS columns, CASE WHEN {_heavy('ev', 'value')} THEN 'RobustScaler' ELSE "
    f"'StandardScaler' END AS scaler UNION ALL SELECT 'user_id', CASE WHEN {_heavy('ev', 'user_id')} "
    "THEN 'RobustScaler' ELSE 'StandardScaler' END UNION ALL SELECT 'value squared', CASE WHEN "
    f"{_heavy('(SELECT value * value AS value FROM ev)', 'value')} THEN 'RobustScaler' ELSE "
    "'StandardScaler' END UNION ALL SELECT 'none', 'None'")))
def scaler_choice(spark, sf):
    d = ev(spark, sf)
    sq = d.select((F.col("value") * F.col("value")).alias("value"))
    rows = [("value", Z.choose_scaler(d, ["value"]).scaler),
            ("user_id", Z.choose_scaler(d, ["user_id"]).scaler),
            ("value squared", Z.choose_scaler(sq, ["value"]).scaler),
            ("none", Z.choose_scaler(d, []).scaler)]
    return spark.createDataFrame(rows, "columns string, scaler string")


@query("standard_scale", sql("ord", "SELECT o_orderkey, round((o_totalprice - (SELECT "
                             "avg(o_totalprice) FROM ord)) / (SELECT stddev_pop(o_totalprice) FROM "
                             "ord), 6) AS o_totalprice, round((c_acctbal - (SELECT avg(c_acctbal) FROM"
                             " ord)) / (SELECT stddev_pop(c_acctbal) FROM ord), 6) AS c_acctbal FROM "
                             "ord"))
def standard_scale(spark, sf):
    d, cols = ord_(spark, sf).select(KEY, "o_totalprice", "c_acctbal"), ["o_totalprice", "c_acctbal"]
    return round_doubles(Z.apply_scaler(d, Z.fit_scaler(d, cols, "StandardScaler")))


@query("robust_scale", sql("ev", "SELECT event_id, round((value - (SELECT quantile_cont(value, 0.5) "
                           "FROM ev)) / (SELECT quantile_cont(value, 0.75) - quantile_cont(value, "
                           "0.25) FROM ev), 6) AS value FROM ev"))
def robust_scale(spark, sf):
    d = ev(spark, sf).select("event_id", "value")
    return round_doubles(Z.apply_scaler(d, Z.fit_scaler(d, ["value"], "RobustScaler")))


@query("minmax", sql("ev", "SELECT event_id, round((value - (SELECT min(value) FROM ev)) / (SELECT "
                     "max(value) - min(value) FROM ev), 6) AS scaled FROM ev"))
def minmax(spark, sf):
    return round_doubles(X.min_max(ev(spark, sf), "value", "scaled").select("event_id", "scaled"))
