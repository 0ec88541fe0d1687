"""Base views the registered queries read, as Spark frames and as SQL for the checker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_parquet

_ORD = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
        "c_acctbal", "c_mktsegment", "c_nationkey"]

# column -> expression over `ord`; the text is valid in Spark SQL and DuckDB
_DIRTY = {
    "o_orderkey": "o_orderkey",
    "price": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END",
    "price_copy": "o_totalprice * 1.001",
    "acctbal": "CASE WHEN o_orderkey % 9 = 0 THEN -999.0 ELSE c_acctbal END",
    "mostly_missing": "CASE WHEN o_orderkey % 10 <> 0 THEN NULL ELSE c_acctbal END",
    "segment": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE c_mktsegment END",
    "priority": "CASE WHEN o_orderkey % 13 = 0 THEN 'N/A' ELSE o_orderpriority END",
    "city": "CASE WHEN o_orderkey % 997 < 6 THEN concat('rare_', CAST(o_orderkey % 997 AS string))"
            " ELSE concat('city_', CAST(c_nationkey AS string)) END",
    "order_code": "concat('CUST', CAST(o_orderkey AS string))",
    "flag": "CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END",
    "constant_col": "'k'",
    "near_constant": "CASE WHEN o_orderkey % 500 = 0 THEN 'b' ELSE 'a' END",
    "order_date": "CAST(CAST(o_orderdate AS date) AS string)",
    "num_text": "CASE WHEN o_orderkey % 20 = 0 THEN 'bad' ELSE CAST(c_nationkey AS string) END",
    "target": "CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_orderstatus END",
    "outcome": "CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_orderstatus END",
}
DIRTY_COLUMNS = list(_DIRTY)
DIRTY_NUMERIC = ["o_orderkey", "price", "price_copy", "acctbal", "mostly_missing"]
DIRTY_TEXT = [c for c in DIRTY_COLUMNS if c not in DIRTY_NUMERIC]

_LAB = {
    "label": "CASE WHEN o_totalprice > 250000 AND c_acctbal > 0 OR o_orderpriority = '1-URGENT'"
             " THEN 1 ELSE 0 END",
    "y": "CAST(0.001 * o_totalprice - 0.01 * c_acctbal + (o_orderkey % 17) AS double)",
}
_CLS = {
    "row_key": "o_orderkey",
    "label": "o_orderstatus",
    "prediction": "CASE WHEN o_orderkey % 5 = 0 THEN 'F' WHEN o_orderkey % 7 = 0 THEN 'O'"
                  " ELSE o_orderstatus END",
    "label_bin": "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END",
    "score": "round((o_totalprice + CASE WHEN o_orderstatus = 'F' THEN 20000 ELSE 0 END) / 1000)"
             " / 1000",
}
_REG = {
    "row_key": "o_orderkey",
    "label": "o_totalprice",
    "prediction": "CAST(0.9 * o_totalprice + 15000 + (o_orderkey % 17) * 100 AS double)",
}
_EV = ["event_id", "ts", "user_id", "event_type", "value"]
_LI = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
       "l_discount", "l_tax", "l_returnflag", "l_shipdate"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf}/{name}.parquet")


def _exprs(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in columns.items()]


def ord_(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(*_ORD)


def ord_dirty(spark, sf):
    return ord_(spark, sf).selectExpr(*_exprs(_DIRTY))


def ord_dup(spark, sf):
    d = ord_dirty(spark, sf)
    return d.unionAll(d.where("o_orderkey % 12 = 0"))


def ord_lab(spark, sf):
    return ord_(spark, sf).selectExpr("*", *_exprs(_LAB))


def ev(spark, sf):
    return table(spark, sf, "events").select(*_EV)


def li(spark, sf):
    return table(spark, sf, "lineitem").select(*_LI)


def pred_cls(spark, sf):
    return table(spark, sf, "orders").selectExpr(*_exprs(_CLS))


def pred_reg(spark, sf):
    return table(spark, sf, "orders").selectExpr(*_exprs(_REG))


_SQL = {
    "ord": f"SELECT {', '.join(_ORD)} FROM orders JOIN customer ON o_custkey = c_custkey",
    "ord_dirty": f"SELECT {', '.join(_exprs(_DIRTY))} FROM ord",
    "ord_dup": "SELECT * FROM ord_dirty UNION ALL SELECT * FROM ord_dirty"
               " WHERE o_orderkey % 12 = 0",
    "ord_lab": f"SELECT *, {', '.join(_exprs(_LAB))} FROM ord",
    "ev": f"SELECT {', '.join(_EV)} FROM events",
    "li": f"SELECT {', '.join(_LI)} FROM lineitem",
    "pred_cls": f"SELECT {', '.join(_exprs(_CLS))} FROM orders",
    "pred_reg": f"SELECT {', '.join(_exprs(_REG))} FROM orders",
}
_NEEDS = {"ord_dirty": ["ord"], "ord_dup": ["ord", "ord_dirty"], "ord_lab": ["ord"]}


def sql(view: str, body: str, *ctes: tuple[str, str]) -> str:
    """`body` with the view (and what it needs) and extra CTEs in front."""
    names = _NEEDS.get(view, []) + [view]
    parts = [(n, _SQL[n]) for n in names] + list(ctes)
    return "WITH " + ", ".join(f"{n} AS ({s})" for n, s in parts) + " " + body


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)
