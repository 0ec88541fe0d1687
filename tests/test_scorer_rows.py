"""The rows of the scoring queries are joined once."""

from tabloom.catalog import model_queries as Q


def test_steps_of_scoring_read_joined_rows(spark, tmp_path):
    customer = spark.range(8).selectExpr("id AS c_custkey", "CAST(id * 100 - 300 AS double) AS c_acctbal", "'A' AS c_mktsegment",
                                         "CAST(id % 3 AS int) AS c_nationkey")
    orders = spark.range(60).selectExpr(
        "id AS o_orderkey", "id % 8 AS o_custkey", "'F' AS o_orderstatus", "CAST(id * 7000 AS double) AS o_totalprice",
        "TIMESTAMP'1998-01-01' AS o_orderdate", "IF(id % 4 = 0, '1-URGENT', '2-HIGH') AS o_orderpriority")
    customer.write.parquet(f"{tmp_path}/customer.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    d, scorer = Q._scorer(spark, str(tmp_path))
    assert "Join" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(Q._agreement(scorer.predict_batch(d, [Q.KEY]), d, scorer).first()) == (60, 0)
