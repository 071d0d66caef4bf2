"""Feeds of filings with more overflow than any customer of the given tables has."""

from gatewright.plans.catalog import ORACLES, QUERIES

from oracle import assert_same


def test_parallel_arrays_keep_every_order_of_a_large_customer(spark, tmp_path):
    import duckdb

    many = spark.range(1, 10_041).selectExpr(
        "IF(id > 10020, 2L, 1L) AS o_custkey", "id AS o_orderkey", "TIMESTAMP_NTZ'1995-01-01 00:00:00' + make_dt_interval(CAST(id % 900 AS INT)) AS o_orderdate",
        "IF(id % 2 = 0, 'F', 'O') AS o_orderstatus", "'1-URGENT' AS o_orderpriority",
    )
    many.write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = assert_same(QUERIES["parallel_arrays_inline"](spark, str(tmp_path)), db, ORACLES["parallel_arrays_inline"])
    assert len(got) == 10_040
