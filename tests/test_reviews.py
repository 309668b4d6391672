"""Review updates: keys beyond a million, several updates of a row."""

import datetime

import duckdb
import pytest

from tessera.operators import candidates
from tessera.plans import registry


def test_shifted_keys_that_are_orders(spark, tmp_path):
    keys = [97 * i for i in range(60)] + [1_000_000 + 97 * i for i in range(0, 60, 2)] + [1_000_001, 7]
    rows = [(k, k % 5, "FOP"[k % 3], 1.0, datetime.datetime(2000, 1, 1), "x") for k in keys]
    at = str(tmp_path / "orders.parquet")
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(at)
    got = sorted(map(tuple, registry.queries()["bulk_review_update"](spark, str(tmp_path)).collect()))
    want = duckdb.sql(registry.oracle_sql()["bulk_review_update"].replace("FROM orders", f"FROM '{at}/*.parquet'")).fetchall()
    assert got == sorted(want)


@pytest.mark.parametrize("updates", [[(1, "approved"), (1, "approved"), (9, "approved")], [(1, "approved"), (1, "a")]])
def test_rows_stay_as_many(spark, updates):
    rows = spark.createDataFrame([(1, "p"), (2, "p")], "k long, status string")
    got = candidates.apply_review(rows, spark.createDataFrame(updates, "k long, new_status string"), "k")
    assert sorted(map(tuple, got.collect())) == [(1, "approved"), (2, "p")]
