"""Queries by wireless line on orders whose suppliers share a phone: numbers repeat after 10,000 suppliers."""

import duckdb
import pytest

from ledgerloom.operators import wireless
from ledgerloom.plans import catalog
from tests.test_queries import normal

ITEMS = [(1, 7, 10.5, 30.0), (1, 10007, 20.25, 3.0), (1, 20007, 20.25, 26.0), (1, 8, 20.25, 50.0), (2, 10007, 1234.5, 1.0), (3, 30008, 5.0, 26.0), (3, 40008, 5.0, 2.0), (3, 40008, 4.0, 27.0)]


@pytest.mark.parametrize("name", ["wireless_charges", "wireless_usage", "wireless_inventory", "wireless_blocks", "wireless_account_charges", "wireless_summary"])
def test_suppliers_with_one_phone(spark, tmp_path, name):
    rows = spark.createDataFrame(ITEMS, "l_orderkey long, l_suppkey long, l_extendedprice double, l_quantity double")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    df, sql = catalog.QUERIES[name](spark, str(tmp_path)), duck.sql(catalog.ORACLE_SQL[name])
    assert normal(df.columns, df.collect()) == normal(sql.columns, sql.fetchall())


def test_what_is_equal_for_a_phone_counts_once_on_a_bill(spark):
    text = "Charges by line details\nA\n555-010-0007\nMonthly Charges\nStorage $2.00\n" * 2
    bills = spark.createDataFrame([(1, 1, text), (1, 2, text)], "doc_id int, bill int, text string")
    found = wireless.blocks(bills, ("doc_id", "bill"))
    assert found.count() == 4 and wireless.charges(found, ("doc_id", "bill")).count() == 2
