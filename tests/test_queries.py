"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from ledgerloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "None" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace(" 00:00:00", "")
    return sorted(columns), sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    sql = duck.sql(catalog.ORACLE_SQL[name])
    assert normal(df.columns, df.collect()) == normal(sql.columns, sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
