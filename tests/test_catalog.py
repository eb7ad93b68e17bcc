"""Every registered query of the retrieval engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from reminis.plans import catalog

ROWS_ONLY = {"ann_lsh", "ann_lists"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"create view {name.split('.')[0]} as select * from '{sf}/{name}'")
    return con


def test_every_query_has_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == ROWS_ONLY
    assert not set(catalog.ORACLE_SQL) - set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r)) for r in df.select(columns).collect())
    assert rows or name in catalog.ORACLE_SQL  # no fact is pending in the smallest tables
    if name in catalog.ORACLE_SQL:
        listed = ", ".join(f'"{c}"' for c in columns)
        assert rows == sorted(map(repr, duck.sql(f"select {listed} from ({catalog.ORACLE_SQL[name]})").fetchall()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == catalog.LIMIT
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(catalog.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
