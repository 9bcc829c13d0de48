"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, tidy
from tidebars import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()  # those of the optional subpackage have their own tests


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"returns", "ma_20"} <= set(df.columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = tidy(QUERIES[name](spark, sf_dir).toPandas())
    assert len(got)
    if name in SQL:
        want = tidy(duck.execute(SQL[name]).fetch_df())
        assert list(got.columns) == list(want.columns)
        assert len(got) == len(want)
        assert got.equals(want)
