"""Dates as text, far from the years of the small tables."""

import datetime as dt

import duckdb
import pandas as pd
import pytest

from tidebars import catalog
from tidebars.catalog.inputs import _as_text

# Days before 1995-01-01 and customers that give them: years 224 and 20,000 before the first, around the first, and none.
CUSTOMERS = [1, 80_958, 80_959, 80_999, 81_040, 89_994, 899_940, None]


@pytest.mark.parametrize("end", ["1995-01-01", "0001-01-01", "0001-12-31", "9999-12-31"])
def test_lookback_before_the_first_year(spark, tmp_path, end):
    keys = range(6 * len(CUSTOMERS))
    rows = [(k, CUSTOMERS[k // 6], dt.datetime.fromisoformat(end)) for k in keys]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = catalog.queries()["lookback_window"](spark, str(tmp_path)).toPandas()
    want = con.execute(catalog.oracle_sql()["lookback_window"]).fetch_df()
    assert any("(BC)" in t for t in want["start"].dropna())
    a, b = (df.sort_values("o_orderkey").reset_index(drop=True)[["o_orderkey", "timeframe", "start"]] for df in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_text_of_far_dates(spark):
    days = [-1_000_000, -719_163, -719_162, 0, 2_932_896, 2_932_897, 100_000_000, None]
    df = spark.createDataFrame([(d,) for d in days], "n int").selectExpr("n", "date_from_unix_date(n) AS d").withColumn("d", _as_text("d")())
    got = dict(df.collect())
    want = dict(duckdb.execute("SELECT n, (DATE '1970-01-01' + n)::VARCHAR FROM (SELECT unnest(?::INT[]) AS n)", [days]).fetchall())
    assert got == want
