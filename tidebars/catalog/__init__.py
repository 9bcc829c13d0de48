"""Every operator as a query over the given tables, with SQL to check it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebars.catalog import alignment, cleaning, inputs, streams, trading, windows  # noqa: F401
from tidebars.operators import indicators as ind


def queries() -> dict:
    return dict(inputs.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(inputs.SQL)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    bars = inputs.daily(spark, sf)
    return ind.with_indicators(bars, ind.returns(), ind.sma(5), ind.sma(20), ind.rsi(), ind.macd())
