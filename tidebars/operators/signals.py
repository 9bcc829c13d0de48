"""From model scores to trading signals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.functions.columns import entry_level
from tidebars.series import BLOCK_ROWS, attach, from_end
from tidebars.timeframes import canonical_column

FIELDS = ("signal_strength", "entry_level", "stop_loss", "position_size")
# Weight of a timeframe in the combined signal, by the library's codes (an hour is 60m).
TIMEFRAME_WEIGHTS = {"1min": 0.05, "5m": 0.1, "15m": 0.15, "60m": 0.2, "4h": 0.2, "1d": 0.2, "1w": 0.1}


def signals(df: DataFrame, max_position: float = 1.0) -> DataFrame:
    """Signal fields from scores ``p0, p1, p2`` with ``trend_strength`` and ``atr``."""
    return df.withColumns(
        {
            "signal_strength": F.col("p0"),
            "entry_level": entry_level(F.col("p1"), F.col("trend_strength")),
            "stop_loss": F.col("p2") * F.col("atr"),
            "position_size": F.least(F.abs(F.col("p0")), F.lit(float(max_position))),
        }
    )


def trend_consistency(df: DataFrame) -> DataFrame:
    """Product over the timeframes of the sign of the last TSI, per symbol."""
    last = df.groupBy("symbol", "timeframe").agg(F.max_by("tsi", "ts").alias("tsi"))
    signs = F.product(F.signum("tsi"))
    return last.groupBy("symbol").agg(F.coalesce(signs, F.lit(0.0)).alias("trend_consistency"))


def _tamed(value: Column) -> Column:
    """NaN to 0, the infinities to 1 and -1."""
    return (
        F.when(F.isnan(value), 0.0)
        .when(value == math.inf, 1.0)
        .when(value == -math.inf, -1.0)
        .otherwise(F.coalesce(value, F.lit(0.0)))
    )


def comprehensive_signal(
    df: DataFrame, consistency: DataFrame, weight: str = "dynamic_weight", rows: int = BLOCK_ROWS
) -> DataFrame:
    """Weighted mean of the timeframes' strengths, row by row from the end.

    ``tail`` 0 is the last row.  As far as every timeframe of the symbol
    reaches, which the number of rows at one ``tail`` tells.
    """
    numbered = from_end(df, rows=rows)
    product = F.col(weight) * F.col("signal_strength")
    by_tail = numbered.groupBy("symbol", "tail").agg(
        F.sum(product).alias("_s"), F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_held")
    )
    facts = df.groupBy("symbol").agg(F.count_distinct("timeframe").alias("_wanted")).join(consistency, "symbol", "left")
    full = attach(by_tail, facts, ["symbol"], chunk=F.expr(f"tail div {rows}")).filter(
        F.col("_held") == F.col("_wanted")
    )
    total = F.when(F.col("_w") == 0, F.lit(1.0)).otherwise(F.col("_w"))
    value = F.col("_s") / total * F.coalesce(F.col("trend_consistency"), F.lit(0.0))
    return full.select("symbol", "tail", _tamed(value).alias("comprehensive_signal"))


def combine_timeframe_signals(df: DataFrame) -> DataFrame:
    """Mean of each field per timeframe, weighted by the fixed table, per symbol.

    Other spellings of a code count as that code; codes without a weight don't count.
    """
    named = df.withColumn("timeframe", canonical_column(F.col("timeframe")))
    means = named.groupBy("symbol", "timeframe").agg(*[F.avg(f).alias(f) for f in FIELDS])
    weight = F.coalesce(*[F.when(F.col("timeframe") == t, F.lit(w)) for t, w in TIMEFRAME_WEIGHTS.items()])
    weighed = means.withColumn("_w", weight)
    return weighed.groupBy("symbol").agg(
        *[
            F.coalesce(F.try_divide(F.sum(F.col(f) * F.col("_w")), F.sum("_w")), F.lit(0.0)).alias(f)
            for f in FIELDS
        ]
    )
