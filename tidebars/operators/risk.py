"""Risk adjustment of signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebars.series import BLOCK_ROWS, SERIES, from_end, position_columns, with_series_values


def normalized_risk(
    df: DataFrame, column: str = "volatility_p", keys: Sequence[str] = SERIES, rows: int = BLOCK_ROWS
) -> DataFrame:
    """``risk``: volatility as a share of the series' greatest."""
    known = with_series_values(df, {"_max": (F.max, F.max(column))}, keys, rows)
    return known.withColumn("risk", F.try_divide(F.col(column), F.col("_max"))).drop("_max")


def risk_adjust(signals: DataFrame, risk: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Weaker, later and tighter signals where risk is high.

    Signals and risk rows are paired from the end of the series; a signal
    without a risk row stays as it is.
    """

    numbers = position_columns(signals)
    right = from_end(risk.select(*keys, "ts", *position_columns(risk), F.col("risk").alias("_risk")), keys)
    left = from_end(signals, keys)
    joined = left.join(right.select(*keys, "tail", "_risk"), [*keys, "tail"], "left")
    if numbers:
        joined = joined.withColumn("pos", F.col("n") - 1 - F.col("tail"))
    r = F.coalesce(F.col("_risk"), F.lit(0.0))
    return joined.withColumns(
        {
            "signal_strength": F.col("signal_strength") * (1 - r),
            "entry_level": F.col("entry_level") * (1 + r),
            "stop_loss": F.col("stop_loss") * (1 - r),
        }
    ).select(*signals.columns)


def daily_loss_limit(
    df: DataFrame, limit: float = 0.02, pnl: str = "pnl", keys: Sequence[str] = SERIES
) -> DataFrame:
    """Running result of the day, and whether its loss has reached the limit."""
    day = Window.partitionBy(*keys, F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    total = df.withColumn("day_pnl", F.sum(pnl).over(day))
    return total.withColumn("stop", F.coalesce(-F.col("day_pnl") >= limit, F.lit(False)))
