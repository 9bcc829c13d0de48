"""Backtest aggregates of per-bar results."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.operators.align import tail_align
from tidebars.operators.indicators import Indicator, with_indicators
from tidebars.series import (
    BLOCK,
    BLOCK_ROWS,
    CHUNK,
    SERIES,
    block_window,
    position_columns,
    with_carry,
    with_chunk,
)

YEAR = math.sqrt(252)
RISK_FREE = 0.02


def pnl(signals: DataFrame, bars: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Position times return, both taken from the end; null counts as 0."""
    returns = bars.select(*keys, "ts", *position_columns(bars), "returns")
    positions = signals.select(*keys, "ts", *position_columns(signals), "position_size")
    value = F.coalesce(F.col("position_size") * F.col("returns"), F.lit(0.0))
    return tail_align(returns, positions, keys).select(*keys, "ts", "pos", "n", value.alias("pnl"))


def _local(keys: Sequence[str], chunk: str = CHUNK):
    return Window.partitionBy(*keys, chunk).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)


def with_running(
    df: DataFrame,
    column: str,
    name: str,
    fold: str = "product",
    keys: Sequence[str] = SERIES,
    rows: int = BLOCK_ROWS,
    chunk: str | None = None,
) -> DataFrame:
    """Running product of ``1 + column`` or running sum of it, and its peak so far.

    Adds ``name`` and ``<name>_peak``.  The running value of a chunk is the
    value carried in, times (plus) the chunk's own running value; so the peak
    before a chunk follows from the chunks' own extremes.  ``chunk`` names a
    column that cuts the series already.
    """
    if fold == "product":
        step, unit = F.col(column) + 1, 1.0
        total: Callable[[Column], Column] = F.product
    else:
        step, unit = F.col(column), 0.0
        total = F.sum

    def join(a: Column, b: Column) -> Column:
        return a * b if fold == "product" else a + b

    chunked = with_chunk(df, rows) if chunk is None else df
    cut = chunk or CHUNK
    own = chunked.withColumn("_own", total(step).over(_local(keys, cut)))
    series = Window.partitionBy(*keys).orderBy(cut)
    before = series.rowsBetween(Window.unboundedPreceding, -1)

    def peaks(table: DataFrame) -> DataFrame:
        carried = F.coalesce(F.col("_total_before"), F.lit(unit))
        best = F.greatest(join(carried, F.col("_high")), join(carried, F.col("_low")))
        return (
            table.withColumn("_carried", carried)
            .withColumn("_best", best)
            .withColumn("_peak_before", F.max("_best").over(before))
            .drop("_total_before", "_best")
        )

    carried = with_carry(
        own,
        {"_total": total(step), "_high": F.max("_own"), "_low": F.min("_own")},
        earlier={"_total": total},
        keys=keys,
        chunk=cut,
        finish=peaks,
    )
    value = carried.withColumn(name, join(F.col("_carried"), F.col("_own")))
    peak = F.greatest(F.col("_peak_before"), F.max(name).over(_local(keys, cut)))
    return value.withColumn(f"{name}_peak", peak).select(*df.columns, name, f"{name}_peak")


def _fall(value: Column, peak: Column) -> Column:
    """``(value - peak) / peak``; minus infinity below a peak of zero."""
    at_zero = F.when(value < 0, F.lit(-math.inf))
    return F.when(peak == 0, at_zero).otherwise((value - peak) / F.nullif(peak, F.lit(0.0)))


def equity_curve(df: DataFrame, keys: Sequence[str] = SERIES, rows: int = BLOCK_ROWS) -> DataFrame:
    return with_running(df, "pnl", "equity", "product", keys, rows).drop("equity_peak")


def max_drawdown_of_pnl(df: DataFrame, keys: Sequence[str] = SERIES, rows: int = BLOCK_ROWS) -> DataFrame:
    """Deepest fall of the compounded result below its peak."""
    run = with_running(df, "pnl", "equity", "product", keys, rows)
    return run.groupBy(*keys).agg(_drawdown().alias("max_drawdown"))


def _drawdown() -> Column:
    fall = F.min(F.try_divide(F.col("equity"), F.col("equity_peak")) - 1)
    return F.coalesce(fall, F.lit(0.0))


def max_drawdown(
    df: DataFrame, column: str = "equity", keys: Sequence[str] = SERIES, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Deepest relative fall of an equity column below its running peak."""
    chunked = with_chunk(df, rows)
    carried = with_carry(chunked, {"_high": F.max(column)}, earlier={"_high": F.max}, keys=keys)
    peak = F.greatest(F.col("_high_before"), F.max(column).over(_local(keys)))
    falls = carried.withColumn("_peak", peak).withColumn("_fall", _fall(F.col(column), F.col("_peak")))
    return falls.groupBy(*keys).agg(F.min("_fall").alias("max_drawdown"))


def calmar(df: DataFrame, column: str = "returns", keys: Sequence[str] = SERIES, rows: int = BLOCK_ROWS) -> DataFrame:
    """Growth of twelve mean returns over the deepest fall of their running sum."""
    run = with_running(df.filter(F.col(column).isNotNull()), column, "_sum", "sum", keys, rows)
    falls = run.withColumn("_fall", _fall(F.col("_sum"), F.col("_sum_peak")))
    growth = F.pow(1 + F.avg(column), 12) - 1
    return falls.groupBy(*keys).agg(F.try_divide(growth, F.abs(F.min("_fall"))).alias("calmar"))


def sharpe(df: DataFrame, column: str = "returns", keys: Sequence[str] = SERIES) -> DataFrame:
    """Annualised excess return per deviation of a return column."""
    excess = F.avg(column) - RISK_FREE / 252
    return df.groupBy(*keys).agg(F.try_divide(excess * YEAR, F.stddev_samp(column)).alias("sharpe"))


def _sharpe_of_change() -> Column:
    """0 where a zero result is followed by another (an infinite change), or
    where there is no deviation to divide by."""
    excess = F.avg("pnl_change") - RISK_FREE / 252
    ratio = F.try_divide(excess * YEAR, F.stddev_samp("pnl_change"))
    return F.when(F.coalesce(F.bool_or("pnl_jump"), F.lit(False)), 0.0).otherwise(F.coalesce(ratio, F.lit(0.0)))


def sharpe_of_pnl(df: DataFrame, keys: Sequence[str] = SERIES, rows: int = BLOCK_ROWS) -> DataFrame:
    """Sharpe ratio of the relative change of the per-bar result."""
    return with_changes(df, keys, rows).groupBy(*keys).agg(_sharpe_of_change().alias("sharpe_ratio"))


def with_changes(df: DataFrame, keys: Sequence[str] = SERIES, rows: int = BLOCK_ROWS) -> DataFrame:
    """Relative change of the result, its jumps from zero, and the row's block."""
    window = block_window(keys)
    before = F.lag("pnl").over(window)
    change = {"pnl_change": F.try_divide(F.col("pnl"), before) - 1}
    change["pnl_jump"] = (before == 0) & (F.col("pnl") != 0)
    return with_indicators(df, Indicator((*change, BLOCK), (change,), 1), keys=keys, rows=rows)


def total_return(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    return df.groupBy(*keys).agg(_total_return().alias("total_return"))


def _total_return() -> Column:
    return F.product(F.col("pnl") + 1) - 1


def win_rate(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    return df.groupBy(*keys).agg(_win_rate().alias("win_rate"))


def _win_rate() -> Column:
    return F.coalesce(F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)), F.lit(0.0))


def metrics(results: DataFrame, keys: Sequence[str] = SERIES, rows: int = BLOCK_ROWS) -> DataFrame:
    """All five figures of a table of per-bar results, one row per series."""
    changes = with_changes(results, keys, rows)
    run = with_running(changes, "pnl", "equity", "product", keys, rows, chunk=BLOCK)
    return run.groupBy(*keys).agg(
        F.sum("pnl").alias("pnl"),
        _sharpe_of_change().alias("sharpe_ratio"),
        _drawdown().alias("max_drawdown"),
        _total_return().alias("total_return"),
        _win_rate().alias("win_rate"),
    )


def backtest(signals: DataFrame, bars: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Result, Sharpe ratio, drawdown, return and win rate of each series with bars."""
    return metrics(pnl(signals, bars, keys), keys)


def parameter_sweep(
    bars: DataFrame, grid: list[dict], position: Callable[[], Column], worst: float = -1e10
) -> DataFrame:
    """Score every parameter set by its mean Sharpe ratio over all series.

    ``bars`` has ``returns`` and what ``position`` reads; the parameters come as
    columns of the same names.  The best set has ``best`` true.
    """
    names = sorted(grid[0])
    sets = F.array(
        *[
            F.struct(F.lit(i).alias("param_id"), *[F.lit(float(p[k])).alias(k) for k in names])
            for i, p in enumerate(grid)
        ]
    )
    keys = ["param_id", *SERIES]
    tried = bars.withColumn("_p", F.explode(sets)).select("*", "_p.*").drop("_p")
    value = F.coalesce(position() * F.col("returns"), F.lit(0.0))
    results = tried.select(*keys, "ts", value.alias("pnl"), *names)
    scores = sharpe_of_pnl(results.select(*keys, "ts", "pnl"), keys)
    score = F.avg("sharpe_ratio")
    by_set = scores.groupBy("param_id").agg(
        F.when(F.isnan(score), worst).otherwise(F.coalesce(score, F.lit(worst))).alias("score")
    )
    described = F.coalesce(
        *[F.when(F.col("param_id") == i, F.struct(*[F.lit(float(p[k])).alias(k) for k in names])) for i, p in enumerate(grid)]
    )
    rank = F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("param_id")))
    return (
        by_set.withColumn("best", rank == 1).withColumn("_p", described).select("param_id", "_p.*", "score", "best")
    )
