"""Technical indicators of a bar table.

An :class:`Indicator` is a list of steps; a step is a dict of columns that may
use window functions over the columns of earlier steps.  Exponential averages
refer to themselves and are :class:`Chain` objects, functions over the arrays
of a block.  ``with_indicators`` runs any number of both in one pass: one
shuffle on (series, block), one sort, and one Arrow pass for the chains.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.operators.recurrence import Arrays, Chain, Whole, average, memory, needed_values, run_chains
from tidebars.series import (
    BLOCK,
    BLOCK_ROWS,
    CHUNK,
    CORE,
    SERIES,
    block_window,
    in_blocks,
    staged,
    trailing,
    with_carry,
    with_chunk,
)

EPS = 2.220446049250313e-16
YEAR = math.sqrt(252)


@dataclass(frozen=True)
class Indicator:
    outputs: tuple[str, ...]
    steps: tuple[dict[str, Column], ...]
    lookback: int


def with_indicators(
    df: DataFrame, *indicators: Indicator | Chain, keys: Sequence[str] = SERIES, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add the outputs of all ``indicators`` to the bars."""
    chains = [i for i in indicators if isinstance(i, Chain)]
    windows = [i for i in indicators if isinstance(i, Indicator)]
    outputs = dict.fromkeys(name for i in indicators for name in i.outputs)
    kept = [c for c in df.columns if c not in outputs]
    if prepared := {name: column for c in chains for name, column in c.prepare.items()}:
        # These are values to be counted themselves: they are worked out and written first.
        df = staged(in_blocks(df, 1, keys, rows).withColumns(prepared).filter(CORE).drop(BLOCK, CORE), "prepared")
    lookback = max([i.lookback for i in windows] + [c.memory for c in chains])
    laid = in_blocks(df, lookback, keys, rows, needed_values(chains))
    for level in range(max((len(i.steps) for i in windows), default=0)):
        columns: dict[str, Column] = {}
        for indicator in windows:
            if level < len(indicator.steps):
                columns |= indicator.steps[level]
        laid = laid.withColumns(columns)
    if not chains:
        return laid.filter(CORE).select(*kept, *outputs)
    made = dict.fromkeys([*kept, *[name for i in windows for name in i.outputs]])
    return run_chains(laid, chains, list(made), keys).select(*kept, *outputs)


def _prev(column: str | Column, back: int = 1) -> Column:
    return F.lag(column, back).over(block_window())


def _or_eps(column: Column) -> Column:
    return F.when(column == 0, F.lit(EPS)).otherwise(column)


def _full(aggregate: Column, column: str, window: int) -> Column:
    """``aggregate`` over the trailing window, null until it holds ``window`` values."""
    frame = trailing(window)
    return F.when(F.count(column).over(frame) == window, aggregate.over(frame))


def _close() -> Column:
    return F.col("close")


def _prev_close() -> dict[str, Column]:
    return {"_prev_close": _prev("close")}


def _change() -> dict[str, Column]:
    return {"_change": _close() - _prev("close")}


def _return() -> dict[str, Column]:
    return {"_return": F.try_divide(_close(), _prev("close")) - 1}


def returns() -> Indicator:
    return Indicator(("returns",), ({"returns": F.try_divide(_close(), _prev("close")) - 1},), 1)


def log_returns() -> Indicator:
    ratio = F.try_divide(_close(), _prev("close"))
    value = F.when(ratio > 0, F.ln(ratio))
    return Indicator(("log_returns",), ({"log_returns": value},), 1)


def volatility(window: int = 20) -> Indicator:
    """Annualised deviation of returns, null until ``window`` returns are there."""
    value = _full(F.stddev_samp("_return"), "_return", window) * YEAR
    return Indicator(("volatility",), (_return(), {"volatility": value}), window)


def volatility_partial(window: int = 20) -> Indicator:
    """Annualised deviation of whatever returns the window holds (two at least)."""
    value = F.stddev_samp("_return").over(trailing(window)) * YEAR
    return Indicator(("volatility_p",), (_return(), {"volatility_p": value}), window)


def sma(period: int) -> Indicator:
    name = f"ma_{period}"
    return Indicator((name,), ({name: F.avg("close").over(trailing(period))},), period)


def sma_strict(period: int) -> Indicator:
    name = f"MA{period}"
    return Indicator((name,), ({name: _full(F.avg("close"), "close", period)},), period)


def ema_of(column: str, span: int, name: str) -> Chain:
    return average(column, span, name)


def _no_zero(x: np.ndarray) -> np.ndarray:
    return np.where(x == 0, EPS, x)


def _crossing(fast: int, slow: int, signal: int, line: str, trend: str, bar: str, factor: int = 1) -> Chain:
    """Difference of two averages, its own average, and a multiple of their difference."""

    def run(c: Arrays, t: Whole) -> Arrays:
        between = t.ema(c["close"], fast) - t.ema(c["close"], slow)
        smooth = t.ema(between, signal)
        return {line: between, trend: smooth, bar: (between - smooth) * factor}

    reach = memory(max(fast, slow)) + memory(signal)
    return Chain((line, trend, bar), ("close",), run, reach, {"close": _close().isNotNull()})


def macd(fast: int = 5, slow: int = 10, signal: int = 5, names: Sequence[str] | None = None) -> Chain:
    return _crossing(fast, slow, signal, *(names or ("macd_line", "macd_signal", "macd_hist")))


def macd_cn(fast: int = 12, slow: int = 26, signal: int = 9) -> Chain:
    return _crossing(fast, slow, signal, "diff", "dea", "macd_bar", factor=2)


def rsi(window: int = 14) -> Indicator:
    change, frame = F.col("_change"), trailing(window)
    gain = F.avg(F.when(change > 0, change).otherwise(0.0)).over(frame)
    loss = F.avg(F.when(change < 0, -change).otherwise(0.0)).over(frame)
    strength = {"_gain": gain, "_loss": loss}
    value = 100 - 100 / (1 + F.col("_gain") / _or_eps(F.col("_loss")))
    return Indicator(("rsi",), (_change(), strength, {"rsi": value}), window)


def atr(window: int = 14) -> Indicator:
    before = F.col("_prev_close")
    ranges = F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)
    )
    steps = (
        _prev_close(),
        {"true_range": ranges},
        {"atr": F.avg("true_range").over(trailing(window))},
    )
    return Indicator(("true_range", "atr"), steps, window)


def momentum(back: int = 10) -> Indicator:
    return Indicator(("mom",), ({"mom": _close() - _prev("close", back)},), back)


def tsi(long: int = 25, short: int = 13) -> Chain:
    def run(c: Arrays, t: Whole) -> Arrays:
        change = c["_close_change"]
        up, size = (t.ema(t.ema(x, long), short) for x in (change, np.abs(change)))
        return {"tsi": up * 100 / _no_zero(size)}

    change = {"_close_change": _close() - _prev("close")}
    values = {"change": F.col("_close_change").isNotNull()}
    return Chain(("tsi",), ("_close_change",), run, 1 + memory(long) + memory(short), values, change)


def trend_strength(short: int = 5, long: int = 20, guarded: bool = True) -> Indicator:
    s, l = F.avg("close").over(trailing(short)), F.avg("close").over(trailing(long))
    low = _or_eps(F.col("_ma_long")) if guarded else F.col("_ma_long")
    value = F.try_divide(F.col("_ma_short") - F.col("_ma_long"), low)
    steps = ({"_ma_short": s, "_ma_long": l}, {"trend_strength": value})
    return Indicator(("trend_strength",), steps, long)


def volume_rate(window: int = 5) -> Indicator:
    mean = F.col(f"vol_ma_{window}")
    steps = (
        {f"vol_ma_{window}": F.avg("volume").over(trailing(window))},
        {"vol_rate": (F.col("volume") - mean) / _or_eps(mean)},
    )
    return Indicator((f"vol_ma_{window}", "vol_rate"), steps, window)


def signed_volume() -> Indicator:
    """Volume with the sign of the price change: what ``obv`` adds up."""
    value = F.signum(F.col("_change")) * F.col("volume")
    return Indicator(("signed_volume",), (_change(), {"signed_volume": value}), 1)


def wavetrend(channel: int = 10, average: int = 21, smooth: int = 4) -> Chain:
    def run(c: Arrays, t: Whole) -> Arrays:
        typical = (c["high"] + c["low"] + c["close"]) / 3
        away = typical - t.ema(typical, channel)
        spread = t.ema(np.abs(away), channel)
        wave = t.ema(away / (_no_zero(spread) * 0.015), average)
        return {"wavetrend": wave, "wavetrend_signal": t.mean(wave, smooth)}

    reach = 2 * memory(channel) + memory(average) + smooth
    values = {"typical": (F.col("high") + F.col("low") + _close()).isNotNull()}
    return Chain(("wavetrend", "wavetrend_signal"), ("high", "low", "close"), run, reach, values)


def signal_accuracy(window: int = 20) -> Chain:
    """Share of bars whose price moved the way the bar histogram pointed."""
    bar, line = macd_cn(), macd()
    bars_of, line_of = bar.run, line.run

    def run(c: Arrays, t: Whole) -> Arrays:
        change = c["close"] - t.back(c["close"], 1)
        pointed = np.where(bars_of(c, t)["macd_bar"] > line_of(c, t)["macd_signal"], 1, -1)
        moved = np.where(change > 0, 1, -1)
        hit = (pointed == moved).astype(np.int64)
        return {"macd_dir": pointed, "price_direction": moved, "correct_signal": hit, "accuracy": t.mean(hit, window)}

    outputs = ("macd_dir", "price_direction", "correct_signal", "accuracy")
    reach = max(bar.memory, line.memory) + window
    return Chain(outputs, ("close",), run, reach, {"close": _close().isNotNull()}, integers=outputs[:3])


def dema(span: int = 30) -> Chain:
    def run(c: Arrays, t: Whole) -> Arrays:
        once = t.ema(c["close"], span)
        return {"dema": once * 2 - t.ema(once, span)}

    return Chain(("dema",), ("close",), run, 2 * memory(span), {"close": _close().isNotNull()})


def macd_chart(fast: int = 9, slow: int = 12, signal: int = 26) -> Chain:
    return macd(fast, slow, signal, names=("macd_m", "macd_s", "macd_h"))


def bollinger(window: int = 20, width: float = 2) -> Indicator:
    steps = (
        {
            "bb_m": _full(F.avg("close"), "close", window),
            "_bb_sd": _full(F.stddev_pop("close"), "close", window),
        },
        {
            "bb_u": F.col("bb_m") + F.col("_bb_sd") * width,
            "bb_l": F.col("bb_m") - F.col("_bb_sd") * width,
        },
    )
    return Indicator(("bb_u", "bb_m", "bb_l"), steps, window)


def _np_round(column: Column, digits: int) -> Column:
    """Half-to-even rounding of the scaled value, as array libraries round."""
    scale = float(10**digits)
    return F.rint(column * scale) / scale


def _row_mean(*columns: str) -> Column:
    """Mean of the non-null columns of a row."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    present = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return F.try_divide(total, present)


def price_stats() -> Indicator:
    steps = (
        {"last_close": _prev("close")},
        {
            "change": _np_round(_close() - F.col("last_close"), 3),
            "value": _np_round(_close() * F.col("volume") / 1e6, 2),
            "upper_lim": _np_round(_close() * 1.1, 3),
            "lower_lim": _np_round(_close() * 0.9, 3),
            "average": _row_mean("open", "close", "high", "low"),
            "volrate": F.col("volume"),
        },
        {"pct_change": _np_round(F.try_divide(F.col("change"), _close()) * 100, 2)},
    )
    outputs = ("change", "pct_change", "value", "upper_lim", "lower_lim", "last_close", "average", "volrate")
    return Indicator(outputs, steps, 1)


def macd_bars(hist: str) -> dict[str, Column]:
    """Positive and non-positive part of a histogram column, as plot bars."""
    h = F.col(hist)
    return {
        "bar_up": F.when(h > 0, h).otherwise(0.0),
        "bar_down": F.when(h <= 0, h).otherwise(0.0),
    }


def with_obv(
    df: DataFrame, column: str = "signed_volume", keys: Sequence[str] = SERIES, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Running total of signed volume; null rows stay null and add nothing."""
    chunked = with_chunk(df, rows)
    carried = with_carry(chunked, {"_sum": F.sum(column)}, earlier={"_sum": F.sum}, keys=keys)
    local = Window.partitionBy(*keys, CHUNK).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum(column).over(local) + F.coalesce(F.col("_sum_before"), F.lit(0.0))
    return carried.withColumn("obv", F.when(F.col(column).isNotNull(), running)).drop(CHUNK, "_sum_before")


def obv(df: DataFrame, keys: Sequence[str] = SERIES, rows: int = BLOCK_ROWS) -> DataFrame:
    signed = with_indicators(df, signed_volume(), keys=keys, rows=rows)
    return with_obv(signed, keys=keys, rows=rows).drop("signed_volume")
