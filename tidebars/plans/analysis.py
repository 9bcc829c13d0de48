"""Whole analyses as plans: clean bars, features, a trading run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.operators import backtest as bt
from tidebars.operators import indicators as ind
from tidebars.operators.align import align_timeframes
from tidebars.operators.clean import (
    OHLCV,
    handle_nan_inf,
    left_pad,
    minmax_normalize,
    numeric_columns,
    tail_n,
    to_numeric,
    winsorize,
)
from tidebars.operators.risk import normalized_risk, risk_adjust
from tidebars.operators.signals import signals
from tidebars.series import position_columns, require_columns, staged, with_position

CLEANED = (*OHLCV, "returns", "log_returns", "volatility")


def process_bars(bars: DataFrame, keep: int | None = 20, base: str | None = None) -> DataFrame:
    """Numbers, returns, volatility, clipping, gap filling, the last ``keep`` bars,
    and alignment to ``base`` if one is named."""
    require_columns(bars, OHLCV)
    numeric = staged(with_position(to_numeric(bars, OHLCV)), "bars")
    computed = ind.with_indicators(numeric, ind.returns(), ind.log_returns(), ind.volatility())
    clipped = winsorize(staged(computed.drop("pos", "n"), "returns"))
    cleaned = handle_nan_inf(staged(clipped, "clipped"), CLEANED)
    if keep is not None:
        cleaned = tail_n(cleaned, keep)
    return align_timeframes(staged(cleaned, "cleaned"), base, CLEANED) if base else cleaned


def feature_indicators(ma_periods=(3, 5, 10, 20), macd=(5, 10, 5)) -> list[ind.Indicator | ind.Chain]:
    return [
        *[ind.sma(p) for p in ma_periods],
        ind.macd(*macd),
        ind.rsi(),
        ind.atr(),
        ind.macd_cn(),
        ind.momentum(),
        ind.tsi(),
        ind.volatility_partial(),
        ind.trend_strength(),
        ind.volume_rate(),
        ind.signed_volume(),
        ind.wavetrend(),
        ind.signal_accuracy(),
    ]


def raw_features(bars: DataFrame, **parameters) -> DataFrame:
    """Every indicator on the full history, in one pass over the blocks."""
    require_columns(bars, OHLCV)
    computed = ind.with_indicators(bars, *feature_indicators(**parameters))
    return ind.with_obv(computed.drop("true_range"))


def engineer_features(
    bars: DataFrame, keep: int | None = 20, pad: bool = False, normalize: bool = True, **parameters
) -> DataFrame:
    """Indicators, gap filling, scaling to 0..1, the last ``keep`` bars.

    Scaling sees the whole series.  Each stage that reads its input twice
    starts from a written table.
    """
    computed = ind.with_indicators(bars, *feature_indicators(**parameters))
    indicators = staged(computed.drop("true_range"), "indicators")
    complete = staged(ind.with_obv(indicators).drop("signed_volume"), "complete")
    filled = staged(handle_nan_inf(complete, numeric_columns(complete)), "features")
    features = minmax_normalize(filled) if normalize else filled
    if keep is None:
        return features
    last = tail_n(features, keep)
    return left_pad(last, keep) if pad else last


def trading_run(scored: DataFrame) -> dict[str, DataFrame]:
    """Signals, risk-adjusted signals and backtest of scored feature rows.

    ``scored`` has scores ``p0, p1, p2``, ``trend_strength``, ``atr``,
    ``volatility_p`` and ``returns``.
    """
    made = signals(scored)
    numbers = position_columns(scored)
    risk = normalized_risk(scored.select("symbol", "timeframe", "ts", *numbers, "volatility_p"))
    fields = ["symbol", "timeframe", "ts", *numbers, "signal_strength", "entry_level", "stop_loss", "position_size"]
    managed = risk_adjust(made.select(*fields), risk)
    return {"signals": made, "managed": managed, "backtest": bt.backtest(managed, scored)}


def trades(managed: DataFrame, weights: DataFrame) -> DataFrame:
    """One trade record per signal row with its timeframe's weight."""
    fields = ["symbol", "timeframe", "ts", "position_size", "entry_level", "stop_loss"]
    joined = managed.select(*fields).join(weights, ["symbol", "timeframe", "ts"])
    return joined.select(*fields, F.col("dynamic_weight"))
