"""The live cycle: finished bars to features, signals, risk and trades, with keyed state.

A batch run sees whole series; here each series (symbol, timeframe) carries what
its next bar needs: the levels of all averages, the rows that trailing windows
look back on (at most 20), the running volume and the greatest volatility so far.  The
features are those of `plans.analysis.raw_features`, bar by bar, however the bars
are cut into batches.  Everything after them is a projection.

The state of a series goes when no bar has come for `EXPIRE` of event time.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidebars.operators import indicators as ind
from tidebars.operators.recurrence import Arrays, Carried, Whole
from tidebars.operators.signals import signals
from tidebars.series import SERIES
from tidebars.streaming.live import start
from tidebars.streaming.store import UpsertStore

EXPIRE = pd.Timedelta(days=30)
BARS = ("open", "high", "low", "close", "volume")
SLOTS = "slots array<array<double>>, last timestamp_ntz, timer bigint"
FEATURES = (
    "ma_3", "ma_5", "ma_10", "ma_20", "rsi", "atr", "mom", "volatility_p", "trend_strength", "vol_ma_5", "vol_rate", "obv",
    "macd_line", "macd_signal", "macd_hist", "diff", "dea", "macd_bar", "tsi", "wavetrend", "wavetrend_signal", "accuracy", "risk",
)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a / b``, missing where ``b`` is 0."""
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)


def _or_eps(x: np.ndarray) -> np.ndarray:
    return np.where(x == 0, ind.EPS, x)


def features(c: Arrays, t: Whole) -> Arrays:
    """The features of consecutive bars of one series."""
    close, volume = c["close"], c["volume"]
    before = t.back(close, 1)
    change = close - before
    out = {f"ma_{p}": t.mean(close, p) for p in (3, 5, 10, 20)}
    gain, loss = t.mean(np.where(change > 0, change, 0.0), 14), t.mean(np.where(change < 0, -change, 0.0), 14)
    out["rsi"] = 100 - 100 / (1 + gain / _or_eps(loss))
    ranges = (c["high"] - c["low"], np.abs(c["high"] - before), np.abs(c["low"] - before))
    out["atr"] = t.mean(np.fmax(np.fmax(*ranges[:2]), ranges[2]), 14)
    out["mom"] = close - t.back(close, 10)
    out["volatility_p"] = t.deviation(_share(close, before) - 1, 20) * ind.YEAR
    out["trend_strength"] = (out["ma_5"] - out["ma_20"]) / _or_eps(out["ma_20"])
    out["vol_ma_5"] = t.mean(volume, 5)
    out["vol_rate"] = (volume - out["vol_ma_5"]) / _or_eps(out["vol_ma_5"])
    out["obv"] = t.total(np.sign(change) * volume)
    for chain in (ind.macd, ind.macd_cn, ind.tsi, ind.wavetrend, ind.signal_accuracy):
        out |= CHAINS[chain.__name__](c | {"_close_change": change}, t)
    out["risk"] = _share(out["volatility_p"], t.greatest(out["volatility_p"]))
    return {name: out[name] for name in FEATURES}


#: The functions of the chains alone, which can travel to the executors.
CHAINS = {}


def _load_chains() -> None:
    """Chains hold conditions for Spark, which need a session to be made."""
    if not CHAINS:
        CHAINS.update({make.__name__: make().run for make in (ind.macd, ind.macd_cn, ind.tsi, ind.wavetrend, ind.signal_accuracy)})


class FeatureState(StatefulProcessor):
    """Features of the new bars of a series; its state is what `Carried` keeps, its last bar and the timer that ends it."""

    def __init__(self, expire_ms: int) -> None:
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carried = handle.getValueState("carried", SLOTS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        slots, last, timer = self.carried.get() if self.carried.exists() else (None, None, None)
        bars = pd.concat(list(rows)).sort_values("ts", kind="stable").drop_duplicates("ts", keep="last")
        if last is not None:
            bars = bars[bars["ts"] > pd.Timestamp(last)]  # a bar that was counted isn't counted again
        if bars.empty:
            return
        tools = Carried(slots)
        found = features({c: bars[c].to_numpy(float) for c in BARS}, tools)
        if timer is not None:
            self.handle.deleteTimer(timer)
        end = bars["ts"].iloc[-1]
        timer = max(int(end.timestamp() * 1000) + self.expire_ms, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(timer)
        self.carried.update((tools.slots, end.to_pydatetime(), timer))
        yield bars[[*SERIES, "ts", *BARS]].assign(**found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        self.carried.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_features(bars: DataFrame, expire: pd.Timedelta = EXPIRE) -> DataFrame:
    """Bars with `FEATURES`; ``bars`` is a stream of finished bars with its event time, as `stream_bars` gives it with ``closing``.

    A series' bars come in order of their times, as the watermark closes them;
    one that isn't later than the last is passed over.  After ``expire``
    without bars a series begins anew.
    """
    _load_chains()
    fields = ", ".join([f"{k} string" for k in SERIES] + ["ts timestamp_ntz"] + [f"{c} double" for c in (*BARS, *FEATURES)])
    processor = FeatureState(int(expire.total_seconds() * 1000))
    return bars.groupBy(*SERIES).transformWithStateInPandas(processor, fields, "Append", "EventTime")


def managed(scored: DataFrame, max_position: float = 1.0) -> DataFrame:
    """Signals of scored features, weaker, later and tighter by the risk: volatility as a share of the greatest so far."""
    r = F.coalesce(F.col("risk"), F.lit(0.0))
    return signals(scored, max_position).withColumns(
        {
            "signal_strength": F.col("signal_strength") * (1 - r),
            "entry_level": F.col("entry_level") * (1 + r),
            "stop_loss": F.col("stop_loss") * (1 - r),
        }
    )


TRADE = (*SERIES, "ts", "signal_strength", "position_size", "entry_level", "stop_loss", "dynamic_weight")


def live_trades(bars: DataFrame, scores: dict[str, Column], expire: pd.Timedelta = EXPIRE, max_position: float = 1.0) -> DataFrame:
    """One trade record per finished bar; ``scores`` are ``p0, p1, p2`` and ``dynamic_weight`` over the features."""
    return managed(live_features(bars, expire).withColumns(scores), max_position).select(*TRADE)


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started within it keep typed state in RocksDB, which keyed state with timers needs; the setting is put back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def trade_store(spark: SparkSession, path: str, trades: DataFrame) -> UpsertStore:
    return UpsertStore(spark, path, trades.schema, [*SERIES, "ts"])


def run_cycle(trades: DataFrame, store: UpsertStore, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upsert the trades of each batch: a repeated batch replaces its own rows, a corrected bar its old record."""
    with keyed_state(trades.sparkSession):
        return start(trades, store.upsert, checkpoint, once)
