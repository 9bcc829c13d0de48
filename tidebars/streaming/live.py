"""Live bars, trades and stop conditions with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidebars.functions.columns import circuit_breaker
from tidebars.operators.clean import tail_n
from tidebars.series import SERIES, join_keys, new_path, staged
from tidebars.streaming.store import UpsertStore

WATERMARK = "10 minutes"


def ticks(stream: DataFrame, symbol: str, price: str, volume: Column | None = None) -> DataFrame:
    """``symbol, ts, price, volume`` of a stream; event time as an instant."""
    return stream.select(
        F.col(symbol).alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col(price).cast("double").alias("price"),
        (F.lit(1.0) if volume is None else volume).cast("double").alias("volume"),
    )


def stream_bars(stream: DataFrame, minutes: int, watermark: str = WATERMARK, closing: str | None = None) -> DataFrame:
    """Tumbling bars of a tick stream; a bar is final once the watermark passes.

    ``closing`` names a column for the end of the bar's slot as an event time, which a stateful step after this one needs.
    """
    moment = F.struct("ts", "price")
    slot = F.window("ts", f"{minutes} minutes")
    bars = stream.withWatermark("ts", watermark).groupBy("symbol", slot).agg(
        F.min_by("price", moment).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", moment).alias("close"), F.sum("volume").alias("volume"),
    )
    return bars.select(
        "symbol", F.lit(f"{minutes}m").alias("timeframe"), F.col("window.start").cast("timestamp_ntz").alias("ts"),
        "open", "high", "low", "close", "volume", *([F.window_time("window").alias(closing)] if closing else []),
    )


def start(
    bars: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True
) -> StreamingQuery:
    writer = bars.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def live_trading(
    bars: DataFrame,
    process: Callable[[DataFrame], DataFrame],
    buffer_path: str,
    trades_path: str,
    checkpoint: str,
    buffer: int = 100,
    once: bool = True,
) -> StreamingQuery:
    """Each batch of finished bars: put the last ``buffer`` bars of each series
    before the new ones, run ``process``, keep the rows of the new bars.

    The bars are kept in a store that is cut to ``buffer`` bars a series each
    time it is compacted, whichever batches came before.  Trades go to one
    folder per batch: a repeated batch replaces its own rows and nothing is logged twice.
    """
    held = UpsertStore(bars.sparkSession, buffer_path, bars.schema, [*SERIES, "ts"], keep=lambda df: tail_n(df, buffer))

    def each(batch: DataFrame, batch_id: int) -> None:
        new = staged(batch, "batch")
        held.upsert(new, batch_id)
        earlier = join_keys(held.read(), new.select(*SERIES, "ts"), [*SERIES, "ts"], "left_anti")
        context = tail_n(earlier, buffer).unionByName(new)
        fresh = process(context).join(new.select(*SERIES, "ts"), [*SERIES, "ts"], "left_semi")
        fresh.write.mode("overwrite").parquet(f"{trades_path}/batch_id={batch_id}")

    return start(bars, each, checkpoint, once)


def emit_trades(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append trade rows to a log, one folder per batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        stamped = batch.withColumn("logged_at", F.current_timestamp())
        stamped.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return start(stream, each, checkpoint, once)


def stop_monitor(
    stream: DataFrame, max_daily_loss: float = 0.02, breaker: float = 0.1, watermark: str = WATERMARK
) -> DataFrame:
    """Stop and pause flags at the end of each symbol's day of a ``symbol, ts, pnl, price`` stream.

    For the moment of a breach see `first_breaches`.

    ``stop`` once the day's loss reaches the limit, ``pause`` when the price
    has moved by more than ``breaker`` since the day's first.  The state is one
    row of partial sums per symbol and day.
    """
    moment = F.struct("ts", "price")
    day = stream.withWatermark("ts", watermark).groupBy("symbol", F.window("ts", "1 day")).agg(
        F.sum("pnl").alias("day_pnl"), F.min_by("price", moment).alias("first_price"),
        F.max_by("price", moment).alias("last_price"),
    )
    change = F.try_divide(F.col("last_price") - F.col("first_price"), F.col("first_price"))
    return day.select(
        "symbol", F.col("window.start").cast("timestamp_ntz").alias("day"), "day_pnl", change.alias("change"),
        (-F.col("day_pnl") >= max_daily_loss).alias("stop"),
        F.coalesce(circuit_breaker(change, breaker), F.lit(False)).alias("pause"),
    )


BREACH = "symbol string, day timestamp, kind string, ts timestamp, value double"
BREACH_STATE = "total double, first_price double, stopped boolean, paused boolean"


def breaches(key: tuple, rows: pd.DataFrame, before: tuple, max_daily_loss: float, breaker: float) -> tuple[list[tuple], tuple]:
    """The limits that a day's next rows, in order, break for the first time, and the day's state after them."""
    symbol, day = key
    total, first, stopped, paused = before
    running = total + rows["pnl"].fillna(0.0).cumsum()
    prices = rows["price"].dropna()
    first = float(prices.iloc[0]) if first is None and len(prices) else first
    moves = (rows["price"] - first) / first if first else rows["price"] * float("nan")
    found = []
    for kind, done, broken, value in (("stop", stopped, -running >= max_daily_loss, running), ("pause", paused, moves.abs() > breaker, moves)):
        if not done and broken.any():
            at = int(broken.to_numpy().argmax())
            found.append((symbol, day, kind, rows["ts"].iloc[at], float(value.iloc[at])))
    kinds = {f[2] for f in found}
    return found, (float(running.iloc[-1]), first, stopped or "stop" in kinds, paused or "pause" in kinds)


def first_breaches(
    stream: DataFrame, max_daily_loss: float = 0.02, breaker: float = 0.1, watermark: str = WATERMARK
) -> DataFrame:
    """The moment when a symbol's day first breaks a limit, as soon as it does.

    ``kind`` is ``stop`` when the day's loss reaches ``max_daily_loss`` (``value``
    is the day's result then) and ``pause`` when the price has moved by more than
    ``breaker`` since the day's first (``value`` is the move); each comes at most
    once a day, also if the day recovers.  The state of a symbol and day is a
    running sum, a price and two flags; it goes when the watermark has passed the
    day.  Events are counted in the order of their times within a batch, and
    batches as they come.  Null results count as 0; null prices are passed over.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        day, before = key[1], state.get if state.exists else (0.0, None, False, False)
        rows = pd.concat(list(frames)).sort_values(["ts", "price"], kind="stable")
        found, after = breaches(key, rows, before, max_daily_loss, breaker)
        state.update(after)
        end = int((pd.Timestamp(day) + pd.Timedelta(days=1)).timestamp() * 1000)
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        if found:
            yield pd.DataFrame(found, columns=["symbol", "day", "kind", "ts", "value"])

    days = stream.withWatermark("ts", watermark).select("symbol", F.date_trunc("day", "ts").alias("day"), "ts", "pnl", "price")
    return days.groupBy("symbol", "day").applyInPandasWithState(step, BREACH, BREACH_STATE, "append", GroupStateTimeout.EventTimeTimeout)


class OrderedStops(StatefulProcessor):
    """First breaches of a symbol's day in the order of event times.

    Events wait in a buffer until the watermark has passed them, when no earlier
    one can come any more; a timer at the first that waits wakes the day up.
    The state goes with the last event after the day has ended.
    """

    def __init__(self, max_daily_loss: float, breaker: float) -> None:
        self.max_daily_loss, self.breaker = max_daily_loss, breaker

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts timestamp, pnl double, price double")
        self.day = handle.getValueState("day", f"{BREACH_STATE}, timer bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        for frame in rows:
            cells = frame[["ts", "pnl", "price"]].astype(object)
            self.waiting.appendList([tuple(r) for r in cells.where(cells.notna(), None).itertuples(index=False)])
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs())

    def _settle(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        total, first, stopped, paused, timer = self.day.get() if self.day.exists() else (0.0, None, False, False, None)
        rows = pd.DataFrame(list(self.waiting.get()), columns=["ts", "pnl", "price"]).astype({"pnl": float, "price": float})
        rows = rows.sort_values(["ts", "price"], kind="stable")
        at = np.array([int(t.timestamp() * 1000) for t in rows["ts"]], np.int64)
        settled, open_ = rows[at <= watermark], rows[at > watermark]
        if len(settled):
            found, state = breaches(key, settled, (total, first, stopped, paused), self.max_daily_loss, self.breaker)
            total, first, stopped, paused = state
            if found:
                yield pd.DataFrame(found, columns=["symbol", "day", "kind", "ts", "value"])
        if timer is not None and timer > watermark:
            self.handle.deleteTimer(timer)
        end = int((pd.Timestamp(key[1]) + pd.Timedelta(days=1)).timestamp() * 1000)
        if open_.empty and end <= watermark:
            self.waiting.clear()
            self.day.clear()
            return
        timer = int(at[at > watermark][0]) if len(open_) else end
        self.handle.registerTimer(timer)
        cells = open_.astype(object)
        if len(settled):
            self.waiting.put([tuple(r) for r in cells.where(cells.notna(), None).itertuples(index=False)]) if len(open_) else self.waiting.clear()
        self.day.update((total, first, stopped, paused, timer))

    def close(self) -> None:
        pass


def breaches_in_order(
    stream: DataFrame, max_daily_loss: float = 0.02, breaker: float = 0.1, watermark: str = WATERMARK
) -> DataFrame:
    """The moment when a symbol's day first breaks a limit, told once the watermark has passed it.

    As `first_breaches`, but events count in the order of their times however
    the batches bring them: a late event inside the watermark takes its place.
    An event without a time has no place and is passed over.  Start it within
    `cycle.keyed_state`.
    """
    days = stream.withWatermark("ts", watermark).filter(F.col("ts").isNotNull())
    days = days.select("symbol", F.date_trunc("day", "ts").alias("day"), "ts", F.col("pnl").cast("double"), F.col("price").cast("double"))
    return days.groupBy("symbol", "day").transformWithStateInPandas(OrderedStops(max_daily_loss, breaker), BREACH, "Append", "EventTime")


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a closed stream to its end and return what it wrote."""
    spark: SparkSession = stream.sparkSession
    out, checkpoint = new_path(spark, name), new_path(spark, f"{name}-checkpoint")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    start(stream, each, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)
