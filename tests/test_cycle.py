"""The live cycle, the store it writes to, and stops in the order of events."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebars.operators.recurrence import Carried, Whole
from tidebars.plans import analysis
from tidebars.series import new_path
from tidebars.streaming import cycle, live
from tidebars.streaming.store import UpsertStore

START = dt.datetime(2024, 1, 1)


def files(spark, batches, schema):
    """A stream that reads one batch a file, in order."""
    path = new_path(spark, "ticks")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{path}/part={i:04d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{path}/*")


@pytest.mark.parametrize("cuts", [[3], [1, 2, 3, 4, 50, 51], list(range(1, 200, 7))])
def test_carried_figures_go_on(cuts):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    x[rng.random(200) < 0.3] = np.nan
    x[:4] = x[60:120] = np.nan

    def figures(x, t):
        return [t.ema(x, 5), t.ema(x, 26), t.mean(x, 4), t.deviation(x, 20), t.back(x, 3), t.total(x), t.greatest(x)]

    want, slots, parts = figures(x, Whole()), None, []
    for part in np.split(x, cuts):
        t = Carried(slots)
        parts.append(figures(part, t))
        slots = t.slots
        assert all(len(s) <= 20 for s in slots)
    for i, w in enumerate(want):
        np.testing.assert_allclose(np.concatenate([p[i] for p in parts]), w, rtol=1e-10, atol=1e-12)


def tick_batches(minutes=60 * 30, batches=7, symbols=("a", "b")):
    rng, price, rows = random.Random(3), dict.fromkeys(symbols, 100.0), []
    for m in range(minutes):
        for s in symbols:
            price[s] += rng.uniform(-1, 1)
            rows.append((s, START + dt.timedelta(minutes=m, seconds=rng.randint(0, 59)), price[s], float(rng.randint(1, 9))))
    size = len(rows) // batches + 1
    return [rows[i : i + size] for i in range(0, len(rows), size)]


TICKS = "symbol string, ts timestamp, price double, volume double"


def scores():
    return {"p0": F.col("tsi") / 100, "p1": F.col("rsi") / 100, "p2": F.lit(1.5), "dynamic_weight": F.col("accuracy")}


@pytest.mark.parametrize("batches", [1, 7])
def test_cycle_is_the_batch_run(spark, batches):
    rows = tick_batches(batches=batches)
    stream = files(spark, rows, TICKS)
    bars = live.stream_bars(live.ticks(stream, "symbol", "price", F.col("volume")), 15, closing="at")
    trades = cycle.live_trades(bars, scores())
    store = cycle.trade_store(spark, new_path(spark, "trades"), trades)
    cycle.run_cycle(trades, store, new_path(spark, "checkpoint")).awaitTermination()
    got = store.read().orderBy("symbol", "ts").toPandas()

    ticks = spark.createDataFrame([r for b in rows for r in b], TICKS)
    end = max(r[1] for b in rows for r in b) - dt.timedelta(minutes=10)
    whole = live.stream_bars(live.ticks(ticks, "symbol", "price", F.col("volume")), 15).filter(F.col("ts") + F.expr("interval 15 minutes") <= F.lit(end))
    known = analysis.raw_features(whole).toPandas().sort_values(["symbol", "ts"])
    known["risk"] = known["volatility_p"] / known.groupby("symbol")["volatility_p"].cummax()
    kinds = {"symbol": "string", "timeframe": "string", "ts": "timestamp_ntz"}
    records = [tuple(None if pd.isna(x) else x if c in ("symbol", "timeframe") else x.to_pydatetime() if c == "ts" else float(x) for c, x in r.items()) for r in known.to_dict("records")]
    want = cycle.managed(spark.createDataFrame(records, ", ".join(f"{c} {kinds.get(c, 'double')}" for c in known)).withColumns(scores()))
    want = want.select(*cycle.TRADE).orderBy("symbol", "ts").toPandas()
    assert len(got) == len(want) > 200 and got["ts"].tolist() == want["ts"].tolist()
    for c in cycle.TRADE[3:]:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-8, atol=1e-9, err_msg=c)


def test_all_features_are_those_of_the_batch(spark):
    rows = tick_batches(minutes=60 * 20, batches=4)
    bars = live.stream_bars(live.ticks(files(spark, rows, TICKS), "symbol", "price", F.col("volume")), 5, closing="at")
    with cycle.keyed_state(spark):
        got = live.run_to_table(cycle.live_features(bars), "features").orderBy("symbol", "ts").toPandas()
    whole = live.stream_bars(live.ticks(spark.createDataFrame([r for b in rows for r in b], TICKS), "symbol", "price", F.col("volume")), 5)
    want = analysis.raw_features(whole).join(spark.createDataFrame(got[["symbol", "ts"]]).withColumn("ts", F.col("ts").cast("timestamp_ntz")), ["symbol", "ts"]).orderBy("symbol", "ts").toPandas()
    assert len(got) == len(want) > 400
    for c in cycle.FEATURES[:-1]:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-8, atol=1e-7, err_msg=c)


def test_old_state_expires(spark):
    """A series that is silent for longer than the limit begins anew; a shorter silence changes nothing."""

    def ticks(symbol, hours):
        return [(symbol, START + dt.timedelta(hours=h), 100.0 + h % 5, 1.0) for h in hours]

    early, late = range(0, 30), range(30, 60)
    rows = [ticks("a", early) + ticks("b", early), ticks("b", late), ticks("b", range(60, 90)), ticks("a", range(90, 95)) + ticks("b", range(90, 95)), ticks("b", range(95, 99))]
    for limit, begins in ((24, 100.0), (500, None)):
        bars = live.stream_bars(live.ticks(files(spark, rows, TICKS), "symbol", "price", F.col("volume")), 60, closing="at")
        with cycle.keyed_state(spark):
            got = live.run_to_table(cycle.live_features(bars, pd.Timedelta(hours=limit)), "features").toPandas()
        first = got[(got["symbol"] == "a") & (got["ts"] == START + dt.timedelta(hours=90))].iloc[0]
        assert (first["ma_20"] == begins) == (begins is not None)
        whole = got[(got["symbol"] == "b") & (got["ts"] == START + dt.timedelta(hours=90))].iloc[0]
        assert whole["ma_20"] == np.mean([100.0 + h % 5 for h in range(71, 91)])


# --- the store -------------------------------------------------------------
ROW = "symbol string, ts int, value double"


def contents(store):
    return sorted(tuple(r) for r in store.read().collect())


def store_of(spark, schema, **more):
    return UpsertStore(spark, new_path(spark, "store"), spark.createDataFrame([], schema).schema, ["symbol", "ts"], **more)


def test_store_keeps_the_latest_and_stays_small(spark):
    store, want = store_of(spark, ROW, keep_batches=6), {}
    assert contents(store) == []
    for batch in range(50):
        rows = [("a", batch, float(batch)), ("a", max(batch - 3, 0), 100.0 + batch), (None, 0, float(batch))]
        store.upsert(spark.createDataFrame(rows[:2] + rows[2:], ROW).coalesce(1), batch)
        want |= {r[:2]: r[2] for r in (rows[0], *rows[1:])}
        if batch == 0:
            want[("a", 0)] = 100.0
        assert store.folders() <= 2 * 7 + 2
    assert contents(store) == sorted((*k, v) for k, v in want.items()) if None not in {k[0] for k in want} else {r[:2]: r[2] for r in store.read().collect()} == want


def test_repeated_and_corrected_rows(spark):
    store = store_of(spark, ROW, keep_batches=3)
    for batch, rows in enumerate([[("a", 1, 1.0), ("a", 2, 2.0)], [("a", 2, 2.5)], [("a", 3, 3.0)]]):
        for _ in range(2):  # each batch comes twice
            store.upsert(spark.createDataFrame(rows, ROW), batch)
    assert contents(store) == [("a", 1, 1.0), ("a", 2, 2.5), ("a", 3, 3.0)]
    store.compact()
    store.upsert(spark.createDataFrame([("a", 1, 9.0)], ROW), 1)  # already in the base
    assert contents(store) == [("a", 1, 1.0), ("a", 2, 2.5), ("a", 3, 3.0)]
    store.upsert(spark.createDataFrame([("a", 1, 9.0), ("a", 4, None)], ROW), 3)
    assert contents(store) == [("a", 1, 9.0), ("a", 2, 2.5), ("a", 3, 3.0), ("a", 4, None)]


def test_order_within_a_batch_and_cut(spark):
    store = store_of(spark, "symbol string, ts int, value double, seen int", order="seen", keep=lambda df: df.filter("ts > 1"))
    store.upsert(spark.createDataFrame([("a", 1, 5.0, 1), ("a", 2, 7.0, 1), ("a", 2, 6.0, 2), ("a", 2, 8.0, None)], "symbol string, ts int, value double, seen int"), 0)
    assert contents(store) == [("a", 1, 5.0, 1), ("a", 2, 6.0, 2)]
    store.compact()
    assert contents(store) == [("a", 2, 6.0, 2)]


# --- stops -----------------------------------------------------------------
@pytest.mark.parametrize("late", [0, 1, 8])
def test_breaches_in_order_of_events(spark, late):
    """Shuffled batches give the breaches that the daily limit gives over all events in order."""
    from tidebars.operators.risk import daily_loss_limit

    rng, rows = random.Random(9), []
    for s in ("a", "b", "c"):
        for m in range(60 * 40):
            rows.append((s, START + dt.timedelta(minutes=m, seconds=rng.randint(0, 59)), rng.gauss(0, 0.001), 100 + rng.gauss(0, 4) if m % 7 else None))
    rows += [("a", None, -1.0, 1.0), (None, START, -0.5, 3.0), ("b", START + dt.timedelta(hours=3), None, None)]
    arrival = {r: (r[1] or START) + dt.timedelta(minutes=rng.randint(0, late)) for r in rows}
    rows.sort(key=arrival.get)
    size = len(rows) // 9 + 1
    schema = "symbol string, ts timestamp, pnl double, price double"
    stream = files(spark, [rows[i : i + size] for i in range(0, len(rows), size)], schema)
    with cycle.keyed_state(spark):
        got = live.run_to_table(live.breaches_in_order(stream, 0.02, 0.1), "breaches").collect()
    end = max(r[1] for r in rows if r[1]) - dt.timedelta(minutes=10)
    known = spark.createDataFrame([r for r in rows if r[1] and r[1] <= end], schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    limited = daily_loss_limit(known.withColumn("pnl", F.coalesce("pnl", F.lit(0.0))), 0.02, keys=("symbol",))
    stops = limited.filter("stop").groupBy("symbol", F.to_date("ts").alias("day")).agg(F.min("ts").alias("ts"))
    want = {(r["symbol"], r["ts"]) for r in stops.collect()}
    assert {(r["symbol"], r["ts"]) for r in got if r["kind"] == "stop"} == want and len(want) >= 4
    first, paused = {}, {}
    for s, ts, _, price in sorted((r for r in rows if r[1] and r[1] <= end and r[3]), key=lambda r: r[1]):
        base = first.setdefault((s, ts.date()), price)
        if abs(price / base - 1) > 0.1:
            paused.setdefault((s, ts.date()), ts)
    assert {(r["symbol"], r["ts"].date()): r["ts"] for r in got if r["kind"] == "pause"} == paused
    assert len(got) == len(want) + len(paused)
