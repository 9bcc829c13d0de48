"""Row numbers, blocks, carries: the same result however a series is cut."""

import datetime as dt
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars import series
from tidebars.operators import backtest as bt
from tidebars.operators import clean
from tidebars.operators import indicators as ind
from tidebars.operators.recurrence import ema_with_gaps, memory

ROWS = 40  # small blocks: many borders in 700 rows


def frame(df, symbol):
    pdf = df.filter(F.col("symbol") == symbol).orderBy("ts").toPandas()
    return pdf.reset_index(drop=True)


def test_position(walk):
    df, frames = walk
    got = series.with_position(df, rows=ROWS)
    for symbol, pdf in frames.items():
        mine = frame(got, symbol)
        assert mine["pos"].tolist() == list(range(len(pdf)))
        assert set(mine["n"]) == {len(pdf)}


def test_blocks_hold_their_lookback(walk):
    df, _ = walk
    laid = series.in_blocks(series.with_position(df, rows=ROWS), 25, rows=ROWS)
    sizes = laid.groupBy("symbol", "_block").agg(F.count("*").alias("n"), F.sum(F.col("_core").cast("int")).alias("core"))
    for r in sizes.collect():
        assert r["n"] <= ROWS + 25
        assert r["core"] <= ROWS
    assert laid.filter("_core").count() == df.count()


@pytest.mark.parametrize("rows", [ROWS, series.BLOCK_ROWS])
def test_trailing_windows_against_pandas(walk, rows):
    df, frames = walk
    got = ind.with_indicators(
        df, ind.returns(), ind.sma(20), ind.sma_strict(60), ind.volatility(), ind.momentum(10), ind.atr(), rows=rows
    )
    for symbol, p in frames.items():
        mine, close = frame(got, symbol), p["close"]
        ret = close.pct_change()
        np.testing.assert_allclose(mine["returns"], ret, atol=1e-12)
        np.testing.assert_allclose(mine["ma_20"], close.rolling(20, min_periods=1).mean())
        np.testing.assert_allclose(mine["MA60"].astype(float), close.rolling(60).mean())
        np.testing.assert_allclose(mine["volatility"].astype(float), ret.rolling(20).std() * np.sqrt(252))
        np.testing.assert_allclose(mine["mom"].astype(float), close.diff(10))


@pytest.mark.parametrize("rows", [ROWS, series.BLOCK_ROWS])
def test_exponential_averages_against_pandas(walk, rows):
    df, frames = walk
    got = ind.with_indicators(
        df, ind.ema_of("close", 3, "e3"), ind.ema_of("close", 26, "e26"), ind.macd(), ind.macd_cn(), ind.tsi(),
        ind.wavetrend(), ind.dema(), rows=rows,
    )

    def ema(s, span):
        return s.ewm(span=span, adjust=False, min_periods=1).mean()

    for symbol, p in frames.items():
        mine, close = frame(got, symbol), p["close"]
        np.testing.assert_allclose(mine["e3"], ema(close, 3), rtol=1e-10)
        np.testing.assert_allclose(mine["e26"], ema(close, 26), rtol=1e-10)
        line = ema(close, 5) - ema(close, 10)
        np.testing.assert_allclose(mine["macd_signal"], ema(line, 5), atol=1e-9)
        diff = ema(close, 12) - ema(close, 26)
        np.testing.assert_allclose(mine["macd_bar"], 2 * (diff - ema(diff, 9)), atol=1e-9)
        delta = close.diff()
        tsi = 100 * ema(ema(delta, 25), 13) / ema(ema(delta.abs(), 25), 13)
        np.testing.assert_allclose(mine["tsi"].astype(float), tsi, atol=1e-8)
        ap = (p["high"] + p["low"] + close) / 3
        esa = ema(ap, 10)
        d = ema((ap - esa).abs(), 10).replace(0, ind.EPS)
        wt = ema((ap - esa) / (0.015 * d), 21)
        np.testing.assert_allclose(mine["wavetrend"], wt, atol=1e-7)
        np.testing.assert_allclose(mine["wavetrend_signal"], wt.rolling(4, min_periods=1).mean(), atol=1e-7)
        np.testing.assert_allclose(mine["dema"], 2 * ema(close, 30) - ema(ema(close, 30), 30), rtol=1e-10)


def test_flat_price_gives_exact_zeros(bars, values):
    flat = bars([(i, 7.1) for i in range(90)])
    got = ind.with_indicators(flat, ind.macd(), ind.macd_cn(), ind.tsi(), ind.wavetrend(), rows=16)
    for name in ("macd_line", "macd_signal", "macd_hist", "diff", "dea", "macd_bar", "wavetrend"):
        assert set(values(got, name)) == {0.0}
    assert values(got, "tsi")[0] is None and set(values(got, "tsi")[1:]) == {0.0}


@pytest.mark.parametrize("rows", [ROWS, series.BLOCK_ROWS])
def test_running_values_against_pandas(walk, rows):
    df, frames = walk
    pnl = df.select("symbol", "timeframe", "ts", (F.sin(F.col("close")) / 50).alias("pnl"))
    obv = ind.obv(df, rows=rows)
    curve = bt.equity_curve(pnl, rows=rows)
    figures = {r["symbol"]: r for r in bt.metrics(pnl, rows=rows).collect()}
    for symbol, p in frames.items():
        want = (np.sign(p["close"].diff()) * p["volume"]).cumsum()
        np.testing.assert_allclose(frame(obv, symbol)["obv"].astype(float), want)
        x = np.sin(p["close"]) / 50
        equity = (1 + x).cumprod()
        np.testing.assert_allclose(frame(curve, symbol)["equity"], equity)
        change = x.pct_change().dropna() - 0.02 / 252
        r = figures[symbol]
        assert r["sharpe_ratio"] == pytest.approx(np.sqrt(252) * change.mean() / change.std())
        assert r["max_drawdown"] == pytest.approx((equity / equity.cummax() - 1).min())
        assert r["total_return"] == pytest.approx(equity.iloc[-1] - 1)
        assert r["win_rate"] == pytest.approx((x > 0).mean())
        assert r["pnl"] == pytest.approx(x.sum())


def test_drawdown_with_a_loss_over_everything(bars, values):
    """A factor below zero turns the curve over; the peak must follow."""
    rows = [(i, x) for i, x in enumerate([0.1, -2.5, 0.3, -1.5, 0.2, 0.1, -0.4])]
    df = bars(rows).select("symbol", "timeframe", "ts", F.col("close").alias("pnl"))
    curve = np.cumprod([1 + x for _, x in rows])
    want = (curve / np.maximum.accumulate(curve) - 1).min()
    for size in (2, 3, 100):
        got = bt.max_drawdown_of_pnl(df, rows=size).first()["max_drawdown"]
        assert got == pytest.approx(want)


def test_fill_and_interpolation_against_pandas(walk):
    df, frames = walk
    holes = df.withColumn("close", F.when(F.dayofmonth("ts") % 9 < 4, None).otherwise(F.col("close")))
    interpolated = clean.interpolate_time(holes, ["close"], rows=ROWS)
    forward, backward = clean.ffill(holes, ["close"], rows=ROWS), clean.bfill(holes, ["close"], rows=ROWS)
    for symbol, p in frames.items():
        s = p.set_index("ts")["close"].where(p.set_index("ts").index.day % 9 >= 4)
        np.testing.assert_allclose(frame(interpolated, symbol)["close"], s.interpolate("time", limit_direction="both"))
        np.testing.assert_allclose(frame(forward, symbol)["close"].astype(float), s.ffill())
        np.testing.assert_allclose(frame(backward, symbol)["close"].astype(float), s.bfill())


def test_ema_with_gaps_against_pandas(walk):
    df, frames = walk
    holes = df.withColumn("close", F.when(F.dayofmonth("ts") % 9 < 4, None).otherwise(F.col("close")))
    for span, rows in ((7, ROWS), (3, 200), (26, series.BLOCK_ROWS)):
        got = ema_with_gaps(holes, "close", span, "e", rows=rows)
        for symbol, p in frames.items():
            s = p["close"].where(p["ts"].dt.day % 9 >= 4)
            want = s.ewm(span=span, adjust=False, min_periods=1).mean()
            np.testing.assert_allclose(frame(got, symbol)["e"].astype(float), want, rtol=1e-9)


def test_ema_with_long_gaps(bars, values):
    import pandas as pd

    closes = [float(i % 7) if i % 97 < 3 or i in (0, 500) else None for i in range(700)]
    df = bars([(i, c) for i, c in enumerate(closes)])
    want = pd.Series(closes, dtype=float).ewm(span=4, adjust=False, min_periods=1).mean()
    np.testing.assert_allclose(values(ema_with_gaps(df, "close", 4, "e", rows=ROWS), "e"), want, rtol=1e-9)


def test_minmax_bounds(walk):
    df, _ = walk
    got = clean.minmax_normalize(df.withColumn("x", F.col("close") * 3).withColumn("same", F.lit(4.0)), rows=ROWS)
    row = got.agg(F.min("x"), F.max("x"), F.min("same"), F.max("same")).first()
    assert list(row) == [0.0, 1.0, 0.0, 0.0]


def test_quantiles_of_long_series_are_exact(walk):
    df, frames = walk
    short = clean.quantiles(df, ["close", "volume"], (0.01, 0.5, 0.99))
    long = clean.quantiles(df, ["close", "volume"], (0.01, 0.5, 0.99))
    a = {r["symbol"]: r.asDict() for r in short.collect()}
    b = {r["symbol"]: r.asDict() for r in long.collect()}
    for symbol, p in frames.items():
        for name in ("close", "volume"):
            for i, q in enumerate((0.01, 0.5, 0.99)):
                want = p[name].quantile(q)
                assert a[symbol][f"{name}_q{i}"] == pytest.approx(want)
                assert b[symbol][f"{name}_q{i}"] == pytest.approx(want)


def test_quantiles_of_a_value_many_rows_share(walk):
    df, frames = walk
    flat = df.withColumns({"volume": F.lit(5.0), "open": F.when(F.col("close") > 100, F.lit(1.0)).otherwise(F.col("close"))})
    got = {r["symbol"]: r for r in clean.quantiles(flat, ["open", "volume"], (0.01, 0.5, 0.99)).collect()}
    for symbol, p in frames.items():
        opened = p["close"].where(p["close"] <= 100, 1.0)
        for i, q in enumerate((0.01, 0.5, 0.99)):
            assert got[symbol][f"open_q{i}"] == pytest.approx(opened.quantile(q))
            assert got[symbol][f"volume_q{i}"] == 5.0


def test_memory_covers_rounding():
    for span in (2, 3, 5, 26, 100):
        q = 1 - 2 / (span + 1)
        assert q ** memory(span) < 1e-20


def test_tail_beyond_the_group_limit(walk):
    df, frames = walk
    for count in (5, 1200):
        got = clean.tail_n(df, count)
        for symbol, p in frames.items():
            assert frame(got, symbol)["ts"].tolist() == p["ts"].tail(count).tolist()


@pytest.mark.parametrize("rows", [512, 700])
def test_averages_follow_the_gap_rule(spark, rows):
    """Leading, inner and trailing nulls, over several blocks, as pandas has it."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    n = 1600
    close = 100 + rng.normal(0, 1, n).cumsum()
    close[rng.random(n) < 0.25] = np.nan
    close[:3] = close[700:730] = close[-4:] = np.nan
    start = dt.datetime(2000, 1, 1)
    cells = [[None if np.isnan(x) else float(x + d) for d in (0, 1, -1, 0)] for x in close]
    bars = [("a", "1d", start + dt.timedelta(days=i), *c, 1.0) for i, c in enumerate(cells)]
    df = spark.createDataFrame(bars, "symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    used = ind.ema_of("close", 60, "slow"), ind.macd(), ind.tsi(), ind.wavetrend(), ind.dema()
    got = ind.with_indicators(df, *used, rows=rows).orderBy("ts").toPandas()
    c = pd.Series(close)

    def e(x, span):
        return x.ewm(span=span, adjust=False).mean()

    line, change, typical = e(c, 5) - e(c, 10), c.diff(), ((c + 1) + (c - 1) + c) / 3
    away = typical - e(typical, 10)
    want = {
        "slow": e(c, 60), "macd_line": line, "macd_signal": e(line, 5), "tsi": 100 * e(e(change, 25), 13) / e(e(change.abs(), 25), 13),
        "wavetrend": e(away / (e(away.abs(), 10).replace(0, 2.220446049250313e-16) * 0.015), 21), "dema": 2 * e(c, 30) - e(e(c, 30), 30),
    }
    for name, values in want.items():
        np.testing.assert_allclose(got[name], values, rtol=1e-9, atol=1e-8)


def _holed(spark, gaps, n=3000, seed=5):
    """Two symbols whose closes are missing in the given (start, length) stretches; highs are missing in others."""
    import pandas as pd

    rng = np.random.default_rng(seed)
    frames, rows, start = {}, [], dt.datetime(2000, 1, 1)
    for symbol, shift in (("a", 0), ("b", 7)):
        close = 100 + rng.normal(0, 1, n).cumsum()
        high = close + 1
        for at, length in gaps:
            close[at + shift : at + shift + length] = np.nan
            high[at // 2 : at // 2 + length] = np.nan
        p = pd.DataFrame({"close": close, "high": high, "low": close - 1})
        frames[symbol] = p
        cells = p.astype(object).where(p.notna(), None)
        rows += [(symbol, "1d", start + dt.timedelta(days=i), c, h, low, 1.0) for i, (c, h, low) in enumerate(cells.itertuples(index=False))]
    names = "symbol string, timeframe string, ts timestamp_ntz, close double, high double, low double, volume double"
    return spark.createDataFrame(rows, names).withColumn("open", F.col("close")), frames


@pytest.mark.parametrize("rows", [64, 512, 700, series.BLOCK_ROWS])
@pytest.mark.parametrize("gaps", [[(5, 2), (300, 200), (800, 2000)], [(i, 1) for i in range(1, 2990, 2)], [(i, 90) for i in range(3, 2800, 91)]])
def test_averages_over_gaps_of_any_length(spark, rows, gaps):
    """Long gaps, every other close, one close in ninety: equal to pandas whatever the block size."""
    df, frames = _holed(spark, gaps)
    used = ind.ema_of("close", 26, "slow"), ind.macd(), ind.tsi(), ind.wavetrend(), ind.dema(), ind.signal_accuracy(), ind.sma(20)
    got = ind.with_indicators(df, *used, rows=rows)

    def e(x, span):
        return x.ewm(span=span, adjust=False).mean()

    for symbol, p in frames.items():
        c, mine = p["close"], frame(got, symbol)
        assert len(mine) == len(p)
        line, change, typical = e(c, 5) - e(c, 10), c.diff(), (p["high"] + p["low"] + c) / 3
        diff, away = e(c, 12) - e(c, 26), typical - e(typical, 10)
        wave = e(away / (e(away.abs(), 10).replace(0, ind.EPS) * 0.015), 21)
        size = e(e(change.abs(), 25), 13).replace(0, ind.EPS)
        pointed = np.where(2 * (diff - e(diff, 9)) > e(line, 5), 1, -1)
        hit = (pointed == np.where(change > 0, 1, -1)).astype(float)
        want = {
            "slow": e(c, 26), "macd_line": line, "macd_signal": e(line, 5), "dema": 2 * e(c, 30) - e(e(c, 30), 30), "wavetrend": wave,
            "wavetrend_signal": wave.rolling(4, min_periods=1).mean(), "tsi": 100 * e(e(change, 25), 13) / size, "ma_20": c.rolling(20, min_periods=1).mean(),
            "accuracy": pd_mean(hit, 20),
        }
        for name, values in want.items():
            np.testing.assert_allclose(mine[name].astype(float), values, rtol=1e-8, atol=1e-7, err_msg=name)


def pd_mean(x, window):
    import pandas as pd

    return pd.Series(x).rolling(window, min_periods=1).mean()


def test_a_block_sees_a_bounded_number_of_rows(spark):
    """What a block looks back on follows the values it needs, not the length of the gap before it."""
    df, _ = _holed(spark, [(300, 2000)])
    values = {"close": (F.col("close").isNotNull(), 50)}
    for source in (df, series.with_position(df, rows=64)):
        laid = series.in_blocks(source, 10, rows=64, values=values)
        assert laid.filter("_core").count() == df.count()
        assert laid.groupBy("symbol", "_block").count().agg(F.max("count")).first()[0] <= 64 + 10 + 50 + 64


@pytest.mark.parametrize("ranked", [1, 7, 1 << 16])
def test_radix_selection(spark, ranked, monkeypatch):
    """Heavy ties, far outliers, infinities, nulls and values that differ in the last digits, at every depth of digits."""
    monkeypatch.setattr(clean, "RANKED_VALUES", ranked)
    rng = np.random.default_rng(8)
    samples = {
        "ties": rng.integers(0, 4, 400).astype(float), "near": 1e6 + rng.random(300) * 1e-8, "wild": rng.normal(size=500) ** 9 * 1e50,
        "signs": np.r_[rng.normal(size=200), [0.0, -0.0]], "ends": np.r_[rng.normal(size=50), [np.inf, -np.inf]], "one": np.array([3.5]),
    }
    rows = [(s, "1d", float(x)) for s, xs in samples.items() for x in xs] + [("ties", "1d", None), ("none", "1d", None), ("one", "1d", float("nan"))]
    rows += [(None, "1d", 2.0), (None, "1d", 4.0)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, x double").repartition(5)
    shares = (0.0, 0.013, 0.5, 0.99, 1.0)
    got = {r["symbol"]: r for r in clean.quantiles(df, ["x"], shares).collect()}
    assert set(got) == {*samples, None} and got[None]["x_q2"] == 3.0
    for s, xs in samples.items():
        xs = np.sort(xs)
        for i, share in enumerate(shares):
            rank = (len(xs) - 1) * share
            low, high = xs[math.floor(rank)], xs[math.ceil(rank)]
            want = low if rank == math.floor(rank) or np.isinf(low) else high if np.isinf(high) else low + (high - low) * (rank - math.floor(rank))
            assert got[s][f"x_q{i}"] == pytest.approx(want, rel=1e-12), (s, i)


def test_winsorize_reads_its_input_three_times(spark, walk, tmp_path):
    df, _ = walk
    df.drop("_x").write.parquet(str(tmp_path / "bars"))
    stored = spark.read.parquet(str(tmp_path / "bars"))
    plan = clean.winsorize(stored)._jdf.queryExecution().optimizedPlan().toString()
    # Digits are counted in a job of its own; what is left reads the bars for the ranking and for the clipping.
    assert len(re.findall(r"Relation \[symbol#\d+,timeframe#\d+,ts#", plan)) == 2


def test_staged_folders_can_be_dropped(spark, walk):
    import os

    df, _ = walk
    before = set(series.staged_paths(spark))
    assert series.staged(df, "gone").count() == df.count()
    made = [p for p in series.staged_paths(spark) if p not in before]
    assert len(made) == 1 and os.path.isdir(made[0])
    series.drop_staged(spark, made)
    assert not os.path.exists(made[0]) and set(series.staged_paths(spark)) == before
