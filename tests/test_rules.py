"""Hand-worked cases of the edge rules."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebars.functions import columns as fn
from tidebars.operators import align, backtest, calendar, clean, integrity, model, risk, signals, text
from tidebars.operators import indicators as ind
from tidebars.operators.recurrence import ema_with_gaps
from tidebars.series import require_columns
from tidebars.sources import bars as bars_source
from tidebars.timeframes import canonical


def test_ema_null_rule(bars, values):
    df = bars([(i, x) for i, x in enumerate([None, 1.0, None, 4.0, 2.0])])
    got = values(ema_with_gaps(df, "close", 3, "e"), "e")
    assert got[0] is None and got[1:] == pytest.approx([1, 1, 3, 2.5])


def test_interpolation_by_elapsed_time(bars, values):
    df = bars([(1, 1.0), (2, None), (5, None), (6, None), (7, 9.0)])
    assert values(clean.interpolate_time(df, ["close"]), "close") == pytest.approx([1, 7 / 3, 19 / 3, 23 / 3, 9])
    df = bars([(1, None), (2, 1.0), (5, None), (6, 4.0), (7, None)])
    assert values(clean.interpolate_time(df, ["close"]), "close") == pytest.approx([1, 1, 3.25, 4, 4])


def test_handle_nan_inf(bars, values):
    df = bars([(0, 1.0), (1, math.inf), (2, math.nan), (3, 4.0)])
    assert values(clean.handle_nan_inf(df, ["close"]), "close") == pytest.approx([1, 2, 3, 4])


def test_quantile_interpolation(bars):
    row = clean.quantiles(bars([(i, float(i + 1)) for i in range(4)]), ["close"], (0.01, 0.99)).first()
    assert (row["close_q0"], row["close_q1"]) == pytest.approx((1.03, 3.97))


def test_single_row_series(bars, values):
    one = bars([(0, 5.0)])
    got = ind.with_indicators(one, ind.returns(), ind.volatility_partial(), ind.rsi(), ind.macd(), ind.wavetrend())
    row = got.first()
    assert row["returns"] is None and row["volatility_p"] is None
    assert row["macd_hist"] == 0 and row["wavetrend"] == 0
    assert row["rsi"] == pytest.approx(0)


def test_zero_prices_do_not_raise(bars):
    df = bars([(i, float(i % 2)) for i in range(30)])
    got = ind.with_indicators(
        df, ind.returns(), ind.log_returns(), ind.trend_strength(), ind.price_stats(), ind.volume_rate(), ind.tsi()
    )
    assert got.count() == 30


def test_rsi_of_a_rising_price(bars, values):
    got = values(ind.with_indicators(bars([(i, float(i)) for i in range(20)]), ind.rsi()), "rsi")
    assert got[-1] == pytest.approx(100)


def test_end_date_forms():
    assert clean.end_date("2024-01-05 10:00:00") == "2024-01-05"
    assert clean.end_date(dt.date(2024, 1, 5)) == "2024-01-05"
    assert clean.end_date(dt.datetime(2024, 1, 5, 9)) == "2024-01-05"


def test_left_pad(bars, values):
    got = clean.left_pad(bars([(0, 1.0), (1, 2.0)]), 4).orderBy("pos").collect()
    assert [(r["pos"], r["close"]) for r in got] == [(0, None), (1, None), (2, 1.0), (3, 2.0)]


def test_drop_empty_rows(spark):
    df = spark.createDataFrame([("", ""), ("a", ""), (None, ""), ("", "b")], "x string, y string")
    assert clean.drop_empty_rows(df).count() == 2


def test_require_columns(bars):
    with pytest.raises(ValueError, match="atr"):
        require_columns(bars([(0, 1.0)]), ["close", "atr"])


def test_timeframe_codes():
    assert canonical("1m") == "1mo" and canonical("5m") == "5m"
    with pytest.raises(ValueError):
        canonical("7m")


# --- calendar --------------------------------------------------------------
def dates(spark, *days):
    return spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "date date")


def last_day(spark, day, period, holidays):
    df = dates(spark, day)
    closed = dates(spark, *holidays)
    cal = calendar.trading_calendar(df, closed, F.min("date"), F.max("date"))
    anchor = calendar.period_anchor(F.col("date"), period)
    return calendar.last_trading_day(df, cal, anchor, F.lit(period == "week")).first()["last_trading_day"]


def test_last_trading_day(spark):
    holiday_friday = ["2024-03-08"]
    assert last_day(spark, "2024-03-04", "week", holiday_friday) == dt.date(2024, 3, 7)
    whole_week = [f"2024-03-{d:02d}" for d in range(4, 9)]
    assert last_day(spark, "2024-03-04", "week", whole_week) is None
    # From a Saturday on it is the next week's Friday.
    assert last_day(spark, "2024-03-09", "week", holiday_friday) == dt.date(2024, 3, 15)
    assert last_day(spark, "2024-03-10", "month", ["2024-03-29"]) == dt.date(2024, 3, 28)
    assert last_day(spark, "2024-05-10", "quarter", ["2024-01-01"]) == dt.date(2024, 6, 28)
    march = [f"2024-03-{d:02d}" for d in range(1, 32)]
    assert last_day(spark, "2024-03-10", "month", march) == dt.date(2024, 2, 29)


def test_trading_slots():
    assert [len(calendar.slot_times(m)) for m in (5, 15, 60)] == [48, 16, 4]
    assert calendar.slot_times(60) == ["10:30", "11:30", "14:00", "15:00"]


def test_default_holidays(spark):
    got = calendar.default_holidays(spark, 2023, 2024)
    assert got.count() == 38 and got.distinct().count() == 38


def test_holiday_dates_parse(spark):
    cases = {
        "1 Jan": "2024-01-01", "Jan 1": "2024-01-01", "01 january": "2024-01-01", "May 5": "2024-05-05",
        "12.03": "2024-03-12", "12.25": "2024-12-25", "2020-2-29": "2020-02-29", "30 Feb": None, "soon": None,
        "13.13": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", fn.parse_holiday_date(F.col("t"), F.lit(2024)).alias("d")).collect()}
    assert {k: v and v.isoformat() for k, v in got.items()} == cases


def test_missing_and_extra_are_disjoint(spark, bars):
    df = bars([(i, 1.0) for i in (0, 1, 2, 5, 6, 9)])
    closed = dates(spark, "2024-01-01")
    missing = {r["ts"] for r in integrity.missing_periods(df, closed).collect()}
    extra = {r["ts"] for r in integrity.extra_periods(df, closed).collect()}
    assert {t.day for t in missing} == {4, 5, 8, 9}
    assert {t.day for t in extra} == {1, 6, 7}
    assert not missing & extra


def test_ohlc_reasons(bars):
    df = bars([(0, 5.0, 4.0, 6.0, 5.0, 1.0)])
    row = integrity.check_ohlc(df).first()
    assert row["reasons"] == ["Low > High", "Open > High", "Open < Low", "Close > High", "Close < Low"]


# --- alignment -------------------------------------------------------------
def minutes(*ms):
    return [dt.datetime(2024, 1, 1, 9, 0) + dt.timedelta(minutes=m) for m in ms]


def test_align_modes(bars):
    base = bars([(t, float(i)) for i, t in enumerate(minutes(0, 5, 10, 15, 20, 25, 30, 35))], timeframe="5m")
    longer = bars([(t, 100.0 + i) for i, t in enumerate(minutes(0, 30))], timeframe="30m")
    both = base.unionByName(longer)

    def closes(mode):
        got = align.align_timeframes(both, "5m", mode=mode).filter("timeframe = '30m'")
        return [r["close"] for r in got.orderBy("ts").collect()]

    # Nothing after the last slot of the longer series, at 09:30.
    assert closes("same_bar") == [100.0] * 6 + [101.0, None]
    assert closes("closed") == [None] * 6 + [100.0, 100.0]


def test_align_skips_off_grid_base_rows(bars):
    base = bars([(dt.datetime(2024, 1, 1, 9, 0, 7), 1.0), (dt.datetime(2024, 1, 1, 9, 5), 2.0)], timeframe="5m")
    longer = bars([(t, 9.0) for t in minutes(0, 60)], timeframe="60m")
    got = align.align_timeframes(base.unionByName(longer), "5m").filter("timeframe = '60m'").orderBy("ts").collect()
    assert [r["close"] for r in got] == [None, 9.0]


def test_ffill_limit(bars, values):
    df = bars([(t, x) for t, x in zip(minutes(0, 30, 60, 90), [1.0, None, None, None])], timeframe="30m")
    assert values(align.ffill_limit(df, 2, "30m"), "close") == [1, 1, 1, None]
    assert values(align.ffill_limit(df, 0, "30m"), "close") == [1, None, None, None]


def test_resample_grid_in_pieces(bars, monkeypatch):
    monkeypatch.setattr(align, "SLOTS_PER_CHUNK", 3)
    df = bars([(t, x) for t, x in zip(minutes(0, 7, 55, 200), [1.0, 2.0, 3.0, 4.0])], timeframe="5m")
    got = align.resample_last(df, "15m", grid=True).orderBy("ts").collect()
    assert [r["ts"] for r in got] == minutes(*range(0, 200, 15))
    assert [r["close"] for r in got if r["close"]] == [2.0, 3.0, 4.0]


def test_tail_align(bars):
    a = bars([(i, float(i)) for i in range(5)]).select("symbol", "timeframe", "ts", "close")
    b = bars([(i, 10.0 * i) for i in range(3)]).select("symbol", "timeframe", "ts", F.col("close").alias("other"))
    got = align.tail_align(a, b).orderBy("pos").collect()
    assert [(r["close"], r["other"], r["pos"], r["n"]) for r in got] == [(2, 0, 0, 3), (3, 10, 1, 3), (4, 20, 2, 3)]


# --- signals, risk, backtest ----------------------------------------------
def test_sharpe_of_infinite_change(bars):
    df = bars([(i, x) for i, x in enumerate([0.0, 0.0, 1.0, 0.0, -1.0])])
    assert backtest.sharpe_of_pnl(df.select("symbol", "timeframe", "ts", F.col("close").alias("pnl"))).first()[2] == 0


def test_entry_strategy_bands(spark):
    cases = [
        (0.8, 2.0, 1, 0.05, "Strong_Long"), (0.7, 1.5, 1, 0.15, "Medium_Long"), (0.5, 1.0, 1, 0.25, "Weak_Long"),
        (-0.3, 1.0, -1, 0.25, "Weak_Short"), (-0.5, 1.2, -1, 0.15, "Medium_Short"), (-0.7, 2.0, -1, 0.05, "Strong_Short"),
        (0.8, 2.0, 0, 0.05, "Neutral"), (0.8, 1.2, 1, 0.05, "Neutral"), (0.8, 2.0, 1, 0.1, "Neutral"),
    ]
    df = spark.createDataFrame([(float(a), float(b), float(c), d, e) for a, b, c, d, e in cases], "s double, l double, c double, r double, w string")
    label = fn.entry_strategy(F.col("s"), F.col("l"), F.col("c"), F.col("r"))
    assert df.filter(label != F.col("w")).count() == 0


def test_combined_signal_weighs_hours_and_ignores_codes_without_weight(spark):
    rows = [("x", "5m", 1.0, 1.0, 1.0, 1.0), ("x", "1d", 4.0, 1.0, 1.0, 1.0), ("x", "30m", 99.0, 1.0, 1.0, 1.0), ("y", "5m", 0.0, 1.0, 1.0, 1.0), ("y", "60m", 1.0, 1.0, 1.0, 1.0), ("z", "1h", 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, signal_strength double, entry_level double, stop_loss double, position_size double")
    got = {r["symbol"]: r["signal_strength"] for r in signals.combine_timeframe_signals(df).collect()}
    assert got == {"x": pytest.approx((0.1 + 0.8) / 0.3), "y": pytest.approx(0.2 / 0.3), "z": pytest.approx(1.0)}


def test_comprehensive_signal_stops_at_the_shortest(bars, spark):
    long = bars([(i, 1.0) for i in range(5)], timeframe="5m")
    short = bars([(i, 3.0) for i in range(2)], timeframe="15m")
    df = long.unionByName(short).withColumn("signal_strength", F.col("close")).withColumn("dynamic_weight", F.lit(1.0))
    consistency = spark.createDataFrame([("x", -1.0)], "symbol string, trend_consistency double")
    got = signals.comprehensive_signal(df, consistency).orderBy("tail").collect()
    assert [(r["tail"], r["comprehensive_signal"]) for r in got] == [(0, -2.0), (1, -2.0)]


def test_risk_keeps_signals_without_bars(bars):
    made = bars([(i, 1.0) for i in range(3)]).select(
        "symbol", "timeframe", "ts", F.lit(1.0).alias("signal_strength"), F.lit(1.0).alias("entry_level"),
        F.lit(1.0).alias("stop_loss"), F.lit(1.0).alias("position_size"),
    )
    known = bars([(9, 1.0)]).select("symbol", "timeframe", "ts", F.lit(0.25).alias("risk"))
    got = risk.risk_adjust(made, known).orderBy("ts").collect()
    assert [r["signal_strength"] for r in got] == [1.0, 1.0, 0.75]
    assert [r["entry_level"] for r in got] == [1.0, 1.0, 1.25]


def test_daily_loss_limit(bars, values):
    hours = [dt.datetime(2024, 1, 1, h) for h in (9, 10, 11)] + [dt.datetime(2024, 1, 2, 9)]
    df = bars(list(zip(hours, [-0.01, -0.01, 0.05, -0.001]))).withColumn("pnl", F.col("close"))
    assert values(risk.daily_loss_limit(df), "stop") == [False, True, False, False]


def test_position_size_without_distance(spark):
    row = spark.range(1).select(fn.position_size(F.lit(100.0), F.lit(0.1), F.lit(5.0), F.lit(5.0)).alias("u")).first()
    assert row["u"] is None


# --- model -----------------------------------------------------------------
def test_feature_target_refuses_nulls(bars):
    df = bars([(0, 1.0)]).withColumns({"returns": F.lit(None).cast("double"), "trend_strength": F.lit(1.0), "atr": F.lit(1.0)})
    with pytest.raises(Exception, match="null or infinite"):
        model.feature_target(df).collect()


def test_split_floor(bars):
    got = model.chronological_split(bars([(i, 1.0) for i in range(9)])).filter("is_train")
    assert got.count() == 7


def test_market_regime(bars, spark):
    import random

    random.seed(1)
    spots = [(0.0, 0.0), (10.0, 10.0), (20.0, 0.0)]
    rows = []
    for i in range(90):
        x, y = spots[i % 3]
        rows.append((i, x + random.random(), y + random.random()))
    df = bars([(i, 1.0, 1.0, 1.0, 1.0, y) for i, x, y in rows])
    extra = spark.createDataFrame([(i, x) for i, x, _ in rows], "i int, x double")
    joined = df.withColumn("i", F.datediff("ts", F.lit("2024-01-01").cast("date"))).join(extra, "i")
    ready = joined.withColumns({"volatility": F.when(F.col("i") != 5, F.col("x")), "trend_strength": F.col("x")})
    short = bars([(0, 1.0), (1, None)], symbol="s").withColumns({"volatility": F.col("close"), "trend_strength": F.lit(1.0)})
    both = ready.drop("i", "x").unionByName(short)
    got = model.market_regime(both, max_k=5).collect()
    by_spot = {}
    for r in got:
        if r["symbol"] == "s":
            assert r["regime"] == 0
        elif (r["ts"] - dt.datetime(2024, 1, 1)).days == 5:
            assert r["regime"] is None
        else:
            by_spot.setdefault((r["ts"] - dt.datetime(2024, 1, 1)).days % 3, set()).add(r["regime"])
    assert by_spot == {0: {0}, 1: {1}, 2: {2}}


# --- text ------------------------------------------------------------------
@pytest.mark.parametrize("rows", [2, 3, 100])
def test_stitch_records(spark, rows):
    lines = ["a", "<b", "<c", "d>", "e>", "<f>", " <g"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id int, pos int, line string")
    got = text.stitch_records(df, "<", ">", rows=rows).orderBy("pos").collect()
    assert [(r["pos"], r["record"]) for r in got] == [(3, "<b<cd>"), (5, "<f>")]


def test_text_columns(spark):
    df = spark.createDataFrame([(["a", "", "b"], [""], " x\t")], "a array<string>, b array<string>, t string")
    row = df.select(
        fn.join_nonempty(F.col("a"), ";").alias("a"), fn.join_nonempty(F.col("b"), ";").alias("b"),
        fn.trim_equals(F.col("t"), "x").alias("t"), fn.split_regex(F.lit("a1b22"), r"\d").alias("s"),
    ).first()
    assert (row["a"], row["b"], row["t"], row["s"]) == ("a;b;", "", True, ["a", "b", "", ""])


def test_normalize_symbol(spark):
    df = spark.createDataFrame([("000001.XSHG",), ("000002.XSHE",), ("sz000003",)], "c string")
    assert [r[0] for r in df.select(fn.normalize_symbol(F.col("c"))).collect()] == ["sh000001", "sz000002", "sz000003"]


# --- nothing is lost without a word -----------------------------------------
def test_null_keys_keep_their_rows(bars, spark):
    df = bars([(0, 1.0), (1, 2.0), (2, 4.0)])
    odd = df.limit(1).withColumn("ts", F.lit(None).cast("timestamp_ntz")).unionByName(df.limit(1).withColumn("symbol", F.lit(None).cast("string")))
    every = df.unionByName(odd)
    assert ind.with_indicators(every, ind.returns()).count() == 5
    assert clean.winsorize(every, ["close"]).count() == 5
    assert clean.ffill(every, ["close"]).count() == 5
    assert clean.handle_nan_inf(every).count() == 5
    assert clean.tail_n(every, 2).count() == 3
    assert bars_source.fallback_union(every.filter("symbol is null"), every).count() == 5


def test_tail_is_the_same_across_chunks(spark):
    df = spark.range(200_000).selectExpr("'a' as symbol", "'5m' as timeframe", "timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, cast(5 * id as int)) as ts", "id")
    for count in (1, 20, 40_000):
        got = clean.tail_n(df, count).agg(F.count("id").alias("n"), F.min("id").alias("lo")).first()
        assert (got["n"], got["lo"]) == (count, 200_000 - count)


def test_gap_filling_has_one_schema(bars):
    df = bars([(0, 1.0), (1, 2.0)]).withColumn("k", F.lit(3))
    gap = df.withColumn("k", F.when(F.col("close") > 1, F.col("k")))
    assert clean.handle_nan_inf(df).schema["k"].dataType == clean.handle_nan_inf(gap).schema["k"].dataType


def test_each_symbol_has_its_own_base(bars):
    day = dt.datetime(2024, 1, 2)
    minutes = lambda symbol, code, step, n: bars([(day + dt.timedelta(minutes=i * step), float(i)) for i in range(n)], symbol, code)
    df = minutes("a", "5m", 5, 24).unionByName(minutes("a", "1h", 60, 2)).unionByName(minutes("b", "15m", 15, 8)).unionByName(minutes("b", "60m", 60, 2))
    got = {(r["symbol"], r["timeframe"]): r["n"] for r in align.align_timeframes(df).groupBy("symbol", "timeframe").agg(F.count("ts").alias("n")).collect()}
    assert got == {("a", "5m"): 24, ("a", "60m"): 24, ("b", "15m"): 8, ("b", "60m"): 8}
    with pytest.raises(Exception, match="unknown timeframe"):
        align.align_timeframes(df.withColumn("timeframe", F.lit("7m"))).collect()


def test_half_hour_bars_are_checked_for_slots(bars, spark):
    day = bars([(dt.datetime(2024, 1, 2, 10, 0), 1.0)], timeframe="30m")
    holidays = spark.createDataFrame([(dt.date(2024, 1, 1),)], "date date")
    found = integrity.missing_slots(day, holidays).first()
    assert found["observed"] == "7" and "15:00" in found["reasons"]


def test_regimes_are_settled(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [("s", "1d", dt.datetime(2020, 1, 1) + dt.timedelta(days=i), *map(float, rng.gamma(2.0, 1.0, 3))) for i in range(400)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp_ntz, volatility double, trend_strength double, volume double")
    points = np.array([r[3:] for r in rows])
    points = (points - points.mean(0)) / points.std(0)
    label = np.array([r["regime"] for r in model.market_regime(df).orderBy("ts").collect()])
    centres = np.array([points[label == c].mean(0) for c in range(label.max() + 1)])
    nearest = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (nearest == label).all()


def test_regimes_do_not_depend_on_the_partitions(spark):
    rng = np.random.default_rng(12)
    n = 120
    rows = [("x", "1d", dt.datetime(2000, 1, 1) + dt.timedelta(days=i), *map(float, rng.normal(size=3))) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp_ntz, volatility double, trend_strength double, volume double")
    found = [model.market_regime(df.repartition(parts)).orderBy("ts").select("regime").collect() for parts in (1, 7)]
    assert found[0] == found[1] and len(set(found[0])) > 1
