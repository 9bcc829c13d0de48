"""Feature, model, signal, risk and backtest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.catalog.inputs import DAILY, INTRADAY, W, daily, intraday, query, rounded, table
from tidebars.catalog.windows import EPS, KEYS, recursive_emas, roll
from tidebars.functions import columns as fn
from tidebars.operators import backtest as bt
from tidebars.operators import indicators as ind
from tidebars.operators import model, risk
from tidebars.operators import signals as sg
from tidebars.plans import analysis
from tidebars.series import staged, with_position

PART = "PARTITION BY symbol, timeframe"

# --- scored feature rows ---------------------------------------------------
# Intraday bars with the features signals need, and scores that are simple
# functions of them.
FEATURES = ["returns", "trend_strength", "atr", "volatility_p"]


def scored(spark, sf):
    numbered = with_position(intraday(spark, sf))
    bars = ind.with_indicators(
        numbered, ind.returns(), ind.trend_strength(), ind.atr(), ind.volatility_partial()
    )
    minute = F.minute("ts") + F.dayofmonth("ts") * 7
    return bars.select(*KEYS, "pos", "n", "volume", *FEATURES).withColumns(
        {
            "p0": ((minute * 13) % 41 - 20) / F.lit(20.0),
            "p1": (minute % 11) / F.lit(10.0),
            "p2": (minute % 5 + 1) / F.lit(4.0),
            "accuracy": (minute % 9) / F.lit(9.0),
        }
    )


MINUTE = "(minute(ts) + day(ts) * 7)"
SCORED = INTRADAY + f""",
lagged AS (SELECT *, lag(close) OVER ({W}) AS prev, close / nullif(lag(close) OVER ({W}), 0) - 1 AS returns FROM intraday),
ranged AS (SELECT *, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr FROM lagged),
scored AS (
  SELECT symbol, timeframe, ts, volume, returns,
         (avg(close) OVER {roll(5)} - avg(close) OVER {roll(20)}) / avg(close) OVER {roll(20)} AS trend_strength,
         avg(tr) OVER {roll(14)} AS atr, stddev_samp(returns) OVER {roll(20)} * sqrt(252) AS volatility_p,
         (({MINUTE} * 13) % 41 - 20) / 20.0::DOUBLE AS p0, ({MINUTE} % 11) / 10.0::DOUBLE AS p1,
         ({MINUTE} % 5 + 1) / 4.0::DOUBLE AS p2, ({MINUTE} % 9) / 9.0::DOUBLE AS accuracy
  FROM ranged)"""
LEVEL = """CASE WHEN p1 > 0.7::DOUBLE AND trend_strength > 0.05 THEN 2.0
  WHEN p1 > 0.5::DOUBLE AND p1 <= 0.7::DOUBLE AND trend_strength > 0.03 THEN 1.0
  WHEN p1 > 0.3::DOUBLE AND p1 <= 0.5::DOUBLE AND trend_strength > 0.01 THEN 0.5 ELSE 0.0 END::DOUBLE"""
SIGNALS = SCORED + f""",
signals AS (SELECT *, p0 AS signal_strength, {LEVEL} AS entry_level, p2 * atr AS stop_loss,
                   least(abs(p0), 1.0) AS position_size FROM scored)"""
FIELDS = list(sg.FIELDS)

query("entry_level", f"WITH {SCORED} SELECT symbol, timeframe, ts, {LEVEL} AS entry_level FROM scored")(
    lambda spark, sf: scored(spark, sf).select(
        *KEYS, fn.entry_level(F.col("p1"), F.col("trend_strength")).alias("entry_level")
    )
)
query(
    "signals",
    f"""WITH {SIGNALS} SELECT symbol, timeframe, ts, signal_strength, entry_level,
    round(stop_loss, 6) AS stop_loss, position_size FROM signals""",
)(lambda spark, sf: rounded(sg.signals(scored(spark, sf)).select(*KEYS, *FIELDS), 6, "stop_loss"))
WEIGHT = "1 / (1 + exp(-(p0 * (1 + accuracy) * (1 + trend_strength) * volatility_p)))"
query(
    "dynamic_weight",
    f"WITH {SCORED} SELECT symbol, timeframe, ts, round({WEIGHT}, 8) AS dynamic_weight FROM scored",
)(
    lambda spark, sf: rounded(
        weighted(scored(spark, sf)).select(*KEYS, "dynamic_weight"), 8, "dynamic_weight"
    )
)


def weighted(df):
    weight = fn.dynamic_weight(F.col("p0"), F.col("accuracy"), F.col("trend_strength"), F.col("volatility_p"))
    return df.withColumn("dynamic_weight", weight)


query(
    "directional_accuracy",
    f"""WITH {SCORED} SELECT symbol, timeframe,
    round(avg(CASE WHEN sign(p0) = sign(returns) THEN 1.0 ELSE 0.0 END), 8) AS accuracy FROM scored GROUP BY 1, 2""",
)(lambda spark, sf: rounded(model.directional_accuracy(scored(spark, sf), "p0", "returns"), 8, "accuracy"))

TSI = recursive_emas(INTRADAY, "intraday", ["up2", "size2"])
TSI_LAST = f"""
tsi AS (SELECT symbol, timeframe, ts, 100 * up2 / CASE WHEN size2 = 0 THEN {EPS} ELSE size2 END AS tsi FROM e),
consistency AS (SELECT symbol, product(s) AS trend_consistency FROM (
  SELECT symbol, timeframe, sign(arg_max(tsi, ts))::DOUBLE AS s FROM tsi GROUP BY 1, 2) GROUP BY 1)"""
query("trend_consistency", f"{TSI},{TSI_LAST} SELECT * FROM consistency")(
    lambda spark, sf: sg.trend_consistency(ind.with_indicators(intraday(spark, sf), ind.tsi()))
)


@query(
    "comprehensive_signal",
    f"""{TSI},{TSI_LAST},{SCORED.replace(INTRADAY + ",", "")},
    t AS (SELECT *, {WEIGHT} AS w, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) - 1 AS tail,
                 count(*) OVER (PARTITION BY symbol, timeframe) AS n FROM scored),
    m AS (SELECT *, min(n) OVER (PARTITION BY symbol) AS shortest FROM t)
    SELECT symbol, tail, round(coalesce(sum(w * p0) / CASE WHEN sum(w) = 0 THEN 1 ELSE sum(w) END, 0)
           * any_value(trend_consistency), 6) AS comprehensive_signal
    FROM m JOIN consistency USING (symbol) WHERE tail < shortest GROUP BY symbol, tail""",
)
def comprehensive_signal(spark, sf):
    consistency = sg.trend_consistency(ind.with_indicators(intraday(spark, sf), ind.tsi()))
    made = sg.signals(weighted(scored(spark, sf)))
    return rounded(sg.comprehensive_signal(made, consistency), 6, "comprehensive_signal")


STRATEGY = """CASE
  WHEN strength > 0.7 AND level > 1.5 AND tc > 0 AND risk < 0.1 THEN 'Strong_Long'
  WHEN strength > 0.5 AND strength <= 0.7 AND level > 1 AND level <= 1.5 AND tc > 0 AND risk < 0.2 THEN 'Medium_Long'
  WHEN strength > 0.3 AND strength <= 0.5 AND level > 0.5 AND level <= 1 AND tc > 0 AND risk < 0.3 THEN 'Weak_Long'
  WHEN strength > -0.5 AND strength <= -0.3 AND level > 0.5 AND level <= 1 AND tc < 0 AND risk < 0.3 THEN 'Weak_Short'
  WHEN strength > -0.7 AND strength <= -0.5 AND level > 1 AND level <= 1.5 AND tc < 0 AND risk < 0.2 THEN 'Medium_Short'
  WHEN strength <= -0.7 AND level > 1.5 AND tc < 0 AND risk < 0.1 THEN 'Strong_Short'
  ELSE 'Neutral' END"""


@query(
    "entry_strategy",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, strength, level, tc, {STRATEGY} AS strategy FROM (
      SELECT *, l_partkey % 21 / 10.0::DOUBLE - 1 AS strength, l_suppkey % 5 / 2.0::DOUBLE AS level,
             (l_linenumber % 3 - 1)::DOUBLE AS tc, l_discount AS risk FROM lineitem)""",
)
def entry_strategy(spark, sf):
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        ((F.col("l_partkey") % 21) / F.lit(10.0) - 1).alias("strength"),
        ((F.col("l_suppkey") % 5) / F.lit(2.0)).alias("level"),
        (F.col("l_linenumber") % 3 - 1).cast("double").alias("tc"),
        F.col("l_discount").alias("risk"),
    )
    label = fn.entry_strategy(F.col("strength"), F.col("level"), F.col("tc"), F.col("risk"))
    return items.withColumn("strategy", label).drop("risk")


MEANS = ", ".join(f"avg({f}) AS {f}" for f in FIELDS)
COMBINED = ", ".join(f"round(sum(w * {f}) / sum(w), 6) AS {f}" for f in FIELDS)
query(
    "combine_timeframe_signals",
    f"""WITH {SIGNALS}, m AS (SELECT symbol, timeframe, {MEANS} FROM signals GROUP BY 1, 2),
    weights(timeframe, w) AS (VALUES ('1min', 0.05), ('5m', 0.1), ('15m', 0.15), ('60m', 0.2), ('4h', 0.2), ('1d', 0.2), ('1w', 0.1))
    SELECT symbol, {COMBINED} FROM m JOIN weights USING (timeframe) GROUP BY symbol""",
)(lambda spark, sf: rounded(sg.combine_timeframe_signals(sg.signals(scored(spark, sf))), 6, *FIELDS))

# --- risk ------------------------------------------------------------------
RISK = f"""
risk AS (SELECT symbol, timeframe, ts, volatility_p / max(volatility_p) OVER ({PART}) AS risk FROM scored)"""


def risk_rows(df):
    return risk.normalized_risk(df.select(*KEYS, "pos", "n", "volatility_p"))


query("normalized_risk", f"WITH {SCORED},{RISK} SELECT symbol, timeframe, ts, round(risk, 8) AS risk FROM risk")(
    lambda spark, sf: rounded(risk_rows(scored(spark, sf)).select(*KEYS, "risk"), 8, "risk")
)
TAIL = "row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) AS tail"
ADJUST = f""",{RISK},
r AS (SELECT *, {TAIL} FROM risk),
s AS (SELECT *, {TAIL} FROM signals)
SELECT s.symbol, s.timeframe, s.ts, round(signal_strength * (1 - coalesce(risk, 0)), 6) AS signal_strength,
       round(entry_level * (1 + coalesce(risk, 0)), 6) AS entry_level,
       round(stop_loss * (1 - coalesce(risk, 0)), 6) AS stop_loss, position_size
FROM s LEFT JOIN r ON r.symbol = s.symbol AND r.timeframe = s.timeframe AND r.tail = s.tail"""


@query("risk_adjust", f"WITH {SIGNALS}{ADJUST}")
def risk_adjust(spark, sf):
    rows = staged(scored(spark, sf))
    known = risk_rows(rows)
    signals = sg.signals(rows).select(*KEYS, "pos", "n", *FIELDS)
    adjusted = risk.risk_adjust(signals, known).drop("pos", "n")
    return rounded(adjusted, 6, "signal_strength", "entry_level", "stop_loss")


def items(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity"
    )


ID = ["l_orderkey", "l_linenumber", "l_partkey"]
query(
    "adaptive_stop_loss",
    f"SELECT {', '.join(ID)}, round(l_extendedprice * (1 - l_tax * l_discount * 2), 6) AS stop FROM lineitem",
)(
    lambda spark, sf: items(spark, sf).select(
        *ID, F.round(fn.adaptive_stop_loss(F.col("l_extendedprice"), F.col("l_tax"), F.col("l_discount")), 6).alias("stop")
    )
)
query(
    "position_size",
    f"""SELECT {', '.join(ID)}, round(100000 * 0.02::DOUBLE / nullif(abs(l_quantity - 25), 0), 6) AS units
    FROM lineitem""",
)(
    lambda spark, sf: items(spark, sf).select(
        *ID, F.round(fn.position_size(F.lit(100000.0), F.lit(0.02), F.col("l_quantity"), F.lit(25.0)), 6).alias("units")
    )
)
query("circuit_breaker", f"SELECT {', '.join(ID)}, abs(l_discount - l_tax) > 0.05::DOUBLE AS pause FROM lineitem")(
    lambda spark, sf: items(spark, sf).select(
        *ID, fn.circuit_breaker(F.col("l_discount") - F.col("l_tax"), 0.05).alias("pause")
    )
)
PNL = f"""
pnl AS (SELECT symbol, timeframe, ts, coalesce(position_size * returns, 0) AS pnl FROM signals)"""


def results(spark, sf):
    rows = staged(scored(spark, sf))
    return bt.pnl(sg.signals(rows), rows)


query(
    "daily_loss_limit",
    f"""WITH {SIGNALS},{PNL}, d AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol, timeframe, ts::DATE ORDER BY ts) AS day_pnl FROM pnl)
    SELECT symbol, timeframe, ts, round(day_pnl, 6) AS day_pnl, -day_pnl >= 0.02::DOUBLE AS stop FROM d""",
)(
    lambda spark, sf: rounded(
        risk.daily_loss_limit(results(spark, sf)).select(*KEYS, "day_pnl", "stop"), 6, "day_pnl"
    )
)

# --- backtest --------------------------------------------------------------
query("pnl", f"WITH {SIGNALS},{PNL} SELECT symbol, timeframe, ts, round(pnl, 11) AS pnl FROM pnl")(
    lambda spark, sf: rounded(results(spark, sf).drop("pos", "n"), 11, "pnl")
)
# Small steady results: no zero, so the ratio is defined.
STEADY = DAILY + f""",
steady AS (SELECT symbol, timeframe, ts, (close / 1e7 - 0.002)::DOUBLE AS pnl,
                  close / 1e7 - 0.002 AS returns, close AS equity FROM daily)"""


def steady(spark, sf):
    x = F.col("close") / 1e7 - 0.002
    return daily(spark, sf).select(*KEYS, x.alias("pnl"), x.alias("returns"), F.col("close").alias("equity"))


CURVE = f"""
curve AS (SELECT *, product(1 + pnl) OVER ({W}) AS c FROM SOURCE),
falls AS (SELECT *, c / max(c) OVER ({W}) - 1 AS fall FROM curve)"""
CHANGES = f"""
steps AS (SELECT *, lag(pnl) OVER ({W}) AS before FROM SOURCE),
changes AS (SELECT *, CASE WHEN before <> 0 THEN pnl / before - 1 END AS change, before = 0 AND pnl <> 0 AS jump FROM steps),
ratios AS (SELECT symbol, timeframe, CASE WHEN coalesce(bool_or(jump), false) THEN 0 ELSE coalesce(
  sqrt(252) * (avg(change) - 0.02 / 252) / nullif(stddev_samp(change), 0), 0) END AS sharpe_ratio FROM changes GROUP BY 1, 2)"""
query(
    "sharpe_of_pnl",
    f"""WITH {STEADY},{CHANGES.replace('SOURCE', 'steady')}
    SELECT symbol, timeframe, round(sharpe_ratio, 6) AS sharpe_ratio FROM ratios""",
)(lambda spark, sf: rounded(bt.sharpe_of_pnl(steady(spark, sf)), 6, "sharpe_ratio"))
query(
    "max_drawdown_of_pnl",
    f"""WITH {STEADY},{CURVE.replace('SOURCE', 'steady')}
    SELECT symbol, timeframe, round(min(fall), 8) AS max_drawdown FROM falls GROUP BY 1, 2""",
)(lambda spark, sf: rounded(bt.max_drawdown_of_pnl(steady(spark, sf)), 8, "max_drawdown"))
query(
    "total_return",
    f"WITH {STEADY} SELECT symbol, timeframe, round(product(1 + pnl) - 1, 8) AS total_return FROM steady GROUP BY 1, 2",
)(lambda spark, sf: rounded(bt.total_return(steady(spark, sf)), 8, "total_return"))
query(
    "win_rate",
    f"""WITH {SIGNALS},{PNL} SELECT symbol, timeframe, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END), 8) AS win_rate
    FROM pnl GROUP BY 1, 2""",
)(lambda spark, sf: rounded(bt.win_rate(results(spark, sf)), 8, "win_rate"))
METRICS = f"""
summary AS (SELECT symbol, timeframe, round(sum(pnl), 6) AS pnl, round(min(fall), 6) AS max_drawdown,
  round(product(1 + pnl) - 1, 6) AS total_return, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate
  FROM falls GROUP BY 1, 2)"""
FIGURES = ("pnl", "sharpe_ratio", "max_drawdown", "total_return", "win_rate")
query(
    "backtest",
    f"""WITH {SIGNALS.replace('least(abs(p0), 1.0)', 'least(abs(p0), 0.0001)')},{PNL},{CURVE.replace('SOURCE', 'pnl')},{CHANGES.replace('SOURCE', 'pnl')},{METRICS}
    SELECT symbol, timeframe, pnl, round(sharpe_ratio, 6) AS sharpe_ratio, max_drawdown, total_return, win_rate
    FROM summary JOIN ratios USING (symbol, timeframe)""",
)(
    lambda spark, sf: rounded(
        (lambda rows: bt.backtest(sg.signals(rows, 0.0001), rows))(staged(scored(spark, sf))), 6, *FIGURES
    )
)
query(
    "backtest_metrics",
    f"""WITH {STEADY},{CURVE.replace('SOURCE', 'steady')},{CHANGES.replace('SOURCE', 'steady')},{METRICS}
    SELECT symbol, timeframe, pnl, round(sharpe_ratio, 6) AS sharpe_ratio, max_drawdown, total_return, win_rate
    FROM summary JOIN ratios USING (symbol, timeframe)""",
)(lambda spark, sf: rounded(bt.metrics(steady(spark, sf).drop("returns", "equity")), 6, *FIGURES))
query(
    "sharpe",
    f"""WITH {STEADY} SELECT symbol, timeframe,
    round(sqrt(252) * (avg(returns) - 0.02 / 252) / stddev_samp(returns), 6) AS sharpe FROM steady GROUP BY 1, 2""",
)(lambda spark, sf: rounded(bt.sharpe(steady(spark, sf)), 6, "sharpe"))
query(
    "max_drawdown",
    f"""WITH {STEADY}, p AS (SELECT *, max(equity) OVER ({W}) AS peak FROM steady)
    SELECT symbol, timeframe, round(min((equity - peak) / peak), 8) AS max_drawdown FROM p GROUP BY 1, 2""",
)(lambda spark, sf: rounded(bt.max_drawdown(steady(spark, sf)), 8, "max_drawdown"))
query(
    "calmar",
    f"""WITH {STEADY}, r AS (SELECT symbol, timeframe, ts, close / 1e7 AS x FROM daily),
    c AS (SELECT *, sum(x) OVER ({W}) AS s FROM (SELECT symbol, timeframe, ts, x - CASE WHEN day(ts) = 13 THEN 0.01 ELSE 0 END AS x FROM r)),
    p AS (SELECT *, max(s) OVER ({W}) AS peak FROM c)
    SELECT symbol, timeframe, round((pow(1 + avg(x), 12) - 1) / abs(min((s - peak) / peak)), 6) AS calmar FROM p GROUP BY 1, 2""",
)(
    lambda spark, sf: rounded(
        bt.calmar(
            daily(spark, sf).select(
                *KEYS, (F.col("close") / 1e7 - F.when(F.dayofmonth("ts") == 13, 0.01).otherwise(0.0)).alias("returns")
            )
        ),
        6, "calmar",
    )
)
query("equity_curve", f"WITH {STEADY},{CURVE.replace('SOURCE', 'steady')} SELECT symbol, timeframe, ts, round(c, 8) AS equity FROM curve")(
    lambda spark, sf: rounded(
        bt.equity_curve(steady(spark, sf).drop("returns", "equity")).select(*KEYS, "equity"), 8, "equity"
    )
)
GRID = [{"bias": b, "cap": c} for b in (0.001, 0.002, 0.004) for c in (0.5, 1.0)]
GRID_SQL = ", ".join(f"({i}, {p['bias']}::DOUBLE, {p['cap']}::DOUBLE)" for i, p in enumerate(GRID))


def sweep_position():
    return F.least(F.abs(F.col("returns") - F.col("bias")) * 100, F.col("cap")) + 0.01


query(
    "parameter_sweep",
    f"""WITH {STEADY}, grid(param_id, bias, cap) AS (VALUES {GRID_SQL}),
    p AS (SELECT param_id, bias, cap, symbol, timeframe, ts, coalesce((least(abs(returns - bias) * 100, cap) + 0.01::DOUBLE) * returns, 0) AS pnl
      FROM steady, grid),
    steps AS (SELECT *, lag(pnl) OVER (PARTITION BY param_id, symbol, timeframe ORDER BY ts) AS before FROM p),
    changes AS (SELECT *, CASE WHEN before <> 0 THEN pnl / before - 1 END AS change, before = 0 AND pnl <> 0 AS jump FROM steps),
    ratios AS (SELECT param_id, bias, cap, symbol, CASE WHEN coalesce(bool_or(jump), false) THEN 0 ELSE coalesce(
      sqrt(252) * (avg(change) - 0.02 / 252) / nullif(stddev_samp(change), 0), 0) END AS r FROM changes GROUP BY ALL),
    scores AS (SELECT param_id, bias, cap, avg(r) AS score FROM ratios GROUP BY ALL)
    SELECT param_id, bias, cap, round(score, 6) AS score,
           row_number() OVER (ORDER BY score DESC, param_id) = 1 AS best FROM scores""",
)(
    lambda spark, sf: rounded(
        bt.parameter_sweep(steady(spark, sf).select(*KEYS, "returns"), GRID, sweep_position), 6, "score"
    )
)

# --- plans -----------------------------------------------------------------
CLEANED = list(analysis.CLEANED)
GAPPED = CLEANED[5:]
AROUND = ", ".join(
    f"last_value(CASE WHEN {c} IS NOT NULL THEN ts END IGNORE NULLS) OVER up AS {c}_t0, "
    f"last_value({c} IGNORE NULLS) OVER up AS {c}_x0, "
    f"first_value(CASE WHEN {c} IS NOT NULL THEN ts END IGNORE NULLS) OVER down AS {c}_t1, "
    f"first_value({c} IGNORE NULLS) OVER down AS {c}_x1"
    for c in GAPPED
)
FILLED = ", ".join(
    f"coalesce({c}, {c}_x0 + ({c}_x1 - {c}_x0) * ((epoch_us(ts) - epoch_us({c}_t0)) / "
    f"(epoch_us({c}_t1) - epoch_us({c}_t0))), {c}_x0, {c}_x1) AS {c}"
    for c in GAPPED
)
COMPUTED = f"""
computed AS (SELECT symbol, timeframe, ts, open, high, low, close, volume,
  close / nullif(prev, 0) - 1 AS returns, CASE WHEN close > 0 AND prev > 0 THEN ln(close / prev) END AS log_returns
  FROM (SELECT *, lag(close) OVER ({W}) AS prev FROM intraday)),
vol AS (SELECT *, CASE WHEN count(returns) OVER {roll(20)} = 20 THEN stddev_samp(returns) OVER {roll(20)} * sqrt(252) END AS volatility FROM computed),
limits AS (SELECT symbol, timeframe, {', '.join(f'quantile_cont({c}, 0.01) AS {c}0, quantile_cont({c}, 0.99) AS {c}1' for c in CLEANED[:5])}
  FROM vol GROUP BY 1, 2),
around AS (SELECT *, {AROUND} FROM vol
  WINDOW up AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         down AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
cleaned AS (SELECT symbol, timeframe, ts, {', '.join(f'least(greatest({c}, {c}0), {c}1) AS {c}' for c in CLEANED[:5])}, {FILLED},
  row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) AS tail FROM around JOIN limits USING (symbol, timeframe))"""
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in CLEANED)
query(
    "process_bars",
    f"WITH {INTRADAY},{COMPUTED} SELECT symbol, timeframe, ts, {ROUNDED} FROM cleaned WHERE tail <= 20",
)(lambda spark, sf: rounded(analysis.process_bars(intraday(spark, sf)), 6, *CLEANED))
PICK = ", ".join(f"round(l.{c}, 6) AS {c}" for c in CLEANED)
EMPTY = ", ".join("NULL" for _ in CLEANED)
ASOF = """FROM wanted w JOIN ends e USING (symbol, timeframe)
ASOF LEFT JOIN cleaned l ON l.symbol = w.symbol AND l.timeframe = w.timeframe AND l.ts <= w.ts"""
LIVE = "coalesce(epoch(w.ts) - epoch(l.ts) <= w.reach AND w.ts <= e.last_ts, false)"
query(
    "process_bars_aligned",
    f"""WITH {INTRADAY},{COMPUTED},
    wanted AS (SELECT b.symbol, t.timeframe, b.ts, t.reach FROM cleaned b
      JOIN (VALUES ('15m', 600), ('60m', 3300)) AS t(timeframe, reach) ON true WHERE b.timeframe = '5m'),
    ends AS (SELECT symbol, timeframe, max(ts) AS last_ts FROM cleaned GROUP BY 1, 2)
    SELECT symbol, timeframe, ts, {ROUNDED} FROM cleaned WHERE timeframe = '5m'
    UNION ALL SELECT w.symbol, w.timeframe, w.ts, {PICK} {ASOF} WHERE {LIVE}
    UNION ALL SELECT w.symbol, w.timeframe, w.ts, {EMPTY} {ASOF} WHERE NOT {LIVE}""",
)(lambda spark, sf: rounded(analysis.process_bars(intraday(spark, sf), keep=None, base="5m"), 6, *CLEANED))

# All indicators of the feature plan over daily bars, scaled over the whole
# series, the last 20 rows.
FEATURE_NAMES = [
    "ma_3", "ma_5", "ma_10", "ma_20", "macd_line", "macd_signal", "macd_hist", "rsi", "atr", "diff", "dea",
    "macd_bar", "mom", "tsi", "volatility_p", "trend_strength", "vol_ma_5", "vol_rate", "wavetrend",
    "wavetrend_signal", "macd_dir", "price_direction", "correct_signal", "accuracy", "obv",
]
RAW = {
    **{f"ma_{p}": f"avg(close) OVER {roll(p)}" for p in (3, 5, 10, 20)},
    "macd_line": "macd_line", "macd_signal": "macd_signal", "macd_hist": "macd_line - macd_signal",
    "rsi": f"100 - 100 / (1 + gain / CASE WHEN loss = 0 THEN {EPS} ELSE loss END)",
    "atr": f"avg(tr) OVER {roll(14)}", "diff": "diff", "dea": "dea", "macd_bar": "2 * (diff - dea)",
    "mom": f"close - lag(close, 10) OVER ({W})",
    "tsi": f"100 * up2 / CASE WHEN size2 = 0 THEN {EPS} ELSE size2 END",
    "volatility_p": f"stddev_samp(ret) OVER {roll(20)} * sqrt(252)",
    "trend_strength": f"(avg(close) OVER {roll(5)} - avg(close) OVER {roll(20)}) / avg(close) OVER {roll(20)}",
    "vol_ma_5": f"avg(volume) OVER {roll(5)}",
    "vol_rate": f"(volume - avg(volume) OVER {roll(5)}) / avg(volume) OVER {roll(5)}",
    "wavetrend": "wavetrend", "wavetrend_signal": f"avg(wavetrend) OVER {roll(4)}",
    "macd_dir": "macd_dir", "price_direction": "price_direction", "correct_signal": "correct_signal",
    "accuracy": f"avg(correct_signal) OVER {roll(20)}",
    "obv": f"CASE WHEN change IS NOT NULL THEN sum(sign(change) * volume) OVER ({W}) END",
}
FIRST = ", ".join(
    f"coalesce({c}, first_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
    for c in FEATURE_NAMES
)
SCALED = ", ".join(
    f"CASE WHEN max({c}) OVER ({PART}) = min({c}) OVER ({PART}) THEN 0 ELSE "
    f"({c} - min({c}) OVER ({PART})) / (max({c}) OVER ({PART}) - min({c}) OVER ({PART})) END AS {c}"
    for c in FEATURE_NAMES
)
ENGINEERED = recursive_emas(
    DAILY, "daily", ["macd_line", "macd_signal", "diff", "dea", "up2", "size2", "wavetrend"]
) + f""",
states AS (SELECT b.*, e.* EXCLUDE (symbol, timeframe, ts, r) FROM b JOIN e USING (symbol, timeframe, r)),
base AS (SELECT *, greatest(high - low, abs(high - close + change), abs(low - close + change)) AS tr0,
  close / lag(close) OVER ({W}) - 1 AS ret, lag(close) OVER ({W}) AS prev,
  CASE WHEN 2 * (diff - dea) > macd_signal THEN 1 ELSE -1 END AS macd_dir,
  CASE WHEN change > 0 THEN 1 ELSE -1 END AS price_direction,
  avg(CASE WHEN change > 0 THEN change ELSE 0 END) OVER {roll(14)} AS gain,
  avg(CASE WHEN change < 0 THEN -change ELSE 0 END) OVER {roll(14)} AS loss FROM states),
flagged AS (SELECT *, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr,
  CASE WHEN macd_dir = price_direction THEN 1 ELSE 0 END AS correct_signal FROM base),
raw AS (SELECT symbol, timeframe, ts, open, high, low, close, volume, {', '.join(f'{x} AS {c}' for c, x in RAW.items())} FROM flagged),
filled AS (SELECT symbol, timeframe, ts, open, high, low, close, volume, {FIRST} FROM raw),
scaled AS (SELECT symbol, timeframe, ts, open, high, low, close, volume, {SCALED},
  row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) AS tail FROM filled)"""
query(
    "engineer_features",
    ENGINEERED
    + f""" SELECT symbol, timeframe, ts, open, high, low, close, volume,
    {', '.join(f'round({c}, 6) AS {c}' for c in FEATURE_NAMES)} FROM scaled WHERE tail <= 20""",
)(lambda spark, sf: rounded(analysis.engineer_features(daily(spark, sf)), 6, *FEATURE_NAMES))

# --- model -----------------------------------------------------------------
MODEL = ["returns", "trend_strength", "atr", "volatility_p", "accuracy", "volume"]


def complete(spark, sf):
    rows = scored(spark, sf).select(*KEYS, *MODEL)
    return rows.dropna(subset=MODEL)


COMPLETE = SCORED + f""",
complete AS (SELECT symbol, timeframe, ts, {', '.join(MODEL)} FROM scored
  WHERE returns IS NOT NULL AND volatility_p IS NOT NULL)"""
INPUTS = sorted(c for c in MODEL if c != "returns")


def unpacked(df, horizon=0):
    made = model.feature_target(df, horizon)
    columns = [F.get("features", F.lit(i)).alias(f"x_{c}") for i, c in enumerate(INPUTS)]
    columns += [F.get("target", F.lit(i)).alias(f"y{i}") for i in range(3)]
    return rounded(made.select(*KEYS, *columns), 6, *[f"x_{c}" for c in INPUTS], "y0", "y1", "y2")


X_SQL = ", ".join(f"round({c}, 6) AS x_{c}" for c in INPUTS)
query(
    "feature_target",
    f"""WITH {COMPLETE} SELECT symbol, timeframe, ts, {X_SQL}, round(returns, 6) AS y0,
    round(trend_strength, 6) AS y1, round(atr, 6) AS y2 FROM complete""",
)(lambda spark, sf: unpacked(complete(spark, sf)))
query(
    "feature_target_ahead",
    f"""WITH {COMPLETE}, l AS (SELECT *, lead(returns, 3) OVER ({W}) AS r3, lead(trend_strength, 3) OVER ({W}) AS t3,
      lead(atr, 3) OVER ({W}) AS a3 FROM complete)
    SELECT symbol, timeframe, ts, {X_SQL}, round(r3, 6) AS y0, round(t3, 6) AS y1, round(a3, 6) AS y2
    FROM l WHERE r3 IS NOT NULL""",
)(lambda spark, sf: unpacked(complete(spark, sf), 3))
query(
    "chronological_split",
    f"""WITH {INTRADAY} SELECT symbol, timeframe, ts,
    row_number() OVER ({W}) <= floor(count(*) OVER ({PART}) * 0.8::DOUBLE) AS is_train FROM intraday""",
)(lambda spark, sf: model.chronological_split(intraday(spark, sf)).select(*KEYS, "is_train"))


@query(
    "sequences",
    f"""WITH {DAILY}, s AS (SELECT symbol, timeframe, ts, list(close) OVER {roll(20)} AS c, list(volume) OVER {roll(20)} AS v FROM daily)
    SELECT symbol, timeframe, ts, c[1] AS first_close, c[20] AS last_close, list_sum(v) AS volume FROM s WHERE len(c) = 20""",
)
def sequences(spark, sf):
    rows = daily(spark, sf).select(*KEYS, F.array("close", "volume").alias("features"))
    seq = model.sequences(rows, 20)
    total = F.aggregate("sequence", F.lit(0.0), lambda t, x: t + F.get(x, F.lit(1)))
    first, last = F.get("sequence", F.lit(0)), F.get("sequence", F.lit(19))
    return seq.select(
        *KEYS, F.get(first, F.lit(0)).alias("first_close"), F.get(last, F.lit(0)).alias("last_close"),
        total.alias("volume"),
    )


@query("fit_signal_model")
def fit_signal_model(spark, sf):
    """Losses of the pooled model on the training and validation rows."""
    rows = staged(model.chronological_split(complete(spark, sf)), "model")
    fitted = model.fit_signal_model(
        rows.filter("is_train"), ["volatility_p", "accuracy", "volume", "trend_strength", "atr"]
    )
    return model.model_losses(fitted, rows)


@query("score_signal_model")
def score_signal_model(spark, sf):
    """Scores of the fitted model turned into a backtest."""
    rows = staged(model.chronological_split(complete(spark, sf)), "model")
    fitted = model.fit_signal_model(
        rows.filter("is_train"), ["volatility_p", "accuracy", "volume", "trend_strength", "atr"]
    )
    scores = staged(model.score_signal_model(fitted, rows).drop("is_train"), "scores")
    return analysis.trading_run(scores)["backtest"]


@query("market_regime")
def market_regime(spark, sf):
    bars = ind.with_indicators(intraday(spark, sf), ind.volatility(), ind.trend_strength())
    return model.market_regime(staged(bars, "regime")).select(*KEYS, "regime")
