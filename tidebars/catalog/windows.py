"""Returns, indicators and other window queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidebars.catalog.inputs import DAILY, GAPPY, INTRADAY, SQL, W, daily, gappy, intraday, query, rounded
from tidebars.operators import indicators as ind
from tidebars.operators.recurrence import ema_with_gaps
from tidebars.series import BLOCK_ROWS, with_position

KEYS = ["symbol", "timeframe", "ts"]
EPS = "2.220446049250313e-16::DOUBLE"


def roll(rows: int, order: str = W) -> str:
    return f"({order} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def over_bars(bars, digits, *indicators, rows=BLOCK_ROWS):
    """Query: the keys and the rounded outputs of some indicators."""

    def build(spark, sf):
        outputs = [o for i in indicators for o in i().outputs]
        result = ind.with_indicators(bars(spark, sf), *[i() for i in indicators], rows=rows)
        return rounded(result.select(*KEYS, *outputs), digits, *outputs)

    return build


def simple(name, bars, digits, cte, columns, *indicators, extra=""):
    """Register an indicator query whose SQL is one SELECT over the bars."""
    source = "intraday" if bars is intraday else "daily"
    outputs = ", ".join(f"round({expr}, {digits}) AS {alias}" for alias, expr in columns.items())
    sql = f"WITH {cte}{extra} SELECT symbol, timeframe, ts, {outputs} FROM {'b' if extra else source}"
    query(name, sql)(over_bars(bars, digits, *indicators))


LAG = f"lag(close) OVER ({W})"
WITH_CHANGE = f""",
b AS (SELECT *, {LAG} AS prev, close - {LAG} AS change, close / nullif({LAG}, 0) - 1 AS ret FROM SOURCE)"""


def changed(source: str) -> str:
    return WITH_CHANGE.replace("SOURCE", source)


simple("returns", intraday, 8, INTRADAY, {"returns": f"close / nullif({LAG}, 0) - 1"}, ind.returns)
simple("log_returns", intraday, 8, INTRADAY, {"log_returns": f"CASE WHEN close > 0 AND {LAG} > 0 THEN ln(close / {LAG}) END"}, ind.log_returns)
simple(
    "volatility", intraday, 6, INTRADAY,
    {"volatility": f"CASE WHEN count(ret) OVER {roll(20)} = 20 THEN stddev_samp(ret) OVER {roll(20)} * sqrt(252) END"},
    ind.volatility, extra=changed("intraday"),
)
simple(
    "volatility_partial", intraday, 6, INTRADAY, {"volatility_p": f"stddev_samp(ret) OVER {roll(20)} * sqrt(252)"},
    ind.volatility_partial, extra=changed("intraday"),
)
simple(
    "sma", daily, 3, DAILY, {f"ma_{p}": f"avg(close) OVER {roll(p)}" for p in (3, 5, 10, 20)},
    *[lambda p=p: ind.sma(p) for p in (3, 5, 10, 20)],
)
simple(
    "sma_strict", daily, 4, DAILY,
    {f"MA{p}": f"CASE WHEN count(close) OVER {roll(p)} = {p} THEN avg(close) OVER {roll(p)} END" for p in (5, 10, 20, 60)},
    *[lambda p=p: ind.sma_strict(p) for p in (5, 10, 20, 60)],
)
RSI = f"""
g AS (SELECT *, avg(CASE WHEN change > 0 THEN change ELSE 0 END) OVER {roll(14)} AS gain,
                avg(CASE WHEN change < 0 THEN -change ELSE 0 END) OVER {roll(14)} AS loss FROM b)"""
query(
    "rsi",
    f"""WITH {DAILY}{changed("daily")},{RSI}
    SELECT symbol, timeframe, ts,
           round(100 - 100 / (1 + gain / CASE WHEN loss = 0 THEN {EPS} ELSE loss END), 4) AS rsi FROM g""",
)(over_bars(daily, 4, ind.rsi))
TRUE_RANGE = "greatest(high - low, abs(high - prev), abs(low - prev))"
query(
    "atr",
    f"""WITH {DAILY}{changed("daily")}, t AS (SELECT *, {TRUE_RANGE} AS tr FROM b)
    SELECT symbol, timeframe, ts, round(tr, 8) AS true_range, round(avg(tr) OVER {roll(14)}, 3) AS atr FROM t""",
)(
    lambda spark, sf: rounded(over_bars(daily, 8, ind.atr)(spark, sf), 3, "atr")
)
simple("momentum", daily, 8, DAILY, {"mom": f"close - lag(close, 10) OVER ({W})"}, ind.momentum)
MA5, MA20 = f"avg(close) OVER {roll(5)}", f"avg(close) OVER {roll(20)}"
simple("trend_strength", daily, 6, DAILY, {"trend_strength": f"({MA5} - {MA20}) / {MA20}"}, ind.trend_strength)
VMA = f"avg(volume) OVER {roll(5)}"
simple(
    "volume_rate", daily, 6, DAILY, {"vol_ma_5": VMA, "vol_rate": f"(volume - {VMA}) / {VMA}"}, ind.volume_rate
)
BB = f"CASE WHEN count(close) OVER {roll(20)} = 20 THEN avg(close) OVER {roll(20)}"
SD = f"stddev_pop(close) OVER {roll(20)}"
simple(
    "bollinger", daily, 3, DAILY,
    {"bb_u": f"{BB} + 2 * {SD} END", "bb_m": f"{BB} END", "bb_l": f"{BB} - 2 * {SD} END"}, ind.bollinger,
)
query(
    "price_stats",
    f"""WITH {DAILY}, c AS (SELECT *, lag(close) OVER ({W}) AS prev FROM daily),
    s AS (SELECT *, round_even((close - prev) * 1000.0::DOUBLE, 0) / 1000 AS change FROM c)
    SELECT symbol, timeframe, ts, round(change, 3) AS change,
           round(round_even(change / close * 100 * 100.0::DOUBLE, 0) / 100, 2) AS pct_change,
           round(round_even(close * volume / 1e6 * 100.0::DOUBLE, 0) / 100, 2) AS value,
           round(round_even(close * 1.1::DOUBLE * 1000.0::DOUBLE, 0) / 1000, 3) AS upper_lim,
           round(round_even(close * 0.9::DOUBLE * 1000.0::DOUBLE, 0) / 1000, 3) AS lower_lim,
           prev AS last_close, (open + close + high + low) / 4 AS average, volume AS volrate FROM s""",
)(
    lambda spark, sf: rounded(
        ind.with_indicators(daily(spark, sf), ind.price_stats()).select(*KEYS, *ind.price_stats().outputs),
        3, "change", "pct_change", "value", "upper_lim", "lower_lim",
    )
)

query(
    "obv",
    f"""WITH {DAILY}{changed("daily")}
    SELECT symbol, timeframe, ts,
           CASE WHEN change IS NOT NULL THEN round(sum(sign(change) * volume) OVER ({W}), 4) END AS obv FROM b""",
)(lambda spark, sf: rounded(ind.obv(daily(spark, sf)).select(*KEYS, "obv"), 4, "obv"))


# One recursive query holds every exponential average; each new value is
# written out of the row's input ``b`` and the state ``e`` of the row before.
def _step(x: str, span: int, state: str, prev: str) -> str:
    a = 2 / (span + 1)
    old = f"{prev}.{state}" if prev else "NULL::DOUBLE"
    return f"coalesce({a!r}::DOUBLE * ({x}) + {1 - a!r}::DOUBLE * {old}, ({x}))"


def _gap_step(x: str, span: int, state: str, prev: str) -> str:
    """As `_step`, for inputs that may be null: ``<state>_g`` counts the rows since the last value."""
    a = 2 / (span + 1)
    if not prev:
        return f"({x})"
    old, faded = f"{prev}.{state}", f"pow({1 - a!r}::DOUBLE, {prev}.{state}_g + 1)"
    new = f"({faded} * {old} + {a!r}::DOUBLE * ({x})) / ({faded} + {a!r}::DOUBLE)"
    return f"CASE WHEN ({x}) IS NULL THEN {old} WHEN {old} IS NULL THEN ({x}) ELSE {new} END"


def ema_states(prev: str, gaps: bool = False) -> dict[str, str]:
    s: dict[str, str] = {}

    def add(name: str, x: str, span: int) -> str:
        s[name] = (_gap_step if gaps else _step)(x, span, name, prev)
        if gaps:
            s[f"{name}_g"] = f"CASE WHEN ({x}) IS NULL THEN {prev}.{name}_g + 1 ELSE 0 END" if prev else "0"
        return s[name]

    for span in (5, 9, 10, 12, 26):
        add(f"ema_{span}", "b.close", span)
    s["macd_line"] = f"({s['ema_5']}) - ({s['ema_10']})"
    add("macd_signal", s["macd_line"], 5)
    s["diff"] = f"({s['ema_12']}) - ({s['ema_26']})"
    add("dea", s["diff"], 9)
    s["macd_m"] = f"({s['ema_9']}) - ({s['ema_12']})"
    add("macd_s", s["macd_m"], 26)
    add("dema_1", "b.close", 30)
    add("dema_2", s["dema_1"], 30)
    add("up", "b.change", 25)
    add("up2", s["up"], 13)
    add("size", "abs(b.change)", 25)
    add("size2", s["size"], 13)
    typical = "(b.high + b.low + b.close) / 3"
    add("esa", typical, 10)
    away = f"({typical} - ({s['esa']}))"
    add("spread", f"abs{away}", 10)
    floor = f"CASE WHEN ({s['spread']}) = 0 THEN {EPS} ELSE ({s['spread']}) END"
    add("wavetrend", f"{away} / (0.015::DOUBLE * {floor})", 21)
    return s


def recursive_emas(cte: str, source: str, names: list[str], gaps: bool = False) -> str:
    def select(prev: str) -> str:
        states = ema_states(prev, gaps)
        return ", ".join(f"{states[n]} AS {n}" for n in needed)

    closed = {
        "macd_line": ["ema_5", "ema_10"], "macd_signal": ["ema_5", "ema_10"], "diff": ["ema_12", "ema_26"],
        "dea": ["ema_12", "ema_26"], "macd_m": ["ema_9", "ema_12"], "macd_s": ["ema_9", "ema_12"],
        "dema_2": ["dema_1"], "up2": ["up"], "size2": ["size"], "spread": ["esa"], "wavetrend": ["esa", "spread"],
    }
    needed = list(dict.fromkeys([d for n in names for d in [*closed.get(n, []), n]]))
    needed += [f"{n}_g" for n in needed if gaps and f"{n}_g" in ema_states("", gaps)]
    return f"""WITH RECURSIVE {cte},
b AS MATERIALIZED (SELECT *, row_number() OVER ({W}) AS r, close - lag(close) OVER ({W}) AS change FROM {source}),
e AS (
  SELECT b.symbol, b.timeframe, b.ts, b.r, {select("")} FROM b WHERE r = 1
  UNION ALL
  SELECT b.symbol, b.timeframe, b.ts, b.r, {select("e")}
  FROM e JOIN b ON b.symbol = e.symbol AND b.timeframe = e.timeframe AND b.r = e.r + 1)"""


query(
    "ema",
    recursive_emas(DAILY, "daily", ["ema_5", "ema_26"])
    + " SELECT symbol, timeframe, ts, round(ema_5, 4) AS ema_5, round(ema_26, 4) AS ema_26 FROM e",
)(over_bars(daily, 4, lambda: ind.ema_of("close", 5, "ema_5"), lambda: ind.ema_of("close", 26, "ema_26")))
query(
    "macd",
    recursive_emas(DAILY, "daily", ["macd_line", "macd_signal"])
    + """ SELECT symbol, timeframe, ts, round(macd_line, 4) AS macd_line, round(macd_signal, 4) AS macd_signal,
          round(macd_line - macd_signal, 4) AS macd_hist FROM e""",
)(over_bars(daily, 4, ind.macd))
query(
    "macd_cn",
    recursive_emas(DAILY, "daily", ["diff", "dea"])
    + """ SELECT symbol, timeframe, ts, round(diff, 4) AS diff, round(dea, 4) AS dea,
          round(2 * (diff - dea), 4) AS macd_bar FROM e""",
)(over_bars(daily, 4, ind.macd_cn))
query(
    "macd_chart",
    recursive_emas(DAILY, "daily", ["macd_m", "macd_s"])
    + """ SELECT symbol, timeframe, ts, round(macd_m, 4) AS macd_m, round(macd_s, 4) AS macd_s,
          round(macd_m - macd_s, 4) AS macd_h FROM e""",
)(over_bars(daily, 4, ind.macd_chart))
query(
    "macd_bars",
    recursive_emas(DAILY, "daily", ["macd_m", "macd_s"])
    + """ SELECT symbol, timeframe, ts, round(greatest(macd_m - macd_s, 0), 4) AS bar_up,
          round(least(macd_m - macd_s, 0), 4) AS bar_down FROM e""",
)(
    lambda spark, sf: rounded(
        ind.with_indicators(daily(spark, sf), ind.macd_chart())
        .withColumns(ind.macd_bars("macd_h"))
        .select(*KEYS, "bar_up", "bar_down"),
        4, "bar_up", "bar_down",
    )
)
query(
    "tsi",
    recursive_emas(DAILY, "daily", ["up2", "size2"])
    + f""" SELECT symbol, timeframe, ts,
           round(100 * up2 / CASE WHEN size2 = 0 THEN {EPS} ELSE size2 END, 4) AS tsi FROM e""",
)(over_bars(daily, 4, ind.tsi))
query(
    "wavetrend",
    recursive_emas(DAILY, "daily", ["wavetrend"])
    + f""" SELECT symbol, timeframe, ts, round(wavetrend, 4) AS wavetrend,
           round(avg(wavetrend) OVER {roll(4)}, 4) AS wavetrend_signal FROM e""",
)(over_bars(daily, 4, ind.wavetrend))
ACCURACY = f""",
m AS (SELECT e.symbol, e.timeframe, e.ts,
             CASE WHEN 2 * (diff - dea) > macd_signal THEN 1 ELSE -1 END AS macd_dir,
             CASE WHEN b.change > 0 THEN 1 ELSE -1 END AS price_direction
      FROM e JOIN b USING (symbol, timeframe, r)),
h AS (SELECT *, CASE WHEN macd_dir = price_direction THEN 1 ELSE 0 END AS correct_signal FROM m)"""
query(
    "signal_accuracy",
    recursive_emas(DAILY, "daily", ["macd_signal", "diff", "dea"])
    + ACCURACY
    + f""" SELECT *, round(avg(correct_signal) OVER {roll(20)}, 6) AS accuracy FROM h""",
)(
    lambda spark, sf: rounded(
        ind.with_indicators(daily(spark, sf), ind.signal_accuracy()).select(
            *KEYS, *ind.signal_accuracy().outputs
        ),
        6, "accuracy",
    )
)
query(
    "dema",
    recursive_emas(DAILY, "daily", ["dema_2"])
    + " SELECT symbol, timeframe, ts, round(2 * dema_1 - dema_2, 4) AS dema FROM e",
)(over_bars(daily, 4, ind.dema))

GAPPED = f"""WITH RECURSIVE {GAPPY},
g AS (SELECT *, row_number() OVER ({W}) AS pos FROM gappy),
v AS MATERIALIZED (
  SELECT *, row_number() OVER ({W}) AS r, pos - lag(pos) OVER ({W}) AS gap FROM g WHERE close IS NOT NULL),
e AS (
  SELECT symbol, timeframe, ts, r, close AS y FROM v WHERE r = 1
  UNION ALL
  SELECT v.symbol, v.timeframe, v.ts, v.r,
         (pow({1 - 2 / 13!r}, v.gap) * e.y + {2 / 13!r} * v.close) / (pow({1 - 2 / 13!r}, v.gap) + {2 / 13!r})
  FROM e JOIN v ON v.symbol = e.symbol AND v.timeframe = e.timeframe AND v.r = e.r + 1)
SELECT g.symbol, g.timeframe, g.ts,
       round(last_value(e.y IGNORE NULLS) OVER (PARTITION BY g.symbol, g.timeframe ORDER BY g.ts
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS ema_12
FROM g LEFT JOIN e USING (symbol, timeframe, ts)"""
query("ema_with_gaps", GAPPED)(
    lambda spark, sf: rounded(
        ema_with_gaps(gappy(spark, sf), "close", 12, "ema_12").select(*KEYS, "ema_12"), 4, "ema_12"
    )
)

# Every seventh close is missing: the averages follow the gap rule.
query(
    "macd_gappy",
    recursive_emas(GAPPY, "gappy", ["macd_line", "macd_signal"], gaps=True)
    + """ SELECT symbol, timeframe, ts, round(macd_line, 4) AS macd_line, round(macd_signal, 4) AS macd_signal,
          round(macd_line - macd_signal, 4) AS macd_hist FROM e""",
)(over_bars(gappy, 4, ind.macd, rows=700))
query(
    "tsi_gappy",
    recursive_emas(GAPPY, "gappy", ["up2", "size2"], gaps=True)
    + f""" SELECT symbol, timeframe, ts,
           round(100 * up2 / CASE WHEN size2 = 0 THEN {EPS} ELSE size2 END, 4) AS tsi FROM e""",
)(over_bars(gappy, 4, ind.tsi, rows=700))
query(
    "wavetrend_gappy",
    recursive_emas(GAPPY, "gappy", ["wavetrend"], gaps=True)
    + f""" SELECT symbol, timeframe, ts, round(wavetrend, 4) AS wavetrend,
           round(avg(wavetrend) OVER {roll(4)}, 4) AS wavetrend_signal FROM e""",
)(over_bars(gappy, 4, ind.wavetrend, rows=700))
query(
    "dema_gappy",
    recursive_emas(GAPPY, "gappy", ["dema_2"], gaps=True)
    + " SELECT symbol, timeframe, ts, round(2 * dema_1 - dema_2, 4) AS dema FROM e",
)(over_bars(gappy, 4, ind.dema, rows=700))

# Gaps of 2, 200 and 2,000 bars, in the closes of each symbol's longest stretch of days: a block sees the last values
# before it, however far back they lie.
CLOSED_GAPS = ((40, 2), (60, 200), (330, 2_000))


def long_gaps(spark, sf):
    bars = with_position(daily(spark, sf))
    inside = reduce(lambda a, b: a | b, [F.col("pos").between(start, start + length - 1) for start, length in CLOSED_GAPS])
    return bars.withColumn("close", F.when(~inside, F.col("close"))).drop("pos", "n")


LONG_GAPS = DAILY + f""",
placed AS (SELECT *, row_number() OVER ({W}) - 1 AS place FROM daily),
holed AS (
  SELECT symbol, timeframe, ts, open, high, low, volume,
         CASE WHEN {" OR ".join(f"place BETWEEN {a} AND {a + n - 1}" for a, n in CLOSED_GAPS)} THEN NULL ELSE close END AS close
  FROM placed)"""
GAPPY_LONG = {
    "ema": (["ema_5", "ema_26"], ["round(ema_5, 4) AS ema_5", "round(ema_26, 4) AS ema_26"], (lambda: ind.ema_of("close", 5, "ema_5"), lambda: ind.ema_of("close", 26, "ema_26"))),
    "macd": (["macd_line", "macd_signal"], ["round(macd_line, 4) AS macd_line", "round(macd_signal, 4) AS macd_signal", "round(macd_line - macd_signal, 4) AS macd_hist"], (ind.macd,)),
    "macd_cn": (["diff", "dea"], ["round(diff, 4) AS diff", "round(dea, 4) AS dea", "round(2 * (diff - dea), 4) AS macd_bar"], (ind.macd_cn,)),
    "tsi": (["up2", "size2"], [f"round(100 * up2 / CASE WHEN size2 = 0 THEN {EPS} ELSE size2 END, 4) AS tsi"], (ind.tsi,)),
    "wavetrend": (["wavetrend"], ["round(wavetrend, 4) AS wavetrend", f"round(avg(wavetrend) OVER {roll(4)}, 4) AS wavetrend_signal"], (ind.wavetrend,)),
    "dema": (["dema_2"], ["round(2 * dema_1 - dema_2, 4) AS dema"], (ind.dema,)),
    "macd_chart": (["macd_m", "macd_s"], ["round(macd_m, 4) AS macd_m", "round(macd_s, 4) AS macd_s", "round(macd_m - macd_s, 4) AS macd_h"], (ind.macd_chart,)),
}
for _number, (_name, (_states, _columns, _indicators)) in enumerate(GAPPY_LONG.items()):
    _sql = recursive_emas(LONG_GAPS, "holed", _states, gaps=True) + f" SELECT symbol, timeframe, ts, {', '.join(_columns)} FROM e"
    query(f"{_name}_gappy_long", _sql)(over_bars(long_gaps, 4, *_indicators, rows=(512, 700, BLOCK_ROWS)[_number % 3]))
query(
    "signal_accuracy_gappy_long",
    recursive_emas(LONG_GAPS, "holed", ["macd_signal", "diff", "dea"], gaps=True)
    + ACCURACY
    + f" SELECT *, round(avg(correct_signal) OVER {roll(20)}, 6) AS accuracy FROM h",
)(over_bars(long_gaps, 6, ind.signal_accuracy, rows=512))

# Small blocks, one size no divisor of the other: each daily series crosses several borders.
LONG = {
    "volatility": (intraday, 6, (ind.volatility,)), "sma": (daily, 3, tuple(lambda p=p: ind.sma(p) for p in (3, 5, 10, 20))),
    "rsi": (daily, 4, (ind.rsi,)), "momentum": (daily, 8, (ind.momentum,)), "macd": (daily, 4, (ind.macd,)), "tsi": (daily, 4, (ind.tsi,)),
    "wavetrend": (daily, 4, (ind.wavetrend,)), "dema": (daily, 4, (ind.dema,)), "bollinger": (daily, 3, (ind.bollinger,)),
}
for _number, (_name, (_bars, _digits, _indicators)) in enumerate(LONG.items()):
    query(f"{_name}_long", SQL[_name])(over_bars(_bars, _digits, *_indicators, rows=(512, 700)[_number % 2]))
query("obv_long", SQL["obv"])(lambda spark, sf: rounded(ind.obv(daily(spark, sf), rows=512).select(*KEYS, "obv"), 4, "obv"))
