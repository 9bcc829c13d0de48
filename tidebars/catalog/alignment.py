"""Resampling, alignment, calendar and integrity queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.catalog.cleaning import DIRTY, dirty
from tidebars.catalog.inputs import (
    DAILY,
    GAPPY,
    INTRADAY,
    MONTHLY,
    W,
    WEEKLY,
    daily,
    gappy,
    intraday,
    query,
    rollup,
    table,
)
from tidebars.functions import columns as fn
from tidebars.operators import align, calendar, integrity
from tidebars.series import staged

OHLCV = ["open", "high", "low", "close", "volume"]
COLS = ", ".join(OHLCV)


def gappy_intraday(spark, sf):
    """15m bars with the close missing where the minute is 30."""
    bars = intraday(spark, sf, (15,))
    return bars.withColumn("close", F.when(F.minute("ts") == 30, None).otherwise(F.col("close")))


GAPPY_15 = INTRADAY + """,
gappy15 AS (SELECT * REPLACE (CASE WHEN minute(ts) = 30 THEN NULL ELSE close END AS close)
  FROM intraday WHERE timeframe = '15m')"""
LAST = ", ".join(f"arg_max({c}, CASE WHEN {c} IS NOT NULL THEN ts END) AS {c}" for c in OHLCV)
RESAMPLED = f"""
found AS (SELECT symbol, timeframe, time_bucket(INTERVAL 30 MINUTE, ts) AS ts, {LAST} FROM gappy15 GROUP BY 1, 2, 3)"""
GRID = f"""
grid AS (SELECT symbol, timeframe, unnest(generate_series(a, b, INTERVAL 30 MINUTE)) AS ts
  FROM (SELECT symbol, timeframe, min(ts) AS a, max(ts) AS b FROM found GROUP BY 1, 2)),
slots AS (SELECT * FROM grid LEFT JOIN found USING (symbol, timeframe, ts))"""
query("resample_last", f"WITH {GAPPY_15},{RESAMPLED} SELECT * FROM found")(
    lambda spark, sf: align.resample_last(gappy_intraday(spark, sf), "30m")
)
query("resample_grid", f"WITH {GAPPY_15},{RESAMPLED},{GRID} SELECT * FROM slots")(
    lambda spark, sf: align.resample_last(gappy_intraday(spark, sf), "30m", grid=True)
)
FILL = ", ".join(
    f"last_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS {c}" for c in OHLCV
)
query("ffill_limit", f"WITH {GAPPY_15},{RESAMPLED},{GRID} SELECT symbol, timeframe, ts, {FILL} FROM slots")(
    lambda spark, sf: align.ffill_limit(align.resample_last(gappy_intraday(spark, sf), "30m", grid=True), 3, "30m")
)
PICK = ", ".join(f"l.{c}" for c in OHLCV)
query(
    "reindex_like",
    f"""WITH {INTRADAY}, b AS (SELECT * FROM intraday WHERE timeframe = '5m'),
    l AS (SELECT * FROM intraday WHERE timeframe = '60m')
    SELECT b.symbol, b.ts, {PICK} FROM b LEFT JOIN l ON b.symbol = l.symbol AND b.ts = l.ts""",
)(
    lambda spark, sf: align.reindex_like(intraday(spark, sf, (60,)), intraday(spark, sf, (5,)))
)
# Longer bars, by slot, with the reach of a bar in seconds.
ALIGN = f"""
bars AS (SELECT * FROM intraday),
wanted AS (SELECT b.symbol, t.timeframe, b.ts, t.reach, t.len FROM bars b
  JOIN (SELECT DISTINCT symbol, timeframe, CASE timeframe WHEN '15m' THEN 600 ELSE 3300 END AS reach,
               CASE timeframe WHEN '15m' THEN 900 ELSE 3600 END AS len
        FROM bars WHERE timeframe <> '5m') t ON t.symbol = b.symbol
  WHERE b.timeframe = '5m'),
ends AS (SELECT symbol, timeframe, max(ts) AS last_ts FROM bars GROUP BY 1, 2)"""
SAME = f"""WITH {INTRADAY},{ALIGN}
SELECT symbol, timeframe, ts, {COLS} FROM bars WHERE timeframe = '5m'
UNION ALL
SELECT w.symbol, w.timeframe, w.ts, {PICK} FROM wanted w JOIN ends e USING (symbol, timeframe)
ASOF LEFT JOIN bars l ON l.symbol = w.symbol AND l.timeframe = w.timeframe AND l.ts <= w.ts
WHERE l.ts IS NOT NULL AND epoch(w.ts) - epoch(l.ts) <= w.reach AND w.ts <= e.last_ts
UNION ALL
SELECT w.symbol, w.timeframe, w.ts, NULL, NULL, NULL, NULL, NULL FROM wanted w JOIN ends e USING (symbol, timeframe)
ASOF LEFT JOIN bars l ON l.symbol = w.symbol AND l.timeframe = w.timeframe AND l.ts <= w.ts
WHERE NOT coalesce(epoch(w.ts) - epoch(l.ts) <= w.reach AND w.ts <= e.last_ts, false)"""
query("align_timeframes", SAME)(lambda spark, sf: align.align_timeframes(intraday(spark, sf), "5m"))
CLOSED = ", ".join(
    f"CASE WHEN epoch(w.ts) - epoch(l.ts) - w.len <= w.reach THEN l.{c} END AS {c}" for c in OHLCV
)
query(
    "align_closed",
    f"""WITH {INTRADAY},{ALIGN}
    SELECT symbol, timeframe, ts, {COLS} FROM bars WHERE timeframe = '5m'
    UNION ALL
    SELECT w.symbol, w.timeframe, w.ts, {CLOSED} FROM (SELECT *, ts - to_seconds(len) AS seen FROM wanted) w
    ASOF LEFT JOIN bars l ON l.symbol = w.symbol AND l.timeframe = w.timeframe AND l.ts <= w.seen""",
)(lambda spark, sf: align.align_timeframes(intraday(spark, sf), "5m", mode="closed"))
query(
    "base_timeframe",
    f"""WITH {INTRADAY} SELECT symbol, arg_min(timeframe, replace(timeframe, 'm', '')::INT) AS base_timeframe
    FROM intraday GROUP BY symbol""",
)(lambda spark, sf: align.base_timeframe(intraday(spark, sf)))


def monthly_gappy(spark, sf):
    return rollup(gappy(spark, sf), "month", "1mo")


query(
    "quarterly_from_monthly",
    f"""WITH {GAPPY},{MONTHLY.replace('FROM daily', 'FROM gappy')}
    SELECT symbol, '1q' AS timeframe,
           (date_trunc('quarter', ts) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::TIMESTAMP AS ts, {LAST}
    FROM monthly GROUP BY symbol, date_trunc('quarter', monthly.ts)""",
)(lambda spark, sf: align.quarterly_from_monthly(monthly_gappy(spark, sf)))
query(
    "tail_align",
    f"""WITH {INTRADAY},
    t AS (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) - 1 AS tail FROM intraday)
    SELECT a.symbol, a.tail, a.ts, a.close, b.volume AS long_volume
    FROM t a JOIN t b ON a.symbol = b.symbol AND a.tail = b.tail AND a.timeframe = '5m' AND b.timeframe = '60m'""",
)(
    lambda spark, sf: align.tail_align(
        intraday(spark, sf, (5,)).select("symbol", "ts", "close"),
        intraday(spark, sf, (60,)).select("symbol", "ts", F.col("volume").alias("long_volume")),
        ["symbol"],
    ).drop("pos", "n")
)

# --- calendar --------------------------------------------------------------
HOLIDAYS = """
hmd(m, d) AS (VALUES (1,1),(2,1),(2,2),(2,3),(2,4),(2,5),(2,6),(2,7),(4,5),(5,1),(6,5),(9,15),
  (10,1),(10,2),(10,3),(10,4),(10,5),(10,6),(10,7)),
holidays AS (SELECT make_date(y, m, d) AS date FROM range(1990, 2030) AS r(y), hmd),
cal AS (SELECT d::DATE AS date FROM generate_series(DATE '1990-01-01', DATE '2029-12-31', INTERVAL 1 DAY) AS g(d)),
trading AS (SELECT date FROM cal WHERE isodow(date) <= 5 AND date NOT IN (SELECT date FROM holidays))"""


def holidays(spark):
    return calendar.default_holidays(spark, 1990, 2029)


def order_years(spark, sf):
    return table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()


query(
    "default_holidays",
    f"""WITH {HOLIDAYS}, y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders)
    SELECT date FROM holidays WHERE year(date) IN (SELECT y FROM y)""",
    dates=("date",),
)(
    lambda spark, sf: holidays(spark).join(
        order_years(spark, sf), F.year("date") == F.col("year"), "left_semi"
    )
)
# Found dates: order dates on the last day of a month.  Their years are fewer
# than the calendar's, which takes the default dates for the others.
FOUND = """
found AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders WHERE last_day(o_orderdate::DATE) = o_orderdate::DATE)"""


def found_holidays(spark, sf):
    day = F.to_date("o_orderdate")
    orders = table(spark, sf, "orders").filter(F.last_day(day) == day)
    return orders.select(day.alias("date")).distinct()


query(
    "holiday_calendar",
    f"""WITH {HOLIDAYS},{FOUND}
    SELECT date FROM found WHERE year(date) BETWEEN 1990 AND 2005 UNION
    SELECT date FROM holidays WHERE year(date) BETWEEN 1990 AND 2005
      AND year(date) NOT IN (SELECT year(date) FROM found)""",
    dates=("date",),
)(lambda spark, sf: calendar.holiday_calendar(found_holidays(spark, sf), 1990, 2005))


def order_days(spark, sf):
    return table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()


ANCHORS = {
    "week": "(date + ((11 - (isodow(date) - 1)) % 7)::INT)::DATE",
    "month": "last_day(date)",
    "quarter": "(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE",
}


def last_day_query(period):
    def build(spark, sf):
        days = order_days(spark, sf)
        cal = calendar.trading_calendar(days, holidays(spark), F.min("date"), F.max("date"))
        anchor = calendar.period_anchor(F.col("date"), period)
        return calendar.last_trading_day(days, cal, anchor, F.lit(period == "week"))

    found = f"(SELECT max(t.date) FROM trading t WHERE t.date <= a.anchor)"
    value = f"CASE WHEN found >= date THEN found END" if period == "week" else "found"
    sql = f"""WITH {HOLIDAYS},
    a AS (SELECT date, {ANCHORS[period]} AS anchor FROM (SELECT DISTINCT o_orderdate::DATE AS date FROM orders)),
    f AS (SELECT date, {found} AS found FROM a)
    SELECT date, {value} AS last_trading_day FROM f"""
    query(f"last_trading_day_{period}", sql, dates=("date", "last_trading_day"))(build)


for _period in ANCHORS:
    last_day_query(_period)

PERIOD_BARS = f"""{DAILY},{WEEKLY},{MONTHLY},
quarters AS (SELECT symbol, '1q' AS timeframe, max(ts) AS ts, arg_min(open, ts) AS open, max(high) AS high,
  min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM daily
  GROUP BY symbol, date_trunc('quarter', ts)),
bars AS (SELECT * FROM daily UNION ALL SELECT * FROM weekly UNION ALL SELECT * FROM monthly
  UNION ALL SELECT * FROM quarters)"""


def period_bars(spark, sf):
    bars = daily(spark, sf)
    return (
        bars.unionByName(rollup(bars, "week", "1w"))
        .unionByName(rollup(bars, "month", "1mo"))
        .unionByName(rollup(bars, "quarter", "1q"))
    )


EXPECTED = f"""
span AS (SELECT symbol, timeframe, min(ts)::DATE AS a, max(ts)::DATE AS b FROM bars GROUP BY 1, 2),
starts AS (
  SELECT symbol, timeframe, unnest(generate_series(
    CASE timeframe WHEN '1d' THEN a WHEN '1w' THEN date_trunc('week', a)::DATE
      WHEN '1mo' THEN date_trunc('month', a)::DATE ELSE date_trunc('quarter', a)::DATE END, b,
    CASE timeframe WHEN '1d' THEN INTERVAL 1 DAY WHEN '1w' THEN INTERVAL 7 DAY
      WHEN '1mo' THEN INTERVAL 1 MONTH ELSE INTERVAL 3 MONTH END))::DATE AS date FROM span),
anchored AS (SELECT symbol, timeframe, date, CASE timeframe WHEN '1d' THEN date WHEN '1w' THEN {ANCHORS['week']}
  WHEN '1mo' THEN {ANCHORS['month']} ELSE {ANCHORS['quarter']} END AS anchor FROM starts),
marks AS (SELECT anchor, (SELECT max(t.date) FROM trading t WHERE t.date <= x.anchor) AS found
  FROM (SELECT DISTINCT anchor FROM anchored) x),
expected AS (SELECT DISTINCT symbol, timeframe, found AS date FROM anchored JOIN marks USING (anchor)
  WHERE timeframe NOT IN ('1d', '1w') OR found >= date),
actual AS (SELECT DISTINCT symbol, timeframe, ts::DATE AS date FROM bars)"""
PERIODS = f"WITH {PERIOD_BARS},{HOLIDAYS},{EXPECTED}"
query("expected_periods", f"{PERIODS} SELECT * FROM expected", dates=("date",))(
    lambda spark, sf: integrity.expected_periods(period_bars(spark, sf), holidays(spark))
)
ISSUE = "symbol, timeframe, {ts} AS ts, '{check}' AS \"check\", {column} AS \"column\", {observed} AS observed, {expected} AS expected, {reasons} AS reasons"


def issue(check, ts="ts", column="NULL::VARCHAR", observed="NULL::VARCHAR", expected="NULL::VARCHAR", reasons="''"):
    return ISSUE.format(check=check, ts=ts, column=column, observed=observed, expected=expected, reasons=reasons)


def flat(issues):
    """Issue rows with the reasons as one text."""
    return issues.withColumn("reasons", F.coalesce(F.array_join("reasons", ", "), F.lit("")))


DATE_TS = "date::TIMESTAMP"
MISSING = f"""SELECT {issue('missing_period', ts=DATE_TS, expected='date::VARCHAR')}
FROM (SELECT * FROM expected EXCEPT SELECT * FROM actual)"""
EXTRA = f"""SELECT {issue('extra_period', ts=DATE_TS, observed='date::VARCHAR')}
FROM (SELECT * FROM actual EXCEPT SELECT * FROM expected)"""
query("missing_periods", f"{PERIODS} {MISSING}")(
    lambda spark, sf: flat(integrity.missing_periods(period_bars(spark, sf), holidays(spark)))
)
query("extra_periods", f"{PERIODS} {EXTRA}")(
    lambda spark, sf: flat(integrity.extra_periods(period_bars(spark, sf), holidays(spark)))
)
WRONG_CTE = f""",
dated AS (SELECT *, ts::DATE AS date FROM bars WHERE timeframe <> '1d'),
due AS (SELECT *, CASE timeframe WHEN '1w' THEN {ANCHORS['week']} WHEN '1mo' THEN {ANCHORS['month']}
  ELSE {ANCHORS['quarter']} END AS anchor FROM dated),
due2 AS (SELECT *, (SELECT max(t.date) FROM trading t WHERE t.date <= due.anchor) AS found FROM due),
due3 AS (SELECT *, CASE WHEN timeframe <> '1w' OR found >= date THEN found END AS wanted FROM due2)"""
WRONG = f"""SELECT {issue('wrong_period_end', observed='date::VARCHAR', expected='wanted::VARCHAR')}
FROM due3 WHERE wanted IS DISTINCT FROM date"""
query("wrong_period_end", f"{PERIODS}{WRONG_CTE} {WRONG}")(
    lambda spark, sf: flat(integrity.wrong_period_end(period_bars(spark, sf), holidays(spark)))
)


# --- content checks --------------------------------------------------------
def double_text(column):
    """Spark's text of a double differs from DuckDB's, so both sides cast it."""
    return f"round(try_cast({column} AS DOUBLE), 6)"


def numbered(issues):
    """``observed`` as a number, rounded, for the comparison."""
    return flat(issues).withColumn("observed", F.round(F.col("observed").try_cast("double"), 6))


def cells(columns):
    return " UNION ALL ".join(f"SELECT symbol, timeframe, ts, '{c}' AS c, {c} AS x FROM dirty" for c in columns)


CELLS = f""",
prices AS ({cells(OHLCV[:4])}), numbers AS ({cells(OHLCV)})"""
NUMERIC = f"""SELECT {issue('numeric', column='c', observed='try_cast(x AS DOUBLE)')}
FROM numbers WHERE try_cast(x AS DOUBLE) IS NULL"""
RANGE = f"""SELECT {issue('price_range', column='c', observed=double_text('x'),
  reasons="CASE WHEN try_cast(x AS DOUBLE) <= 0 THEN 'Price <= 0' ELSE 'Price > 100000' END")}
FROM prices WHERE try_cast(x AS DOUBLE) <= 0 OR try_cast(x AS DOUBLE) > 100000"""
VOLUME = f"""SELECT {issue('volume', column="'volume'", observed=double_text('volume'), reasons="'Negative volume'")}
FROM dirty WHERE try_cast(volume AS DOUBLE) < 0"""
O, H, L, C = (f"try_cast({c} AS DOUBLE)" for c in OHLCV[:4])
RULES = {
    "Low > High": f"{L} > {H}", "Open > High": f"{O} > {H}", "Open < Low": f"{O} < {L}",
    "Close > High": f"{C} > {H}", "Close < Low": f"{C} < {L}",
}
REASONS = "concat_ws(', ', " + ", ".join(f"CASE WHEN {r} THEN '{n}' END" for n, r in RULES.items()) + ")"
OHLC = f"""SELECT {issue('ohlc', observed='NULL::DOUBLE', reasons=REASONS)} FROM dirty WHERE {REASONS} <> ''"""
for _name, _sql, _check in (
    ("check_numeric", NUMERIC, integrity.check_numeric),
    ("check_price_range", RANGE, integrity.check_price_range),
    ("check_volume", VOLUME, integrity.check_volume),
    ("check_ohlc", OHLC, integrity.check_ohlc),
):
    query(_name, f"WITH {DIRTY}{CELLS} {_sql}")(lambda spark, sf, check=_check: numbered(check(dirty(spark, sf))))

# --- intraday slots --------------------------------------------------------
SLOTS = """
slots AS (SELECT m, lpad((s // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS slot
  FROM (VALUES (5), (15), (60)) AS steps(m), range(0, 1440) AS r(s)
  WHERE (s > 570 AND s <= 690 AND (s - 570) % m = 0) OR (s > 780 AND s <= 900 AND (s - 780) % m = 0))"""


@query(
    "trading_slots",
    f"""WITH {SLOTS}, d AS (SELECT DISTINCT ts::DATE AS date FROM events)
    SELECT date, m AS minutes, slot FROM d, slots""",
    dates=("date",),
)
def trading_slots(spark, sf):
    days = table(spark, sf, "events").select(F.to_date("ts").alias("date")).distinct()
    parts = [calendar.trading_slots(days, m).withColumn("minutes", F.lit(m)) for m in (5, 15, 60)]
    return reduce(DataFrame.unionByName, parts)


GAPS = f""",{SLOTS},
open_days AS (SELECT DISTINCT symbol, timeframe, ts::DATE AS date FROM intraday
  WHERE isodow(ts) <= 5 AND ts::DATE NOT IN (SELECT date FROM holidays)),
gaps AS (SELECT o.symbol, o.timeframe, o.date, string_agg(slot, ', ' ORDER BY slot) AS missing, count(*) AS n
  FROM open_days o JOIN slots s ON o.timeframe = s.m || 'm'
  WHERE NOT EXISTS (SELECT 1 FROM intraday i WHERE i.symbol = o.symbol AND i.timeframe = o.timeframe
    AND i.ts::DATE = o.date AND strftime(i.ts, '%H:%M') = s.slot)
  GROUP BY 1, 2, 3)"""
SLOT_ISSUES = f"""SELECT {issue('missing_slots', ts=DATE_TS, observed='n::DOUBLE', reasons='missing')} FROM gaps"""
query("missing_slots", f"WITH {INTRADAY},{HOLIDAYS}{GAPS} {SLOT_ISSUES}")(
    lambda spark, sf: numbered(integrity.missing_slots(intraday(spark, sf), holidays(spark)))
)

# --- everything ------------------------------------------------------------
ALL_BARS = f"""{DIRTY},{INTRADAY},
bars AS (SELECT symbol, timeframe, ts FROM dirty UNION ALL SELECT symbol, timeframe, ts FROM intraday)"""


def all_bars(spark, sf):
    text = {c: F.col(c).cast("string") for c in OHLCV}
    return dirty(spark, sf).unionByName(intraday(spark, sf).withColumns(text))


TEXT = ", ".join(f"{c}::VARCHAR AS {c}" for c in OHLCV)
EVERY = f""",
every_bar AS (SELECT symbol, timeframe, ts, {COLS} FROM dirty UNION ALL SELECT symbol, timeframe, ts, {TEXT} FROM intraday)"""
ALL_ISSUES = f"""WITH {ALL_BARS}{EVERY}{CELLS.replace('FROM dirty', 'FROM every_bar')},{HOLIDAYS}{GAPS},
pbars AS (SELECT * FROM bars WHERE timeframe = '1d'),{EXPECTED.replace('FROM bars', 'FROM pbars')},
issues AS ({NUMERIC} UNION ALL {RANGE} UNION ALL {VOLUME.replace('FROM dirty', 'FROM every_bar')}
  UNION ALL {OHLC.replace('FROM dirty', 'FROM every_bar')}
  UNION ALL {MISSING.replace('NULL::VARCHAR AS observed', 'NULL::DOUBLE AS observed')}
  UNION ALL {EXTRA.replace('date::VARCHAR AS observed', 'NULL::DOUBLE AS observed')}
  UNION ALL {SLOT_ISSUES})"""
query("check_bars", f"{ALL_ISSUES} SELECT * FROM issues")(
    lambda spark, sf: numbered(integrity.check_bars(staged(all_bars(spark, sf)), holidays(spark)))
)
REQUIRED = [(s, t) for s in ("A", "N", "R", "view", "none") for t in ("1d", "5m")]
REQUIRED_SQL = ", ".join(f"('{s}', '{t}')" for s, t in REQUIRED)


@query(
    "integrity_summary",
    f"""{ALL_ISSUES}, req(symbol, timeframe) AS (VALUES {REQUIRED_SQL}),
    held AS (SELECT symbol, timeframe, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts,
      CASE WHEN timeframe = '1d' THEN count(*) ELSE count(DISTINCT ts::DATE) END AS periods FROM bars GROUP BY 1, 2),
    bad AS (SELECT symbol, timeframe, count(*) AS issues FROM issues GROUP BY 1, 2)
    SELECT symbol, timeframe, coalesce(rows, 0) AS rows, first_ts, last_ts, coalesce(periods, 0) AS periods,
      coalesce(issues, 0) AS issues
    FROM req LEFT JOIN held USING (symbol, timeframe) LEFT JOIN bad USING (symbol, timeframe)""",
)
def integrity_summary(spark, sf):
    bars = staged(all_bars(spark, sf))
    return integrity.integrity_summary(bars, integrity.check_bars(bars, holidays(spark)), REQUIRED)


FORMATS = ["d MMM", "MMM d", "dd MMMM", "MMMM dd", "dd.MM", "yyyy-MM-dd"]
query(
    "parse_holiday_date",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE o_orderdate::DATE END AS date FROM orders",
    dates=("date",),
)(
    lambda spark, sf: table(spark, sf, "orders").select(
        "o_orderkey",
        fn.parse_holiday_date(
            F.coalesce(
                *[F.when(F.col("o_orderkey") % 7 == i, F.date_format("o_orderdate", f)) for i, f in enumerate(FORMATS)],
                F.lit("n/a"),
            ),
            F.year("o_orderdate"),
        ).alias("date"),
    )
)


def file_lines(spark, sf):
    """The dirty daily bars as lines of bar files, some with a time that does not parse, some twice."""
    bars = dirty(spark, sf)
    lines = bars.select(
        F.concat("symbol", F.lit("_1d_1995-01-01_2001-12-31.csv")).alias("file"), "symbol", "timeframe",
        F.when(F.dayofmonth("ts") == 13, F.lit("13th")).otherwise(F.col("ts").cast("string")).alias("ts_text"),
        F.when(F.dayofmonth("ts") != 13, F.col("ts")).alias("ts"), *OHLCV, F.lit(False).alias("is_header"), F.lit(7).alias("cells"),
    )
    return lines.unionByName(lines.filter("dayofmonth(ts) = 2"))


query(
    "check_files",
    f"""WITH {DIRTY}, timed AS (SELECT * FROM dirty WHERE day(ts) <> 13)
    SELECT symbol, timeframe, NULL::TIMESTAMP AS ts, 'bad_time' AS "check", count(*) AS n FROM dirty WHERE day(ts) = 13 GROUP BY ALL
    UNION ALL SELECT symbol, timeframe, ts, 'duplicate', 1 FROM timed WHERE day(ts) = 2""",
)(
    lambda spark, sf: integrity.check_files(staged(file_lines(spark, sf)), holidays(spark))
    .filter("check in ('bad_time', 'duplicate', 'unmatched_file', 'missing_column')")
    .groupBy("symbol", "timeframe", "ts", "check").agg(F.count(F.lit(1)).alias("n"))
)
