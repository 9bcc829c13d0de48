"""Integrity checks.  Each returns typed issue rows; ``check_bars`` is all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.operators.calendar import (
    PERIODS,
    last_trading_day,
    slot_times,
    timeframe_anchor,
    trading_calendar,
)
from tidebars.sources.bars import raw_bars
from tidebars.timeframes import INTRADAY_MINUTES, canonical_column, is_intraday

PRICES = ("open", "high", "low", "close")
NUMERIC = (*PRICES, "volume")
MAX_PRICE = 100_000
ISSUE = ("symbol", "timeframe", "ts", "check", "column", "observed", "expected", "reasons")


def _issues(df: DataFrame, check: str, **given: Column) -> DataFrame:
    empty = F.lit(None)
    columns = {
        "symbol": F.col("symbol"),
        "timeframe": F.col("timeframe"),
        "ts": F.col("ts"),
        "check": F.lit(check),
        "column": empty.cast("string"),
        "observed": empty.cast("string"),
        "expected": empty.cast("string"),
        "reasons": empty.cast("array<string>"),
    } | given
    return df.select(*[columns[name].alias(name) for name in ISSUE])


def _issue(check: str, column=None, observed=None, reasons=None) -> Column:
    """An issue of one row, as the struct the row checks put into arrays."""

    def text(x) -> Column:
        return (F.lit(None) if x is None else x).cast("string")

    return F.struct(
        F.lit(check).alias("check"),
        text(column).alias("column"),
        text(observed).alias("observed"),
        F.lit(None).cast("string").alias("expected"),
        (F.lit(None) if reasons is None else reasons).cast("array<string>").alias("reasons"),
    )


def _cells(columns) -> Column:
    """Name, text and number of each of a row's cells."""
    return F.array(
        *[
            F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("t"), F.col(c).try_cast("double").alias("x"))
            for c in columns
        ]
    )


def _numeric() -> Column:
    bad = F.filter(_cells(NUMERIC), lambda e: e["x"].isNull())
    return F.transform(bad, lambda e: _issue("numeric", e["c"], e["t"]))


def _price_range() -> Column:
    bad = F.filter(_cells(PRICES), lambda e: (e["x"] <= 0) | (e["x"] > MAX_PRICE))

    def issue(e: Column) -> Column:
        reason = F.when(e["x"] <= 0, F.lit("Price <= 0")).otherwise(F.lit("Price > 100000"))
        return _issue("price_range", e["c"], e["t"], F.array(reason))

    return F.transform(bad, issue)


def _volume() -> Column:
    bad = F.filter(_cells(["volume"]), lambda e: e["x"] < 0)
    return F.transform(bad, lambda e: _issue("volume", e["c"], e["t"], F.array(F.lit("Negative volume"))))


def _ohlc() -> Column:
    o, h, l, c = (F.col(x).try_cast("double") for x in PRICES)
    rules = F.array(
        F.when(l > h, "Low > High"),
        F.when(o > h, "Open > High"),
        F.when(o < l, "Open < Low"),
        F.when(c > h, "Close > High"),
        F.when(c < l, "Close < Low"),
    )
    broken = F.filter(rules, lambda r: r.isNotNull())
    observed = F.concat_ws("/", *[F.col(x).cast("string") for x in PRICES])
    one = F.array(_issue("ohlc", None, observed, broken))
    return F.filter(one, lambda e: F.size(e["reasons"]) > 0)


def _row_checks(df: DataFrame, *checks: Column) -> DataFrame:
    """Issues of single rows; any number of checks share one scan."""
    found = df.select("symbol", "timeframe", "ts", F.explode(F.concat(*checks)).alias("_i"))
    return found.select("symbol", "timeframe", "ts", "_i.*").select(*ISSUE)


def check_numeric(df: DataFrame) -> DataFrame:
    """Cells that are not numbers (an empty one is not)."""
    return _row_checks(df, _numeric())


def check_price_range(df: DataFrame) -> DataFrame:
    """Prices of zero or less, or above 100000."""
    return _row_checks(df, _price_range())


def check_volume(df: DataFrame) -> DataFrame:
    """Negative volumes."""
    return _row_checks(df, _volume())


def check_ohlc(df: DataFrame) -> DataFrame:
    """Bars whose four prices contradict each other."""
    return _row_checks(df, _ohlc())


def _dated(df: DataFrame) -> DataFrame:
    """Distinct dates of the period (not intraday) series."""
    period = df.filter(~is_intraday(F.col("timeframe")))
    return period.select("symbol", "timeframe", F.to_date("ts").alias("date")).distinct()


def bars_calendar(df: DataFrame, holidays: DataFrame) -> DataFrame:
    day = F.to_date("ts")
    return trading_calendar(df, holidays, F.min(day), F.max(day))


def expected_periods(df: DataFrame, holidays: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """The dates each period series should have, from its first bar to its last."""
    calendar = calendar if calendar is not None else bars_calendar(df, holidays)
    ends = (
        df.filter(~is_intraday(F.col("timeframe")))
        .groupBy("symbol", "timeframe")
        .agg(F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last"))
    )
    # One row per series and year first, then the days of each: small arrays.
    years = ends.withColumn("year", F.explode(F.sequence(F.year("first"), F.year("last"))))
    new_year, eve = F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31))
    starts = {"1d": F.col("first"), "1w": F.date_sub("first", F.weekday("first"))}
    starts |= {"1mo": F.trunc("first", "month"), "1q": F.trunc("first", "quarter")}
    first_start = F.coalesce(*[F.when(F.col("timeframe") == t, s) for t, s in starts.items()])
    bounded = years.withColumn("_start", first_start)
    from_day = F.when(F.year("_start") < F.year("first"), F.when(F.col("year") == F.year("first"), F.col("_start")))
    from_day = F.coalesce(from_day, F.greatest("_start", new_year))
    days = bounded.withColumn("date", F.explode(F.sequence(from_day, F.least("last", eve))))
    tf, date = F.col("timeframe"), F.col("date")
    is_start = (
        (tf == "1d")
        | ((tf == "1w") & (F.weekday(date) == 0))
        | ((tf == "1mo") & (F.dayofmonth(date) == 1))
        | ((tf == "1q") & (date == F.trunc(date, "quarter")))
    )
    begun = days.filter(is_start).select("symbol", "timeframe", "date")
    anchor = F.coalesce(timeframe_anchor(date, tf), date)
    found = last_trading_day(begun, calendar, anchor, weekly=tf.isin("1w", "1d"))
    return (
        found.filter(F.col("last_trading_day").isNotNull())
        .select("symbol", "timeframe", F.col("last_trading_day").alias("date"))
        .distinct()
    )


def period_differences(df: DataFrame, holidays: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Expected dates without a bar and bars without an expected date."""
    expected = expected_periods(df, holidays, calendar).withColumn("_due", F.lit(True))
    actual = _dated(df).withColumn("_there", F.lit(True))
    both = expected.join(actual, ["symbol", "timeframe", "date"], "full_outer")
    missing, date = F.col("_there").isNull(), F.col("date").cast("string")
    odd = both.filter(missing | F.col("_due").isNull()).withColumn("ts", F.col("date").cast("timestamp_ntz"))
    issues = _issues(odd, "", expected=F.when(missing, date), observed=F.when(~missing, date))
    name = F.when(F.col("expected").isNotNull(), "missing_period").otherwise("extra_period")
    return issues.withColumn("check", name)


def missing_periods(df: DataFrame, holidays: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    expected = expected_periods(df, holidays, calendar)
    missing = expected.join(_dated(df), ["symbol", "timeframe", "date"], "left_anti")
    return _issues(missing, "missing_period", ts=F.col("date").cast("timestamp_ntz"), expected=F.col("date").cast("string"))


def extra_periods(df: DataFrame, holidays: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    expected = expected_periods(df, holidays, calendar)
    extra = _dated(df).join(expected, ["symbol", "timeframe", "date"], "left_anti")
    return _issues(extra, "extra_period", ts=F.col("date").cast("timestamp_ntz"), observed=F.col("date").cast("string"))


def wrong_period_end(df: DataFrame, holidays: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Weekly, monthly, quarterly bars not dated at their period's last trading day."""
    calendar = calendar if calendar is not None else bars_calendar(df, holidays)
    bars = df.filter(F.col("timeframe").isin(*PERIODS)).withColumn("date", F.to_date("ts"))
    anchor = timeframe_anchor(F.col("date"), F.col("timeframe"))
    found = last_trading_day(bars, calendar, anchor, weekly=F.col("timeframe") == "1w")
    wrong = found.filter(~F.col("last_trading_day").eqNullSafe(F.col("date")))
    return _issues(
        wrong, "wrong_period_end", observed=F.col("date").cast("string"),
        expected=F.col("last_trading_day").cast("string"),
    )


def missing_slots(df: DataFrame, holidays: DataFrame) -> DataFrame:
    """Trading times without a bar, per trading day that has any bar."""
    tf = F.col("timeframe")
    checked = [t for t, m in INTRADAY_MINUTES.items() if slot_times(m)]
    intraday = df.filter(tf.isin(*checked)).withColumn("date", F.to_date("ts"))
    closed = F.broadcast(holidays.select("date").distinct())  # bounded: a row a day at most
    open_days = intraday.filter(F.weekday("date") < 5).join(closed, "date", "left_anti")
    by_day = open_days.groupBy("symbol", "timeframe", "date").agg(
        F.collect_set(F.date_format("ts", "HH:mm")).alias("_there")
    )
    expected = F.coalesce(
        *[F.when(tf == t, F.array(*[F.lit(s) for s in slot_times(INTRADAY_MINUTES[t])])) for t in checked]
    )
    gaps = by_day.withColumn("reasons", F.array_sort(F.array_except(expected, F.col("_there"))))
    return _issues(
        gaps.filter(F.size("reasons") > 0), "missing_slots", ts=F.col("date").cast("timestamp_ntz"),
        observed=F.size("reasons").cast("string"), reasons=F.col("reasons"),
    )


def integrity_summary(df: DataFrame, issues: DataFrame, required: list[tuple[str, str]]) -> DataFrame:
    """Rows, date range, periods and issue count of each required series."""
    series = ["symbol", "timeframe"]
    by_day = df.groupBy(*series, F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    held = by_day.groupBy(*series).agg(
        F.sum("rows").alias("rows"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.count(F.lit(1)).alias("days"),
    )
    found = issues.groupBy(*series).agg(F.count(F.lit(1)).alias("issues"))
    wanted = df.sparkSession.createDataFrame(required, "symbol string, timeframe string")
    joined = wanted.join(held, series, "left").join(found, series, "left")
    periods = F.when(is_intraday(F.col("timeframe")), F.col("days")).otherwise(F.col("rows"))
    counts = {"rows": F.col("rows"), "periods": periods, "issues": F.col("issues")}
    return joined.withColumns({k: F.coalesce(v, F.lit(0).cast("bigint")) for k, v in counts.items()}).select(
        *series, "rows", "first_ts", "last_ts", "periods", "issues"
    )


def check_bars(df: DataFrame, holidays: DataFrame) -> DataFrame:
    """Every check over every series, as one issues table."""
    bars = df.withColumn("timeframe", canonical_column(F.col("timeframe")))
    calendar = bars_calendar(bars, holidays)
    parts = [
        _row_checks(bars, _numeric(), _price_range(), _volume(), _ohlc()),
        period_differences(bars, holidays, calendar),
        wrong_period_end(bars, holidays, calendar),
        missing_slots(bars, holidays),
    ]
    return reduce(DataFrame.unionByName, parts)


def check_files(lines: DataFrame, holidays: DataFrame) -> DataFrame:
    """Every check over the lines of bar files (``sources.bars.read_raw_bars``), before anything is dropped.

    Besides `check_bars` over the bars' text cells: ``unmatched_file`` for a file
    that isn't named like a bar file (its name is ``observed``),
    ``missing_column`` for one whose header lacks a price or the volume,
    ``bad_time`` for a line whose time does not parse, ``duplicate`` for a time
    that several lines of a series have.
    """
    named = F.col("symbol").isNotNull()
    body = lines.filter(named & ~F.col("is_header"))
    no_time = F.lit(None).cast("timestamp_ntz")
    unmatched = lines.filter(~named).select("symbol", "timeframe", "file").distinct()
    headers = lines.filter(named & F.col("is_header"))
    absent = F.filter(F.array(*[F.when(~F.coalesce(F.col(c) == c, F.lit(False)), F.lit(c)) for c in NUMERIC]), lambda c: c.isNotNull())
    short = headers.withColumn("reasons", absent).filter(F.size("reasons") > 0)
    untimed = body.filter(F.col("ts").isNull())
    again = body.filter(F.col("ts").isNotNull()).groupBy("symbol", "timeframe", "ts").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    values = F.max(F.struct(*NUMERIC)).alias("_b")
    once = raw_bars(lines).groupBy("symbol", "timeframe", "ts").agg(values).select("symbol", "timeframe", "ts", "_b.*")
    parts = [
        _issues(unmatched, "unmatched_file", ts=no_time, observed=F.col("file")),
        _issues(short, "missing_column", ts=no_time, observed=F.col("file"), reasons=F.col("reasons")),
        _issues(untimed, "bad_time", ts=no_time, column=F.lit("day"), observed=F.col("ts_text")),
        _issues(again, "duplicate", observed=F.col("n").cast("string")),
        check_bars(once, holidays),
    ]
    return reduce(DataFrame.unionByName, parts)
