"""Trading calendar: holidays, last trading days, trading slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Default holidays of a year, (month, first day, days).
DEFAULT_HOLIDAYS = (
    (1, 1, 1),
    (2, 1, 7),
    (4, 5, 1),
    (5, 1, 1),
    (6, 5, 1),
    (9, 15, 1),
    (10, 1, 7),
)
# Trading sessions, in minutes of the day.
SESSIONS = ((9 * 60 + 30, 11 * 60 + 30), (13 * 60, 15 * 60))
# Timeframe -> calendar period of its bars.
PERIODS = {"1w": "week", "1mo": "month", "1q": "quarter"}


def default_holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    days = [(m, d + i) for m, d, count in DEFAULT_HOLIDAYS for i in range(count)]
    literal = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d")) for m, d in days])
    return years.withColumn("md", F.explode(literal)).select(F.make_date("year", "md.m", "md.d").alias("date"))


def holiday_calendar(found: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Known dates where a year has any, the default dates elsewhere."""
    known = found.filter(F.year("date").between(first_year, last_year)).select("date")
    years = known.select(F.year("date").alias("year")).distinct()
    defaults = default_holidays(found.sparkSession, first_year, last_year)
    rest = defaults.withColumn("year", F.year("date")).join(years, "year", "left_anti").select("date")
    return known.unionByName(rest).distinct().orderBy("date")


def trading_calendar(df: DataFrame, holidays: DataFrame, first: Column, last: Column) -> DataFrame:
    """One row per day with the last trading day up to it.

    Covers ``first`` .. ``last`` (aggregates of ``df``) and the days after, to
    the end of the quarter.  It starts a week before the earliest holiday, so a
    run of closed days always ends at a trading day.  A calendar holds 366 rows
    a year at most, whatever the size of the bar table.
    """
    ends = df.agg(first.alias("first"), last.alias("last"))
    earliest = holidays.agg(F.min("date").alias("first"), F.lit(None).cast("date").alias("last"))
    span = ends.unionByName(earliest).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    start = F.date_sub("first", 10)
    end = F.date_add(F.last_day(F.add_months(F.trunc("last", "quarter"), 2)), 7)
    days = span.select(F.explode(F.sequence(start, end)).alias("date"))
    closed = holidays.select("date").distinct().withColumn("closed", F.lit(True))
    marked = days.join(closed, "date", "left").withColumn(
        "is_trading", F.col("closed").isNull() & (F.weekday("date") < 5)
    )
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    trading = F.when(F.col("is_trading"), F.col("date"))
    return marked.select("date", "is_trading", F.last(trading, ignorenulls=True).over(upto).alias("last_trading"))


def period_anchor(date: Column, period: str) -> Column:
    """The calendar day a period's last bar is sought back from."""
    if period == "week":
        # Friday of this week; from a Saturday or Sunday on, the next Friday.
        return F.date_add(date, (F.lit(11) - F.weekday(date)) % 7)
    if period == "month":
        return F.last_day(date)
    if period == "quarter":
        return F.last_day(F.add_months(F.trunc(date, "quarter"), 2))
    raise ValueError(f"unknown period {period!r}")


def timeframe_anchor(date: Column, timeframe: Column) -> Column:
    cases = [F.when(timeframe == code, period_anchor(date, period)) for code, period in PERIODS.items()]
    return F.coalesce(*cases)


def last_trading_day(df: DataFrame, calendar: DataFrame, anchor: Column, weekly: Column, date: str = "date") -> DataFrame:
    """Add ``last_trading_day``: the last trading day up to ``anchor``.

    For a week (``weekly`` true) a day before ``date`` itself means null.
    """
    days = calendar.select(F.col("date").alias("_anchor"), F.col("last_trading").alias("_found"))
    # Bounded: one row a day.  Every series has the same dates, so a shuffle on
    # the date would meet a few very large keys.
    joined = df.withColumn("_anchor", anchor).join(F.broadcast(days), "_anchor", "left")
    value = F.when(~weekly | (F.col("_found") >= F.col(date)), F.col("_found"))
    return joined.withColumn("last_trading_day", value).drop("_anchor", "_found")


def slot_times(minutes: int) -> list[str]:
    """Closing times of the bars of a trading day."""
    times = []
    for start, end in SESSIONS:
        for m in range(start + minutes, end + 1, minutes):
            times.append(f"{m // 60:02d}:{m % 60:02d}")
    return times


def trading_slots(df: DataFrame, minutes: int) -> DataFrame:
    """Every expected bar time of each row's day, as ``slot`` text."""
    return df.withColumn("slot", F.explode(F.array(*[F.lit(t) for t in slot_times(minutes)])))
