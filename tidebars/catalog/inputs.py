"""Bar tables made from the given tables, in Spark and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()):
    """Register a query, and the SQL that gives the same rows.

    ``dates`` are date columns, compared as text.
    """

    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if dates:
            text = {d: _as_text(d) for d in dates}
            QUERIES[name] = lambda spark, sf: function(spark, sf).withColumns({d: t() for d, t in text.items()})
        if sql is not None:
            replaced = ", ".join(f"{d}::VARCHAR AS {d}" for d in dates)
            SQL[name] = f"SELECT * REPLACE ({replaced}) FROM ({sql})" if dates else sql
        return function

    return register


def _as_text(column: str):
    """Year, month and day as the SQL writes them: years before the first count back from 1 and are marked, long ones have no sign."""
    def text():
        day, year = F.col(column), F.year(column)
        counted = F.format_string("%04d-%02d-%02d", F.when(year < 1, 1 - year).otherwise(year), F.month(column), F.day(column))
        odd = F.concat(counted, F.when(year < 1, " (BC)").otherwise(""))
        return F.when(year.between(1, 9999), day.cast("string")).when(day.isNotNull(), odd)

    return text


_SCHEMAS: dict = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file's footer once."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _ohlc(price: str, order):
    return [
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
    ]


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars per return flag: unit price of the items shipped that day."""
    items = table(spark, sf, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    # One number orders the items of a day (a struct would force a sort-based
    # aggregation): order and line, ties by what makes up the unit price.
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    cost = F.round(F.col("l_extendedprice") * 100).cast("bigint") * 100 + F.col("l_quantity").cast("bigint")
    order = line.cast("decimal(19,0)") * F.lit(10**12).cast("decimal(13,0)") + cost.cast("decimal(18,0)")
    return (
        items.groupBy(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("ts"))
        .agg(*_ohlc("price", order), F.sum("l_quantity").alias("volume"))
        .select("symbol", F.lit("1d").alias("timeframe"), "ts", "open", "high", "low", "close", "volume")
    )


DAILY = """
items AS (
  SELECT l_returnflag AS symbol, l_shipdate AS ts, l_quantity, l_extendedprice / l_quantity AS price,
         (l_orderkey * 10 + l_linenumber)::HUGEINT * 1000000000000
           + round(l_extendedprice * 100)::BIGINT * 100 + l_quantity::BIGINT AS k
  FROM lineitem),
daily AS (
  SELECT symbol, '1d' AS timeframe, ts, arg_min(price, k) AS open, max(price) AS high,
         min(price) AS low, arg_max(price, k) AS close, sum(l_quantity) AS volume
  FROM items GROUP BY symbol, ts)"""


def intraday(spark: SparkSession, sf: str, minutes: tuple[int, ...] = (5, 15, 60)) -> DataFrame:
    """Intraday bars per event type, several timeframes in one aggregation."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    minute = F.hour("ts") * 60 + F.minute("ts")
    steps = F.explode(F.array(*[F.lit(m) for m in minutes]))
    events = table(spark, sf, "events").select("ts", "event_type", "value").withColumn("_step", steps)
    start = F.expr("cast(date_trunc('day', ts) as timestamp_ntz) + make_dt_interval(0, 0, (hour(ts) * 60 + minute(ts)) div _step * _step)")
    return (
        events.groupBy(F.col("event_type").alias("symbol"), "_step", start.alias("start"))
        .agg(*_ohlc("value", F.col("ts")), F.count(F.lit(1)).cast("double").alias("volume"))
        .select(
            "symbol", F.concat(F.col("_step"), F.lit("m")).alias("timeframe"), F.col("start").alias("ts"),
            "open", "high", "low", "close", "volume",
        )
    )


INTRADAY = """
intraday AS (
  SELECT event_type AS symbol, m || 'm' AS timeframe, time_bucket(to_minutes(m), ts) AS ts,
         arg_min(value, e.ts) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, e.ts) AS close, count(*)::DOUBLE AS volume
  FROM events e CROSS JOIN (VALUES (5), (15), (60)) AS steps(m)
  GROUP BY 1, 2, 3)"""


def rollup(bars: DataFrame, unit: str, code: str) -> DataFrame:
    """Period bars (week, month, quarter) stamped with the period's last bar."""
    period = F.date_trunc(unit, "ts")
    return (
        bars.groupBy("symbol", period.alias("_period"))
        .agg(
            F.max("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"),
            F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
        )
        .select("symbol", F.lit(code).alias("timeframe"), "ts", "open", "high", "low", "close", "volume")
    )


def rollup_sql(unit: str, code: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT symbol, '{code}' AS timeframe, max(ts) AS ts, arg_min(open, ts) AS open, max(high) AS high,
         min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume
  FROM daily GROUP BY symbol, date_trunc('{unit}', ts))"""


WEEKLY, MONTHLY = rollup_sql("week", "1w", "weekly"), rollup_sql("month", "1mo", "monthly")


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars with every seventh close missing."""
    close = F.when(F.unix_date(F.to_date("ts")) % 7 == 0, None).otherwise(F.col("close"))
    return daily(spark, sf).withColumn("close", close)


GAPPY = DAILY + """,
gappy AS (
  SELECT * REPLACE (CASE WHEN datediff('day', DATE '1970-01-01', ts::DATE) % 7 = 0 THEN NULL ELSE close END AS close)
  FROM daily)"""

W = "PARTITION BY symbol, timeframe ORDER BY ts"
