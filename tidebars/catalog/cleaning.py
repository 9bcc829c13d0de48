"""Filter, cleaning, scaling and source queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

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
    rounded,
    table,
)
from tidebars.functions import columns as fn
from tidebars.operators import clean
from tidebars.series import new_path, require_columns
from tidebars.sources import bars as src

KEYS = ["symbol", "timeframe", "ts"]
OHLCV = list(clean.OHLCV)
COLUMNS = ", ".join([*KEYS, *OHLCV])


def dirty(spark, sf):
    """Daily bars as text, with broken cells on fixed days."""
    day = F.unix_date(F.to_date("ts"))
    text = {c: F.col(c).cast("string") for c in OHLCV}
    text["close"] = F.when(day % 97 == 0, "bad").when(day % 89 == 0, "-1.0").otherwise(text["close"])
    text["volume"] = F.when(day % 83 == 0, "-5.0").otherwise(text["volume"])
    text["low"] = F.when(day % 79 == 0, "100000.5").otherwise(text["low"])
    return daily(spark, sf).withColumns(text)


DAY = "datediff('day', DATE '1970-01-01', ts::DATE)"
DIRTY = DAILY + f""",
dirty AS (
  SELECT symbol, timeframe, ts, open::VARCHAR AS open, high::VARCHAR AS high,
         CASE WHEN {DAY} % 79 = 0 THEN '100000.5' ELSE low::VARCHAR END AS low,
         CASE WHEN {DAY} % 97 = 0 THEN 'bad' WHEN {DAY} % 89 = 0 THEN '-1.0' ELSE close::VARCHAR END AS close,
         CASE WHEN {DAY} % 83 = 0 THEN '-5.0' ELSE volume::VARCHAR END AS volume FROM daily)"""
CAST = ", ".join(f"try_cast({c} AS DOUBLE) AS {c}" for c in OHLCV)

query("to_numeric", f"WITH {DIRTY} SELECT symbol, timeframe, ts, {CAST} FROM dirty")(
    lambda spark, sf: clean.to_numeric(dirty(spark, sf), OHLCV)
)
query("filter_from", f"WITH {INTRADAY} SELECT * FROM intraday WHERE ts >= TIMESTAMP '2024-01-10 12:00:00'")(
    lambda spark, sf: clean.filter_from(intraday(spark, sf), "2024-01-10 12:00:00")
)
query(
    "filter_until",
    f"""WITH {INTRADAY} SELECT * FROM intraday WHERE ts <= TIMESTAMP '2024-01-20'
    QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) <= 50""",
)(lambda spark, sf: clean.filter_until(intraday(spark, sf), "2024-01-20 15:00:00", 50))
query(
    "filter_until_long",
    f"""WITH {INTRADAY} SELECT * FROM intraday WHERE ts <= TIMESTAMP '2024-01-20'
    QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) <= 1200""",
)(lambda spark, sf: clean.filter_until(intraday(spark, sf), "2024-01-20", 1200))
query(
    "to_utc",
    "SELECT event_id, ts - INTERVAL 8 HOUR AS ts FROM events",
)(lambda spark, sf: clean.to_utc(table(spark, sf, "events").select("event_id", "ts"), "Asia/Shanghai"))
query("require_columns", f"WITH {DAILY} SELECT {COLUMNS} FROM daily")(
    lambda spark, sf: require_columns(daily(spark, sf), [*KEYS, *OHLCV])
)
LIMITS = ", ".join(f"quantile_cont({c}, 0.01) AS {c}0, quantile_cont({c}, 0.99) AS {c}1" for c in OHLCV)
CLIPS = ", ".join(f"round(least(greatest({c}, {c}0), {c}1), 6) AS {c}" for c in OHLCV)
WINSOR = f"""WITH {INTRADAY}, q AS (SELECT symbol, timeframe, {LIMITS} FROM intraday GROUP BY 1, 2)
SELECT symbol, timeframe, ts, {CLIPS} FROM intraday JOIN q USING (symbol, timeframe)"""
query("winsorize", WINSOR)(lambda spark, sf: rounded(clean.winsorize(intraday(spark, sf)), 6, *OHLCV))
query("winsorize_long_series", WINSOR)(
    lambda spark, sf: rounded(clean.winsorize(intraday(spark, sf)), 6, *OHLCV)
)


def infinite(spark, sf):
    """Ratio column with infinities and NaN on fixed days."""
    day = F.unix_date(F.to_date("ts"))
    x = F.when(day % 11 == 0, float("inf")).when(day % 13 == 0, float("-inf")).when(day % 17 == 0, float("nan"))
    return daily(spark, sf).withColumn("x", F.coalesce(x, F.col("close")))


query(
    "inf_to_null",
    f"""WITH {DAILY} SELECT {COLUMNS},
    CASE WHEN {DAY} % 11 = 0 OR {DAY} % 13 = 0 OR {DAY} % 17 = 0 THEN NULL ELSE close END AS x FROM daily""",
)(lambda spark, sf: clean.inf_to_null(infinite(spark, sf), ["x"]))

PART = "PARTITION BY symbol, timeframe"
INTERPOLATE = f"""
n AS (SELECT *,
  last_value(CASE WHEN close IS NOT NULL THEN ts END IGNORE NULLS) OVER up AS t0,
  last_value(close IGNORE NULLS) OVER up AS x0,
  first_value(CASE WHEN close IS NOT NULL THEN ts END IGNORE NULLS) OVER down AS t1,
  first_value(close IGNORE NULLS) OVER down AS x1
  FROM SOURCE
  WINDOW up AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         down AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT symbol, timeframe, ts, round(coalesce(close,
  x0 + (x1 - x0) * ((epoch_us(ts) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0))), x0, x1), 9) AS close FROM n"""
query("interpolate_time", f"WITH {GAPPY},{INTERPOLATE.replace('SOURCE', 'gappy')}")(
    lambda spark, sf: rounded(clean.interpolate_time(gappy(spark, sf), ["close"]).select(*KEYS, "close"), 9, "close")
)
query(
    "ffill",
    f"WITH {GAPPY} SELECT symbol, timeframe, ts, last_value(close IGNORE NULLS) OVER ({W}) AS close FROM gappy",
)(lambda spark, sf: clean.ffill(gappy(spark, sf), ["close"]).select(*KEYS, "close"))
query(
    "bfill",
    f"""WITH {GAPPY} SELECT symbol, timeframe, ts, first_value(close IGNORE NULLS)
    OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS close FROM gappy""",
)(lambda spark, sf: clean.bfill(gappy(spark, sf), ["close"]).select(*KEYS, "close"))
INF = f"""
broken AS (SELECT symbol, timeframe, ts,
  CASE WHEN {DAY} % 11 = 0 OR {DAY} % 13 = 0 OR {DAY} % 17 = 0 THEN NULL ELSE close END AS close FROM daily),"""
query("handle_nan_inf", f"WITH {DAILY},{INF}{INTERPOLATE.replace('SOURCE', 'broken')}")(
    lambda spark, sf: rounded(
        clean.handle_nan_inf(infinite(spark, sf), ["x"]).select(*KEYS, F.col("x").alias("close")), 9, "close"
    )
)
query(
    "minmax_normalize",
    f"""WITH {DAILY} SELECT symbol, timeframe, ts, open, high, low, close, volume,
    round(((high - low) - min(high - low) OVER ({PART})) / (max(high - low) OVER ({PART}) - min(high - low) OVER ({PART})), 8) AS width,
    0.0::DOUBLE AS flat FROM daily""",
)(
    lambda spark, sf: rounded(
        clean.minmax_normalize(
            daily(spark, sf).withColumns({"width": F.col("high") - F.col("low"), "flat": F.lit(7.0)})
        ),
        8, "width",
    )
)
query(
    "tail_n",
    f"""WITH {INTRADAY} SELECT * FROM intraday
    QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) <= 20""",
)(lambda spark, sf: clean.tail_n(intraday(spark, sf), 20))


query(
    "left_pad",
    f"""WITH {DAILY}, j AS (SELECT *, row_number() OVER ({W}) - 1 AS r, count(*) OVER ({PART}) AS n FROM daily)
    SELECT symbol, timeframe, r + greatest(3000 - n, 0) AS pos, open, high, low, close, volume FROM j
    UNION ALL
    SELECT symbol, timeframe, unnest(range(3000 - n)), NULL, NULL, NULL, NULL, NULL FROM j WHERE r = 0""",
)(lambda spark, sf: clean.left_pad(daily(spark, sf), 3000))
query(
    "drop_empty_rows",
    """SELECT doc_id, g.i AS pos, split_part(l, ' ', 1) AS head, substr(l, length(split_part(l, ' ', 1)) + 2) AS rest
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(len(ls))) AS g(i),
    LATERAL (SELECT ls[g.i + 1] AS l) WHERE l <> '' AND l <> ' '""",
)(
    lambda spark, sf: clean.drop_empty_rows(
        table(spark, sf, "documents")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .withColumn("head", F.split_part("line", F.lit(" "), F.lit(1)))
        .select(
            "doc_id", F.col("pos").cast("bigint").alias("pos"), "head",
            F.substr("line", F.length("head") + 2).alias("rest"),
        ),
        ["head", "rest"],
    )
)


# --- sources and sinks -----------------------------------------------------
def stored(spark, bars, fmt):
    path = new_path(spark, "bars")
    src.write_bars(bars, path, fmt)
    return src.read_stored_bars(spark, path, fmt)


query("write_bars", f"WITH {INTRADAY} SELECT * FROM intraday")(
    lambda spark, sf: stored(spark, intraday(spark, sf), "parquet")
)
query("write_bars_csv", f"WITH {INTRADAY} SELECT * FROM intraday")(
    lambda spark, sf: stored(spark, intraday(spark, sf), "csv")
)


@query("read_bars", f"WITH {DAILY} SELECT {COLUMNS} FROM daily")
def read_bars(spark, sf):
    """Bars written as CSV files, several to a series, then all read by file name."""
    path = new_path(spark, "named")
    bars = daily(spark, sf)
    # Spark names its own files, so they are given the bar-file names through
    # the Hadoop file system of the folder.
    text = bars.withColumn("day", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows = text.select("symbol", "timeframe", F.col("day").alias("index"), "day", *OHLCV)
    rows.write.option("header", True).partitionBy("symbol", "timeframe").csv(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    for i, f in enumerate(fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/*/*/*.csv"))):
        old = f.getPath()
        tf, symbol = old.getParent().getName(), old.getParent().getParent().getName()
        first = dt.date(1900, 1, 1) + dt.timedelta(days=i)
        name = f"{symbol.split('=')[1]}_{tf.split('=')[1]}_{first}_2001-12-31.csv"
        fs.rename(old, jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
    return src.read_bars(spark, f"{path}/*.csv")


@query("read_holidays", "SELECT DISTINCT o_orderdate::DATE AS date FROM orders", dates=("date",))
def read_holidays(spark, sf):
    path = new_path(spark, "holidays")
    dates = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    dates.write.option("header", True).csv(path)
    return src.read_holidays(spark, path)


def payloads_of_objects(spark, sf):
    """5m and 15m bars landed as one array of objects per symbol and day."""
    bars = intraday(spark, sf)
    fields = [F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("day"), *[F.col(c).cast("string").alias(c) for c in OHLCV]]
    day = F.to_date("ts").alias("date")
    landed = bars.groupBy("symbol", "timeframe", day).agg(F.to_json(F.collect_list(F.struct(*fields))).alias("payload"))
    return landed


query("kline_objects", f"WITH {INTRADAY} SELECT * FROM intraday")(
    lambda spark, sf: src.kline_from_json(payloads_of_objects(spark, sf), "objects")
)


def payloads_of_arrays(spark, sf):
    """Daily bars per month (adjusted for even months), minute bars per day with a quote."""
    order = ["open", "close", "high", "low", "volume"]

    def rows(time_format: str):
        cells = F.array(F.date_format("ts", time_format), *[F.col(c).cast("string") for c in order])
        return F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ts", cells.alias("c")))), lambda s: s["c"]))

    month = F.trunc(F.to_date("ts"), "month")
    by_month = daily(spark, sf).groupBy("symbol", "timeframe", month.alias("m")).agg(rows("yyyy-MM-dd").alias("rows"))
    unit = F.when(F.month("m") % 2 == 0, "qfqday").otherwise("day")
    days = by_month.select(
        "symbol", "timeframe",
        F.format_string('{"code":0,"data":{"%s":{"%s":%s,"qt":{"%s":["a","b","c","1.5"]}}}}', "symbol", unit, "rows", "symbol").alias("payload"),
    )
    by_day = (
        intraday(spark, sf, (5,)).groupBy("symbol", "timeframe", F.to_date("ts").alias("d"))
        .agg(rows("yyyyMMddHHmm").alias("rows"))
    )
    minutes = by_day.select(
        "symbol", "timeframe",
        F.format_string('{"data":{"%s":{"m5":%s,"qt":{"%s":["a","b","c","1.5"]}}}}', "symbol", "rows", "symbol").alias("payload"),
    )
    return days.unionByName(minutes)


query(
    "kline_arrays",
    f"""WITH {DAILY}, {INTRADAY} SELECT * FROM daily UNION ALL
    SELECT symbol, timeframe, ts, open, high, low,
           CASE WHEN ts = max(ts) OVER (PARTITION BY symbol, ts::DATE) THEN 1.5 ELSE close END, volume
    FROM intraday WHERE timeframe = '5m'""",
)(lambda spark, sf: src.kline_from_json(payloads_of_arrays(spark, sf), "arrays"))

query(
    "normalize_symbol",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'sh' || lpad(o_custkey::VARCHAR, 6, '0')
       WHEN 1 THEN 'sz' || lpad(o_custkey::VARCHAR, 6, '0') ELSE 'bj' || lpad(o_custkey::VARCHAR, 6, '0') END AS symbol
    FROM orders""",
)(
    lambda spark, sf: table(spark, sf, "orders").select(
        "o_orderkey",
        fn.normalize_symbol(
            F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit(".XSHG")))
            .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit(".XSHE")))
            .otherwise(F.concat(F.lit("bj"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")))
        ).alias("symbol"),
    )
)


@query(
    "fallback_union",
    f"""WITH {DAILY},{WEEKLY},{MONTHLY}
    SELECT symbol, timeframe, ts, open, high, low, close, volume FROM weekly
    UNION ALL SELECT symbol, timeframe, ts, open, high, low, close, volume FROM monthly""",
)
def fallback_union(spark, sf):
    """The second source answers with daily prices for weeks, and with months."""
    bars = daily(spark, sf)
    weekly, monthly = rollup(bars, "week", "1w"), rollup(bars, "month", "1mo")
    second = bars.withColumn("timeframe", F.lit("1w")).unionByName(monthly)
    return src.fallback_union(weekly, second)


# Six timeframes and a count, told by the order key.
CODES = ["5m", "60m", "1d", "1w", "1mo", "1q"]
CODE_SQL = "(['5m', '60m', '1d', '1w', '1mo', '1q'])[o_orderkey % 6 + 1]"


def requests(spark, sf):
    code = F.get(F.array(*[F.lit(c) for c in CODES]), (F.col("o_orderkey") % 6).cast("int"))
    return table(spark, sf, "orders").select(
        "o_orderkey", code.alias("timeframe"), F.to_date("o_orderdate").alias("end"),
        (F.col("o_custkey") * 9).alias("count"),
    )


query(
    "lookback_window",
    f"""SELECT o_orderkey, {CODE_SQL} AS timeframe, (o_orderdate::DATE - CASE {CODE_SQL}
      WHEN '1w' THEN 7 * least(o_custkey * 9, 6000) WHEN '1mo' THEN 30 * least(o_custkey * 9, 2000)
      WHEN '1q' THEN 90 * least(o_custkey * 9, 500) ELSE o_custkey * 9 END::INT)::DATE AS start FROM orders""",
    dates=("start",),
)(
    lambda spark, sf: requests(spark, sf).select(
        "o_orderkey", "timeframe",
        fn.lookback_window(F.col("timeframe"), F.col("end"), F.col("count")).alias("start"),
    )
)
query(
    "bar_budget",
    f"""SELECT o_orderkey, {CODE_SQL} AS timeframe, CASE {CODE_SQL} WHEN '5m' THEN o_custkey * 9 * 240 // 5
      WHEN '60m' THEN o_custkey * 9 * 240 // 60 WHEN '1d' THEN o_custkey * 9 WHEN '1w' THEN o_custkey * 9 // 7
      WHEN '1mo' THEN o_custkey * 9 // 30 ELSE o_custkey * 9 // 90 + 1 END AS bars FROM orders""",
)(
    lambda spark, sf: requests(spark, sf).select(
        "o_orderkey", "timeframe",
        fn.bar_budget(
            F.col("timeframe"), F.date_sub("end", F.col("count").cast("int")), F.col("end")
        ).alias("bars"),
    )
)


@query("append_trade_log", "SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_totalprice FROM orders")
def append_trade_log(spark, sf):
    path = new_path(spark, "trades")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    src.append_trade_log(rows, path)
    src.append_trade_log(rows, path)
    return spark.read.parquet(path).filter(F.col("logged_at").isNotNull()).drop("logged_at")


@query("read_lines", "SELECT p_partkey::VARCHAR || ' ' || p_name || ' 行情' AS line FROM part")
def read_lines(spark, sf):
    path = new_path(spark, "lines")
    text = F.concat(F.col("p_partkey").cast("string"), F.lit(" "), F.col("p_name"), F.lit(" 行情"))
    lines = table(spark, sf, "part").select(text.alias("line"))
    src.write_lines(lines, path)
    return src.read_lines(spark, path, "UTF-8")


@query("write_lines", "SELECT unnest(string_split(text, chr(10))) AS line FROM documents")
def write_lines(spark, sf):
    path = new_path(spark, "lines")
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    src.write_lines(lines, path)
    return src.read_lines(spark, path, "utf-8")


@query("write_rows", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer")
def write_rows(spark, sf):
    path = new_path(spark, "rows")
    src.write_rows(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return spark.read.option("header", True).csv(path)
