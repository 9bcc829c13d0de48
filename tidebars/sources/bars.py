"""Bar files, holiday files, landed payloads, trade logs and text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.series import CHUNK, SERIES, join_keys, with_chunk
from tidebars.timeframes import INTRADAY_MINUTES, canonical_column

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("timeframe", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
    ]
)
# File name of one series: symbol, timeframe, first and last date.
FILE_NAME = r"^(.+)_(\d+[a-zA-Z]+)_(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})\.csv$"
PERIOD_UNITS = {"1d": "day", "1w": "week", "1mo": "month"}
DEFAULT_ENCODING = "gb2312"


def _ts(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def dedupe_bars(df: DataFrame) -> DataFrame:
    """One bar per (symbol, timeframe, ts): the greatest record wins a tie."""
    values = ["open", "high", "low", "close", "volume"]
    best = F.max(F.struct(*values)).alias("_b")
    return df.groupBy("symbol", "timeframe", "ts").agg(best).select("symbol", "timeframe", "ts", "_b.*")


def read_raw_bars(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the bar CSV files under a path or glob, as text.

    ``file, symbol, timeframe, ts_text, ts, open, high, low, close, volume,
    is_header, cells``: symbol and timeframe come from the file name and are
    null for a file that isn't named like one; ``ts`` is null where the time does
    not parse; ``cells`` counts the line's cells that are there.  Two layouts
    occur: an index column, ``day``, open, high, low, close, volume; or the time
    as index column, open, close, high, low, volume.  A time in the second
    column tells them apart, and so does the header.
    """
    names = [f"c{i}" for i in range(7)]
    raw = T.StructType([T.StructField(c, T.StringType()) for c in names])
    lines = spark.read.schema(raw).csv(path).select("*", F.col("_metadata.file_name").alias("file"))
    named = lambda group: F.nullif(F.regexp_extract("file", FILE_NAME, group), F.lit(""))
    is_header = F.coalesce(F.col("c1").isin("day", "open"), F.lit(False))
    # A bad time keeps its column: a line of seven cells has its day second.
    with_day = _ts(F.col("c1")).isNotNull() | (_ts(F.col("c0")).isNull() & F.col("c6").isNotNull()) | (F.col("c1") == "day")
    with_day = F.coalesce(with_day, F.lit(False))

    def pick(first: str, second: str) -> Column:
        return F.when(with_day, F.col(first)).otherwise(F.col(second))

    text = pick("c1", "c0")
    return lines.select(
        "file", named(1).alias("symbol"), canonical_column(named(2)).alias("timeframe"), text.alias("ts_text"), _ts(text).alias("ts"),
        pick("c2", "c1").alias("open"), pick("c3", "c3").alias("high"), pick("c4", "c4").alias("low"),
        pick("c5", "c2").alias("close"), pick("c6", "c5").alias("volume"),
        is_header.alias("is_header"), sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0)).alias("cells"),
    )


def raw_bars(lines: DataFrame) -> DataFrame:
    """The bars of `read_raw_bars`, cells still text: lines of bar files with a time, without the header."""
    kept = lines.filter(F.col("symbol").isNotNull() & ~F.col("is_header") & F.col("ts").isNotNull())
    return kept.select("symbol", "timeframe", "ts", "open", "high", "low", "close", "volume")


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """All bar CSV files under a path or glob, one row per bar, cells as numbers.

    What can't be a bar is left out, of equal times the greatest record is kept
    and bad cells are null; `operators.integrity.check_files` over
    `read_raw_bars` reports all of these.
    """
    bars = raw_bars(read_raw_bars(spark, path))
    values = {c: F.col(c).try_cast("double") for c in ("open", "high", "low", "close", "volume")}
    return dedupe_bars(bars.withColumns(values))


def write_bars(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Store bars by symbol and timeframe, the files of a series sorted by time."""
    ordered = df.sortWithinPartitions("symbol", "timeframe", "ts")
    writer = ordered.write.mode(mode).partitionBy("symbol", "timeframe")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def read_stored_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bars as ``write_bars`` stores them."""
    reader = spark.read.schema(BAR_SCHEMA)
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path).select(BAR_SCHEMA.names)


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    """Distinct dates of a holiday file with one column ``date``."""
    rows = spark.read.option("header", True).schema("date string").csv(path)
    return rows.select(F.col("date").try_cast("date").alias("date")).filter("date is not null").distinct()


def _bars_of(df: DataFrame, ts: Column, fields: dict[str, Column]) -> DataFrame:
    numbers = [fields[c].try_cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")]
    return df.select("symbol", "timeframe", ts.alias("ts"), *numbers)


def kline_from_json(df: DataFrame, provider: str, payload: str = "payload") -> DataFrame:
    """Bars of landed JSON answers (``symbol, timeframe, payload``).

    ``objects``: an array of ``{day, open, high, low, close, volume}``.
    ``arrays``: under ``data[symbol]``, rows of time, open, close, high, low,
    volume; the adjusted list (``qfq`` and the unit) if there is one.  In a
    minute answer the last close is the one of the quote, its fourth field.
    """
    if provider == "objects":
        fields = ["day", "open", "high", "low", "close", "volume"]
        schema = f"array<struct<{', '.join(f'{f}: string' for f in fields)}>>"
        rows = df.select("symbol", "timeframe", F.explode(F.from_json(payload, schema)).alias("b"))
        return _bars_of(rows, _ts(F.col("b.day")), {f: F.col(f"b.{f}") for f in fields})
    if provider != "arrays":
        raise ValueError("provider is 'objects' or 'arrays'")
    tf = F.col("timeframe")
    units = [F.when(tf == code, F.lit(unit)) for code, unit in PERIOD_UNITS.items()]
    units += [F.when(tf == code, F.lit(f"m{m}")) for code, m in INTRADAY_MINUTES.items()]
    parsed = df.select(
        "symbol", "timeframe", F.coalesce(*units).alias("_unit"),
        F.from_json(payload, "struct<data: map<string, map<string, string>>>")["data"].alias("_data"),
    ).withColumn("_parts", F.try_element_at("_data", F.col("symbol")))
    minute = tf.isin(*INTRADAY_MINUTES)
    adjusted = F.when(~minute, F.try_element_at("_parts", F.concat(F.lit("qfq"), F.col("_unit"))))
    listed = F.coalesce(adjusted, F.try_element_at("_parts", F.col("_unit")))
    quotes = F.from_json(F.try_element_at("_parts", F.lit("qt")), "map<string, array<string>>")
    rows = parsed.select(
        "symbol", "timeframe",
        F.from_json(listed, "array<array<string>>").alias("_rows"),
        F.get(F.try_element_at(quotes, F.col("symbol")), F.lit(3)).alias("_quote"),
    )
    bars = rows.select("symbol", "timeframe", "_quote", F.size("_rows").alias("_n"), F.posexplode("_rows").alias("_i", "b"))
    last = (F.col("_i") == F.col("_n") - 1) & minute & F.col("_quote").isNotNull()
    order = {"open": 1, "close": 2, "high": 3, "low": 4, "volume": 5}
    values = {name: F.get("b", F.lit(i)) for name, i in order.items()}
    values["close"] = F.when(last, F.col("_quote")).otherwise(values["close"])
    text = F.get("b", F.lit(0))
    compact = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:00")
    return _bars_of(bars, _ts(compact), values)


def fallback_union(primary: DataFrame, secondary: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Rows of ``secondary`` only for keys ``primary`` has nothing for.

    The anti join meets one row per key and time chunk, so a key with many rows
    in ``secondary`` is not sent to one task.
    """
    chunked = with_chunk(secondary)
    answered = primary.select(*keys).distinct()
    wanted = join_keys(chunked.select(*keys, CHUNK).distinct(), answered, keys, "left_anti")
    rest = join_keys(chunked, wanted, [*keys, CHUNK], "left_semi").drop(CHUNK)
    return primary.unionByName(rest)


def append_trade_log(df: DataFrame, path: str) -> None:
    """Append trade rows with the time of writing."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def read_lines(spark: SparkSession, path: str, encoding: str = DEFAULT_ENCODING) -> DataFrame:
    """Text lines in any encoding whose line feed is the byte 0x0A."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    if encoding.lower().replace("-", "") == "utf8":
        return lines
    # Spark decodes encodings outside its short list only under this setting.
    name = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        return lines.select(F.decode(F.col("line").cast("binary"), encoding).alias("line"))
    finally:
        spark.conf.set(name, before)


def write_lines(df: DataFrame, path: str, column: str = "line", mode: str = "overwrite") -> None:
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def write_rows(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)
