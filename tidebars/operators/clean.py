"""Filters, cleaning and scaling of bar tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.series import (
    BLOCK_ROWS,
    CHUNK,
    SERIES,
    epoch_micros,
    join_keys,
    require_columns,
    staged,
    with_carry,
    with_chunk,
    with_position,
    with_series_values,
)

OHLCV = ("open", "high", "low", "close", "volume")
# Bits after the point of the scale that digits are cut from, level by level, and the values that a last bracket may hold.
DIGIT_BITS = (8, 20, 32, 44)
RANKED_VALUES = 1 << 16


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    skipped = {*skip, *SERIES, "pos", "n"}
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skipped]


def to_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to double; what does not parse becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def end_date(end) -> str:
    """Date text of a date, a timestamp or text that starts with a date."""
    return str(end).strip().split(" ")[0]


def filter_from(df: DataFrame, start) -> DataFrame:
    return df.filter(F.col("ts") >= F.lit(str(start)).cast(df.schema["ts"].dataType)).drop("pos", "n")


def filter_until(df: DataFrame, end, count: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """The last ``count`` bars of each series up to ``end``."""
    limit = F.lit(end_date(end)).cast(df.schema["ts"].dataType)
    return tail_n(df.filter(F.col("ts") <= limit).drop("pos", "n"), count, keys)


def to_utc(df: DataFrame, zone: str | None = None, column: str = "ts") -> DataFrame:
    """Zone-free UTC timestamps.

    A zoned timestamp is an instant and only changes its spelling; a zone-free
    one is read in ``zone`` (UTC if none is named).
    """
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        if zone is None:
            return df
        return df.withColumn(column, F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col(column)))
    local = F.col(column).cast("timestamp_ntz")
    return df.withColumn(column, F.convert_timezone(F.current_timezone(), F.lit("UTC"), local))


def _interpolated(low: Column, high: Column, share: Column) -> Column:
    endless = F.when(F.abs(low) == math.inf, low).when(F.abs(high) == math.inf, high)
    return F.when((share == 0) | (low == high), low).otherwise(F.coalesce(endless, low + (high - low) * share))


def _digit(x: Column, level: int) -> Column:
    """The digits of a value down to a level: the same for close values, and never less for a greater one."""
    scale = F.signum(x) * F.least(F.log1p(F.abs(x)), F.lit(1e3))
    return F.floor(scale * float(1 << DIGIT_BITS[level]))


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], keys: Sequence[str] = SERIES) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per series, by radix selection.

    Columns are named ``<column>_q<i>``.  One aggregation counts the leading
    digits of all columns and series, and running sums of the counts say which
    digit holds each wanted rank.  The values with that digit are ranked, equal
    values as one; a digit that holds more than `RANKED_VALUES` is cut into the
    next digits first, in an aggregation over its own values.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_x")) for c in columns])
    values = df.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*").filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    column_keys = [*keys, "_column"]
    wanted = F.array(*[F.struct(F.lit(i).alias("_q"), F.lit(float(s)).alias("_share")) for i, s in enumerate(shares)])
    counts = values.groupBy(*column_keys, _digit(F.col("_x"), 0).alias("_digit")).agg(F.count(F.lit(1)).alias("_count"))
    cell = Window.partitionBy(*column_keys)
    placed = _with_below(counts, column_keys).withColumn("_n", F.sum("_count").over(cell))
    ranks = placed.select("*", F.explode(wanted).alias("_w")).select("*", "_w.*").withColumn("_rank", (F.col("_n") - 1) * F.col("_share"))
    ends = F.explode(F.array(F.floor("_rank"), F.ceil("_rank")))
    picked = _holding(ranks.withColumn("_at", ends)).select(*column_keys, "_q", "_rank", "_at", "_digit", "_below", "_count")
    brackets, level = staged(picked.distinct(), "brackets"), 0
    while level < len(DIGIT_BITS) - 1 and (brackets.agg(F.max("_count")).first()[0] or 0) > RANKED_VALUES:
        inner = _inside(values, brackets, column_keys, level).withColumn("_next", _digit(F.col("_x"), level + 1))
        finer = inner.groupBy(*column_keys, "_digit", "_base", "_next").agg(F.count(F.lit(1)).alias("_count"))
        finer = _with_below(finer, [*column_keys, "_digit", "_base"], "_next").withColumn("_below", F.col("_below") + F.col("_base"))
        asked = brackets.select(*column_keys, "_q", "_rank", "_at", "_digit")
        met = join_keys(finer, asked, [*column_keys, "_digit"])
        brackets = staged(_holding(met).select(*column_keys, "_q", "_rank", "_at", F.col("_next").alias("_digit"), "_below", "_count"), "brackets")
        level += 1
    inner = _inside(values, brackets, column_keys, level)
    # Equal values count as one row, so a value many rows share stays small.
    tied = inner.groupBy(*column_keys, "_digit", "_base", "_x").agg(F.count(F.lit(1)).alias("_count"))
    tied = _with_below(tied, [*column_keys, "_digit", "_base"], "_x").withColumn("_below", F.col("_below") + F.col("_base"))
    asked = brackets.select(*column_keys, "_q", "_rank", "_at", "_digit")
    found = _holding(join_keys(tied, asked, [*column_keys, "_digit"]))
    low, high = (F.max(F.when(F.col("_at") == end("_rank"), F.col("_x"))).alias(n) for n, end in (("_low", F.floor), ("_high", F.ceil)))
    both = found.groupBy(*column_keys, "_q").agg(low, high, F.first("_rank").alias("_rank"))
    value = both.withColumn("_value", _interpolated(F.col("_low"), F.col("_high"), F.col("_rank") - F.floor("_rank")))
    picks = [
        F.max(F.when((F.col("_column") == c) & (F.col("_q") == i), F.col("_value"))).alias(f"{c}_q{i}")
        for c in columns
        for i in range(len(shares))
    ]
    return value.groupBy(*keys).agg(*picks)


def _with_below(counts: DataFrame, keys: Sequence[str], order: str = "_digit") -> DataFrame:
    """Add the number of values before each digit (or value) of a cell; a cell has few rows."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_below", F.coalesce(F.sum("_count").over(before), F.lit(0)))


def _holding(ranks: DataFrame) -> DataFrame:
    """The rows that hold the rank asked for."""
    return ranks.filter((F.col("_below") <= F.col("_at")) & (F.col("_at") < F.col("_below") + F.col("_count")))


def _inside(values: DataFrame, brackets: DataFrame, column_keys: Sequence[str], level: int) -> DataFrame:
    """The values that have a bracket's digit, with the number of values before it (``_base``)."""
    open_ = brackets.select(*column_keys, "_digit", F.col("_below").alias("_base")).distinct()
    return join_keys(values.withColumn("_digit", _digit(F.col("_x"), level)), open_, [*column_keys, "_digit"])


def winsorize(
    df: DataFrame,
    columns: Sequence[str] = OHLCV,
    low: float = 0.01,
    high: float = 0.99,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Clip each column to its own quantiles within its series."""
    require_columns(df, columns)
    limits = join_keys(df, quantiles(df, columns, (low, high), keys), keys, "left")
    clipped = {
        c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"{c}_q0")), F.col(f"{c}_q1")))
        for c in columns
    }
    return limits.withColumns(clipped).select(*df.columns)


def finite(column: str) -> Column:
    c = F.col(column)
    return F.when(F.isnan(c) | (F.abs(c) == math.inf), None).otherwise(c)


def inf_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN and infinite values become null."""
    chosen = columns if columns is not None else numeric_columns(df)
    fractional = [c for c in chosen if isinstance(df.schema[c].dataType, T.FractionalType)]
    return df.withColumns({c: finite(c) for c in fractional}) if fractional else df


def _with_neighbours(
    df: DataFrame, columns: Sequence[str], sides: str, keys: Sequence[str], rows: int
) -> DataFrame:
    """Time and value of the nearest non-null cell of each column.

    Side ``b`` looks at or before the row, ``a`` at or after; the columns are
    ``_bt<i>, _bx<i>`` and ``_at<i>, _ax<i>`` for the i-th column.
    """
    picks = {"b": F.max_by, "a": F.min_by}
    times = {"b": F.max, "a": F.min}
    totals, folds, local = {}, {"b": {}, "a": {}}, {"b": {}, "a": {}}
    for side in sides:
        for i, c in enumerate(columns):
            seen = F.when(F.col(c).isNotNull(), F.col("ts"))
            value = F.col(c).cast("double")
            totals |= {f"_{side}t{i}": times[side](seen), f"_{side}x{i}": picks[side](value, seen)}
            local[side] |= {f"_{side}t{i}": seen, f"_{side}x{i}": value}
            for name in (f"_{side}t{i}", f"_{side}x{i}"):
                folds[side][name] = lambda x: F.last(x, ignorenulls=True)
    carried = with_carry(with_chunk(df, rows), totals, folds["b"], folds["a"], keys)
    window = Window.partitionBy(*keys, CHUNK)
    order = {"b": F.col("ts").asc(), "a": F.col("ts").desc()}
    suffix = {"b": "before", "a": "after"}
    for side in sides:
        upto = window.orderBy(order[side]).rowsBetween(Window.unboundedPreceding, 0)
        carried = carried.withColumns(
            {
                name: F.coalesce(F.last(x, ignorenulls=True).over(upto), F.col(f"{name}_{suffix[side]}"))
                for name, x in local[side].items()
            }
        )
    return carried


def interpolate_time(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = SERIES, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Fill gaps linearly in elapsed time; the ends take the nearest value."""
    if not columns:
        return df
    found = _with_neighbours(df, columns, "ba", keys, rows)

    def elapsed(a: Column, b: Column) -> Column:
        return epoch_micros(b) - epoch_micros(a)

    filled = {}
    for i, c in enumerate(columns):
        t0, x0, t1, x1 = (F.col(f"_{n}{i}") for n in ("bt", "bx", "at", "ax"))
        share = F.try_divide(elapsed(t0, F.col("ts")), elapsed(t0, t1))
        filled[c] = F.coalesce(F.col(c).cast("double"), x0 + (x1 - x0) * share, x0, x1)
    return found.withColumns(filled).select(*df.columns)


def ffill(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = SERIES, rows: int = BLOCK_ROWS) -> DataFrame:
    """Carry the last value forward."""
    found = _with_neighbours(df, columns, "b", keys, rows)
    return found.withColumns({c: F.col(f"_bx{i}") for i, c in enumerate(columns)}).select(*df.columns)


def bfill(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = SERIES, rows: int = BLOCK_ROWS) -> DataFrame:
    """Carry the next value backward."""
    found = _with_neighbours(df, columns, "a", keys, rows)
    return found.withColumns({c: F.col(f"_ax{i}") for i, c in enumerate(columns)}).select(*df.columns)


def handle_nan_inf(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    keys: Sequence[str] = SERIES,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """NaN and infinities out, then time interpolation of every numeric column.

    Interpolation already gives both ends the nearest value, so the forward and
    backward fill that follow it in a hand-written clean-up have nothing to do.
    The columns come out as doubles, whether they have gaps or not.
    """
    treated = list(columns or numeric_columns(df))
    return interpolate_time(inf_to_null(df, treated), treated, keys, rows)


def minmax_normalize(
    df: DataFrame, except_: Sequence[str] = OHLCV, keys: Sequence[str] = SERIES, rows: int = BLOCK_ROWS
) -> DataFrame:
    """``(x - min) / (max - min)`` within the series; a constant column is 0."""
    scaled = numeric_columns(df, except_)
    stats = {}
    for i, c in enumerate(scaled):
        stats[f"_min{i}"] = (F.min, F.min(c))
        stats[f"_max{i}"] = (F.max, F.max(c))
    known = with_series_values(df, stats, keys, rows)
    columns = {}
    for i, c in enumerate(scaled):
        low, high = F.col(f"_min{i}"), F.col(f"_max{i}")
        columns[c] = F.when(low == high, F.lit(0.0)).otherwise((F.col(c) - low) / (high - low))
    return known.withColumns(columns).select(*df.columns)


def tail_n(df: DataFrame, count: int, keys: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """The last ``count`` bars of each series.

    Chunks that lie before the last ``count`` rows go by the table of chunk
    sizes; what is left to rank of a series is ``count`` rows and a chunk.
    """
    kept = [c for c in df.columns if c not in ("pos", "n")]
    if "pos" in df.columns and "n" in df.columns:
        return df.filter(F.col("pos") >= F.col("n") - count).select(*kept)
    chunked = with_chunk(df, ts=ts)
    sizes = chunked.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_size"))
    later = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    wanted = sizes.withColumn("_later", F.coalesce(F.sum("_size").over(later), F.lit(0))).filter(F.col("_later") < count)
    near = join_keys(chunked, wanted.select(*keys, CHUNK), [*keys, CHUNK], "left_semi")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(ts).desc()))
    return near.withColumn("_rank", rank).filter(F.col("_rank") <= count).select(*kept)


def left_pad(df: DataFrame, count: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """Prepend null rows until each series has ``count``; ``pos`` replaces ``ts``."""
    numbered = with_position(df, keys)
    missing = F.greatest(F.lit(count) - F.col("n"), F.lit(0))
    rows = numbered.withColumn("pos", F.col("pos") + missing)
    short = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < count)
    pads = short.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), count - F.col("n") - 1)).alias("pos"))
    return rows.drop("ts", "n").unionByName(pads, allowMissingColumns=True)


def drop_empty_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows whose every cell is empty text."""
    cells = F.array(*[F.col(c).cast("string") for c in columns or df.columns])
    return df.filter(F.exists(cells, lambda cell: F.coalesce(cell != "", F.lit(False))))
