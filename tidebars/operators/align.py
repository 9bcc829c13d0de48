"""Resampling and alignment of timeframes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.series import SERIES, epoch_seconds, from_end, join_keys
from tidebars.timeframes import MINUTES, canonical, canonical_column, known_column, minutes_of

BARS = ("open", "high", "low", "close", "volume")
SLOTS_PER_CHUNK = 32_768


def _slot(ts: Column, seconds: int | Column) -> Column:
    """Left edge of the time slot, counted from midnight; a day at most."""
    day = F.to_date(ts).cast("timestamp_ntz")
    in_day = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    if not isinstance(seconds, Column):
        seconds = min(seconds, 86_400)
    return day + F.make_dt_interval(secs=(in_day - in_day % seconds).cast("decimal(18,6)"))


def _last_value(column: str, ts: str = "ts") -> Column:
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(ts)))


def resample_last(
    df: DataFrame, step: str, columns: Sequence[str] = BARS, grid: bool = False, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Last non-null value per column in each ``step`` slot, stamped at its start.

    With ``grid`` every slot between a series' first and last gets a row.
    """
    seconds = MINUTES[canonical(step)] * 60
    slotted = df.withColumn("_slot", _slot(F.col("ts"), seconds))
    found = (
        slotted.groupBy(*keys, "_slot").agg(*[_last_value(c).alias(c) for c in columns])
        .withColumnRenamed("_slot", "ts")
    )
    if not grid:
        return found.select(*keys, "ts", *columns)
    # The grid is laid out by pieces, so a long series is never one array.
    span = SLOTS_PER_CHUNK * seconds
    ends = slotted.groupBy(*keys).agg(F.min("_slot").alias("_first"), F.max("_slot").alias("_last"))
    first, last = epoch_seconds(F.col("_first")), epoch_seconds(F.col("_last"))
    pieces = ends.select(
        *keys, first.alias("_from"), last.alias("_to"),
        F.explode(F.sequence(F.floor(first / span), F.floor(last / span))).alias("_piece"),
    ).repartition(*keys, "_piece")
    begin = F.greatest(
        F.col("_from"), F.col("_from") + F.ceil((F.col("_piece") * span - F.col("_from")) / seconds) * seconds
    )
    end = F.least(F.col("_to"), (F.col("_piece") + 1) * span - 1)
    seconds_column = F.explode(F.sequence(begin, end, F.lit(seconds).cast("bigint")))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    slots = pieces.filter(begin <= end).select(*keys, seconds_column.alias("_at")).select(
        *keys, (epoch + F.make_dt_interval(secs=F.col("_at").cast("decimal(18,6)"))).alias("ts")
    )
    return slots.join(found, [*keys, "ts"], "left").select(*keys, "ts", *columns)


def _reaching(df: DataFrame, reach: int, span: int, at: str = "_at") -> DataFrame:
    """Copy rows into each time piece of ``span`` seconds that looks back on them."""
    own = F.floor(F.col(at) / span)
    piece = F.explode(F.sequence(own, F.floor((F.col(at) + reach) / span)))
    return df.withColumn("_piece", piece).withColumn("_core", F.col("_piece") == own)


def ffill_limit(
    df: DataFrame, limit: int, step: str, columns: Sequence[str] = BARS, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Carry values at most ``limit`` slots of ``step`` forward (0: not at all)."""
    if limit <= 0:
        return df
    seconds = MINUTES[canonical(step)] * 60
    reach = limit * seconds
    laid = _reaching(df.withColumn("_at", epoch_seconds(F.col("ts"))), reach, max(SLOTS_PER_CHUNK * seconds, 8 * reach))
    window = Window.partitionBy(*keys, "_piece").orderBy("_at").rangeBetween(-reach, 0)
    filled = laid.withColumns({c: F.last(c, ignorenulls=True).over(window) for c in columns})
    return filled.filter("_core").select(*df.columns)


def reindex_like(
    df: DataFrame, base: DataFrame, columns: Sequence[str] = BARS, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """The rows of ``df`` at exactly the time stamps of ``base``, null where it has none."""
    return base.select(*keys, "ts").join(df.select(*keys, "ts", *columns), [*keys, "ts"], "left")


def base_timeframe(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The shortest timeframe present, per symbol."""
    return df.groupBy(*keys).agg(F.min_by("timeframe", minutes_of(F.col("timeframe"))).alias("base_timeframe"))


def align_timeframes(
    df: DataFrame, base: str | None = None, columns: Sequence[str] = BARS, mode: str = "same_bar"
) -> DataFrame:
    """Every timeframe on the time stamps of the base timeframe.

    The base is each symbol's own shortest timeframe, or the one named for all
    symbols, of which those without it have no rows.  Other spellings of a code
    count as that code; an unknown one is an error.  A bounded as-of join.  ``same_bar`` gives a base bar the last values of a
    longer bar that began within that bar's length, also when the longer bar is
    still running, and nothing after the series' last slot.  ``closed`` uses
    finished bars only: a bar counts from its start plus its length on.
    """
    if mode not in ("same_bar", "closed"):
        raise ValueError("mode is 'same_bar' or 'closed'")
    if base is not None and MINUTES[canonical(base)] > MINUTES["1d"]:
        raise ValueError("the base timeframe is a day or shorter")
    df = df.withColumn("timeframe", known_column(F.col("timeframe")))
    # One row per symbol: its base, and how far each of its timeframes reaches.
    ends = df.groupBy("symbol", "timeframe").agg(F.max("ts").alias("last")).withColumn("minutes", minutes_of(F.col("timeframe")))
    own_base = F.min_by("timeframe", "minutes") if base is None else F.first(F.lit(canonical(base)))
    facts = ends.groupBy("symbol").agg(own_base.alias("_base"), F.collect_list(F.struct("timeframe", "minutes", "last")).alias("_held"))
    base_minutes = minutes_of(F.col("_base"))
    # Slots are a day at most, also for a symbol that has longer bars only.
    known = join_keys(df, facts, ["symbol"]).withColumn("_base_minutes", base_minutes)
    known = known.withColumn("_step", F.least("_base_minutes", F.lit(MINUTES["1d"])) * 60)
    step, minutes = F.col("_step"), minutes_of(F.col("timeframe"))

    def tagged(kind: str, timeframe: Column, length: Column, at: Column, end: Column) -> Column:
        """A row of one timeframe's line: a bar, in each piece that looks back on it, or a base row that wants a value."""
        reach = length * 60 - step
        span = F.greatest(F.lit(SLOTS_PER_CHUNK) * step, reach * 8)
        own = F.coalesce(F.floor(at / span), F.lit(0))
        last = F.coalesce(F.floor((at + reach) / span), F.lit(0)) if kind == "bar" else own
        return F.struct(
            F.lit(kind).alias("kind"), timeframe.alias("timeframe"), reach.cast("bigint").alias("reach"), at.alias("at"), end.alias("end"), F.sequence(own, last).alias("pieces")
        )

    def shifted(slot: Column, length: Column) -> Column:
        return epoch_seconds(slot) + (length * 60 if mode == "closed" else F.lit(0))

    here, slot = epoch_seconds(F.col("ts")), _slot(F.col("ts"), step)
    none = F.lit(None).cast("bigint")
    longer = F.filter("_held", lambda h: h["minutes"] > F.col("_base_minutes"))
    # A base row is wanted once per longer timeframe its symbol has, and stands for itself.
    wanted = F.transform(longer, lambda h: tagged("base", h["timeframe"], h["minutes"], here, shifted(_slot(h["last"], step), h["minutes"])))
    itself = F.array(tagged("self", F.col("timeframe"), minutes, here, none))
    bar = F.array(tagged("bar", F.col("timeframe"), minutes, shifted(slot, minutes), none))
    roles = F.when(F.col("timeframe") == F.col("_base"), F.concat(itself, wanted)).when(minutes > F.col("_base_minutes"), bar)
    rows = known.select("symbol", "ts", (F.col("ts") == slot).alias("_on_grid"), *columns, F.explode(roles).alias("_r"))
    laid = rows.select("symbol", "ts", "_on_grid", *columns, "_r.*").withColumn("_piece", F.explode("pieces")).drop("pieces")
    # Each bar is looked back on for its own length, told by how far it reaches.
    window = Window.partitionBy("symbol", "timeframe", "_piece").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    # Ties at one slot go to the later bar, as the last of the slot.
    fresh = {f"_{c}": F.max(F.when((F.col("kind") == "bar") & F.col(c).isNotNull(), F.struct("at", "ts", F.col(c).alias("x")))).over(window) for c in columns}
    found = laid.withColumns(fresh).filter(F.col("kind") != "bar")
    alive = F.lit(True) if mode == "closed" else F.coalesce((F.col("at") <= F.col("end")) & F.col("_on_grid"), F.lit(False))
    picked = {
        c: F.when(F.col("kind") == "self", F.col(c)).when(alive & (F.col("at") - F.col(f"_{c}")["at"] <= F.col("reach")), F.col(f"_{c}")["x"])
        for c in columns
    }
    return found.select("symbol", "timeframe", "ts", *[x.alias(c) for c, x in picked.items()])


def quarterly_from_monthly(df: DataFrame, columns: Sequence[str] = BARS) -> DataFrame:
    """Quarter bars holding the last non-null value of each column among the month bars."""
    start = F.trunc(F.to_date("ts"), "quarter")
    monthly = df.filter(canonical_column(F.col("timeframe")) == "1mo")
    return (
        monthly.groupBy("symbol", start.alias("_quarter"))
        .agg(*[_last_value(c).alias(c) for c in columns])
        .select(
            "symbol", F.lit("1q").alias("timeframe"),
            F.last_day(F.add_months("_quarter", 2)).cast("timestamp_ntz").alias("ts"), *columns,
        )
    )


def tail_align(a: DataFrame, b: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Pair two tables row by row from the end, to the shorter of the two.

    ``tail`` counts rows from the end, 0 being the last.  Columns of ``b`` that
    ``a`` has too are left out.  ``pos`` and ``n`` number the pairs.
    """
    extra = [c for c in b.columns if c not in a.columns and c not in ("pos", "n")]
    left = from_end(a, keys).withColumnRenamed("n", "_n")
    right = from_end(b, keys).select(*keys, "tail", "n", *extra)
    paired = left.join(right, [*keys, "tail"]).withColumn("n", F.least("n", "_n")).drop("_n")
    return paired.withColumn("pos", F.col("n") - 1 - F.col("tail"))
