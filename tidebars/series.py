"""Series cut into bounded blocks.

A *series* is all rows of one ``(symbol, timeframe)``.  One series may hold a
large share of a table, so no operator here ever gives a whole series to one
task.  Three building blocks do all the work:

``with_position``
    numbers the rows of each series 0, 1, 2 ... .  Rows are ranked inside time
    chunks; chunk sizes, one row per chunk, give each chunk its offset.

``in_blocks``
    cuts a series into blocks of about ``rows`` consecutive rows, each with
    the ``lookback`` rows before it.  A trailing window of at most
    ``lookback`` rows computed inside a block is then exact.  What remembers
    values rather than rows also gets the last values it needs, however many
    empty rows lie between.

``with_carry``
    joins to each chunk a value computed from the chunks before (or after) it,
    for running totals and gap filling, whose memory has no bound.

Chunk and block tables hold one row per ``BLOCK_ROWS`` input rows; only those
are ever ordered per series.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebars.timeframes import MINUTES

SERIES = ("symbol", "timeframe")
BLOCK_ROWS = 32_768

CHUNK, BLOCK, CORE = "_chunk", "_block", "_core"


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equal keys meet, and null meets null: no row is lost to a null symbol, timeframe or time."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zone-free timestamp, whatever the session zone."""
    days = F.unix_date(F.to_date(ts)).cast("bigint")
    return days * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session zone."""
    minutes = F.unix_date(F.to_date(ts)).cast("bigint") * 1_440 + F.hour(ts) * 60 + F.minute(ts)
    return minutes * 60_000_000 + (F.extract(F.lit("SECONDS"), ts) * 1_000_000).cast("bigint")


def with_chunk(df: DataFrame, rows: int = BLOCK_ROWS, ts: str = "ts") -> DataFrame:
    """Add the time chunk: the days that hold ``rows`` steps of the timeframe."""
    days = " ".join(f"WHEN '{code}' THEN {max(1, m * rows // 1440)}" for code, m in MINUTES.items())
    finest = max(1, rows // 1440)
    width = f"CASE timeframe {days} ELSE {finest} END" if "timeframe" in df.columns else str(finest)
    return df.withColumn(CHUNK, F.expr(f"cast(floor(unix_date(to_date({ts})) / {width}) AS int)"))


def with_position(
    df: DataFrame, keys: Sequence[str] = SERIES, ts: str = "ts", rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``pos`` (0-based row number by ``ts``) and ``n`` (rows of the series).

    Rows with a null key are a series of their own; rows without a time come
    first in theirs.  A table that has both keeps them.  Whoever drops rows drops the two columns.
    """
    if "pos" in df.columns and "n" in df.columns:
        return df
    chunked = with_chunk(df, rows, ts)
    chunk_keys = [*keys, CHUNK]
    series = Window.partitionBy(*keys)
    sizes = chunked.groupBy(*chunk_keys).agg(F.count(F.lit(1)).alias("_size"))
    earlier = series.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *chunk_keys, F.sum("_size").over(earlier).alias("_before"), F.sum("_size").over(series).alias("n")
    )
    rank = F.row_number().over(Window.partitionBy(*chunk_keys).orderBy(ts)).alias("_rank")
    ranked = join_keys(chunked.select("*", rank), offsets, chunk_keys)
    return ranked.select(*df.columns, F.expr("coalesce(_before, 0) + _rank - 1").alias("pos"), "n")


def from_end(df: DataFrame, keys: Sequence[str] = SERIES, rows: int = BLOCK_ROWS) -> DataFrame:
    """Replace ``pos`` by ``tail``, the number of rows after this one."""
    numbered = with_position(df, keys, rows=rows)
    return numbered.withColumn("tail", F.col("n") - 1 - F.col("pos")).drop("pos")


def position_columns(df: DataFrame) -> list[str]:
    return [c for c in ("pos", "n") if c in df.columns]


def _reach(table: DataFrame, memory: dict[str, int], keys: Sequence[str]) -> DataFrame:
    """The last chunk that needs rows of each chunk, one column a kind of value.

    ``table`` numbers the chunks of a series (``_own``) and counts the values of
    each kind in them.  A chunk needs one before it if the chunks between hold
    fewer than ``memory`` values.
    """
    series = Window.partitionBy(*keys)
    upto = series.orderBy("_own").rowsBetween(Window.unboundedPreceding, 0)
    summed = table.withColumns({f"_upto_{k}": F.sum(f"_count_{k}").over(upto) for k in memory})
    last = F.max("_own").over(series)
    far = {
        f"_far_{k}": F.least(F.max("_own").over(series.orderBy(f"_upto_{k}").rangeBetween(0, m - 1)) + 1, last)
        for k, m in memory.items()
    }
    return summed.withColumns(far).drop(*[f"_upto_{k}" for k in memory])


def in_blocks(
    df: DataFrame,
    lookback: int,
    keys: Sequence[str] = SERIES,
    rows: int = BLOCK_ROWS,
    values: dict[str, tuple[Column, int]] | None = None,
) -> DataFrame:
    """Copy each row into its own block and the ones that look back on it.

    Blocks of a numbered table are ``rows`` positions, those of any other its
    time chunks, which are numbered on the way.  ``values`` maps a kind of value
    to the condition that a row has it and to the number of them that a block
    has to see: rows with such a value are copied as far as the chunks after
    theirs hold too few.  How far is told by the table of chunk sizes, which
    counts the values too; nothing else is read for it.
    """
    numbered = "pos" in df.columns and "n" in df.columns
    has = {k: present for k, (present, _) in (values or {}).items()}
    memory = {k: m for k, (_, m) in (values or {}).items()}
    counts = [F.count(F.when(c, 1)).alias(f"_count_{k}") for k, c in has.items()]
    if numbered:
        own = F.expr(f"pos div {rows}")
        last = F.least(F.expr(f"(pos + {lookback}) div {rows}"), F.expr(f"(n - 1) div {rows}"))
        placed, after = df, F.least((own + 1) * rows, F.col("n")) - 1 - F.col("pos")
        if has:
            sizes = df.groupBy(*keys, own.alias("_own")).agg(F.count(F.lit(1)).alias("_size"), *counts)
            table = _reach(sizes, memory, keys)
            # A chunk whose rows all have values needs no more than the rows before it.
            sparse = [(F.col(f"_count_{k}") < F.col("_size")) | (F.col(f"_far_{k}") > F.col("_own") + 1) for k in has]
            sparse_only = table.filter(reduce(lambda a, b: a | b, sparse))
            placed = join_keys(df.withColumn("_own", own), sparse_only, [*keys, "_own"], "left")
    else:
        chunked = with_chunk(df, rows)
        series = Window.partitionBy(*keys)
        in_order = series.orderBy(CHUNK)
        sizes = chunked.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_size"), *counts)
        ordered = sizes.withColumns(
            {
                "_own": F.row_number().over(in_order).cast("bigint") - 1,
                "_end": F.sum("_size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)),
                "n": F.sum("_size").over(series),
                "_count_row": F.col("_size"),
            }
        )
        table = _reach(ordered, memory | ({"row": lookback} if lookback else {}), keys)
        rank = F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy("ts"))
        placed = join_keys(chunked.withColumn("_rank", rank), table, [*keys, CHUNK])
        placed = placed.withColumn("pos", F.col("_end") - F.col("_size") + F.col("_rank") - 1)
        own, after = F.col("_own"), F.col("_size") - F.col("_rank")
        last = F.when(after < lookback, F.col("_far_row")).otherwise(own) if lookback else own
    for k, present in has.items():
        # So many rows from the end hold the values asked for, whichever of them are empty.
        near = after < F.col("_size") - F.col(f"_count_{k}") + memory[k]
        last = F.greatest(last, F.when(present & near, F.col(f"_far_{k}")))
    spread = placed.withColumn(BLOCK, F.explode(F.sequence(own, last))).withColumn(CORE, F.col(BLOCK) == own)
    kept = list(dict.fromkeys([*df.columns, "pos", "n", BLOCK, CORE]))
    return spread.select(*kept).repartition(*keys, BLOCK).sortWithinPartitions(*keys, BLOCK, "pos")


def block_window(keys: Sequence[str] = SERIES):
    return Window.partitionBy(*keys, BLOCK).orderBy("pos")


def trailing(rows: int, keys: Sequence[str] = SERIES):
    """The current row and the ``rows - 1`` rows before it."""
    return block_window(keys).rowsBetween(-(rows - 1), 0)


def with_carry(
    df: DataFrame,
    totals: dict[str, Column],
    earlier: dict[str, Callable[[Column], Column]] | None = None,
    later: dict[str, Callable[[Column], Column]] | None = None,
    keys: Sequence[str] = SERIES,
    chunk: str = CHUNK,
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Join to each chunk what the chunks before (after) it add up to.

    ``totals`` are aggregates of one chunk.  ``earlier`` and ``later`` map one
    of them to the aggregate that folds it over all chunks before / after; the
    folded value is named ``<total>_before`` / ``<total>_after``.
    """
    per_chunk = df.groupBy(*keys, chunk).agg(*[agg.alias(name) for name, agg in totals.items()])
    series = Window.partitionBy(*keys)
    before = series.orderBy(F.col(chunk).asc()).rowsBetween(Window.unboundedPreceding, -1)
    after = series.orderBy(F.col(chunk).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"{k}_before": fold(F.col(k)).over(before) for k, fold in (earlier or {}).items()}
    carried |= {f"{k}_after": fold(F.col(k)).over(after) for k, fold in (later or {}).items()}
    table = per_chunk.withColumns(carried)
    if finish is not None:
        table = finish(table)
    return join_keys(df, table.drop(*totals), [*keys, chunk])


def with_series_values(
    df: DataFrame,
    values: dict[str, tuple[Callable, Column]],
    keys: Sequence[str] = SERIES,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add whole-series aggregates to every row: ``{name: (merge, partial)}``.

    ``partial`` is taken per chunk and ``merge`` (``F.min``, ``F.max``,
    ``F.sum``) over the chunks, so the join back is on (series, chunk) and no
    key of it is large.
    """
    chunked = with_chunk(df, rows)
    series = Window.partitionBy(*keys)
    per_chunk = chunked.groupBy(*keys, CHUNK).agg(*[p.alias(k) for k, (_, p) in values.items()])
    merged = per_chunk.withColumns({k: m(F.col(k)).over(series) for k, (m, _) in values.items()})
    return join_keys(chunked, merged, [*keys, CHUNK]).drop(CHUNK)


def attach(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str] = SERIES,
    rows: int = BLOCK_ROWS,
    chunk: Column | None = None,
) -> DataFrame:
    """Left-join a table of one row per key, spread over the chunks of the key.

    The small table is first joined to the list of chunks, so the join to the
    rows has no key with more rows than one chunk holds.
    """
    chunked = with_chunk(df, rows) if chunk is None else df.withColumn(CHUNK, chunk)
    chunks = chunked.select(*keys, CHUNK).distinct()
    return join_keys(chunked, join_keys(chunks, table, keys, "left"), [*keys, CHUNK]).drop(CHUNK)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: as the session names it, else one in its warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/") if folder else os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_staged")


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


_STAGED: dict[str, list[str]] = {}


def staged_paths(spark: SparkSession) -> list[str]:
    """The folders that this application has written by `staged` and not dropped, in order."""
    return _STAGED.setdefault(spark.sparkContext.applicationId, [])


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a plan reads its input several times (carries, whole-series
    aggregates): the input is computed once and later reads prune columns.
    The folder stays until `drop_staged`.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    staged_paths(df.sparkSession).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, paths: Sequence[str] | None = None) -> None:
    """Remove staged folders, all of them by default: for callers who have written what they wanted of a plan."""
    known = staged_paths(spark)
    for path in list(known if paths is None else paths):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        if path in known:
            known.remove(path)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail, before any job runs, when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df
