"""Operators on lines of text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.series import BLOCK_ROWS, CHUNK, with_carry


def lines_of(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line: the key, the line's 0-based ``pos``, ``line``."""
    return df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def _stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def stitch_records(
    df: DataFrame, start: str, end: str, keys: Sequence[str] = ("doc_id",), sep: str = "", rows: int = BLOCK_ROWS
) -> DataFrame:
    """Join the lines from a start marker to the next end marker into a record.

    A line is in a record when, since the last line with an end marker, a line
    with a start marker came up, and an end marker still follows.  Both are
    running values over blocks of lines; only lines of records are collected.
    ``pos`` of a record is the position of its end line.
    """
    marked = df.withColumns(
        {
            CHUNK: F.expr(f"pos div {rows}"),
            "_start": F.startswith(_stripped(F.col("line")), F.lit(start)),
            "_end": F.endswith(_stripped(F.col("line")), F.lit(end)),
        }
    )
    ends = F.col("_end").cast("bigint")
    started = F.when(F.col("_start"), F.col("pos"))
    ended = F.when(F.col("_end"), F.col("pos"))
    carried = with_carry(
        marked,
        {"_ends": F.sum(ends), "_started": F.max(started), "_ended": F.max(ended)},
        earlier={"_ends": F.sum, "_started": F.max, "_ended": F.max},
        keys=keys,
        finish=lambda t: t.withColumn("_total", F.sum("_ends").over(Window.partitionBy(*keys))),
    )
    local = Window.partitionBy(*keys, CHUNK).orderBy("pos")
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    state = carried.withColumns(
        {
            "_record": F.coalesce(F.col("_ends_before"), F.lit(0)) + F.coalesce(F.sum(ends).over(before), F.lit(0)),
            "_opened": F.coalesce(F.max(started).over(upto), F.col("_started_before")),
            "_closed": F.coalesce(F.max(ended).over(before), F.col("_ended_before"), F.lit(-1)),
        }
    )
    inside = state.filter((F.col("_opened") > F.col("_closed")) & (F.col("_record") < F.col("_total")))
    parts = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return (
        inside.groupBy(*keys, "_record")
        .agg(parts.alias("_parts"))
        .select(
            *keys,
            F.element_at("_parts", -1)["pos"].alias("pos"),
            F.array_join(F.transform("_parts", lambda p: p["line"]), sep).alias("record"),
        )
    )
