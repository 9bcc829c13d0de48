"""Whole rows through tasks and joins as one struct, so that no column name can clash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "row"


def packed(columns: Sequence[str]) -> Column:
    """The columns as one struct, named `ROW`; without any, a struct of one null."""
    return F.struct(*([F.col(c) for c in columns] or [F.lit(None).cast("int").alias("none")])).alias(ROW)


def with_row(df: DataFrame, fields: str) -> T.StructType:
    """Schema of a task's result: the packed row of ``df``, then the fields of a DDL string."""
    return T.StructType([df.schema[ROW], *T.StructType.fromDDL(fields).fields])


def unpacked(df: DataFrame, columns: Sequence[str], *more: Column | str) -> DataFrame:
    return df.select(*[F.col(ROW)[c].alias(c) for c in columns], *more)
