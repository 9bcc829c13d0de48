"""Labelled rows to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on, about; a table with fewer is used whole.
SAMPLE_ROWS = 10_000


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from learning: CRC-32 of its key as text, modulo 5, is 0.  A null key isn't."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``(key, text, y)`` of about ``rows`` labelled rows that aren't held out, picked by a hash of the key.

    The label table is cut to that size first, so what is broadcast to the
    texts is bounded and no text is shuffled.  Rows without key or label are
    not used; a key labelled twice gives two rows.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).select(key, F.col(label).cast("int").alias("y"))
    n = usable.count()
    share = min(1.0, rows / max(n, 1))
    picked = usable.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select(key, text).join(F.broadcast(picked), key)
