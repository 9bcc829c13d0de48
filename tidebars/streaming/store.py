"""Rows by key that are corrected later: batches as versions, the latest of a key wins when read.

Each batch is a folder of its own, which a repeated batch replaces.  Compaction
merges all batches up to one into a base folder; what a base holds is removed at
the next compaction, so that readers that began before it finish.  A store
of any age is a base or two and a bounded number of batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEEP_BATCHES = 8


class UpsertStore:
    """A table of one row per ``keys`` in a folder that all executors reach.

    ``order`` names a column that decides between rows of one batch and key:
    the greatest wins, null is the smallest; without it, or if equal, the greatest row.
    ``keep`` cuts the table when it is compacted, to the last bars of a series
    for instance.  Null keys are keys.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], order: str | None = None,
        keep: Callable[[DataFrame], DataFrame] | None = None, keep_batches: int = KEEP_BATCHES,
    ) -> None:
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        self.order, self.keep, self.keep_batches = order, keep, keep_batches
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folders(self, kind: str) -> list[int]:
        root = self._hadoop(self.path)
        if not self._fs.exists(root):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(root)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))

    def _remove(self, kind: str, number: int) -> None:
        self._fs.delete(self._hadoop(f"{self.path}/{kind}={number}"), True)

    def _live(self) -> tuple[int, list[int]]:
        """Number of the newest base (-1: none) and the batches after it."""
        base = max(self._folders("base"), default=-1)
        return base, [b for b in self._folders("batch") if b > base]

    def folders(self) -> int:
        return len(self._folders("base")) + len(self._folders("batch"))

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """Write a batch; one that a base already holds changes nothing, any other replaces its own rows."""
        base, batches = self._live()
        if batch <= base:
            return
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        if len({*batches, batch}) > self.keep_batches:
            self.compact()

    def read(self) -> DataFrame:
        """One row per key; an empty table if nothing was written."""
        base, batches = self._live()
        return self._merged(base, batches)

    def _merged(self, base: int, batches: list[int]) -> DataFrame:
        paths = [f"{self.path}/base={base}"] * (base >= 0) + [f"{self.path}/batch={b}" for b in batches]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(self.schema).parquet(*paths)
        version = F.regexp_extract("_metadata.file_path", r"/(?:base|batch)=(\d+)/[^/]*$", 1).cast("bigint")
        rest = [c for c in self.schema.names if c not in self.keys]
        rank = F.struct(version.alias("version"), *([F.col(self.order).alias("order")] if self.order else []), *rest)
        latest = found.groupBy(*self.keys).agg(F.max(rank).alias("_latest"))
        return latest.select(*[F.col("_latest")[c].alias(c) if c in rest else F.col(c) for c in self.schema.names])

    def compact(self) -> None:
        """Merge what is there into a new base, and remove what the base before it made superfluous.

        The new base appears under its name when it is complete: a compaction
        that fails leaves the store as it was.
        """
        base, batches = self._live()
        if not batches:
            return
        number, merged = batches[-1], self._merged(base, batches)
        begun = f"{self.path}/_base-{number}"
        (self.keep(merged).select(*self.schema.names) if self.keep else merged).write.mode("overwrite").parquet(begun)
        if not self._fs.rename(self._hadoop(begun), self._hadoop(f"{self.path}/base={number}")):
            raise OSError(f"{begun} could not be renamed")
        for old in self._folders("base"):
            if old < base:
                self._remove("base", old)
        for old in self._folders("batch"):
            if old <= base:
                self._remove("batch", old)
