"""Connected components of a graph of any size."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebars.llm import words as W
from tidebars.llm.staging import staged

#: Edges of a block, of which a task keeps what connects it.
BLOCK_EDGES = 1 << 20


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def trees(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the edges ``(a, b)``, ascending; of each the place of the smallest end it is connected with; places of the edges of a forest."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root, left, taken = np.arange(len(names)), np.arange(len(a)), []
    while True:
        left = left[root[x[left]] != root[y[left]]]
        if not len(left):
            return names, root, np.sort(np.concatenate([np.zeros(0, np.int64), *taken]))
        low, high = np.minimum(root[x[left]], root[y[left]]), np.maximum(root[x[left]], root[y[left]])
        hung, at = np.unique(high, return_index=True)  # each tree that has a smaller neighbour hangs on one
        taken.append(left[at])
        root[hung] = low[at]
        while (root[root] != root).any():
            root = root[root]


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of links ``(a, b)`` that connect what all of them connect, fewer than there are ends: none closes a circle."""
    return trees(a, b)[2]


def thinned(edges: DataFrame, blocks: int) -> DataFrame:
    """``(a, b)`` that connect what ``edges`` do: of each block every node with the smallest that it is connected with there."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def stars(block: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        names, root, _ = trees(*(np.concatenate(x) for x in zip(*block, strict=True)))
        return W.record_batch(schema, [names, names[root]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n = [], 0
        for batch in batches:
            a, b = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            if pa.types.is_list(a.type):
                a, b = a.flatten(), np.repeat(b, np.diff(a.offsets.to_numpy()))
            block.append((a.to_numpy(zero_copy_only=False), b))
            n += len(b)
            if n >= BLOCK_EDGES:
                yield stars(block)
                block, n = [], 0
        if block:
            yield stars(block)

    return edges.select("a", "b").coalesce(blocks).mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``: the smallest node that can be reached.

    ``a`` may also be an array of nodes, all linked to ``b``.
    Tasks first turn blocks of at most about `BLOCK_EDGES` edges into stars; a
    larger graph has more blocks, not larger ones.  One block leaves nothing to do.  Else
    each round hangs every node's larger neighbours on the smallest node it
    sees, then every node's smaller neighbours, which about halves the depth of
    the trees; rounds go on until each tree is a star: no node with a smaller
    neighbour has another one.  That shows in the neighbours counted for the next
    round, so it costs no round of its own.
    The smallest neighbour is a partial aggregate, so a node with very many
    neighbours costs no task more than its share; it is staged, so the join that
    follows is one of two plain exchanges, which Spark splits when a key is large.  All joins
    are merges at every size: tables of many short rounds would pile up in the driver as broadcasts.  Null ends and loops link nothing; an
    empty table gives an empty one.  Only the number of edges and whether there is such a node reach
    the driver.
    """
    if isinstance(edges.schema["a"].dataType, T.ArrayType):
        now, size = staged(edges, "edges"), F.sum(F.size("a"))
    else:
        now, size = staged(edges.where("a is not null and b is not null and a <> b"), "edges"), F.count(F.lit(1))
    blocks = math.ceil((now.agg(size).first()[0] or 1) / BLOCK_EDGES)
    now = staged(thinned(now, blocks), "components")
    if blocks == 1:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    now = staged(now.where("a <> b").distinct(), "components")
    while True:
        sym = _both_ways(now)
        near = sym.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most"))
        low = staged(near.select("a", F.least("a", "m").alias("m"), (F.col("m") < F.least("a", "most")).alias("open")), "components")
        if low.where("open").isEmpty():
            return low.select(F.col("a").alias("node"), F.col("m").alias("component"))
        large = sym.join(low.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low.hint("merge"), "a")
        small = hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        now = staged(small, "components")
