"""Hard-negative mining: candidates by one-bit codes with exact error intervals, survivors scored in integers.

A vector of integers is rotated (signs and a Walsh-Hadamard transform, fixed by
`SEED`) and each coordinate leaves one bit, its sign.  The code vector is the
sign pattern over the root of the size; the stored *alignment* is the vector's
inner product with it.  What the code leaves over is rotated and coded again,
`LEVELS` times in all, and the norm of the last remainder is stored.

An anchor is rotated the same way and rounded to `QUERY_BITS` bits a coordinate,
so its inner product with a code is a few popcounts.  The score of a row is then
known up to two bounded errors, of the rounding (its absolute sum) and of the
remainder (Cauchy-Schwarz).  Both bounds always hold, so each score lies in its interval.  A row
whose interval can't reach a result is dropped; every other one is scored by its
integers.  The result is that of scoring all pairs.

Rows are coded once into blocks of `BLOCK_BYTES`; anchors come in groups of about
`ANCHOR_ROWS`.  Every block meets every group once, in numbered cells of a few blocks
and a few groups each, and keeps its few best rows for each anchor, which a ranking per anchor
merges.  Neither anchors nor rows pass through the driver or are broadcast, and a task holds the blocks
and groups of one cell at a time, each once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.llm import words as W
from tidebars.llm.staging import staged

SEED = 20_240_607
LEVELS, QUERY_BITS = 4, 6
BLOCK_BYTES, ANCHOR_ROWS, BLOCKS_PER_CELL = 2 << 20, 1024, 4
#: Groups of anchors of a cell at most; cells there are to be, if groups and blocks suffice, before a cell holds more than one group.
GROUPS_PER_CELL, LEAST_CELLS = 16, 64
PAIRS_AT_ONCE = 1 << 18
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95

U = np.uint64


class Codes(NamedTuple):
    """Per row: bits ``[rows, levels, words]``, alignments ``[rows, levels]``, norm of the remainder, norm of the vector."""

    bits: np.ndarray
    align: np.ndarray
    rest: np.ndarray
    norm: np.ndarray


class Query(NamedTuple):
    """Per anchor: bit planes ``[anchors, levels, bits, words]``, sums of the rounded coordinates, size of a step, rounding error, norm."""

    planes: np.ndarray
    sums: np.ndarray
    step: np.ndarray
    error: np.ndarray
    norm: np.ndarray


def size_of(dim: int) -> int:
    """Coordinates after padding: a power of two."""
    return 1 << max(dim - 1, 0).bit_length()


def rotated(x: np.ndarray, level: int) -> np.ndarray:
    """An orthogonal map of the rows, the same everywhere."""
    size = x.shape[1]
    signs = np.random.default_rng([SEED, level, size]).integers(0, 2, size) * 2.0 - 1
    x, half = x * signs, 1
    while half < size:
        pairs = x.reshape(len(x), -1, 2, half)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(x), size)
        half *= 2
    return x / math.sqrt(size)


def bit_words(flags: np.ndarray) -> np.ndarray:
    """Flags of the last axis as 64-bit words."""
    data = np.packbits(flags, axis=-1, bitorder="little")
    room = [(0, 0)] * (flags.ndim - 1) + [(0, -data.shape[-1] % 8)]
    return np.ascontiguousarray(np.pad(data, room)).view(U)


def padded(vectors: np.ndarray) -> np.ndarray:
    rows, dim = vectors.shape
    return np.pad(vectors.astype(np.float64), ((0, 0), (0, size_of(dim) - dim)))


def encode(vectors: np.ndarray, levels: int = LEVELS) -> Codes:
    x = padded(vectors)
    root, bits, align = math.sqrt(x.shape[1]), [], []
    norm = np.sqrt((x * x).sum(1))
    for level in range(levels):
        x = rotated(x, level)
        positive = x >= 0
        bits.append(bit_words(positive))
        align.append(np.abs(x).sum(1) / root)
        x = x - np.where(positive, 1.0, -1.0) * (align[-1] / root)[:, None]
    return Codes(np.stack(bits, 1), np.stack(align, 1), np.sqrt((x * x).sum(1)), norm)


def prepare(anchors: np.ndarray, levels: int = LEVELS, bits: int = QUERY_BITS) -> Query:
    y = padded(anchors)
    root, planes, sums, steps, errors = math.sqrt(y.shape[1]), [], [], [], []
    norm = np.sqrt((y * y).sum(1))
    for level in range(levels):
        y = rotated(y, level)
        step = np.maximum(np.abs(y).max(1), 1e-300) / ((1 << (bits - 1)) - 1)
        z = np.rint(y / step[:, None])
        errors.append(np.abs(y - z * step[:, None]).sum(1) / root)
        z = z.astype(np.int64)
        planes.append(np.stack([bit_words(((z + (1 << (bits - 1))) >> b) & 1) for b in range(bits)], 1))
        sums.append(z.sum(1))
        steps.append(step / root)
    return Query(np.stack(planes, 1), np.stack(sums, 1), np.stack(steps, 1), np.stack(errors, 1), norm)


def intervals(query: Query, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each anchor (rows of the result) may have with each coded vector (columns)."""
    levels, bits = query.planes.shape[1:3]
    estimate = np.zeros((len(query.norm), len(codes.norm)))
    error, common = estimate + 0.0, np.empty(estimate.shape, U)
    for level in range(levels):
        words = codes.bits[:, level]
        inside = np.zeros(estimate.shape, np.int32) - (1 << (bits - 1)) * np.bitwise_count(words).sum(1, dtype=np.int32)[None, :]
        for b in range(bits):
            for w in range(words.shape[1]):
                np.bitwise_and(words[None, :, w], query.planes[:, level, b, w, None], out=common)
                inside += np.left_shift(np.bitwise_count(common), b, dtype=np.int32)
        along = (2 * inside - query.sums[:, level, None]) * query.step[:, level, None]
        estimate += along * codes.align[None, :, level]
        error += query.error[:, level, None] * np.abs(codes.align[None, :, level])
    # The last remainder is orthogonal to its code vector: only what the anchor has beside that vector counts.
    surely_along = np.maximum(np.abs(along) - query.error[:, -1, None], 0)
    beside = np.sqrt(np.maximum(query.norm[:, None] ** 2 - surely_along**2, 0))
    error += beside * codes.rest[None, :] + 1e-9 * query.norm[:, None] * codes.norm[None, :] + 1e-6
    return estimate - error, estimate + error


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``; an error if a score could leave the range of 64 bits."""
    made = np.floor(vectors.astype(np.float64) * scale)
    if made.size and float(np.abs(made).max()) ** 2 * made.shape[1] >= 2**62:
        raise ValueError("components are too large for 64-bit scores")
    return made.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n first: greatest score, then smallest id."""
    return np.lexsort((ids, -scores))[:n]


def at_least(values: np.ndarray, n: int) -> np.ndarray:
    """Per row the n-th greatest value, minus infinity if there are fewer."""
    if values.shape[1] < n:
        return np.full(len(values), -np.inf)
    return -np.partition(-values, n - 1, axis=1)[:, n - 1]


# --- blocks ----------------------------------------------------------------
BLOCK = "dim int, name string, ids binary, labels binary, vectors binary, bits binary, align binary, rest binary, norm binary"


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``(id, label, vector)`` of the rows that take part: nothing null, all components finite."""
    finite = F.forall(vector, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x.cast("double")), F.lit(False)))
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(finite)
    return rows.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("vector"))


def blocks_of(rows: DataFrame, scale: int = SCALE, levels: int = LEVELS) -> DataFrame:
    """The rows in coded blocks, each of one length of vectors."""
    names = [f.split()[0] for f in BLOCK.split(", ")]
    schema = pa.schema(list(zip(names, [pa.int32(), pa.string()] + [pa.binary()] * 7, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            lists = batch.column(2)
            dims = lists.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                of_dim = np.flatnonzero(dims == dim)
                step = max(BLOCK_BYTES // (8 * size_of(int(dim))), 1)
                for at in range(0, len(of_dim), step):
                    take = pa.array(of_dim[at : at + step])
                    values = lists.take(take).flatten().to_numpy(zero_copy_only=False).reshape(len(take), dim)
                    numbers = whole_numbers(values, scale)
                    codes = encode(numbers, levels)
                    arrays = (batch.column(0).take(take).to_numpy(), batch.column(1).take(take).to_numpy(), numbers, *codes)
                    name = f"{TaskContext.get().partitionId()}-{made}"
                    made += 1
                    yield W.record_batch(schema, [[dim], [name], *([a.tobytes()] for a in arrays)])

    return rows.select("id", "label", "vector").mapInArrow(run, BLOCK)


class Rows(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    codes: Codes

    def take(self, at: np.ndarray) -> Rows:
        return Rows(self.ids[at], self.labels[at], self.vectors[at], Codes(*(c[at] for c in self.codes)))


def block_rows(row: dict, levels: int = LEVELS) -> Rows:
    ids = np.frombuffer(row["ids"], np.int64)
    n, words = len(ids), -(-size_of(row["dim"]) // 64)
    codes = Codes(
        np.frombuffer(row["bits"], U).reshape(n, levels, words), np.frombuffer(row["align"], np.float64).reshape(n, levels),
        np.frombuffer(row["rest"], np.float64), np.frombuffer(row["norm"], np.float64),
    )
    return Rows(ids, np.frombuffer(row["labels"], np.int64), np.frombuffer(row["vectors"], np.int64).reshape(n, row["dim"]), codes)


def slices(anchors: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    step = max(PAIRS_AT_ONCE // max(rows, 1), 1)
    for at in range(0, len(anchors), step):
        yield anchors[at : at + step]


def best_positives(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, rows: Rows, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per anchor: the block's first n other rows of its label, and their scores."""
    query = prepare(vectors)
    for label in np.unique(labels):
        mine = rows.take(np.flatnonzero(rows.labels == label))
        if not len(mine.ids):
            continue
        for part in slices(np.flatnonzero(labels == label), len(mine.ids)):
            low, high = intervals(Query(*(x[part] for x in query)), mine.codes)
            own = mine.ids[None, :] == ids[part, None]
            low[own] = high[own] = -np.inf
            open_ = (high >= at_least(low, n)[:, None]) & ~own
            for a, alive in zip(part, open_, strict=True):
                at = np.flatnonzero(alive)
                scores = mine.vectors[at] @ vectors[a]
                first = best(scores, mine.ids[at], n)
                yield int(a), mine.ids[at[first]], scores[first]


def best_negatives(labels: np.ndarray, vectors: np.ndarray, bands: list[list[tuple[int, int]]], rows: Rows, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per anchor and band of scores: the block's first n rows of another label inside the band, and their scores."""
    query = prepare(vectors)
    for label in np.unique(labels):
        other = rows.take(np.flatnonzero(rows.labels != label))
        if not len(other.ids):
            continue
        for part in slices(np.flatnonzero(labels == label), len(other.ids)):
            low, high = intervals(Query(*(x[part] for x in query)), other.codes)
            for a, lo, hi in zip(part, low, high, strict=True):
                alive = []
                for least, most in bands[a]:
                    sure = np.where((lo >= least) & (hi <= most), lo, -np.inf)
                    alive.append((hi >= max(least, at_least(sure[None, :], n)[0])) & (lo <= most))
                at = np.flatnonzero(np.logical_or.reduce(alive)) if alive else np.zeros(0, np.int64)
                scores = other.vectors[at] @ vectors[a]
                for b, (least, most) in enumerate(bands[a]):
                    inside = np.flatnonzero((scores >= least) & (scores <= most))
                    first = inside[best(scores[inside], other.ids[at[inside]], n)]
                    if len(first):
                        yield int(a), b, other.ids[at[first]], scores[first]


def _cells(anchors: DataFrame, blocks: DataFrame, groups: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of vectors and groups of anchors by ``(column, line, dim)``, in which every group meets every block of vectors as long.

    A block goes once to each column of cells, for all groups there, and a group once to each line of them.
    """
    lines = max(-(-blocks.count() // BLOCKS_PER_CELL), 1)
    columns = max(-(-groups // min(GROUPS_PER_CELL, max(groups * lines // LEAST_CELLS, 1))), 1)
    dealt = anchors.groupBy("group", "dim").agg(F.collect_list("anchor").alias("anchors"))
    dealt = dealt.select(F.pmod("group", F.lit(columns)).alias("column"), F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("line"), "dim", "anchors")
    laid = blocks.withColumn("line", F.pmod(F.xxhash64("name"), F.lit(lines)).cast("int"))
    laid = laid.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    return laid.select("column", "line", "dim", "ids", "labels", "vectors", "bits", "align", "rest", "norm"), dealt


def _anchor_arrays(anchors: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, copies, labels and integer vectors of a group."""
    ids, copies, labels = (anchors.field(n).to_numpy(zero_copy_only=False) for n in ("id", "copy", "label"))
    values = anchors.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
    return ids, copies, labels, whole_numbers(values, scale)


def _paired(cells: tuple[DataFrame, DataFrame], found, fields: str, types: list[pa.DataType]) -> DataFrame:
    """``found(anchors, row)`` of each group and block of a cell, whose tuples become rows."""
    schema = pa.schema(list(zip([f.split()[0] for f in fields.split(", ")], types, strict=True)))

    def run(blocks: pa.Table, groups: pa.Table) -> pa.Table:
        made = []
        for i in range(blocks.num_rows):
            row = {n: blocks.column(n)[i].as_py() for n in blocks.schema.names}
            for group in groups.column("anchors"):
                if rows := list(found(group.values, row)):
                    made.append(W.record_batch(schema, list(zip(*rows, strict=True))))
        return pa.Table.from_batches(made, schema)

    laid, dealt = (side.groupBy("column", "line", "dim") for side in cells)
    return laid.cogroup(dealt).applyInArrow(run, fields)


def mine(
    vectors: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Vectors become integers, ``floor(scale * x)``, and a score is an inner product.  An anchor's
    positives are its ``positives`` first other rows of the same label, and for each of these come the
    ``negatives`` first rows of another label that score at least ``low`` and at most ``high`` percent
    of it.  First is the greatest score, then the smallest key.

    ``is_anchor`` is a condition on ``vectors``.  Rows with a null key, label, vector or component, or one that isn't finite,
    take no part.  Only vectors of equal length are compared.  A row of the anchor's own key is no positive.
    Rows with a key of others are rows of their own, but anchors alike in key, label and vector are one.
    A positive without negatives gives no row, an empty table an empty result.
    Components whose scores could leave 64 bits are an error.
    """
    columns = vectors.withColumn("_anchor", F.coalesce(is_anchor, F.lit(False)))
    blocks = staged(blocks_of(usable(vectors, key, vector, label), scale), "vector-blocks")
    picked = usable(columns.where("_anchor"), key, vector, label).distinct()
    picked = staged(picked.withColumns({"copy": F.xxhash64("vector"), "dim": F.size("vector")}), "anchors")
    groups = -(-picked.count() // ANCHOR_ROWS)
    anchor = ["id", "copy", "label"]

    def grouped(df: DataFrame, *more: str) -> DataFrame:
        group = F.pmod(F.xxhash64("id", "copy"), F.lit(max(groups, 1))).cast("int").alias("group")
        return df.select(group, "dim", F.struct(*anchor, "vector", *more).alias("anchor"))

    def positives_of(anchors: pa.Array, row: dict) -> Iterator[tuple]:
        ids, copies, labels, numbers = _anchor_arrays(anchors, row["dim"], scale)
        for a, found, scores in best_positives(ids, labels, numbers, block_rows(row), positives):
            yield from ((ids[a], copies[a], labels[a], i, s) for i, s in zip(found, scores, strict=True))

    def ranked(df: DataFrame, keys: list[str], score: str, row: str, n: int) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(F.col(score).desc(), row)
        return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)

    long = pa.int64()
    near = _paired(_cells(grouped(picked), blocks, groups), positives_of, "id bigint, copy bigint, label bigint, positive_id bigint, positive_score bigint", [long] * 5)
    near = ranked(near, anchor, "positive_score", "positive_id", positives)
    lists = near.groupBy(*anchor).agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("positives"))
    known = staged(picked.join(lists.hint("merge"), anchor), "anchors-positives")

    def negatives_of(anchors: pa.Array, row: dict) -> Iterator[tuple]:
        ids, copies, labels, numbers = _anchor_arrays(anchors, row["dim"], scale)
        wanted = [[(p["rank"], p["positive_id"], p["positive_score"]) for p in ps] for ps in anchors.field("positives").to_pylist()]
        bands = [[(-(-low * s // 100), high * s // 100) for _, _, s in ps] for ps in wanted]
        for a, b, found, scores in best_negatives(labels, numbers, bands, block_rows(row), negatives):
            yield from ((ids[a], copies[a], labels[a], *wanted[a][b], i, s) for i, s in zip(found, scores, strict=True))

    fields = "id bigint, copy bigint, label bigint, place int, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    hard = _paired(_cells(grouped(known, "positives"), blocks, groups), negatives_of, fields, [long] * 3 + [pa.int32()] + [long] * 4)
    hard = ranked(hard, [*anchor, "place", "positive_id", "positive_score"], "negative_score", "negative_id", negatives)
    return hard.select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
