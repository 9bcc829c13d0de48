"""Passages that repeat across documents, by seed and extend.

*Seeds.*  Of the ``SEED_WORDS``-word runs inside a window of ``length`` words,
the leftmost with the least hash is the window's anchor.  The choice depends on
the window's words alone, so equal windows have equal anchors, and a row has
about one anchor per fifteen words.  Only anchors that occur in two documents
are followed.

*Extension.*  An anchor is extended both ways over all windows whose anchor it
is; the words so reached are its stretch.  Occurrences with one stretch form a
class with a smallest document: every other document of the class repeats the
whole stretch.  Between the classes of one anchor only the class's smallest
document is extended window by window (some words left of the anchor, the rest
right), and windows that a smaller document has are repeats.

*Maximal repeats* are the unions of a row's repeated windows.

All keys are hashes of content, all groups are met by partial aggregates and by
joins that Spark splits (what is joined to many rows is staged first, so that both
sides of the join are plain exchanges), and copies fold into their class before anything is
spelt out, so a passage in a third of all rows costs what its rows cost.
Hashes have 64 bits and are compared only among occurrences of one anchor or
window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm import words as W
from tidebars.llm.staging import staged

LENGTH_WORDS = 50
SEED_WORDS = 20
NO_KEY = 2**63 - 1


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in each run of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        span += step
    return best[:n]


class Windows:
    """The windows of ``length`` words of some rows and the anchor of each."""

    def __init__(self, part: W.Text, length: int, seed: int):
        self.words = W.find_words(part.data, part.offsets, W.space_separated())
        self.hashes = W.word_hashes(part.data, self.words)
        seeds = W.run_hashes(self.hashes, seed)
        inside = W.run_rows(self.words, length)
        anchor = sliding_argmin(seeds, length - seed + 1)
        self.at = np.flatnonzero(inside)
        anchor = anchor[self.at]
        # Windows with one anchor follow each other.
        new = np.r_[True, (anchor[1:] != anchor[:-1])] if len(anchor) else np.zeros(0, bool)
        self.opens = np.flatnonzero(new)
        self.sizes = np.diff(np.r_[self.opens, len(anchor)])
        self.first = self.at[self.opens]
        self.anchor = seeds[anchor[self.opens]] if len(anchor) else np.zeros(0, W.U)
        self.row = np.searchsorted(self.words.first, self.first, "right") - 1
        self.from_row = self.first - self.words.first[self.row]

    def stretches(self, length: int) -> np.ndarray:
        """Hash of all words that the windows of each anchor reach."""
        return W.span_hashes(self.hashes, self.first, self.first + self.sizes - 1 + length, W.WORD_BASE)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows are told apart by key and text; equal rows have equal results."""
    return docs.select(F.coalesce(F.col(key), F.lit(NO_KEY)).cast("bigint").alias("k"), F.xxhash64(text).alias("copy"), F.col(text).alias("text"))


def _anchors(keyed: DataFrame, length: int, seed: int, full: bool) -> DataFrame:
    fields = [("anchor", pa.int64()), ("k", pa.int64())]
    fields += [("copy", pa.int64()), ("stretch", pa.int64()), ("first", pa.int32()), ("size", pa.int32())] if full else []
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.texts(batches, "text"):
            found = Windows(part, length, seed)
            key = part.rows.column(0).to_numpy()[found.row]
            anchor = found.anchor.view(np.int64)
            if full:
                copy = part.rows.column(1).to_numpy()[found.row]
                yield W.record_batch(schema, [anchor, key, copy, found.stretches(length).view(np.int64), found.from_row.astype(np.int32), found.sizes.astype(np.int32)])
            else:
                _, once = np.unique(W.mix(found.anchor + found.row.astype(W.U)), return_index=True)
                yield W.record_batch(schema, [anchor[once], key[once]])

    return keyed.mapInArrow(run, "anchor bigint, k bigint" + ", copy bigint, stretch bigint, first int, size int" * full)


def _windows_of(keyed: DataFrame, stretches: DataFrame, length: int) -> DataFrame:
    """``(window, k, copy, first)`` for every window of the given stretches ``(k, copy, first, size)``."""
    wanted = stretches.groupBy("k", "copy").agg(F.collect_set(F.struct("first", "size")).alias("parts"))
    rows = keyed.join(wanted, ["k", "copy"]).dropDuplicates(["k", "copy"])
    schema = pa.schema([("window", pa.int64()), ("k", pa.int64()), ("copy", pa.int64()), ("first", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.texts(batches, "text"):
            found = W.find_words(part.data, part.offsets, W.space_separated())
            runs = W.run_hashes(W.word_hashes(part.data, found), length)
            parts = part.rows.column(part.rows.schema.get_field_index("parts"))
            row = np.repeat(np.arange(part.rows.num_rows), parts.value_lengths().to_numpy())
            first, size = (x.to_numpy().astype(np.int64) for x in parts.flatten().flatten())
            row, nth = np.repeat(row, size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            first = np.repeat(first, size) + nth
            key, copy = (part.rows.column(i).to_numpy()[row] for i in (0, 1))
            yield W.record_batch(schema, [runs[found.first[row] + first].view(np.int64), key, copy, first.astype(np.int32)])

    return rows.select("k", "copy", "text", "parts").mapInArrow(run, "window bigint, k bigint, copy bigint, first int")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH_WORDS, seed: int = SEED_WORDS) -> DataFrame:
    """Per row its key, text and ``spans``: ``(begin, end)`` word spans of the repeated windows, one of each run of them.

    Words are what white space separates, unchanged.  A window of ``length``
    consecutive words is a repeat if the same words also start in a document
    with a smaller key.  Rows with equal keys don't repeat each other; a null
    key is larger than any other.  Texts of fewer words, and null ones, have no
    windows.  Empty tables give empty results.
    """
    if not 0 < seed <= length:
        raise ValueError("the seed must have from 1 to length words")
    keyed = _keyed(docs, key, text)
    ends = _anchors(keyed, length, seed, full=False).groupBy("anchor").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    shared = staged(ends.where("lo < hi").select("anchor"), "shared")
    found = staged(_anchors(keyed, length, seed, full=True).join(shared, "anchor"), "anchors")
    classes = found.groupBy("anchor", "stretch").agg(F.min(F.struct("k", "copy", "first", "size")).alias("rep"))
    classes = staged(classes, "classes")
    whole = found.join(classes, ["anchor", "stretch"]).where("k > rep.k")
    spans = whole.select("k", "copy", F.col("first").alias("begin"), (F.col("first") + F.col("size") - 1 + length).alias("end"))
    several = staged(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "several")
    # A class's smallest document may hold the stretch in several rows and places: each is judged.
    heads = found.join(classes.join(several, "anchor", "left_semi"), ["anchor", "stretch"]).where("k = rep.k").select("k", "copy", "first", "size")
    windows = staged(_windows_of(keyed, heads, length), "windows")
    least = windows.groupBy("window").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").select("window", "lo")
    single = windows.join(staged(least, "least"), "window").where("k > lo").select("k", "copy", F.col("first").alias("begin"), (F.col("first") + length).alias("end"))
    merged = spans.union(single).groupBy("k", "copy").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    none = F.array().cast("array<struct<begin:int,end:int>>")
    out = keyed.join(merged, ["k", "copy"], "left").select("k", "text", F.coalesce("spans", none).alias("spans"))
    return out.select(F.nullif("k", F.lit(NO_KEY)).alias(key), F.col("text").alias(text), "spans")


def without_repeats(found: DataFrame) -> DataFrame:
    """From `repeats`: key, ``n_words``, ``n_removed``, the maximal repeats and the words ``kept``, joined by one space."""
    key, text = found.columns[:2]
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    names = ["key", "n_words", "n_removed", "repeats", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.texts(batches, "text"):
            words, rows = W.find_words(part.data, part.offsets, W.space_separated()), part.rows.num_rows
            n, spans = len(words.starts), part.rows.column(2)
            row = np.repeat(np.arange(rows), spans.value_lengths().to_numpy())
            begin, end = (x.to_numpy().astype(np.int64) + words.first[row] for x in spans.flatten().flatten())
            gone = W.covered(begin, end, n)
            edge = np.zeros(n + 1, bool)
            edge[words.first[:-1]] = True
            opens = np.flatnonzero(gone & (~np.r_[False, gone[:-1]] | edge[:n]))
            closes = np.flatnonzero(gone & (~np.r_[gone[1:], False] | edge[1:])) + 1
            at = np.searchsorted(words.first, opens, "right") - 1
            where = np.searchsorted(at, np.arange(rows + 1)).astype(np.int32)
            base = words.first[at]
            merged = pa.ListArray.from_arrays(pa.array(where), pa.StructArray.from_arrays([pa.array(opens - base), pa.array(closes - base)], fields=list(span)))
            # Kept words with one space between them.
            kept = np.flatnonzero(~gone)
            size = words.ends[kept] - words.starts[kept] + 1
            begins = np.cumsum(size) - size
            data = np.full(int(size.sum()), 0x20, np.uint8)
            source = np.repeat(words.starts[kept] - begins, size) + np.arange(len(data))
            last = np.zeros(len(data), bool)
            last[begins + size - 1] = True
            data[~last] = part.data[source[~last]]
            first = np.searchsorted(kept, words.first)
            bounds = np.r_[begins, len(data)][first]
            buffer = data.tobytes()
            texts = [buffer[a : max(a, b - 1)].decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.rows.column(0), pa.array(words.counts), pa.array(W.totals(gone, words.first)), merged, pa.array(texts, pa.string())], names)

    made = found.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), "spans").mapInArrow(
        run, "key bigint, n_words bigint, n_removed bigint, repeats array<struct<begin:bigint,end:bigint>>, kept string"
    )
    return made.withColumnRenamed("key", key)
