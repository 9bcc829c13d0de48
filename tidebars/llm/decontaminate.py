"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of documents inside a task.  Its words become numbers: the
words of the test phrases in the order of their hashes, 0 for any other word.
A stretch of document words without a 0 is the only place where a phrase can
occur, and only if it is as long as the shortest phrase; the shard's index is
built over these stretches, each ended by a 0.

The index is the Burrows-Wheeler transform of the stretches in a wavelet tree
(one bit vector with block counts per bit of the word numbers) and every
``SAMPLE``-th suffix position.  All phrases are searched at once, last word
first: each step is two rank queries per phrase.  Ranges of the suffix array
that remain are occurrences; they are located by walking to the next sampled
position, all together.  Occurrences become removal spans, merged per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm import words as W
from tidebars.llm.rows import ROW, packed, unpacked, with_row

WINDOW_WORDS = 10
SAMPLE = 8
#: Bytes of test phrases that a task holds at a time; more are searched in blocks.
BLOCK_BYTES = 16 << 20

U = np.uint64


class RankedBits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.blocks = np.zeros(len(bits) // 64 + 1, U)
        self.blocks.view(np.uint8)[: len(packed)] = packed
        self.before = np.cumsum(np.bitwise_count(self.blocks), dtype=np.int64) - np.bitwise_count(self.blocks)
        self.zeros = len(bits) - int(np.count_nonzero(bits))

    def ones(self, at: np.ndarray) -> np.ndarray:
        block, bit = at >> 6, (at & 63).astype(U)
        return self.before[block] + np.bitwise_count(self.blocks[block] & ((U(1) << bit) - U(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.blocks[at >> 6] >> (at & 63).astype(U)) & U(1) > 0


class WaveletTree:
    """Symbols by rank: one bit vector per bit, highest first, each level stably parted by the bit before."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for k in reversed(range(bits)):
            ones = symbols >> k & 1 > 0
            self.levels.append((k, RankedBits(ones)))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``at``."""
        begin = np.zeros_like(at)
        for k, level in self.levels:
            one, lo, hi = symbol >> k & 1 > 0, level.ones(begin), level.ones(at)
            begin = np.where(one, level.zeros + lo, begin - lo)
            at = np.where(one, level.zeros + hi, at - hi)
        return at - begin

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it occurs before it."""
        symbol, begin = np.zeros_like(at), np.zeros_like(at)
        for k, level in self.levels:
            one, lo, hi = level.get(at), level.ones(begin), level.ones(at)
            symbol |= one.astype(np.int64) << k
            begin = np.where(one, level.zeros + lo, begin - lo)
            at = np.where(one, level.zeros + hi, at - hi)
        return symbol, at - begin


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; only suffixes that are still equal are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    first = np.r_[True, symbols[order][1:] != symbols[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    step = 1
    while True:
        begins = np.flatnonzero(first)
        sizes = np.diff(np.r_[begins, n])
        open_ = np.repeat(sizes > 1, sizes)
        places = np.flatnonzero(open_)
        if not len(places):
            return order
        at = order[places]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1)
        moved = np.lexsort((after, rank[at]))
        at, after = at[moved], after[moved]
        order[places] = at
        same = np.r_[False, (rank[at][1:] == rank[at][:-1]) & (after[1:] == after[:-1])]
        first[places] = ~same
        rank[at] = places[np.maximum.accumulate(np.where(same, 0, np.arange(len(places))))]
        step *= 2


class FMIndex:
    """Backward search and location over word numbers; a number is one more inside, after the only 0 at the end."""

    def __init__(self, symbols: np.ndarray, largest: int):
        bits = (largest + 1).bit_length()
        text = np.r_[symbols + 1, 0]
        order = suffix_array(text)
        self.n = len(text)
        self.tree = WaveletTree(text[order - 1], bits)
        self.less = np.r_[0, np.cumsum(np.bincount(text, minlength=1 << bits))]
        sampled = order % SAMPLE == 0
        self.marks, self.samples = RankedBits(sampled), order[sampled]

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix array ranges of right-aligned phrases of any lengths."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(1, phrases.shape[1] + 1 if len(phrases) else 0):
            live = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(live):
                break
            symbol = phrases[live, -back] + 1
            lo[live], hi[live] = (self.less[symbol] + self.tree.rank(symbol, x[live]) for x in (lo, hi))
        return lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffix array places."""
        out, walked, live = np.empty(len(at), np.int64), 0, np.arange(len(at))
        at = at.copy()
        while len(live):
            here = self.marks.get(at[live])
            done = live[here]
            out[done] = self.samples[self.marks.ones(at[done])] + walked
            live = live[~here]
            symbol, before = self.tree.access(at[live])
            at[live] = self.less[symbol] + before
            walked += 1
        return out


class Phrases:
    """The windows of some items: their words' hashes in order, and the windows as word numbers."""

    def __init__(self, items: list[str], texts: list[str | None], window: int):
        column = pa.array(texts, pa.large_string())
        data, offsets = W.text_bytes(column)
        data = W.lower_ascii(data)
        found = W.find_words(data, offsets, W.letters_and_digits())
        self.known, number = np.unique(W.word_hashes(data, found), return_inverse=True)
        rows, lengths, owners = [], [], []
        for i, (a, b) in enumerate(zip(found.first[:-1], found.first[1:], strict=True)):
            for s in range(a, max(b - window, a) + 1) if b > a else ():
                size = min(window, b - a)
                rows.append(np.r_[np.zeros(window - size, np.int64), number[s : s + size] + 1])
                lengths.append(size)
                owners.append(i)
        windows = np.array(rows, np.int64).reshape(-1, window)
        self.windows, which = np.unique(windows, axis=0, return_inverse=True)
        self.lengths = (self.windows > 0).sum(axis=1)
        pairs = np.unique(np.stack([which.ravel(), np.array(owners, np.int64)], axis=1), axis=0) if rows else np.zeros((0, 2), np.int64)
        self.items, self.owner = items, pairs[:, 1]
        self.owned = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        self.table = np.zeros(1 << 16, bool)
        self.table[(self.known & U(0xFFFF)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for one that is in no phrase."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.table[(hashes & U(0xFFFF)).astype(np.int64)]) if len(self.known) else out[:0]
        place = np.minimum(np.searchsorted(self.known, hashes[maybe]), max(len(self.known) - 1, 0))
        out[maybe] = np.where(self.known[place] == hashes[maybe], place + 1, 0) if len(maybe) else 0
        return out


def occurrences(hashes: np.ndarray, words: W.Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and window number of every occurrence of a window in the rows of a batch."""
    none = np.zeros(0, np.int64)
    if not len(hashes) or not len(phrases.windows):
        return none, none, none
    numbers, shortest = phrases.numbers(hashes), int(phrases.lengths.min())
    inside = numbers > 0
    begins = inside & ~np.r_[False, inside[:-1]]
    edge = words.first[:-1][words.first[:-1] < len(numbers)]
    begins[edge] |= inside[edge]
    starts = np.flatnonzero(begins)
    ends = np.minimum(np.r_[starts[1:], len(numbers)], np.r_[np.flatnonzero(~inside), len(numbers)][np.searchsorted(np.flatnonzero(~inside), starts)])
    long = ends - starts >= shortest
    starts, sizes = starts[long], (ends - starts)[long]
    if not len(starts):
        return none, none, none
    # The stretches one after another, a 0 after each.
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    nth = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    text[np.repeat(begin, sizes) + nth] = numbers[np.repeat(starts, sizes) + nth]
    index = FMIndex(text, len(phrases.known))
    lo, hi = index.ranges(phrases.windows, phrases.lengths)
    count = np.maximum(hi - lo, 0)
    window = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
    at = index.locate(lo[window] + nth)
    stretch = np.searchsorted(begin, at, "right") - 1
    first = starts[stretch] + at - begin[stretch]
    return first, first + phrases.lengths[window], window


def item_blocks(items: DataFrame, item: str, text: str, window: int) -> list[Phrases]:
    """The test items in blocks of at most `BLOCK_BYTES` (or one longer item) each, built on the driver block by block."""
    blocks, ids, texts, size = [], [], [], 0
    for row in items.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        if ids and size + len(row["t"] or "") > BLOCK_BYTES:
            blocks.append(Phrases(ids, texts, window))
            ids, texts, size = [], [], 0
        ids.append(row["i"])
        texts.append(row["t"])
        size += len(row["t"] or "")
    return [*blocks, Phrases(ids, texts, window)] if ids else blocks


RESULT = "n_words bigint, n_hit bigint, spans array<struct<begin:bigint,end:bigint>>, items array<string>"


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """Per row of ``docs`` its key, words, words hit, merged spans of hit words, and the items whose windows occur, in string order.

    Words are runs of digits, a-z and characters beyond ASCII after A-Z are put
    in lower case.  A window is ``window`` consecutive words of an item; an item
    of fewer words is one window, one without words (null, empty) none.  A
    document word inside an occurrence of a window is hit.  Repeated items count
    once by id; an item without id hits words but isn't listed.  Null texts have
    no words.  The items are a stated query set: they go to every task, in blocks
    of bounded size.
    """
    return unpacked(_scan(docs, items, [key], text, item, item_text, window), [key], "n_words", "n_hit", "spans", "items")


def _scan(docs: DataFrame, items: DataFrame, carry: list[str], text: str, item: str, item_text: str, window: int) -> DataFrame:
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(b) for b in item_blocks(items, item, item_text, window)]
    rows = docs.select(packed(carry), F.col(text).alias("text"))
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.texts(batches, "text"):
            data = W.lower_ascii(part.data)
            found = W.find_words(data, part.offsets, W.letters_and_digits())
            hashes, n = W.word_hashes(data, found), len(found.starts)
            begins, ends, hits = [], [], [set() for _ in range(part.rows.num_rows)]
            for block in blocks:
                phrases = block.value
                first, end, which = occurrences(hashes, found, phrases)
                begins.append(first)
                ends.append(end)
                row = np.searchsorted(found.first, first, "right") - 1
                for r, w in np.unique(np.stack([row, which], axis=1), axis=0):
                    hits[r].update(phrases.items[i] for i in phrases.owner[phrases.owned[w] : phrases.owned[w + 1]])
            hit = W.covered(np.concatenate(begins), np.concatenate(ends), n) if begins else np.zeros(n, bool)
            edge = np.zeros(n + 1, bool)
            edge[found.first[:-1]] = True
            opens = np.flatnonzero(hit & (~np.r_[False, hit[:-1]] | edge[:n]))
            closes = np.flatnonzero(hit & (~np.r_[hit[1:], False] | edge[1:])) + 1
            row = np.searchsorted(found.first, opens, "right") - 1
            base = found.first[row]
            where = np.searchsorted(row, np.arange(part.rows.num_rows + 1)).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(where), pa.StructArray.from_arrays([pa.array(opens - base), pa.array(closes - base)], fields=list(span)))
            named = pa.array([sorted(x for x in h if x is not None) for h in hits], pa.list_(pa.string()))
            counts = pa.array(found.counts), pa.array(W.totals(hit, found.first))
            yield pa.RecordBatch.from_arrays([part.rows.column(0), *counts, spans, named], [ROW, "n_words", "n_hit", "spans", "items"])

    return rows.mapInArrow(run, with_row(rows, RESULT))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", max_share: float = 0.0) -> DataFrame:
    """The rows of ``docs`` of whose words at most ``max_share`` are hit; columns and values are those of ``docs``."""
    found = _scan(docs, items, docs.columns, text, "item_id", "text", WINDOW_WORDS)
    return unpacked(found.where(F.col("n_hit") <= max_share * F.col("n_words")), docs.columns)
