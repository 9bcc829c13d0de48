"""Words of whole texts as flat numpy arrays, for use inside tasks.

A batch of texts is one byte array with the offsets of its rows.  Word
characters are told by single bytes of UTF-8 (every byte from 0x80 on belongs
to a word), so words, their hashes and the hashes of runs of words come from a
handful of array operations over the batch, whatever the number of rows.
Null texts count as empty ones.  Rows are never cut; a batch is only sliced
between rows, so memory follows the longest text or `SLICE_BYTES`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 2 << 20

U = np.uint64
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class Text(NamedTuple):
    """Some rows of a batch: their bytes and, per row, where these begin and end."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Byte spans of the words, and per row the number of its first word (one more entry than rows)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def space_separated() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def letters_and_digits() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``: digits, a-z, and all beyond ASCII."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table[data]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[Text]:
    """Slices of whole rows with at most ``limit`` bytes of text, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            cut = offsets[at : to + 1]
            yield Text(batch.slice(at, to - at), data[cut[0] : cut[-1]], cut - cut[0])
            at = to


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offsets), np.int64))
    inside = table[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return Words(starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size, made = max(n, 1 << 16), []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, U(b))
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=U))
        _powers[base] = (made[0], made[1])
    return _powers[base]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span.

    For spans of a few hundred hashes at most: sums modulo a power of two agree on some long sequences of two values.
    """
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum((values.astype(U) + U(1)) * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(U) * U(0xFF51AFD7ED558CCD))


def spelt(data: np.ndarray, words: Words) -> pa.StringArray:
    """The words of a batch as strings."""
    offsets = np.zeros(len(words.starts) + 1, np.int32)
    np.cumsum(words.ends - words.starts, out=offsets[1:])
    inside = np.repeat(words.starts - offsets[:-1], np.diff(offsets)) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(words.starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside])))


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """XXH64 of each word's bytes; every different word of the batch, told by its bytes, is hashed once."""
    if not len(words.starts):
        return np.zeros(0, U)
    coded = spelt(data, words).cast(pa.binary()).dictionary_encode()
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(w) for w in coded.dictionary.to_pylist()), U, len(coded.dictionary))[coded.indices.to_numpy()]


def sequence_hashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """XXH64 of each row's word hashes, in order; ``first`` are the numbers of the rows' first words, with the end."""
    view, hashed = memoryview(np.ascontiguousarray(hashes).view(np.uint8)), xxhash.xxh64_intdigest
    bounds = (8 * first).tolist()
    return np.fromiter((hashed(view[a:b]) for a, b in zip(bounds, bounds[1:])), U, len(first) - 1)


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each word on, rows ignored: entries whose run leaves its row mean nothing."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, U)
    at = np.arange(n)
    return span_hashes(hashes, at, at + length, WORD_BASE)


def run_rows(words: Words, length: int) -> np.ndarray:
    """Whether the run of ``length`` words from each word on stays in its row."""
    ends = np.repeat(words.first[1:], words.counts)
    n = max(len(ends) - length + 1, 0)
    return (np.arange(len(ends)) + length <= ends)[:n]


def totals(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` per row."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in at least one span."""
    change = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
