"""Token ids in files of their own format, coded by a static range asymmetric numeral system (rANS).

`write_tokens` tokenises whole texts with a tokenizer of the ``tokenizers``
library, closes each with an end id, and writes the ids in ascending order of
the key; `read_tokens` gives every document's ids back with its place in the
stream of all ids.

A file holds one frequency table and the blocks it codes.  A block is some whole
documents, about `BLOCK_IDS` ids, and can be decoded alone.  Its ids are dealt
in turn to interleaved lanes that share one stream of 32-bit words; a long
block has more lanes, not more steps.  Every `CHECKPOINT_STEPS` steps the states
of the lanes and the place in the stream are kept, so that a decoder starts at
all checkpoints of all blocks of a file at once: encoder and decoder are array
operations over blocks times lanes.  Tables, blocks and the ids of each block
carry CRC-32 checksums; a file that fails one raises ``ValueError``.

A task makes a file of at most `FILE_IDS` ids (or one longer document) at a
time, from documents that Spark has dealt out by ranges of the key, and Spark's
own writer and ``binaryFile`` source handle the files.

Layout, little-endian: ``TIDF``, length and CRC-32 of the table, the table
(zlib: symbols, then frequencies, 32 bits each); then per block a header
(`HEADER`) and its body: keys (64 bits), which keys are null (8), lengths (64),
lane states at each checkpoint (64), words read before each checkpoint (64),
words (32).
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import sys
import types
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebars.llm import words as W
from tidebars.llm.staging import staged

END_ID = 2
PRECISION = 20  # bits of a frequency; a table has at most this power of two of symbols
LOW = 1 << 31  # a state is at least this between two steps
LANES, LANE_STEPS, CHECKPOINT_STEPS = 16, 1024, 512
BLOCK_IDS, FILE_IDS = 1 << 14, 1 << 21
SLICE_BYTES = 8 << 20
KNOWN_PIECES = 2_000_000
SENT_PARTS = 100_000

MAGIC = b"TIDF"
#: CRC-32 of the rest of the block, bytes of the body, file's part, ids of the part before, documents, ids, lanes, steps, checkpoints, words, CRC-32 of the ids.
HEADER = "<IQIQQQIIIQI"

U = np.uint64


# --- ids of texts ----------------------------------------------------------
def safe_cuts(data: np.ndarray, offsets: np.ndarray, whole: list[bytes] | None) -> np.ndarray:
    """Places at which a byte-level pre-tokenizer cuts whatever stands around, but none inside the strings ``whole``.

    These are row borders; white space after a visible character; ASCII punctuation but the apostrophe after a
    letter; and a visible character after a single white space that is no space.  White space goes with what follows
    it, so a piece is tokenised alone as it is in its text.  Visible is ASCII, letters are ASCII or Latin (U+00C0 to
    U+023F but the two signs among them).  Without ``whole``, rows stay whole.
    """
    if whole is None:
        return np.unique(offsets)
    space, visible, letter, mark, lead = (np.zeros(256, bool) for _ in range(5))
    space[[0x20, *range(0x09, 0x0E)]] = True
    visible[0x21:0x7F] = True
    letter[0x41:0x5B] = letter[0x61:0x7B] = True
    mark[0x21:0x30] = mark[0x3A:0x41] = mark[0x5B:0x61] = mark[0x7B:0x7F] = True
    mark[0x27] = False
    lead[0xC3:0xC9] = True
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        ends_letter = letter[data]
        ends_letter[1:] |= lead[data[:-1]] & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        ends_visible = ends_letter | visible[data]
        cut[1:-1] = (space[data[1:]] & ends_visible[:-1]) | (mark[data[1:]] & ends_letter[:-1])
        single = space[data[1:-1]] & (data[1:-1] != 0x20) & ends_visible[:-2]
        cut[2:-1] |= single & (visible | lead)[data[2:]]
    text = data.tobytes() if whole else b""
    for string in whole:
        at = text.find(string)
        while at >= 0:
            cut[at + 1 : at + len(string)] = False
            at = text.find(string, at + len(string))
    cut[offsets] = True
    return np.flatnonzero(cut)


class Known:
    """Ids of pieces met before, for as long as the worker lives; forgotten when there are more than `KNOWN_PIECES`."""

    def __init__(self) -> None:
        self.pieces = pa.array([], pa.string())
        self.ids, self.offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def look_up(self, pieces: pa.StringArray, encode: Callable[[pa.StringArray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of each piece's ids in the third array; the pieces differ."""
        if len(self.pieces) > KNOWN_PIECES:
            self.__init__()
        found = pc.index_in(pieces, value_set=self.pieces)
        new = pieces.filter(found.is_null())
        which = found.fill_null(0).to_numpy().astype(np.int64)
        if len(new):
            which[found.is_null().to_numpy(zero_copy_only=False)] = len(self.pieces) + np.arange(len(new))
            ids, sizes = encode(new)
            self.pieces = pa.concat_arrays([self.pieces, new])
            self.ids, self.offsets = np.concatenate([self.ids, ids]), np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        return self.offsets[which], self.offsets[which + 1], self.ids


def known(name: str) -> Known:
    """The worker's own table for a tokenizer: functions travel by value, so it hangs on a module of the worker."""
    holder = sys.modules.setdefault("_tidebars_token_files", types.ModuleType("_tidebars_token_files"))
    return holder.__dict__.setdefault(name, Known())


def spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers from each start to its end."""
    sizes = ends - starts
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Encoder(NamedTuple):
    """Ids of texts on end and their numbers, and the strings that `safe_cuts` mustn't cut; None if texts have to be tokenised whole."""

    encode: Callable[[pa.StringArray], tuple[np.ndarray, np.ndarray]]
    whole: list[bytes] | None


#: Pieces that are a single word of a byte-level pre-tokenizer.
ONE_WORD = r"^ ?([A-Za-zÀ-ÖØ-öø-ȿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)$"


def byte_letters() -> dict[int, int]:
    """The character that stands for each byte: itself if it is printed, else the next one from U+0100 on."""
    printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printed]
    return {b: b for b in printed} | {b: 256 + i for i, b in enumerate(others)}


def library_encoder(path: str) -> Encoder:
    """Encoder of a file of the ``tokenizers`` library, without added special tokens; used inside tasks.

    With a byte-level tokenizer, pieces that are one word go to the library's model at once.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    made = json.loads(tokenizer.to_str())
    split, added = made["pre_tokenizer"] or {}, made["added_tokens"]
    plain = made["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    plain = plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.match(ONE_WORD, t["content"]) for t in added)
    model, letters = tokenizer.model, byte_letters()

    def whole(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(texts: list[str]) -> list[list[int]]:
        return [[t.id for t in model.tokenize(text.encode().decode("latin-1").translate(letters))] for text in texts]

    def encode(pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        one = pc.match_substring_regex(pieces, ONE_WORD) if plain else pa.array(np.zeros(len(pieces), bool))
        simple, other = pieces.filter(one), pieces.filter(pc.invert(one))
        found = [ids for way, part in ((words, simple), (whole, other)) for at in range(0, len(part), 10_000) for ids in way(part[at : at + 10_000].to_pylist())]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum()))
        # Back into the order of the pieces.
        place = np.argsort(~one.to_numpy(zero_copy_only=False), kind="stable")
        at, ends = np.empty_like(place), np.cumsum(sizes)
        at[place] = np.arange(len(place))
        return ids[spread((ends - sizes)[at], ends[at])], sizes[at]

    return Encoder(encode, [t["content"].encode() for t in added] if plain else None)


def ids_of_texts(data: np.ndarray, offsets: np.ndarray, encoder: Encoder, table: Known, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows on end, and the offsets of rows in them."""
    cuts = safe_cuts(data, offsets, encoder.whole)
    pieces = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    coded = pieces.dictionary_encode()
    begin, end, ids = table.look_up(coded.dictionary, encoder.encode)
    codes = coded.indices.to_numpy()
    before = np.zeros(len(codes) + 1, np.int64)
    np.cumsum((end - begin)[codes], out=before[1:])
    found = ids[np.repeat(begin[codes] - before[:-1], np.diff(before)) + np.arange(before[-1])]
    at = before[np.searchsorted(cuts, offsets)]
    if end_id is None:
        return found, at
    closed = np.full(len(found) + len(at) - 1, end_id, np.uint32)
    inside = np.ones(len(closed), bool)
    inside[at[1:] + np.arange(len(at) - 1)] = False
    closed[inside] = found
    return closed, at + np.arange(len(at))


# --- the code --------------------------------------------------------------
class Table(NamedTuple):
    symbols: np.ndarray
    frequency: np.ndarray
    before: np.ndarray  # sum of the frequencies of the symbols before


def table_of(ids: np.ndarray, precision: int = PRECISION) -> Table:
    """Frequencies of the ids, each at least 1, that add up to 2**precision."""
    symbols, counts = np.unique(ids, return_counts=True)
    size = 1 << precision
    if len(symbols) > size:
        raise ValueError(f"{len(symbols)} different ids, more than {size}")
    frequency = np.maximum(counts * size // max(counts.sum(), 1), 1)
    left = size - int(frequency.sum())
    order = np.argsort(-frequency, kind="stable")
    if left > 0 and len(symbols):
        frequency[order[0]] += left
    while left < 0:  # the largest give what the smallest were lifted by
        give = np.minimum(frequency[order] // 2, frequency[order] - 1)
        give = np.minimum(give, np.maximum(-left - np.cumsum(give) + give, 0))
        frequency[order] -= give
        left += int(give.sum())
    return Table(symbols.astype(np.uint32), frequency.astype(np.uint32), (np.cumsum(frequency) - frequency).astype(np.uint32))


class Block(NamedTuple):
    """``states`` has a row per checkpoint, the first at the block's beginning; ``read`` are the words read before each."""

    n: int
    lanes: int
    states: np.ndarray
    read: np.ndarray
    words: np.ndarray


def shape(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of n ids."""
    lanes = LANES
    while n > lanes * LANE_STEPS:
        lanes *= 2
    return lanes, -(-n // lanes)


def encode_blocks(ids: np.ndarray, bounds: np.ndarray, table: Table, precision: int = PRECISION) -> list[Block]:
    """The blocks ``ids[bounds[i]:bounds[i + 1]]``, none of them empty, all coded side by side.

    Ids are coded from the last to the first.  Lanes that end a step early are filled up with the most frequent symbol.
    """
    sizes = np.diff(bounds)
    shapes = [shape(int(n)) for n in sizes]
    order = sorted(range(len(sizes)), key=lambda b: -shapes[b][1])
    lanes, steps = (np.array([shapes[b][i] for b in order]) for i in (0, 1))
    room = lanes * steps
    first = np.cumsum(room) - room
    padded = np.full(room.sum(), np.argmax(table.frequency), np.int32)
    codes = np.searchsorted(table.symbols, ids).astype(np.int32)
    for b, at in zip(order, first, strict=True):
        padded[at : at + sizes[b]] = codes[bounds[b] : bounds[b + 1]]
    block = np.repeat(np.arange(len(order)), lanes)
    lane_end = np.cumsum(lanes)
    width = lanes[block]
    where = first[block] + spread(np.zeros(len(lanes), np.int64), lanes)
    frequency, before, shift = table.frequency.astype(U), table.before.astype(U), U(precision)
    x = np.full(len(block), LOW, U)
    words, owners, emitted = [], [], np.zeros(len(order), np.int64)
    kept: list[list[tuple[np.ndarray, int]]] = [[] for _ in order]
    active = np.searchsorted(-steps, -np.arange(steps.max(initial=0)), "left")  # blocks with more than t steps
    for t in range(steps.max(initial=0) - 1, -1, -1):
        k = int(lane_end[active[t] - 1])
        symbol = padded[where[:k] + t * width[:k]]
        f, state = frequency[symbol], x[:k]
        full = np.flatnonzero(state >= f << U(63 - precision))
        if len(full):
            words.append((state[full] & U(0xFFFFFFFF)).astype(np.uint32)[::-1])
            owners.append(block[full][::-1])
            emitted += np.bincount(owners[-1], minlength=len(order))
            state[full] >>= U(32)
        quotient = state // f
        x[:k] = (quotient << shift) + (state - quotient * f) + before[symbol]
        if t % CHECKPOINT_STEPS == 0:
            for b in range(active[t]):
                kept[b].append((x[lane_end[b] - lanes[b] : lane_end[b]].copy(), int(emitted[b])))
    word, owner = (np.concatenate(a) if a else np.zeros(0, np.int64) for a in (words, owners))
    word, owner = word[::-1], owner[::-1]
    by_block = word[np.argsort(owner, kind="stable")].astype(np.uint32)
    ends = np.cumsum(emitted)
    made: dict[int, Block] = {}
    for b, source in enumerate(order):
        points = kept[b][::-1]
        read = np.array([emitted[b] - e for _, e in points], np.int64)
        made[source] = Block(int(sizes[source]), int(lanes[b]), np.array([s for s, _ in points], U), read, by_block[ends[b] - emitted[b] : ends[b]])
    return [made[b] for b in range(len(sizes))]


def decode_blocks(blocks: list[Block], table: Table, precision: int = PRECISION) -> list[np.ndarray]:
    """The ids of each block; all stretches between checkpoints of all blocks advance together."""
    if not blocks:
        return []
    symbol_at = np.repeat(np.arange(len(table.symbols)), table.frequency)
    frequency, before, mask, shift = table.frequency.astype(U), table.before.astype(U), U((1 << precision) - 1), U(precision)
    all_steps = [-(-b.n // b.lanes) for b in blocks]
    room = np.array([s * b.lanes for s, b in zip(all_steps, blocks, strict=True)])
    first, base = np.cumsum(room) - room, np.cumsum([0, *(len(b.words) for b in blocks)])
    words = np.concatenate([b.words for b in blocks])
    parts = [
        (min(CHECKPOINT_STEPS, all_steps[i] - c * CHECKPOINT_STEPS), i, c) for i, b in enumerate(blocks) for c in range(len(b.states))
    ]
    parts.sort(key=lambda p: -p[0])
    steps, source, point = (np.array([p[i] for p in parts]) for i in range(3))
    lanes = np.array([blocks[i].lanes for i in source])
    part, lane_end = np.repeat(np.arange(len(parts)), lanes), np.cumsum(lanes)
    x = np.concatenate([blocks[i].states[c] for _, i, c in parts])
    at = np.array([base[i] + blocks[i].read[c] for _, i, c in parts])
    where = (first[source] + point * CHECKPOINT_STEPS * lanes)[part] + spread(np.zeros(len(lanes), np.int64), lanes)
    width, out = lanes[part], np.zeros(room.sum(), np.uint32)
    active = np.searchsorted(-steps, -np.arange(steps.max()), "left")
    for t in range(steps.max()):
        k = int(lane_end[active[t] - 1])
        slot = x[:k] & mask
        symbol = symbol_at[slot.astype(np.int64)]
        out[where[:k] + t * width[:k]] = table.symbols[symbol]
        state = frequency[symbol] * (x[:k] >> shift) + slot - before[symbol]
        short = np.flatnonzero(state < U(LOW))
        if len(short):
            owner = part[short]
            counts = np.bincount(owner, minlength=len(parts))
            place = at[owner] + np.arange(len(short)) - (np.cumsum(counts) - counts)[owner]
            if place.max() >= len(words):
                raise ValueError("a block has fewer words than its ids need")
            state[short] = (state[short] << U(32)) | words[place]
            at += counts
        x[:k] = state
    return [out[f : f + b.n] for f, b in zip(first, blocks, strict=True)]


# --- the format ------------------------------------------------------------
def pack_table(table: Table) -> bytes:
    body = zlib.compress(np.concatenate([np.diff(table.symbols, prepend=np.uint32(0)), table.frequency]).astype("<u4").tobytes(), 1)
    return MAGIC + struct.pack("<QI", len(body), zlib.crc32(body)) + body


def pack_block(block: Block, part: int, before: int, keys: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    arrays = (keys.astype("<i8"), nulls.astype("u1"), lengths.astype("<i8"), block.states.astype("<u8"), block.read.astype("<i8"), block.words.astype("<u4"))
    body = b"".join(a.tobytes() for a in arrays)
    head = struct.pack(HEADER, 0, len(body), part, before, len(keys), block.n, block.lanes, -(-block.n // block.lanes), len(block.read), len(block.words), zlib.crc32(ids.astype("<u4")))[4:]
    return struct.pack("<I", zlib.crc32(body, zlib.crc32(head))) + head + body


def pack_file(keys: np.ndarray, nulls: np.ndarray, ids: np.ndarray, offsets: np.ndarray, part: int, before: int) -> bytes:
    """A file of whole documents: ``offsets`` are those of the documents in ``ids``, ``before`` the ids of the part in earlier files."""
    table = table_of(ids)
    cuts = [0]
    while cuts[-1] < len(keys):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(offsets, offsets[cuts[-1]] + BLOCK_IDS, "left"))))
        cuts[-1] = min(cuts[-1], len(keys))
    bounds, made = offsets[cuts], [pack_table(table)]
    for i, block in enumerate(encode_blocks(ids, bounds, table)):
        a, b = cuts[i], cuts[i + 1]
        made.append(pack_block(block, part, before + int(bounds[i]), keys[a:b], nulls[a:b], np.diff(offsets[a : b + 1]), ids[bounds[i] : bounds[i + 1]]))
    return b"".join(made)


class Stored(NamedTuple):
    part: int
    before: int
    keys: np.ndarray
    nulls: np.ndarray
    lengths: np.ndarray
    block: Block
    crc: int


def unpack_file(content: bytes) -> tuple[Table, list[Stored]]:
    """Table and blocks of a file, checked against their checksums."""
    if content[:4] != MAGIC:
        raise ValueError("not a token file")
    size, crc = struct.unpack_from("<QI", content, 4)
    body, at = content[16 : 16 + size], 16 + size
    if len(body) < size or zlib.crc32(body) != crc:
        raise ValueError("a frequency table fails its checksum")
    numbers = np.frombuffer(zlib.decompress(body), "<u4")
    half = len(numbers) // 2
    frequency = numbers[half:]
    table = Table(np.cumsum(numbers[:half], dtype=np.uint32), frequency, (np.cumsum(frequency) - frequency).astype(np.uint32))
    found = []
    while len(content) - at > 1:  # what is left over at the end is the writer's line end
        if len(content) - at < struct.calcsize(HEADER):
            raise ValueError("a block is cut short")
        crc, size, part, before, docs, n, lanes, steps, points, words, ids_crc = struct.unpack_from(HEADER, content, at)
        end = at + struct.calcsize(HEADER) + size
        if end > len(content) or zlib.crc32(memoryview(content)[at + 4 : end]) != crc:
            raise ValueError("a block fails its checksum")
        at += struct.calcsize(HEADER)
        arrays = []
        for kind, count in (("<i8", docs), ("u1", docs), ("<i8", docs), ("<u8", points * lanes), ("<i8", points), ("<u4", words)):
            arrays.append(np.frombuffer(content, kind, count, at))
            at += arrays[-1].nbytes
        keys, nulls, lengths, states, read, stream = arrays
        found.append(Stored(part, before, keys, nulls, lengths, Block(n, lanes, states.reshape(points, lanes).astype(U), read, stream), ids_crc))
    return table, found


def decode_file(content: bytes) -> Iterator[tuple[Stored, np.ndarray]]:
    """Each block with its ids, checked against their checksum."""
    table, stored = unpack_file(content)
    for s, ids in zip(stored, decode_blocks([s.block for s in stored], table), strict=True):
        if zlib.crc32(ids.astype("<u4")) != s.crc:
            raise ValueError("decoded ids fail their checksum")
        yield s, ids


# --- tables and files ------------------------------------------------------
def write_tokens(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = END_ID) -> None:
    """Write the ids of all texts into files under ``path``, in ascending order of the key.

    A null key comes first and stays null; rows of one key follow by a hash of
    their texts, then by the texts.  A null text is an empty one, which has the end id only
    (nothing, without an end id).  Equal rows are written one by one; an empty
    table gives a folder without ids.  The key is stored as a 64-bit number.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("copy", F.xxhash64("text"))
    dealt = rows.repartitionByRange("key", "copy").sortWithinPartitions("key", "copy", "text")
    schema = pa.schema([("file", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table, part, before = library_encoder(tokenizer), known(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def file() -> pa.RecordBatch:
            nonlocal before
            keys, nulls, ids, sizes = (np.concatenate(c) for c in zip(*held, strict=True))
            content = pack_file(keys, nulls, ids, np.r_[0, np.cumsum(sizes)], part, before)
            before += len(ids)
            held.clear()
            return W.record_batch(schema, [pa.array([content], pa.binary())])

        for rows in W.texts(batches, "text", SLICE_BYTES):
            ids, offsets = ids_of_texts(rows.data, rows.offsets, encoder, table, end_id)
            column = rows.rows.column(0)
            held.append((column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False), ids, np.diff(offsets)))
            if sum(len(h[2]) for h in held) >= FILE_IDS:
                yield file()
        if held and sum(len(h[0]) for h in held):
            yield file()

    files = dealt.select("key", "text").mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """``(part, part_start)``: the ids before each part, from the headers of its blocks; one row per part."""
    schema = pa.schema([("part", pa.int64()), ("ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                _, stored = unpack_file(content.as_py())
                if stored:
                    yield W.record_batch(schema, [[stored[0].part], [sum(s.block.n for s in stored)]])

    totals = _contents(spark, path).mapInArrow(run, "part bigint, ids bigint").groupBy("part").agg(F.sum("ids").alias("ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("part_start"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(key, start, ids)`` of each document: the number of ids before it in all files, and its ids as 32-bit numbers on end."""
    schema = pa.schema([("key", pa.int64()), ("part", pa.int64()), ("before", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for s, ids in decode_file(content.as_py()):
                    at = np.r_[0, np.cumsum(s.lengths)]
                    data = pa.BinaryArray.from_buffers(pa.binary(), len(s.keys), [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(ids.astype("<u4").tobytes())])
                    yield W.record_batch(schema, [pa.array(s.keys, mask=s.nulls.astype(bool)), np.full(len(s.keys), s.part), s.before + at[:-1], data])

    found = _contents(spark, path).mapInArrow(run, "key bigint, part bigint, before bigint, ids binary")
    starts = staged(part_starts(spark, path), "token-parts")
    # The ids stay where they are decoded, unless there are too many parts to send along.
    starts = F.broadcast(starts) if starts.count() <= SENT_PARTS else starts
    return found.join(starts, "part").select("key", (F.col("part_start") + F.col("before")).alias("start"), "ids")


def checksum(ids: Column) -> Column:
    """Unsigned CRC-32 of ids as `read_tokens` gives them."""
    return F.crc32(ids)
