"""SimHash near-duplicates, found by ball hashing that meets in the middle.

Two fingerprints that differ in at most ``2 r`` bits have a common variant,
one that differs in at most ``r`` bits from each.  So every distinct
fingerprint emits all its variants within ``r`` bits, and fingerprints that
share a variant are linked.  (By the triangle inequality a shared variant
never joins fingerprints further apart; the links are counted bit by bit all
the same.)

The shuffle is on the variants.  A variant's bucket is made of the parities of
``b`` groups of its bits; flipping one bit changes one parity.  A fingerprint's
variants thus lie in ``1 + b + b(b-1)/2`` buckets at most.  ``b`` grows with the
number of fingerprints so that a bucket holds about ``VARIANTS_PER_BUCKET``
variants at every size.  Fingerprints are distinct and flips move between buckets,
so neither copies nor a cloud of near copies make a bucket large.

Buckets that agree in their first parities are one task's: a fingerprint is sent
once to each such part that has a variant of it, in the bytes it fills, and the
task spells the variants out bucket by bucket.  A part has about
``PRINTS_PER_PART`` fingerprints at most, many times a bucket's, so a fingerprint
goes to fewer parts than buckets.

Within a bucket, the fingerprints around one variant are linked to the
smallest of them, and of these links only a forest is kept: as many as connect
what all of them connect.  A fingerprint adds one link to a bucket at most,
however many others are close to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm import words as W
from tidebars.llm.components import components, forest, trees
from tidebars.llm.rows import packed, unpacked
from tidebars.llm.staging import staged

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
VARIANTS_PER_BUCKET = 1 << 22
#: Fingerprints that a task holds at once; parts there are at least, for tasks to work side by side; rows that `packed_parts` sorts at once.
PRINTS_PER_PART, LEAST_PARTS, SENT_AT_ONCE = 1 << 21, 256, 1 << 20
NO_KEY = 2**63 - 1

U = np.uint64


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, length: int = SHINGLE_WORDS) -> np.ndarray:
    """One 64-bit fingerprint per row of a batch of texts (see `fingerprints`)."""
    data, rows = W.lower_ascii(data), len(offsets) - 1
    table = W.space_separated()
    found = W.find_words(data, offsets, table)
    if not len(found.starts):
        return np.zeros(rows, U)
    # Write the words again with one space after each.
    sizes = found.ends - found.starts + 1
    starts = np.cumsum(sizes) - sizes
    joined = np.full(int(sizes.sum()), 0x20, np.uint8)
    spaces = np.zeros(len(joined), bool)
    spaces[starts + sizes - 1] = True
    joined[~spaces] = data[table[data]]
    n = found.counts
    per_row = np.where(n > 0, np.maximum(n - length + 1, 1), 0)
    row = np.repeat(np.arange(rows), per_row)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    from_word = found.first[:-1][row] + nth
    to_word = from_word + np.minimum(length, n[row]) - 1
    view, hashed = memoryview(joined), xxhash.xxh64_intdigest
    ends = starts + sizes - 1
    h = np.fromiter((hashed(view[a:b], SEED) for a, b in zip(starts[from_word].tolist(), ends[to_word].tolist(), strict=True)), U, len(row))
    ones = np.zeros((rows, 64), np.int64)
    bits_of = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
    lanes = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, rows, 1024):  # counts of each byte value per row, a bounded number of rows at a time
        to = min(rows, at + 1024)
        a, b = np.searchsorted(row, [at, to])
        for lane in range(8):
            counts = np.bincount((row[a:b] - at) * 256 + lanes[a:b, lane], minlength=(to - at) * 256).reshape(-1, 256)
            ones[at:to, lane * 8 : lane * 8 + 8] = np.rint(counts @ bits_of)
    bits = 2 * ones > per_row[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().astype(U)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(key, fp bigint, copy bigint)``: the SimHash of every whole text, as signed 64 bits, and a hash of the text.

    Words are what white space separates, with A-Z in lower case.  Features are
    the runs of ``shingle_words`` words joined by one space, repeats counted;
    a text of fewer words is one feature, one without words (null, empty) has
    fingerprint zero.  A bit is set if it is set in more than half of the
    features' XXH64 values (seed 42).  Repeated rows each get their row.
    """
    made = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("copy"))
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("copy", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.texts(batches, "text"):
            fp = fingerprints_of(part.data, part.offsets, shingle_words)
            yield W.record_batch(schema, [part.rows.column(0).cast(pa.int64()), fp.view(np.int64), part.rows.column(2)])

    return made.mapInArrow(run, "key bigint, fp bigint, copy bigint").withColumnRenamed("key", key)


def _parity_masks(bits: int) -> np.ndarray:
    """Bit groups of the bucket number: bit i belongs to group i mod ``bits``."""
    return np.array([sum(1 << i for i in range(g, 64, bits)) for g in range(bits)], U)


def bucket_of(fp: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(fp.shape, np.int64)
    for g, mask in enumerate(_parity_masks(bits)):
        out |= (np.bitwise_count(fp & mask).astype(np.int64) & 1) << g
    return out


def flips(radius: int, width: int = 64) -> np.ndarray:
    """Every mask of at most ``radius`` of the lowest ``width`` bits."""
    return np.array([sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(width), k)], U)


def links_around(pieces: list[tuple[np.ndarray, np.ndarray]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, smaller) that connect what shares a variant; ``pieces`` are fingerprints with the flips that make their variants."""
    none = np.zeros(0, U)
    variants = np.empty(sum(len(some) * len(masks) for some, masks in pieces), U)
    at = 0
    for some, masks in pieces:
        size = len(some) * len(masks)
        np.bitwise_xor(some[:, None], masks[None, :], out=variants[at : at + size].reshape(len(some), len(masks)))
        at += size
    # Most variants are alone: a sorted copy shows which are not, a table of their low bits finds these.
    ordered = np.sort(variants)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return none, none
    table = np.zeros(1 << 24, bool)
    table[(W.mix(twice) & U((1 << 24) - 1)).astype(np.int64)] = True
    owners, shared, at = [], [], 0
    for fps, masks in pieces:
        width = len(masks)
        for a in range(0, len(fps), max(1, (1 << 20) // width)):
            some = fps[a : a + max(1, (1 << 20) // width)]
            v = variants[at + a * width : at + (a + len(some)) * width]
            near = np.flatnonzero(table[(W.mix(v) & U((1 << 24) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(twice, v[near]), len(twice) - 1)
            hit = twice[place] == v[near]
            owners.append(some[near[hit] // width])
            shared.append(place[hit])
        at += len(fps) * width
    owner, group = np.concatenate(owners), np.concatenate(shared)
    order = np.lexsort((owner, group))
    owner, group = owner[order], group[order]
    begins = np.r_[True, group[1:] != group[:-1]]
    least = owner[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
    apart = np.bitwise_count(owner ^ least)
    keep = (apart > 0) & (apart <= 2 * radius)
    owner, least = owner[keep], least[keep]
    kept = forest(owner, least)
    return owner[kept], least[kept]


def links_in(fps: np.ndarray, part: int, bits: int, radius: int, width: int = 64, part_bits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, smaller) that connect the fingerprints that share a variant in a part: all buckets whose first ``part_bits`` bits are ``part``."""
    part_bits = bits if part_bits is None else part_bits
    masks = flips(radius, width)
    kinds = bucket_of(masks, bits)
    order = np.argsort(kinds, kind="stable")
    masks = masks[order]
    reach, first = np.unique(kinds[order], return_index=True)
    ends = np.r_[first[1:], len(masks)]
    own = bucket_of(fps, bits)
    order = np.argsort(own, kind="stable")
    fps, own = fps[order], own[order]
    found = []
    for rest in range(1 << (bits - part_bits)):
        wanted = reach ^ (part | rest << part_bits)
        lo, hi = np.searchsorted(own, wanted, "left"), np.searchsorted(own, wanted, "right")
        found.append(links_around([(fps[a:b], masks[c:d]) for a, b, c, d in zip(lo, hi, first, ends, strict=True) if b > a], radius))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(found) > 1:
        kept = forest(a, b)
        a, b = a[kept], b[kept]
    return a, b


def bytes_of(width: int) -> int:
    """Bytes that a fingerprint is sent in; the 32 bits or fewer above ``width`` go with the part."""
    return 8 if width < 32 else -(-width // 8)


def packed_parts(fps: np.ndarray, reach: np.ndarray, bits: int, part_bits: int, width: int = 64) -> tuple[np.ndarray, pa.Array]:
    """Parts that hold variants of some of the fingerprints, and of each part these, in `bytes_of` bytes each.

    What a fingerprint has above ``width`` bits stands in its parts' numbers, above 32 bits.
    """
    part = bucket_of(fps, bits) & ((1 << part_bits) - 1)
    if 32 <= width < 64:
        part |= (fps >> U(width)).astype(np.int64) << 32
    parts = (part[:, None] ^ reach[None, :]).ravel()
    order = np.argsort(parts, kind="stable")
    parts, first = np.unique(parts[order], return_index=True)
    each = bytes_of(width)
    data = fps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :each][order // len(reach)]
    offsets = (np.r_[first, len(order)] * each).astype(np.int32)
    return parts, pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def unpacked_part(rows: pa.ChunkedArray, part: int, width: int = 64) -> np.ndarray:
    """The fingerprints of a part from its rows of `packed_parts`."""
    each = bytes_of(width)
    data = np.frombuffer(b"".join(x.as_py() for x in rows), np.uint8).reshape(-1, each)
    made = np.zeros((len(data), 8), np.uint8)
    made[:, :each] = data
    fps = made.view("<u8").ravel().astype(U)
    return fps | U((part >> 32 & 0xFFFFFFFF) << width) if 32 <= width < 64 else fps


def links(fps: DataFrame, max_bits: int = MAX_BITS, width: int = 64, kinds: int = 1, stars: bool = False) -> DataFrame:
    """``(a, b)`` of the distinct ``fp`` column, which connect what lies within ``max_bits`` bits; parts may repeat a link.

    Each link joins two fingerprints of at most ``max_bits`` different bits, and
    any two such fingerprints are connected, though not always directly.
    ``max_bits`` is even.  Null fingerprints link nothing.  Fingerprints of
    less than 64 bits lie in the lowest ``width``; those that differ in the bits above are never linked.
    With ``stars`` each tree of a part's links is one row, ``a`` the array of all its fingerprints but the smallest, ``b``.
    """
    if max_bits % 2 or max_bits < 2:
        raise ValueError("max_bits must be a positive even number")
    radius = max_bits // 2
    distinct = fps.where("fp is not null").select("fp").distinct()
    masks = flips(radius, width)
    each = distinct.count() // kinds
    bits = min(30, max(4, math.ceil(math.log2(max(each * len(masks), 1) / VARIANTS_PER_BUCKET))))
    reached = [np.unique(bucket_of(masks, bits) & ((1 << n) - 1)) for n in range(bits + 1)]
    part_bits = next((n for n in range(bits) if kinds << n >= LEAST_PARTS and each * len(reached[n]) >> n <= PRINTS_PER_PART), bits)
    reach = reached[part_bits]
    sent = pa.schema([("part", pa.int64()), ("fps", pa.binary())])
    out = pa.schema([("a", pa.list_(pa.int64()) if stars else pa.int64()), ("b", pa.int64())])
    at_once = max(1, SENT_AT_ONCE // len(reach))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(U))
            n += len(held[-1])
            if n >= at_once:
                yield W.record_batch(sent, list(packed_parts(np.concatenate(held), reach, bits, part_bits, width)))
                held, n = [], 0
        if n:
            yield W.record_batch(sent, list(packed_parts(np.concatenate(held), reach, bits, part_bits, width)))

    def meet(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        fps = unpacked_part(table.column("fps"), part, width)
        a, b = links_in(fps, part & 0xFFFFFFFF, bits, radius, width, part_bits)
        a, b = a.view(np.int64), b.view(np.int64)
        if stars:
            names, root, _ = trees(a, b)
            order = np.argsort(root, kind="stable")  # a tree's smallest is its first
            first, n = np.unique(root[order], return_counts=True)
            rest = order[root[order] != order]
            a, b = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n - 1)].astype(np.int32)), pa.array(names[rest])), names[first]
        return pa.Table.from_batches([W.record_batch(out, [a, b])])

    found = distinct.mapInArrow(send, "part bigint, fps binary").groupBy("part")
    return found.applyInArrow(meet, f"a {'array<bigint>' if stars else 'bigint'}, b bigint")


def first_rows(prints: DataFrame, key: str, nodes: DataFrame) -> DataFrame:
    """``(fp, first)``: the first row, by key (null last) and text, of the fingerprint's component in ``nodes(node, component)``."""
    row = F.struct(F.coalesce(key, F.lit(NO_KEY)).alias("key"), "copy")
    least = prints.groupBy("fp").agg(F.min(row).alias("first"))
    grouped = least.join(nodes, least["fp"] == nodes["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    # Both sides are written, so the join is one of two plain exchanges, which Spark splits where a component is large.
    grouped = staged(grouped, "grouped")
    roots = staged(grouped.groupBy("root").agg(F.min("first").alias("first")), "roots")
    return grouped.select("fp", "root").join(roots.hint("merge"), "root").select("fp", "first")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """``(key, fp, component)`` per row: the smallest key reachable over links, itself included.

    Rows of one fingerprint are one node, so copies cost nothing; a text
    without words has fingerprint zero and is linked like any other.  A null key
    gets its row and takes part in links, but is never the smallest; a group of
    nothing but null keys has a null component.  Empty tables give empty results.
    """
    prints = staged(fingerprints(docs, key, text, shingle_words), "fingerprints")
    least = F.nullif(F.col("first.key"), F.lit(NO_KEY)).alias("component")
    nodes = components(links(prints, max_bits))
    return prints.join(first_rows(prints, key, nodes), "fp").select(key, "fp", least)


def hex_fingerprint(fp: str = "fp"):
    """The fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest key.

    Of rows with equal keys in a group, that with the smaller hash of its text
    stays, and of equal rows one; a null key comes after all others.  Columns
    and values are those of ``docs``.
    """
    prints = staged(fingerprints(docs, key, text), "fingerprints")
    nodes = components(links(prints, MAX_BITS))
    firsts = first_rows(prints, key, nodes).select(F.col("first.key").alias("_k"), F.col("first.copy").alias("_c")).distinct()
    stamped = docs.select(packed(docs.columns), F.coalesce(F.col(key), F.lit(NO_KEY)).alias("_k"), F.xxhash64(text).alias("_c"))
    return unpacked(stamped.join(firsts, ["_k", "_c"], "left_semi").dropDuplicates(["_k", "_c"]), docs.columns)
