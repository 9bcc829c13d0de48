"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text's features are its words, its pairs of neighbouring words, and the same
for the words' shapes (capitals, length, the mark at the end), each hashed into
one of ``2 ** bits`` places; a pair of equal words is one feature for all
words.  A feature's value is its share in the text's n-grams of that kind, so
the score of a text is a bias plus mean weights: a sparse dot product that is
summed as the words come.

Training rows are dealt into a fixed number of shards; each shard runs FTRL
with L1 and L2 over its rows in the order of a hash, and the shards' weights
are averaged.  What the driver and the scoring tasks hold is one vector of
``2 ** bits`` weights, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm import words as W
from tidebars.llm.labelled import SAMPLE_ROWS, training_rows

BITS = 18
SHARDS = 4
EPOCHS = 10
ALPHA, BETA, L1, L2 = 5.0, 0.01, 1e-6, 1e-5

KINDS = 4


def shapes(data: np.ndarray, words: W.Words) -> np.ndarray:
    """A small number per word: capitals only, first letter capital, length class, last byte if it is a mark."""
    n = len(words.starts)
    if not n:
        return np.zeros(0, W.U)
    upper = np.r_[0, np.cumsum((data >= 0x41) & (data <= 0x5A))]
    lower = np.r_[0, np.cumsum((data >= 0x61) & (data <= 0x7A))]
    caps, small = upper[words.ends] - upper[words.starts], lower[words.ends] - lower[words.starts]
    mark = np.ones(256, bool)
    mark[0x30:0x3A] = mark[0x41:0x5B] = mark[0x61:0x7B] = mark[0x80:] = False
    last = data[words.ends - 1]
    size = np.searchsorted(np.array([1, 2, 4, 8, 16, 32]), words.ends - words.starts)
    case = np.where(caps == 0, 0, np.where(small == 0, 1, 2))
    return (((size * 3 + case) << 8) + np.where(mark[last], last, 0)).astype(W.U)


def features(part: W.Text, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of every n-gram of a batch, and the number of words per row."""
    words = W.find_words(part.data, part.offsets, W.space_separated())
    row, n = words.row(), words.counts
    pair = np.flatnonzero(W.run_rows(words, 2))
    found = []
    for kind, h in enumerate((W.word_hashes(part.data, words), shapes(part.data, words))):
        h = W.mix(h * W.U(2 * kind + 3))
        two = W.mix(h[pair] * W.U(0x9FB21C651E98DF25) + h[pair + 1])
        two[h[pair] == h[pair + 1]] = W.U(kind + 1)
        found += [(row, h, n), (row[pair], two, np.maximum(n - 1, 0))]
    rows, places, values = [], [], []
    for kind, (at, h, size) in enumerate(found):
        rows.append(at)
        places.append((W.mix(h + W.U(kind)) >> W.U(64 - bits)).astype(np.int64))
        values.append(1.0 / size[at])
    return np.concatenate(rows), np.concatenate(places), np.concatenate(values), n


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], bits: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes; the last entry is the bias."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for (at, x), y in zip(rows, labels, strict=True):
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    return weights(np.arange(size))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights learned from about ``sample`` labelled rows that aren't held out; zeros without any (score one half)."""
    chosen = training_rows(docs, labels, label, key, text, sample)
    rows = chosen.select(F.pmod(F.xxhash64(key), F.lit(SHARDS)).alias("shard"), F.xxhash64(key, text).alias("turn"), "y", F.col(text).alias("text"))
    made = pa.schema([("shard", pa.int64()), ("turn", pa.int64()), ("y", pa.int32()), ("at", pa.binary()), ("x", pa.binary())])
    out = pa.schema([("n", pa.int64()), ("w", pa.binary())])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.texts(batches, "text"):
            row, place, value, _ = features(part, bits)
            order = np.lexsort((place, row))
            row, place, value = row[order], place[order], value[order]
            new = np.r_[True, (row[1:] != row[:-1]) | (place[1:] != place[:-1])] if len(row) else np.zeros(0, bool)
            begins = np.flatnonzero(new)
            value = np.add.reduceat(value, begins) if len(begins) else value
            row, place = row[begins], place[begins].astype(np.int32)
            cut = np.searchsorted(row, np.arange(part.rows.num_rows + 1))
            at = [place[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            x = [value[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield W.record_batch(made, [part.rows.column(0), part.rows.column(1), part.rows.column(2), at, x])

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by("turn")
        bias = 1 << bits
        rows = [(np.r_[np.frombuffer(a, np.int32), bias].astype(np.int64), np.r_[np.frombuffer(x), 1.0]) for a, x in zip(table["at"].to_pylist(), table["x"].to_pylist(), strict=True)]
        w = ftrl(rows, table["y"].to_pylist(), bits)
        return pa.Table.from_batches([W.record_batch(out, [[len(rows)], [w.tobytes()]])])

    spelt = rows.mapInArrow(spell, "shard bigint, turn bigint, y int, at binary, x binary")
    shards = spelt.groupBy("shard").applyInArrow(train, "n bigint, w binary").collect()  # SHARDS rows
    total = sum(r["n"] for r in shards)
    weights = np.zeros((1 << bits) + 1)
    for r in sorted(shards, key=lambda r: (r["n"], bytes(r["w"]))):
        weights += np.frombuffer(bytes(r["w"])) * (r["n"] / total)
    return weights


def score(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score)``: probability of label 1 per row, from its whole text; a null or empty text scores by the bias."""
    bits = (len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    schema = pa.schema([("key", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for part in W.texts(batches, "text"):
            row, place, value, _ = features(part, bits)
            logit = w[-1] + np.bincount(row, w[place] * value, minlength=part.rows.num_rows)
            yield W.record_batch(schema, [part.rows.column(0), 1 / (1 + np.exp(-np.clip(logit, -35, 35)))])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key bigint, score double").withColumnRenamed("key", key)
