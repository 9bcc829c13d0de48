"""Token files: ids against the library, exact round trips, damage."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidebars.llm import queries, token_files
from tidebars.series import new_path

PATH = queries.TOKENIZER_PATH


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(n=3000):
    rng = random.Random(5)
    bits = ["Äpfel", "×", "÷", "ñandú", "ȿ", "ɀ", "Ω", "a", "Word", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "''", "don't", "é", "中文", " ", "　", " ", "\x85", "123", "4", ".", "...", ",", "!", "-", "\x00", "\x1c", "😀", "_", "x'll", "<|endoftext|>", "\r\n", "ß", "\x0b"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("path", [PATH, PATH.replace("byte_bpe_50k", "word_bpe_49k")])
def test_ids_equal_the_library(path):
    texts, encoder, library = odd_texts(), token_files.library_encoder(path), Tokenizer.from_file(path)
    assert (encoder.whole is not None) == (path == PATH)
    data = [t.encode() for t in texts]
    offsets = np.r_[0, np.cumsum([len(d) for d in data])]
    ids, at = token_files.ids_of_texts(np.frombuffer(b"".join(data), np.uint8), offsets, encoder, token_files.Known(), 2)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*library.encode(t, add_special_tokens=False).ids, 2], t


def test_known_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN_PIECES", 5)
    table, asked = token_files.Known(), []

    def encode(new):
        asked.extend(new.to_pylist())
        return np.array([x for p in new.to_pylist() for x in [7] * len(p)], np.uint32), np.array([len(p) for p in new.to_pylist()])

    for i in range(50):
        pieces = [f"a{i}", "b", f"c{i}"]
        begin, end, ids = table.look_up(pa.array(pieces), encode)
        assert [ids[b:e].tolist() for b, e in zip(begin, end, strict=True)] == [[7] * len(p) for p in pieces]
        assert len(table.pieces) < 10
    assert asked.count("b") < 30


@pytest.mark.parametrize("sizes", [[1], [5, 16, 17, 1], [16_384, 100, 40_000, 1], [300_000], [1] * 50])
@pytest.mark.parametrize("symbols", [1, 2, 50_000])
def test_blocks_round_trip(sizes, symbols):
    rng = np.random.default_rng(sum(sizes) + symbols)
    ids = np.minimum(rng.zipf(1.3, sum(sizes)), symbols).astype(np.uint32)
    bounds, table = np.r_[0, np.cumsum(sizes)], token_files.table_of(ids)
    assert table.frequency.sum() == 1 << token_files.PRECISION and table.frequency.min() >= 1
    made = token_files.encode_blocks(ids, bounds, table)
    for i, got in enumerate(token_files.decode_blocks(made, table)):
        assert np.array_equal(got, ids[bounds[i] : bounds[i + 1]])
    one = [token_files.decode_blocks([b], table)[0] for b in made]  # each alone
    assert np.array_equal(np.concatenate(one), ids)


def test_size_is_near_the_entropy():
    ids = np.minimum(np.random.default_rng(2).zipf(1.4, 1 << 20), 50_000).astype(np.uint32)
    _, counts = np.unique(ids, return_counts=True)
    entropy = -(counts * np.log2(counts / len(ids))).sum() / 8
    content = token_files.pack_file(np.arange(64), np.zeros(64, bool), ids, np.arange(65) * 16_384, 0, 0)
    assert len(content) < 1.07 * entropy


def test_many_rare_symbols():
    ids = np.r_[np.arange(700_000), np.zeros(1000)].astype(np.uint32)
    table = token_files.table_of(ids)
    assert table.frequency.sum() == 1 << token_files.PRECISION and table.frequency.min() >= 1
    with pytest.raises(ValueError, match="different ids"):
        token_files.table_of(np.arange(1 << 20 | 1, dtype=np.uint32))


def test_damage_is_found():
    ids = np.arange(60_000, dtype=np.uint32) % 977
    content = token_files.pack_file(np.arange(6), np.zeros(6, bool), ids, np.arange(7) * 10_000, 3, 8)
    assert np.array_equal(np.concatenate([i for _, i in token_files.decode_file(content + b"\n")]), ids)
    for at in (0, 30, len(content) // 2, len(content) - 1):
        hurt = content[:at] + bytes([content[at] ^ 1]) + content[at + 1 :]
        with pytest.raises(ValueError):
            list(token_files.decode_file(hurt))
    with pytest.raises(ValueError):
        list(token_files.decode_file(content[:-1000]))


@pytest.mark.parametrize("small", [False, True])
def test_files(spark, table, odd_rows, library, small, monkeypatch):
    if small:
        for name, value in (("BLOCK_IDS", 40), ("FILE_IDS", 300), ("SLICE_BYTES", 600)):
            monkeypatch.setattr(token_files, name, value)
    rows = [*odd_rows, *[(1000 + i, t) for i, t in enumerate(odd_texts(200))]]
    path = new_path(spark, "tokens")
    token_files.write_tokens(table(rows, clash=True).repartition(5), path, PATH)
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    ids = [np.frombuffer(r["ids"], "<u4").tolist() for r in got]
    assert [r["start"] for r in got] == np.r_[0, np.cumsum([len(i) for i in ids])][:-1].tolist()
    keys = [r["key"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    want = sorted((k is not None, k or 0, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for k, t in rows)
    assert sorted((k is not None, k or 0, i) for k, i in zip(keys, ids, strict=True)) == want


def test_empty(spark, table):
    path = new_path(spark, "tokens")
    token_files.write_tokens(table([]), path, PATH)
    assert token_files.read_tokens(spark, path).count() == 0


def test_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    start, want = 0, []
    for r in docs:
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = queries.QUERIES["op12_token_files"](spark, sf_dir)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in got.collect()) == want
