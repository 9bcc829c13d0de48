"""Repeated runs of lines against brute force over all pairs of lines: windows take each run that stood before, chunks nearly each."""

from __future__ import annotations

import hashlib
import random
import struct

import corpus_pipeline
import pytest
import xxhash

from tidebars.llm import line_dedup, queries


def expected(rows):
    """Lines that stay, per key; keys are unique."""
    first, out = {}, {}
    for k, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        lines, gone = (t or "").split("\n"), set()
        for i in range(len(lines) - 1):
            pair = (lines[i], lines[i + 1])
            if any(x.strip() for x in pair):
                where, at = first.setdefault(pair, (k, i))
                if where != k or i >= at + 2:
                    gone |= {i, i + 1}
        out[k] = [x for i, x in enumerate(lines) if i not in gone]
    return out


@pytest.fixture(scope="module")
def short_rows(prose):
    """Documents of 1 to 8 lines in which passages of 2 to 5 lines come again, at any place."""
    rng, passages = random.Random(8), [prose(12 * n, 500 + i).split("\n") for i, n in enumerate([2, 2, 3, 3, 4, 5])]
    rows = []
    for k in range(60):
        lines = prose(12 * rng.randint(1, 4), 1000 + k).split("\n")
        at = rng.randint(0, len(lines))
        rows.append((k, "\n".join(lines[:at] + (rng.choice(passages) if k % 3 else []) + lines[at:])))
    return [*rows, (100, None), (101, ""), (102, "\n\n\n\n"), (103, "\n\n\n\n"), (104, "a\na\na\na\na"), (105, "b\na\na"), (106, "x"), (107, "x"), (None, rows[1][1])]


def test_all_runs_go(table, short_rows):
    want = expected(short_rows)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(table(short_rows, clash=True), parts_of=line_dedup.windows_of).collect()}
    for k, t in short_rows:
        assert got[k]["text"] == (None if t is None else "\n".join(want[k]))
        assert (got[k]["n_lines"], got[k]["n_removed"]) == (len((t or "").split("\n")), len((t or "").split("\n")) - len(want[k]))
    assert got[104]["text"] == "a\na" and got[105]["text"] == "b"
    stay = {x for k in want for x in want[k]}
    assert all(x in stay for _, t in short_rows for x in (t or "").split("\n"))


def check_chunks(rows, got, reached):
    """Lines go only where brute force over all pairs of lines lets them go, nearly all of these do, and no line is lost altogether."""
    want, gone, wanted, untouched, runs = expected(rows), 0, 0, 0, 0
    for k, t in rows:
        lines, least = (t or "").split("\n"), want[k]
        kept = (got[k] or "").split("\n") if got[k] or least else []
        gone, wanted = gone + len(lines) - len(kept), wanted + len(lines) - len(least)
        both = iter(kept)
        assert all(any(x == y for y in both) for x in least)  # what brute force keeps is kept, in order
        if len(least) < len(lines):
            runs, untouched = runs + 1, untouched + (kept == lines)
    stay = {x for t in got.values() for x in (t or "").split("\n")}
    assert all(x in stay for _, t in rows for x in (t or "").split("\n"))
    assert gone >= reached * wanted and untouched <= (1 - reached) * runs
    return gone / max(wanted, 1)


def test_stage(spark, table, short_rows):
    docs = table(short_rows, clash=True)
    edited = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    assert edited.columns == docs.columns
    found = {r["doc_id"]: r for r in edited.collect()}
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in found.values())
    check_chunks(short_rows, {k: r["text"] for k, r in found.items()}, 0.9)  # six passages only
    plan = edited._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_recall_on_the_tables(spark):
    """Of all lines in repeated runs of two lines or more, nearly all go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, parts_of=line_dedup.chunkings_of).collect()}
    assert check_chunks(rows, got, 0.95) > 0.97


def chunks(spark, lines):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("\n".join(lines),)], "text string").select(line_dedup.chunkings_of(F.split("text", "\n", -1)).alias("c")).first()
    return {(r["start"], r["lines"]) for r in row["c"]}


def test_chunks_are_those_of_64_plain_chunkings(spark):
    rng, mask = random.Random(2), (1 << 64) - 1
    lines = [f"line {rng.randint(0, 30)}" for _ in range(60)] + ["", "", "x", *["same"] * 9]
    alike = [any(0 <= j < len(lines) and lines[j] == x for j in (i - 1, i + 1)) for i, x in enumerate(lines)]
    h = [xxhash.xxh64_intdigest(struct.pack("<i", i % 4 if a else 0), xxhash.xxh64_intdigest(struct.pack("<Q", xxhash.xxh64_intdigest(x.encode(), 42)), 42)) for i, (x, a) in enumerate(zip(lines, alike))]
    marked = lambda v, m: xxhash.xxh64_intdigest(struct.pack("<i", m), xxhash.xxh64_intdigest(struct.pack("<Q", v), 42))
    want = set()
    for bit in range(64):
        at = 0
        for i in range(len(lines)):
            if i == len(lines) - 1 or ((marked(h[i], 1) | marked(h[i + 1], 2)) & mask) >> bit & 1:
                if 2 <= i + 1 - at <= line_dedup.MAX_LINES:
                    want.add((at, i + 1 - at))
                at = i + 1
    assert chunks(spark, lines) == want


def test_inserted_lines_move_no_boundaries(spark):
    lines = [f"line {i}" for i in range(50)]
    before, after = chunks(spark, lines), chunks(spark, [*lines[:20], "new", "and new", *lines[20:]])
    assert {(s, n) for s, n in before if s + n < 20} <= after
    assert {(s + 2, n) for s, n in before if s > 20} <= after


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want, texts = expected(rows), dict(rows)
    edited = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), parts_of=line_dedup.chunkings_of).collect()}
    gone = 0
    for r in queries.QUERIES["op2_line_dedup"](spark, sf_dir).collect():
        k = r["doc_id"]
        assert r["kept_sha256"] == hashlib.sha256((edited[k] or "").encode()).hexdigest()
        assert r["n_lines"] == len((texts[k] or "").split("\n")) and r["n_removed"] <= r["n_lines"] - len(want[k])
        gone += r["n_removed"]
    assert gone >= 0.95 * sum(len((t or "").split("\n")) - len(want[k]) for k, t in rows)
