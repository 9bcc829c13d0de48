"""The registered queries over the smallest tables: contract columns, row counts, SQL or brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tidebars.llm import queries

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    made = {}

    def rows(number):
        name = next(q for q in queries.QUERIES if q.startswith(f"op{number}_"))
        if name not in made:
            made[name] = queries.QUERIES[name](spark, sf_dir).collect()
        return made[name]

    return rows


def test_registered():
    names = {f"op{n}_" for n in range(1, 14)}
    assert names == {re.match(r"op\d+_", q)[0] for q in queries.QUERIES if q != "pipeline"}
    assert set(queries.QUERIES) <= set(entry.queries()) and "pipeline" in queries.QUERIES


def test_base_measures(run, tables):
    docs = {r["doc_id"]: r["text"] for r in tables("documents").collect()}
    got = run(1)
    assert len(got) == len(docs)
    for r in got:
        w = SPACED.findall(docs[r["doc_id"]])
        runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        twice = {j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(twice))
    labels = {r["doc_id"]: r["quality"] for r in tables("labels").collect()}
    good = [r for r in got if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    bad = [r for r in got if labels.get(r["doc_id"]) == 0]
    assert sum(r["kept"] for r in good) >= 0.97 * len(good) and sum(r["kept"] for r in bad) <= 0.1 * len(bad)


def test_lines_and_pieces(run, tables):
    n = tables("documents").count()
    assert len(run(2)) == len(run(3)) == n
    assert all(r["n_removed"] <= r["n_lines"] for r in run(2)) and any(r["n_removed"] for r in run(2))
    assert all(r["round_trip"] and len(r["ids"]) == r["n_ids"] for r in run(3))


def test_fingerprints(run, tables):
    got = run(4)
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in got}
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert len(got) == tables("documents").count()
    assert all(r["component_id"] == find(r["doc_id"]) and re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in got)


def test_repeated_windows(run, tables):
    words = {r["doc_id"]: SPACED.findall(r["text"]) for r in tables("documents").collect()}
    first = {}
    for k in sorted(words):
        for i in range(len(words[k]) - 49):
            first.setdefault(tuple(words[k][i : i + 50]), k)
    for r in run(5):
        w = words[r["doc_id"]]
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < r["doc_id"] for j in range(i, i + 50)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize(("number", "label"), [(6, "toxic"), (8, "quality")])
def test_scores(run, tables, number, label):
    labels = {r["doc_id"]: r[label] for r in tables("labels").collect()}
    got = run(number)
    assert len(got) == tables("documents").count()
    least = 0.5 if number == 6 else 0.3
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    right = [r["predicted"] == labels[r["doc_id"]] for r in got if r["doc_id"] in labels]
    assert sum(right) >= 0.85 * len(right)


def test_archives(spark, sf_dir, run):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = con.execute(queries.SQL["op7_legacy_archives"]).fetchall()
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(tuple(r[n] for n in names) for r in run(7)) == Counter(want)


def test_hits(run, tables):
    def words(text):
        return LETTERS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = {}
    for r in tables("benchmark").collect():
        w = words(r["text"])
        for i in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(r["item_id"]))
    sizes, docs = {len(w) for w in windows}, {r["doc_id"]: words(r["text"]) for r in tables("documents").collect()}
    for r in run(9):
        w, hit, names = docs[r["doc_id"]], set(), set()
        for i in range(len(w)):
            for size in sizes:
                found = windows.get(tuple(w[i : i + size]), ())
                if found and i + size <= len(w):
                    hit.update(range(i, i + size))
                    names |= found
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(names), digest, bool(hit))


def test_main_texts(run, tables):
    import html

    pages = {(r["page_id"], r["url"]): r["html"] for r in tables("pages").collect()}
    for r in run(10):
        body = re.search(r"<article>(.*?)(?:</article>|$)", pages[(r["page_id"], r["url"])], re.S)[1]
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", body))
        assert r["text"] == " ".join(html.unescape(body).split()) and r["n_chars"] == len(r["text"])
