"""The divergence audit against plain loops."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidebars.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def expected(rows, min_docs=3, top=200):
    """Rows of (text, lang, source); nulls are empty."""
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))) for t, _, _ in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        mine = [(r[2], w) for r, w in zip(rows, words, strict=True) if r[1] == lang]
        docs = Counter(t for _, w in mine for t in w)
        kept = sorted(t for t in docs if docs[t] >= min_docs)
        by_source = defaultdict(Counter)
        for s, w in mine:
            by_source[s].update({t: n for t, n in w.items() if t in set(kept)})
        total = sum(by_source.values(), Counter())

        def share(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in by_source.items()}, share(total)
        for s in p:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in p if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if by_source[s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", item, -v, i) for i, (v, _, item) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", item, -v, i) for i, (v, _, item) in enumerate(sorted(terms)[:top], 1)}
    return out


@pytest.fixture(scope="module")
def rows(prose):
    rng, made = random.Random(3), []
    for k in range(90):
        own = " ".join(rng.choice(["Alpha", "beta", "gammaé", "ÉTÉ", "x1y", "delta"]) for _ in range(rng.randint(0, 12)))
        made.append((own + " " + prose(rng.randint(0, 60), k % 20), rng.choice(["en", "de", None, ""]), rng.choice(["s0", "s0", "s0", "s1", "s2", None, "é", "z"])))
    return [*made, *[("only here", "fr", f"f{i}") for i in range(2)], (None, "it", "quiet"), ("", "it", None), ("same same", "nl", "a"), ("same same", "nl", "a"), ("same same", "nl", "b"), (None, "nl", "c")]


def frame(spark, rows):
    extra = "text string, lang string, source string, doc_id bigint, term string, counts string, total bigint, slice int, n bigint"
    return spark.createDataFrame([(*r, None, "t", "c", 1, 2, 3) for r in rows], extra)


@pytest.mark.parametrize("entries", [1 << 20, 40])
def test_brute_force(spark, rows, entries, monkeypatch):
    monkeypatch.setattr(divergence.pair_divergence, "__defaults__", (entries,))
    got = divergence.audit(frame(spark, rows))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == expected(rows)


def test_top_terms_and_min_docs(spark, rows):
    got = divergence.audit(frame(spark, rows), min_docs=1, top_terms=2)
    assert {tuple(r) for r in got.collect()} == expected(rows, 1, 2)


def test_empty(spark):
    assert divergence.audit(frame(spark, [])).count() == 0


def test_large_counts_stay_exact():
    counts, total = np.array([3, 9_300_000_000, 12_345_678_901_234]), 98_765_432_109_876_543
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


def test_runs_are_few():
    """Ordered by equal counts, a column has as many runs as it has counts, or one more."""
    rng = np.random.default_rng(1)
    term = np.arange(5_000)
    n = rng.integers(1, 4, 5_000)
    order = divergence.vocabulary_order(term, np.zeros(5_000, np.int64), n, 6_000, 1)
    place = np.empty(6_000, np.int64)
    place[order] = np.arange(6_000)
    at = np.argsort(place[term])
    ends, counts = divergence.run_length(place[term][at], n[at], np.arange(6_001))
    assert counts.tolist() == [0, 1, 2, 3] and ends[-1] == 6_000
