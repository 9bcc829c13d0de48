"""Each operator against a brute-force version on small texts, and over odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import struct
from collections import Counter
from itertools import product

import numpy as np
import pytest
import xxhash

from tidebars.llm import arc, classifier, decontaminate, html_text, line_dedup, pieces, quality_rules, simhash, staging, substrings, toxicity
from tidebars.llm import components as components_of
from tidebars.llm import words as W
from tidebars.llm.components import components

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


# SimHash


def simhash_of(text):
    w = SPACED.findall(lower(text))
    features = [" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(f.encode(), 42) for f in features]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, bits):
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in product(prints, prints):
        if (a ^ b).bit_count() <= bits:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {f: find(f) for f in prints}


@pytest.fixture(scope="module")
def corpus(prose, odd_rows):
    base = [(100 + i, prose(120, i)) for i in range(12)]
    near = [(200 + i, t.replace(" ", " x ", 1) if i % 2 else t + " end") for i, (_, t) in enumerate(base[:8])]
    shared = prose(70, 99)
    inside = [(300 + i, prose(30, 50 + i) + "\n" + shared + "\n" + prose(30 + i, 70 + i)) for i in range(6)]
    return [*odd_rows, *base, *near, *inside, (400, base[0][1]), (401, "Eare " * 200), (402, "Eare " * 150)]


def test_near_duplicates(table, corpus):
    got = simhash.near_duplicates(table(corpus, clash=True)).collect()
    prints = [simhash_of(t) for _, t in corpus]
    assert Counter((r["doc_id"], r["fp"]) for r in got) == Counter((k, signed(p)) for (k, _), p in zip(corpus, prints, strict=True))
    root = groups(set(prints), 4)
    least = {}
    for (k, _), p in zip(corpus, prints, strict=True):
        least[root[p]] = min(x for x in (least.get(root[p]), k) if x is not None) if k is not None or root[p] in least else None
    assert all(r["component"] == least[root[r["fp"] % (1 << 64)]] for r in got)


def test_links_are_whole(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    prints = {b ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 6), replace=False)) for b in base for _ in range(5)} | set(base) | {0, 1, 15, 31}
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    edges = simhash.links(df)
    assert all((r["a"] % (1 << 64) ^ r["b"] % (1 << 64)).bit_count() <= 4 for r in edges.collect())
    parts = {r["node"] % (1 << 64): r["component"] for r in components(edges).collect()}
    want = groups(prints, 4)
    sizes = Counter(want.values())
    for a, b in product(prints, prints):
        if sizes[want[a]] > 1 and sizes[want[b]] > 1:
            assert (want[a] == want[b]) == (parts[a] == parts[b])


def test_near_duplicates_dropped(table, corpus):
    docs = table(corpus, clash=True)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    prints = [(simhash_of(t), k) for k, t in corpus]
    root = groups({p for p, _ in prints}, 4)
    assert kept.count() == len(set(root.values()))
    ids = {r["doc_id"] for r in kept.collect()}
    assert {100, 1, 4} <= ids and not {400, 8, 5} & ids


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 140)}


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_components_take_few_joins_and_no_broadcast(spark, monkeypatch, block):
    """Near copies make far more links than nodes; the rounds join few of them, and never by way of the driver."""
    rng = random.Random(8)
    edges = [(100 * g + rng.randrange(30), 100 * g + rng.randrange(30)) for g in range(40) for _ in range(150)]
    plans, written = [], []

    def stage(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = staging.staged(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(components_of, "staged", stage)
    monkeypatch.setattr(components_of, "BLOCK_EDGES", block, raising=False)
    rows = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert Counter((r["node"], r["component"]) for r in rows) == Counter((x, x // 100 * 100 + min(y % 100 for e in edges for y in e if y // 100 == x // 100)) for x in {y for e in edges for y in e})
    assert not any("Broadcast" in p for p in plans)
    assert sum("Join" in p for p in plans) <= (0 if block > len(edges) else 8)
    assert len(written) == 2 or block < len(edges)


def test_stars_of_links(spark):
    """Arrays of nodes count as links of each to the same, and connect what single links do."""
    made = spark.createDataFrame([([5, 7], 3), ([9], 7), ([12], 11)], "a array<bigint>, b bigint")
    assert {r["node"]: r["component"] for r in components(made).collect()} == {3: 3, 5: 3, 7: 3, 9: 3, 11: 11, 12: 11}
    assert components(made.limit(0)).count() == 0
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 40, 30)]
    prints = spark.createDataFrame([(b ^ (1 << int(i)),) for b in base for i in rng.integers(0, 40, 6)], "fp bigint")
    parts = [{r["node"]: r["component"] for r in components(simhash.links(prints, 4, 40, stars=s)).collect()} for s in (True, False)]
    assert parts[0] == parts[1] and len(parts[0]) > 100


def data_size(plan):
    """Bytes that the exchanges of an adaptive plan that has run have written, without what compression saves."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return data_size(plan.executedPlan())
    if name.endswith("QueryStage"):
        return data_size(plan.plan())
    own = plan.metrics().apply("dataSize").value() if name == "Exchange" else 0
    return own + sum(data_size(plan.children().apply(i)) for i in range(plan.children().size()))


@pytest.mark.parametrize(("width", "kinds"), [(40, 16), (64, 1), (20, 2)])
def test_links_of_many_buckets_are_sent_to_few_parts(spark, monkeypatch, width, kinds):
    """What buckets send grows slower than the buckets, and all links are there, between fingerprints of one kind only."""
    rng = np.random.default_rng(6)
    base = [int(x) for x in rng.integers(0, 1 << min(width, 62), 200)]
    prints = {(b ^ sum(1 << int(i) for i in rng.choice(width, n % 5, replace=False))) | (b % kinds << width) for b in base for n in range(5)}
    monkeypatch.setattr(simhash, "VARIANTS_PER_BUCKET", 1 << 10)
    monkeypatch.setattr(simhash, "LEAST_PARTS", 16, raising=False)
    monkeypatch.setattr(simhash, "SENT_AT_ONCE", 40_000, raising=False)
    edges = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp bigint"), 4, width, kinds)
    found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in edges.collect()]
    assert 0 < data_size(edges._jdf.queryExecution().executedPlan()) < 400 * len(prints)
    assert all(a >> width == b >> width and (a ^ b).bit_count() <= 4 for a, b in found)
    names, root, _ = components_of.trees(*(np.array(x, np.uint64) for x in zip(*found, strict=True)))
    parts = {int(p): int(names[r]) for p, r in zip(names, root, strict=True)}
    want = {p: root for k in range(kinds) for p, root in groups({p for p in prints if p >> width == k}, 4).items()}
    sizes = Counter(want.values())
    assert parts == {p: root for p, root in want.items() if sizes[root] > 1}


# Substring dedup


def test_substrings(table, corpus):
    found = substrings.without_repeats(substrings.repeats(table(corpus, clash=True))).collect()
    key = lambda k: float("inf") if k is None else k
    words = [(key(k), SPACED.findall(t or "")) for k, t in corpus]
    first = {}
    for k, w in words:
        for i in range(len(w) - 49):
            run = tuple(w[i : i + 50])
            first[run] = min(first.get(run, k), k)
    want = Counter()
    for k, w in words:
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < k for j in range(i, i + 50)}
        want[(k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    assert Counter((key(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in found) == want
    for r in found:
        assert sum(s["end"] - s["begin"] for s in r["repeats"]) == r["n_removed"]


def test_sliding_argmin():
    values = np.random.default_rng(1).integers(0, 5, 200)
    for width in (1, 2, 7, 31, 200):
        want = [i + int(np.argmin(values[i : i + width])) for i in range(len(values) - width + 1)]
        assert substrings.sliding_argmin(values, width).tolist() == want


# Decontamination


def test_contamination(table, spark, corpus, prose):
    items = [(0, prose(40, 0)), (1, prose(15, 2)), (2, "One"), (3, None), (4, ""), (4, prose(15, 2)), (None, prose(30, 1)), (5, prose(300, 5)), (6, "the THE é中")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(table(corpus, clash=True), benchmark).collect()
    windows = {}
    for i, t in items:
        w = LETTERS.findall(lower(t))
        for a in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + 10]), set()).add(i)
    sizes = {len(w) for w in windows}
    want = Counter()
    for k, t in corpus:
        w, hit, names = LETTERS.findall(lower(t)), set(), set()
        for a, size in product(range(len(w)), sizes):
            run = tuple(w[a : a + size])
            if len(run) == size and run in windows:
                hit.update(range(a, a + size))
                names |= windows[run]
        want[(k, len(w), len(hit), tuple(sorted(str(n) for n in names if n is not None)))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == want
    assert all(sum(s["end"] - s["begin"] for s in r["spans"]) == r["n_hit"] for r in got)
    docs = table(corpus, clash=True)
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == sum(n for (_, _, hits, _), n in want.items() if not hits)


def test_blocks_of_items(table, spark, corpus, prose, monkeypatch):
    benchmark = spark.createDataFrame([(i, prose(40, i)) for i in range(9)], "item_id bigint, text string")
    whole = decontaminate.contamination(table(corpus), benchmark).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert decontaminate.contamination(table(corpus), benchmark).collect() == whole


def test_fm_index():
    rng = np.random.default_rng(2)
    for n, symbols in ((1, 1), (50, 2), (400, 3), (300, 40)):
        text = rng.integers(0, symbols + 1, n)
        assert substrings is not None
        index = decontaminate.FMIndex(text, symbols)
        assert decontaminate.suffix_array(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())
        for size in (1, 2, 5):
            phrases = rng.integers(1, symbols + 1, (20, size))
            lo, hi = index.ranges(phrases, np.full(20, size))
            for p, a, b in zip(phrases.tolist(), lo, hi, strict=True):
                want = [i for i in range(n - size + 1) if text[i : i + size].tolist() == p]
                assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


# Quality rules


def test_measures_and_votes(table, corpus):
    corpus = [*corpus, (500, "a b c a b c\na b\na b\n\n x# | *y <z>\nÉCOLE ABC")]
    got = {(r["doc_id"], r["n_words"], r["word_chars"]): r for r in quality_rules.judged(table(corpus, clash=True)).collect()}
    for k, t in corpus:
        text = t or ""
        w = SPACED.findall(text)
        runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        twice = {j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        r = got[(k, len(w), sum(map(len, w)))]
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_lines"] == len(lines)
        assert r["n_repeat_words"] == len(twice) and r["n_distinct"] == len(set(w))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(twice) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_expectation_maximisation():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    right = [0.95, 0.9, 0.85, 0.8]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.3, 0, np.where((rng.random(len(truth)) < p) == truth, 1, -1)) for p in right], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.fit(patterns, counts)
    assert abs(model.prior - 0.8) < 0.03
    assert np.abs(model.accuracies() - right).max() < 0.04
    where = {tuple(p): i for i, p in enumerate(patterns.tolist())}
    guess = model.posterior(patterns)[[where[tuple(v)] for v in votes.tolist()]] >= 0.5
    assert (guess == truth).mean() > 0.9


# Line dedup


def java_hash(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=h)
    return signed(h)


def test_line_dedup(table, prose):
    block = [f"line {i} of a block that many rows share" for i in range(40)]
    rows = [(i, "\n".join([prose(30, i), *block[i:], prose(20, 100 + i)])) for i in range(10)]
    rows += [(50, rows[3][1]), (51, None), (52, ""), (53, "\n\n\n\n\n\n"), (54, "\n\n\n\n\n\n"), (55, "one\none\none\none"), (None, rows[2][1])]
    seen, want = set(), {}
    for k, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        lines = (t or "").split("\n")
        hashes = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in lines]
        out, at, gone = [], 0, 0
        for i in range(len(lines)):
            if i == len(lines) - 1 or java_hash([hashes[i - 1] if i else 0, hashes[i]]) % 4 == 0:
                body = "\n".join(lines[at : i + 1])
                if i > at and body.strip() and body in seen:
                    gone += i + 1 - at
                else:
                    out.append(body)
                    if i > at:
                        seen.add(body)
                at = i + 1
        want[k] = (None if t is None else "\n".join(out), len(lines), gone)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(table(rows, clash=True)).collect()}
    assert got == want
    assert sum(w[2] for w in want.values()) > 100
    docs = table(rows, clash=True)
    edited = line_dedup.without_repeats(docs)
    assert edited.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in edited.collect()} == {k: (w[0], None if w[0] is None else len(w[0])) for k, w in want.items()}


def test_line_dedup_has_no_python(table, corpus):
    plan = line_dedup.without_repeats(table(corpus))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# SentencePiece


def test_pieces_as_the_library(table, corpus):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model = pieces.read_model(MODEL)
    texts = [*[t for _, t in corpus], "  two  spaces ", "▁", "a▁ b", "日本語 🤗🤗", "\t\n", " ", "x" * 500, " " * 40]
    encoded = pieces.encode(table(list(enumerate(texts)), clash=True).drop("ids"), model, keep=("doc_id", "text", "key"))
    got = pieces.decode(encoded, model, keep=("doc_id", "ids"), into="decoded").collect()
    for r in got:
        want = library.encode(texts[r["doc_id"]] or "")
        assert r["ids"] == want
        assert r["decoded"] == library.decode(want)
    docs = table(list(enumerate(texts)), clash=True).drop("ids")
    both = {r["doc_id"]: (r["ids"], r["exact"]) for r in pieces.round_trip(docs, model, keep=("doc_id", "row")).collect()}
    assert both == {r["doc_id"]: (r["ids"], r["decoded"] == (texts[r["doc_id"]] or "")) for r in got}


def test_unigram_by_brute_force():
    made = {"▁": -2.0, "a": -2.5, "b": -2.7, "ab": -3.0, "▁a": -3.1, "ba": -3.3, "aab": -4.9, "▁ab": -4.0}
    model = pieces.Model(["<unk>", *made], [0.0, *made.values()], [pieces.UNKNOWN, *[pieces.NORMAL] * len(made)], pieces.UNIGRAM, True, False, "identity")
    encoder = pieces.Encoder(model)

    def best(text):
        found = {0: (0.0, [])}
        for end in range(1, len(text) + 1):
            for p, score in made.items():
                if text.endswith(p, 0, end) and end - len(p) in found:
                    total = found[end - len(p)][0] + score
                    if end not in found or total > found[end][0]:
                        found[end] = (total, [*found[end - len(p)][1], p])
        return found[len(text)][0]

    for text in ("a", "ab", "aab", "abba", "aabab ab", "b a b", "bbbaaab"):
        ids, _ = encoder.encode([text])
        assert sum(model.scores[i] for i in ids) == pytest.approx(sum(best(w) for w in encoder.split(encoder.prepared(text))))
    ids, _ = encoder.encode(["axxb"])
    assert ids.tolist().count(0) == 1


# Toxicity


def test_folding_and_exceptions():
    fold = toxicity.fold
    assert fold("Tr4sh, TRASH! tr@sh") == " trash trash trash "
    assert fold("іdіоt ｉｄｉｏｔ id​iot 1d10t") == " idiot idiot idiot idiot "
    assert fold("***loser***") == fold("l0ser") == fold("1oser")
    assert fold("") == fold(" !$ ") == ""
    lexicon = toxicity.Lexicon({fold("trash").strip(): 2.0, fold("idiot").strip(): 3.0}, frozenset({fold("trash can").strip()}))
    found = lambda t: [w for *_, w in toxicity.matches(fold(t), lexicon.automaton())]
    assert found("the trash can, trash and 1D10TS") == [2.0, 3.0]
    assert found("untrash retrash") == [] and found("trash canary") == [2.0]


def test_learned_lexicon(table, spark, prose):
    bad, rows, labels = ["loser", "moron", "stupid"], [], []
    for i in range(240):
        words = prose(60, i).split()
        toxic = i % 4 == 0
        if toxic:
            for j, b in enumerate(bad):
                words.insert(7 + 11 * j + i % 5, b.replace("o", "0") if i % 8 == 0 else b.upper())
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (None, "loser"), (1001, ""), (1002, "stupid m0ron"), (1003, "x " * 50_000 + "moron")]
    frame = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id bigint, toxic int")
    docs = table(rows, clash=True)
    lexicon = toxicity.learn(docs, frame)
    assert all(any(toxicity.fold(b).strip().startswith(t) for t in lexicon.terms) for b in bad)
    scores = {r["doc_id"]: r["score"] for r in toxicity.weigh(docs, lexicon).collect()}
    truth = dict(labels)
    assert all((scores[i] >= 0.5) == bool(truth[i]) for i in truth)
    assert scores[1002] > 0.5 > scores[1000] == scores[1001] and scores[1003] < scores[1002]
    kept = toxicity.drop_toxic(docs, lexicon)
    assert kept.columns == docs.columns and kept.count() == sum(1 for s in [scores[k] for k, _ in rows] if s < 0.5)


# Archives


def test_arc_lines_of_both_versions():
    v1 = arc.arc_opening(1, "a.arc", "20010203040506") + b"http://x/a b 1.2.3.4 20010203040506 text/html 5\nhello\nhttp://y/ 1.2.3.4 200102030405 text/plain 9\nab"
    got = list(arc.parse_arc(arc._opened(v1)))
    assert [(v, f["URL"], c, short) for _, v, f, c, short in got] == [(1, "http://x/a b", b"hello", False), (1, "http://y/", b"ab", True)]
    v2 = arc.arc_opening(2, "b.arc", "20010203040506") + b"http://x/ 1.2.3.4 20010203040506 text/html 404 - - 77 b.arc 3\nabc\n\njunk line\n"
    assert [(v, f["Result-code"], c) for _, v, f, c, _ in arc.parse_arc(arc._opened(v2))] == [(2, "404", b"abc")]
    bare = b"http://x/ 1.2.3.4 20010203040506 text/html 200 - - 0 c.arc 3\nabc\n"
    assert [v for _, v, *_ in arc.parse_arc(arc._opened(bare))] == [2]


def test_archives_round_trip(spark, tmp_path):
    big, same = "é" * 600, "<p>copy</p>" * 200
    rows = [(1, "http://a/", big), (2, "http://a b/", same), (9, None, same), (5, "http://c/", same), (6, "u", None), (7, "u", ""), (8, "u", "x"), (10, "u", "x"),
            (None, "u", "y\r\n\r\nWARC/1.1\r\n\r\n"), (11, "u", "z" * 300_000), (11, "u", "z" * 300_000), (12, "u", "HTTP/1.1 200 OK\r\n\r\nx")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as key", "2 as body")
    arc.write_arc(pages, str(tmp_path / "arc"), limit=2000)
    records = arc.read_arc(spark, str(tmp_path / "arc")).collect()
    assert len(records) == len(rows) and {r["version"] for r in records} <= {1, 2}
    assert Counter(bytes(r["payload"]) for r in records) == Counter((h or "").encode() for _, _, h in rows)
    warc = arc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = arc.index(warc).collect()
    assert Counter((r["key"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter(
        (k, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for k, _, h in rows
    )
    key_of = {r["record_id"]: r["key"] for r in got}
    again = Counter((r["key"], key_of[r["refers_to"]]) for r in got if r["type"] == "revisit")
    assert again == Counter({(2, 9): 1, (5, 9): 1, (11, 11): 1})
    assert {r["date"] for r in warc.select("date").collect()} == {"1970-01-01T00:00:00Z"}


# Classifier


def test_classifier(table, spark, prose):
    rows = [(i, prose(60, i) if i % 3 else " ".join(w.upper() + "!!" for w in prose(60, i).split())) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    rows += [(900, None), (901, ""), (None, "word"), (902, prose(20_000, 7))]
    docs = table(rows, clash=True)
    weights = classifier.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in classifier.score(docs, weights).collect()}
    assert sum((got[i] >= 0.3) == (i % 3 > 0) for i in range(300)) >= 297
    assert got[900] == got[901] and got[902] > 0.5 and all(0 <= s <= 1 for s in got.values())
    none = classifier.fit(docs, labels.where("false"))
    assert {r["score"] for r in classifier.score(docs, none).collect()} == {0.5}


# Pages


def test_minimum_cut():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        gains = rng.normal(0, 2, n).tolist()
        edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, n, 12), rng.integers(0, n, 12), rng.random(12) * 2, strict=True)]

        def cost(side, gains=gains, edges=edges):
            return sum(abs(g) for g, s in zip(gains, side, strict=True) if (g > 0) != s) + sum(w for a, b, w in edges if side[a] != side[b])

        assert cost(html_text.content_side(gains, edges)) == pytest.approx(min(map(cost, product([False, True], repeat=n))))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<p>A short page &amp; no more.</p>", "A short page & no more."),
        ("<head><title>t</title></head><body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p><b>First   part.<br><p>Second &eacute;&#x41;.</p></article><footer>&copy; me</footer>", "Title First part. Second éA."),
        ("<article><p>One two three.</p><div class='ad'>Buy this now.</div><p>Four five.</p><script>if (a<b) c()</script><aside>x</aside></article>", "One two three. Four five."),
        ("<div id='main'><p>Words of an article, a good many of them here.</p></div><div class='comments'><p>I liked this article very much, thank you all.</p></div>", "Words of an article, a good many of them here."),
        ("<article>a < b <!-- no --> &lt;p&gt; <form>f<input></form></article", "a < b <p>"),
    ],
)
def test_pages(page, want):
    assert html_text.main_text(page) == want


def test_pages_frame(spark):
    rows = [(1, "u", None), (1, "u", "<p>A few plain words here.</p>"), (None, None, "<article>" + "<p>Some words of text.</p>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' as page", "'y' as row", "'z' as text")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "page", "row", "text"]
    assert sorted(len(r["text"]) for r in got.collect()) == [0, 23, 3000 * 20 - 1]


# Empty tables


def test_empty_tables(spark, table):
    docs = table([(1, "x")]).where("false")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    items = spark.createDataFrame([], "item_id bigint, text string")
    model = pieces.read_model(MODEL)
    for made in (
        simhash.near_duplicates(docs), simhash.drop_near_duplicates(docs), substrings.without_repeats(substrings.repeats(docs)),
        decontaminate.contamination(docs, items), quality_rules.judged(docs), line_dedup.dedup_lines(docs), pieces.encode(docs, model),
        toxicity.scores(docs, labels), classifier.score(docs, classifier.fit(docs, labels)), html_text.extract(docs, "text", "body"),
    ):
        assert made.count() == 0
    some = table([(1, "a b"), (2, None)])
    assert [r["n_hit"] for r in decontaminate.contamination(some, items).collect()] == [0, 0]
    assert toxicity.scores(some, labels).count() == 2


def test_empty_archives(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    arc.write_arc(pages, str(tmp_path / "arc"))
    assert arc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc")).count() == 0


def test_words_of_a_batch():
    import pyarrow as pa

    texts = ["a bc", None, "", " x", "é\n中 y", "end"]
    data, offsets = W.text_bytes(pa.array(texts))
    found = W.find_words(data, offsets, W.space_separated())
    assert found.counts.tolist() == [2, 0, 0, 1, 3, 1]
    assert [bytes(data[a:b]).decode() for a, b in zip(found.starts, found.ends, strict=True)] == ["a", "bc", "x", "é", "中", "y", "end"]
