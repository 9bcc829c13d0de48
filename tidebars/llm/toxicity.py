"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts and lexicon are folded alike: lower case, compatibility forms undone,
Cyrillic and Greek look-alikes made Latin, digits and marks that stand for
letters replaced, ``l`` and ``i`` one letter, zero-width characters gone, all
else between words one space.  The automaton holds the lexicon's terms, which
are beginnings of words, and the exception phrases; a term inside an exception
phrase doesn't count.  A text's weight is the sum of its matched terms' weights;
the score is a logistic curve over that weight and the weight per word, so long
texts need more than short ones.

The lexicon is learned from labelled rows.  A text speaks for a term through
one of the places where it has it, and equal neighbourhoods count once, so a
text that was copied a thousand times speaks once.  An exception phrase is a
term's word with a neighbour that texts without the label have about as often
as those with it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.labelled import SAMPLE_ROWS, training_rows
from tidebars.llm.rows import ROW, packed, unpacked, with_row
from tidebars.llm.staging import staged

MIN_CONTEXTS = 6
MIN_WEIGHT = 2.5
SHORTEST, LONGEST = 3, 12

#: Look-alike letters and the letters that digits and marks stand for.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ғ": "f", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j",
    "к": "k", "ӏ": "i", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "у": "y",
    "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o",
    "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ℓ": "i", "ø": "o", "đ": "d", "ł": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i",
}
MARKS = {"@": "a", "$": "s", "!": "i", "|": "i"}
ZERO_WIDTH = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


class Folding(dict):
    """Translation table that is filled as characters are met; what is no letter or digit becomes a space."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if char in ZERO_WIDTH:
            out = ""
        else:
            plain = unicodedata.normalize("NFKC", char).lower()
            out = "".join(LOOK_ALIKES.get(c, c) if c.isalnum() or c in LOOK_ALIKES else " " for c in plain)
        self[code] = out
        return out


_MARK = re.compile(r"[!|$@](?=\w)")


def _letter(mark: re.Match) -> str:
    at, text = mark.start(), mark.string
    return MARKS[mark[0]] if at and text[at - 1].isalnum() else mark[0]


def fold(text: str, table: dict | None = None) -> str:
    """Folded words with one space before, between and after them; a mark is a letter only inside a word."""
    words = _MARK.sub(_letter, text).translate(Folding() if table is None else table).split()
    return f" {' '.join(words)} " if words else ""


class Lexicon(NamedTuple):
    """Folded beginnings of words with weights, folded exception phrases, and the curve from weights to a score."""

    terms: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (-2.0, 1.0, 0.5)

    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            made.add_word(f" {term}", (len(term), weight))
        for phrase in self.exceptions:
            made.add_word(f" {phrase} ", (len(phrase) + 1, 0.0))
        made.make_automaton()
        return made


def matches(folded: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
    """``(begin, end, weight)`` of the weightiest term at each word that lies in no exception phrase."""
    found, excepted = {}, []
    for last, (size, weight) in automaton.iter(folded):
        begin, end = last + 1 - size, last + 1
        if not weight:
            excepted.append((begin, end))
        elif weight > found.get(begin, (0, 0.0))[1]:
            found[begin] = (end, weight)
    return [(a, b, w) for a, (b, w) in found.items() if not any(x <= a and b <= y for x, y in excepted)]


def _measures(text: str | None, automaton, table: dict) -> tuple[float, int, int]:
    folded = fold(text, table) if text else ""
    found = matches(folded, automaton) if folded and len(automaton) else []
    return sum(m[2] for m in found), len(found), max(folded.count(" ") - 1, 0)


def _inputs(weight, n_words):
    return np.log1p(weight), np.log1p(100 * weight / np.maximum(n_words, 1))


def weigh(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, ``weight`` and ``n_matches`` of its terms, ``n_words``, ``score``.

    Whole texts are read.  A null or empty text has weight 0 and the score of a
    text without terms.
    """
    return unpacked(_scan(docs, lexicon, [key], text), [key], "weight", "n_matches", "n_words", "score")


def _scan(docs: DataFrame, lexicon: Lexicon, carry: list[str], text: str) -> DataFrame:
    rows = docs.select(packed(carry), F.col(text).alias("text"))
    a, b, c = lexicon.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, table = lexicon.automaton(), Folding()
        for batch in batches:
            found = [_measures(t.as_py(), automaton, table) for t in batch.column(1)]
            weight, hits, n = (np.array(x, kind) for x, kind in zip(zip(*found, strict=True) if found else ((), (), ()), (float, np.int64, np.int64), strict=True))
            x, y = _inputs(weight, n)
            score = 1 / (1 + np.exp(-np.clip(a + b * x + c * y, -35, 35)))
            made = [batch.column(0), pa.array(weight), pa.array(hits), pa.array(n), pa.array(score)]
            yield pa.RecordBatch.from_arrays(made, [ROW, "weight", "n_matches", "n_words", "score"])

    return rows.mapInArrow(run, with_row(rows, "weight double, n_matches bigint, n_words bigint, score double"))


def _evidence(rows: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    """``(term, place)``: the beginnings of a text's folded words, each with a hash of the neighbours of one of its places."""
    schema = pa.schema([("term", pa.string()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Folding()
        for batch in batches:
            for text in batch.column(0):
                words = fold(text.as_py() or "", table).split()
                around = {}
                for before, word, after in zip(["", *words[:-1]], words, [*words[1:], ""], strict=True):
                    around[word] = min(around.get(word, (after, before)), (after, before))
                seen: dict[str, tuple] = {}
                for word, near in around.items():
                    for size in range(min(SHORTEST, len(word)), min(LONGEST, len(word)) + 1):
                        term = word[:size]
                        if wanted is None or term in wanted:
                            seen[term] = min(seen.get(term, (word, near)), (word, near))
                for part in (list(seen.items())[a : a + 50_000] for a in range(0, len(seen), 50_000)):
                    places = [hash_text(f"{w} {n[0]} {n[1]}") for _, (w, n) in part]
                    yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in part], pa.string()), pa.array(places, pa.int64())], schema=schema)

    return rows.mapInArrow(run, "term string, place bigint")


def hash_text(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - 2**63


def _phrases(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``(phrase, y)``: the words that match a term with the word before, and with the word after, once a text."""
    schema = pa.schema([("phrase", pa.string()), ("y", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, table = lexicon.automaton(), Folding()
        for batch in batches:
            out = []
            for text, y in zip(batch.column(0), batch.column(1), strict=True):
                folded, found = fold(text.as_py() or "", table), set()
                for begin, _, _ in matches(folded, automaton):
                    end = folded.index(" ", begin)
                    before = folded.rfind(" ", 0, begin - 1) + 1 if begin > 1 else begin
                    after = folded.find(" ", end + 1)
                    found |= {folded[before:end], folded[begin:after] if after > 0 else folded[begin:end]} - {folded[begin:end]}
                out += [(f, y.as_py()) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.int32())], schema=schema)

    return rows.mapInArrow(run, "phrase string, y int")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Coefficients (bias first) by Newton steps until they rest; classes weigh alike."""
    x = np.column_stack([np.ones(len(x)), x])
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * max(len(y), 1) / 100)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (share * (p - y)) + penalty * w
        curve = (x * (share * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", sample: int = SAMPLE_ROWS
) -> Lexicon:
    """A lexicon from about ``sample`` labelled rows that aren't held out.

    A term needs `MIN_CONTEXTS` different places in labelled texts and a log
    odds ratio of `MIN_WEIGHT` over the others, and no longer term that tells nearly
    as many labelled texts better; all of these are kept, and all exception
    phrases.  The driver sees the terms of the sample that labelled texts share,
    which the sample's size bounds.  Without labelled
    rows the lexicon is empty.
    """
    rows = staged(training_rows(docs, labels, label, key, text, sample).select(F.col(text).alias("text"), "y"), "labelled")
    places = lambda found: found.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    often = {r["term"]: r["n"] for r in places(_evidence(rows.where("y = 1").select("text"))).where(F.col("n") >= MIN_CONTEXTS).collect()}
    others = {r["term"]: r["n"] for r in places(_evidence(rows.where("y = 0").select("text"), frozenset(often))).collect()} if often else {}
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    yes, no = sizes.get(1, 0) + 1, sizes.get(0, 0) + 1
    weights = {t: math.log((n + 0.5) / yes) - math.log((others.get(t, 0) + 0.5) / no) for t, n in often.items()}
    # A beginning whose labelled places nearly all go on alike says less than the longer term.
    vague = {t[:n] for t, w in weights.items() for n in range(SHORTEST, len(t)) if often[t] >= 0.9 * often.get(t[:n], 0) and w > weights.get(t[:n], w)}
    terms = sorted((-w, t) for t, w in weights.items() if w >= MIN_WEIGHT and t not in vague)
    lexicon = Lexicon({t: -w for w, t in terms})
    if not terms:
        return lexicon
    y = F.col("y")
    neutral = _phrases(rows, lexicon).groupBy("phrase").agg(F.sum(y).alias("t"), F.sum(1 - y).alias("f")).where("f >= 2 and f >= t")
    phrases = [r["phrase"] for r in neutral.select("phrase").collect()]
    lexicon = lexicon._replace(exceptions=frozenset(phrases))
    seen = weigh(rows, lexicon, "y", "text").select("weight", "n_words", "y").toArrow()  # numbers of the sample only
    x, labelled = np.column_stack(_inputs(seen["weight"].to_numpy(), seen["n_words"].to_numpy())), seen["y"].to_numpy().astype(float)
    if not 0 < labelled.sum() < len(labelled):
        return lexicon
    a, b, c = logistic(x, labelled)
    return lexicon._replace(curve=(float(a), float(b), float(c)))


def scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", sample: int = SAMPLE_ROWS) -> DataFrame:
    """`weigh` with a lexicon learned from ``labels``."""
    return weigh(docs, learn(docs, labels, label, key, text, sample), key, text)


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``; columns and values are those of ``docs``."""
    return unpacked(_scan(docs, lexicon, docs.columns, text).where(F.col("score") < threshold), docs.columns)
