"""Weak supervision: quality rules that vote or abstain, weighed by expectation maximisation.

Each rule looks at measures of a text and votes 1 (fit), -1 (unfit) or 0 (no
opinion).  A latent-class model says how often each rule votes how among fit and
among unfit texts; its parameters are estimated from the votes alone.  They
depend on the texts only through the number of texts with each vote pattern, at
most ``3 ** rules`` numbers whatever the number of texts, so the estimate sees
every text, and the driver only this table.  The posterior probability of
being fit replaces a demand that all rules pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm import words as W
from tidebars.llm.staging import staged

#: Frequent function words of the four languages.
FUNCTION_WORDS = (
    "the of and to in a is that for it with as was on are by this be from or "
    "der die das und in den von zu mit nicht ein eine auf ist im dem des auch für "
    "le la les de des et un une du en que qui dans pour sur au par est pas avec "
    "el los las una y en por con para del se no lo su al es"
).split()

SYMBOLS = b"#*$%&|<>"
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_function", "n_plain", "n_long", "n_distinct",
)


class Rule(NamedTuple):
    """``fit`` and ``unfit`` are conditions on the measures; neither: no opinion."""

    name: str
    fit: Column
    unfit: Column


def default_rules() -> list[Rule]:
    share = lambda part: F.col(part) / F.greatest(F.col("n_words"), F.lit(1))
    size = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return [
        Rule("length", F.col("n_words") >= 100, F.col("n_words") < 50),
        Rule("symbols", share("n_symbols") < 0.02, share("n_symbols") > 0.1),
        Rule("dup_lines", F.col("n_dup_lines") == 0, F.col("n_dup_lines") > 0.3 * F.col("n_lines")),
        Rule("repeats", share("n_repeat_words") < 0.1, share("n_repeat_words") > 0.3),
        Rule("word_size", size.between(3, 9), (size < 2.2) | (size > 12)),
        Rule("shouting", F.col("n_upper") < 0.1 * F.col("word_chars"), F.col("n_upper") > 0.4 * F.col("word_chars")),
        Rule("function_words", share("n_function") > 0.12, share("n_function") < 0.04),
        Rule("plain_words", share("n_plain") > 0.9, share("n_plain") < 0.6),
        Rule("variety", share("n_distinct") > 0.3, (share("n_distinct") < 0.1) & (F.col("n_words") < 2000)),
    ]


def _measure(part: W.Text, function_words: np.ndarray) -> list[np.ndarray]:
    data, offsets, rows = part.data, part.offsets, part.rows.num_rows
    table = W.space_separated()
    words = W.find_words(data, offsets, table)
    row, n = words.row(), len(words.starts)
    letters = (data & 0xC0) != 0x80
    in_word = table[data]
    symbols = np.zeros(256, bool)
    symbols[list(SYMBOLS)] = True
    upper = (data >= 0x41) & (data <= 0x5A)
    # Of Latin letters beyond ASCII (lead byte C3) the upper-case ones end in 80 to 9E.
    upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    per_row = lambda flags: W.totals(flags, offsets)
    by_word = lambda flags: np.bincount(row[flags], minlength=rows)

    # Lines: what stands between line breaks; those with a word count.
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.r_[offsets[:-1], breaks + 1])
    starts = starts[starts < len(data)]
    ends = np.r_[starts[1:], len(data)]
    ends = ends - ((ends > starts) & (data[ends - 1] == 0x0A) if len(ends) else 0)
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts) if len(starts) else np.zeros(0, bool)
    starts, ends = starts[has_word], ends[has_word]
    line_row = np.searchsorted(offsets, starts, "right") - 1
    line = W.mix(W.span_hashes(data, starts, ends, W.BYTE_BASE) + line_row.astype(W.U) * W.U(W.WORD_BASE)) if len(starts) else np.zeros(0, W.U)
    _, first = np.unique(line, return_index=True)
    again = np.ones(len(line), bool)
    again[first] = False

    hashes = W.word_hashes(data, words)
    runs = W.run_hashes(hashes, 3)
    at = np.flatnonzero(W.run_rows(words, 3))
    runs = W.mix(runs[at] + row[at].astype(W.U) * W.U(W.BYTE_BASE))
    order = np.argsort(runs)
    same = runs[order][1:] == runs[order][:-1]
    twice = at[order[np.r_[False, same] | np.r_[same, False]]] if len(at) else at
    repeated = W.covered(twice, twice + 3, n)

    low = np.zeros(256, bool)
    low[0x61:0x7B] = low[0x80:] = True
    bad = in_word & ~low[data] & ~((data >= 0x41) & (data <= 0x5A))
    sums = np.r_[0, np.cumsum(bad)]
    size = words.ends - words.starts
    # Letters only, or one mark at the end.
    marks = sums[words.ends] - sums[words.starts]
    plain = (marks == 0) | ((marks == 1) & (size > 1) & bad[words.ends - 1]) if n else np.zeros(0, bool)
    lower = W.word_hashes(W.lower_ascii(data), words)
    place = np.minimum(np.searchsorted(function_words, lower), len(function_words) - 1)
    distinct = np.unique(W.mix(hashes + row.astype(W.U) * W.U(W.BYTE_BASE)), return_index=True)[1]
    return [
        words.counts, per_row(in_word & letters), per_row(symbols[data]), np.bincount(line_row[again], minlength=rows),
        W.totals(repeated, words.first), np.bincount(line_row, minlength=rows), per_row(upper),
        by_word(function_words[place] == lower), by_word(plain), by_word(size > 20), np.bincount(row[distinct], minlength=rows),
    ]


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of every whole text, one row per row; words are what white space separates.

    ``word_chars`` code points in words; ``n_symbols`` characters of
    ``#*$%&|<>``; ``n_dup_lines`` lines with a word that equal an earlier line;
    ``n_repeat_words`` words in 3-word windows found twice or more; ``n_lines``
    lines with a word; ``n_upper`` capital letters; ``n_function`` function
    words; ``n_plain`` words of letters with at most one mark at the end;
    ``n_long`` words of over 20 bytes; ``n_distinct`` different words.  Null
    and empty texts have zeros.
    """
    schema = pa.schema([("key", pa.int64()), *((m, pa.int64()) for m in MEASURES)])
    joined = " ".join(FUNCTION_WORDS)
    data, offsets = W.text_bytes(pa.array([joined]))
    known = np.unique(W.word_hashes(data, W.find_words(data, offsets, W.space_separated())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.texts(batches, "text"):
            yield W.record_batch(schema, [part.rows.column(0), *_measure(part, known)])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    made = rows.mapInArrow(run, "key bigint, " + ", ".join(f"{m} bigint" for m in MEASURES))
    return made.withColumnRenamed("key", key)


class Model(NamedTuple):
    """Share of fit texts, and how often each rule votes -1, 0, 1 among unfit (0) and fit (1) texts."""

    prior: float
    votes: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of being fit for rows of votes."""
        logs = np.log(self.votes)
        at = patterns + 1
        score = [sum((logs[c, j, at[:, j]] for j in range(at.shape[1])), np.zeros(len(at))) for c in (0, 1)]
        odds = score[1] - score[0] + np.log(self.prior) - np.log1p(-self.prior)
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))

    def accuracies(self) -> np.ndarray:
        """How often each rule is right when it votes."""
        right = self.prior * self.votes[1, :, 2] + (1 - self.prior) * self.votes[0, :, 0]
        wrong = self.prior * self.votes[1, :, 0] + (1 - self.prior) * self.votes[0, :, 2]
        return right / (right + wrong)


def fit(patterns: np.ndarray, counts: np.ndarray, tolerance: float = 1e-9, smoothing: float = 1.0) -> Model:
    """Expectation maximisation from vote patterns and how many texts have each, until nothing moves by ``tolerance``.

    It starts from the belief that an unfit vote weighs more than a fit one,
    which also tells the two classes apart.  Without texts nothing is known:
    every text is as likely fit as not.
    """
    rules = patterns.shape[1]
    counts = counts.astype(float)
    belief = 1 / (1 + np.exp(-((patterns == 1).sum(1) - 4.0 * (patterns == -1).sum(1))))
    while True:
        weight = np.stack([counts * (1 - belief), counts * belief])
        votes = np.stack([[(weight[c][:, None] * (patterns == v)).sum(0) + smoothing for v in (-1, 0, 1)] for c in (0, 1)]).transpose(0, 2, 1)
        votes = votes / votes.sum(2, keepdims=True)
        prior = (weight[1].sum() + smoothing) / (counts.sum() + 2 * smoothing)
        model = Model(float(prior), votes if rules else np.zeros((2, 0, 3)))
        after = model.posterior(patterns)
        if not len(after) or np.abs(after - belief).max() < tolerance:
            return model
        belief = after


def score(measured: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """``measured`` with each rule's vote (``vote_<name>``) and ``quality``, the posterior of being fit.

    All rows take part in the estimate; rows that tie in their votes have equal
    posteriors.  A null measure makes a rule abstain.
    """
    rules = default_rules() if rules is None else list(rules)
    names = [f"vote_{r.name}" for r in rules]
    vote = {n: F.when(r.unfit, F.lit(-1)).when(r.fit, F.lit(1)).otherwise(F.lit(0)) for n, r in zip(names, rules, strict=True)}
    voted = measured.withColumns(vote)
    table = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** rules rows
    patterns = np.array([[row[n] for n in names] for row in table], np.int64).reshape(-1, len(names))
    model = fit(patterns, np.array([row["n"] for row in table]))
    logs = np.log(model.votes)
    odds = F.lit(float(np.log(model.prior) - np.log1p(-model.prior)))
    for j, name in enumerate(names):
        gain = (logs[1, j] - logs[0, j]).tolist()
        odds = odds + F.element_at(F.array(*[F.lit(g) for g in gain]), F.col(name) + 2)
    return voted.withColumn("quality", 1 / (1 + F.exp(-odds)))


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """`measures` and `score` of every text, with ``base_failed`` (under 50 words, or over half of them repeated) and ``kept``."""
    measured = staged(measures(docs, key, text), "measures")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return score(measured, rules).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
