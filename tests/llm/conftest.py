from __future__ import annotations

import random

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def prose():
    """Makes invented prose: the same seed gives the same words."""
    syllables = "an be co de er fi go hu in ka lo me nu or pa qui re sa ti un vo wei xi za".split()

    def make(words: int, seed: int, lines: int = 12) -> str:
        rng = random.Random(seed)
        made = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(words)]
        return "\n".join(" ".join(made[i : i + lines]).capitalize() + "." for i in range(0, words, lines))

    return make


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (id, text) pairs; ``clash`` adds columns whose names operators use inside."""

    def make(rows, clash: bool = False):
        df = spark.createDataFrame([(k, t, "en", "s", len(t) if t is not None else None) for k, t in rows], DOC)
        return df.selectExpr("*", *[f"'x{i}' as `{c}`" for i, c in enumerate(CLASHES)]) if clash else df

    return make


CLASHES = ["key", "row", "_k", "_copy", "copy", "fp", "y", "made", "score", "weight", "n_words", "spans", "items", "ids", "_text", "at", "hash", "_gone", "k"]


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls in any column, empty, blank, one-word and very long texts, ties and repeated rows."""
    long = prose(20_000, 5)
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (6, prose(80, 1)), (6, prose(80, 1)), (6, prose(80, 2)), (None, prose(80, 3)),
        (None, None), (7, long), (8, long), (9, "é中 " * 70), (10, "a\x00b \U0001f600 c"), (11, "\n\n\n"),
    ]
