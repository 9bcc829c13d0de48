"""Source divergence audit: how the words of a language's sources differ, on run-length columns.

Each language keeps the terms that stand in at least `MIN_DOCS` of its
documents.  A source is a column of counts over them, nearly all of which are
small and equal to their neighbours once the vocabulary is ordered well:

* terms with the same counts in every source are one row with a length;
* these rows are dealt to slices by a hash of their counts, and ordered in a
  slice by the counts of its fullest sources, so that equal counts lie together;
* every source is run-length encoded over that order, the run boundaries of two
  sources are intersected, and what one term of a common run adds is multiplied
  by the run's length.

A slice holds about `SLICE_ENTRIES` counts and compares `SOURCE_BLOCK` sources
with all of their language; partial sums of slices add up in Spark.  No task
sees a whole vocabulary, and no term is looked at once per pair of sources.

All arithmetic is on integers: ``p = 1 + SCALE * (count + 1) // (N + V)`` for
``V`` terms with ``N`` occurrences, and a term adds ``(p - q)**2 // q``.

Null texts, languages and sources count as empty ones.  A source without terms
takes part with counts of zero, a language without kept terms gives pairs of
value 0, equal rows count one by one, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.llm import words as W
from tidebars.llm.staging import staged

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
SLICE_ENTRIES = 1 << 20
SOURCE_BLOCK = 64
ORDER_BY_SOURCES = 8
SLICE_BYTES = 8 << 20
SAFE_COUNT = 9_000_000_000  # SCALE times this is still a 64-bit number


def letters() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` after A-Z have become a-z."""
    table = np.zeros(256, bool)
    table[0x61:0x7B] = table[0x80:] = True
    return table


def group_numbers(rows: pa.RecordBatch, columns: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Per row the number of its group, and per group one of its rows."""
    number = np.zeros(rows.num_rows, np.int64)
    for c in columns:
        codes = rows.column(c).dictionary_encode()
        number = number * max(len(codes.dictionary), 1) + codes.indices.to_numpy(zero_copy_only=False)
    _, first, number = np.unique(number, return_index=True, return_inverse=True)
    return number.ravel(), first


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of each term in each group, and documents with it."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters()
        for part in W.texts(batches, "text", SLICE_BYTES):
            data = W.lower_ascii(part.data)
            found = W.find_words(data, part.offsets, table)
            if not len(found.starts):
                continue
            coded = W.spelt(data, found).dictionary_encode()
            size = len(coded.dictionary)
            in_row, times = np.unique(found.row() * size + coded.indices.to_numpy(), return_counts=True)
            group, first = group_numbers(part.rows, (0, 1))
            cells, cell = np.unique(group[in_row // size] * size + in_row % size, return_inverse=True)
            n = np.zeros(len(cells), np.int64)
            np.add.at(n, cell.ravel(), times)
            names = pa.array(first[cells // size])
            yield W.record_batch(schema, [part.rows.column(0).take(names), part.rows.column(1).take(names), coded.dictionary.take(pa.array(cells % size)), n, np.bincount(cell.ravel())])

    filled = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    partial = filled.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vocabulary(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, term, total, counts)`` of the kept terms; ``counts`` are ``(source, n)`` in order of the sources, one a source at most."""
    merged = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts")
    )
    return merged.where(F.col("docs") >= min_docs).select("lang", "term", "total", "counts")


def groups_of(docs: DataFrame, vocab: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, n, lang_n, v)`` of each group that occurs: its kept occurrences, those of its language, and the kept terms."""
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]).distinct()
    own = vocab.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    languages = vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    joined = occurring.join(own, ["lang", "source"], "left").join(languages, "lang", "left")
    return joined.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "lang_n", "v")])


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """``1 + SCALE * (count + 1) // total``, exactly."""
    if len(counts) and counts.max() >= SAFE_COUNT:
        return np.array([1 + SCALE * (c + 1) // total for c in counts.tolist()], np.int64)
    return 1 + SCALE * (counts.astype(np.int64) + 1) // total


def vocabulary_order(term: np.ndarray, source: np.ndarray, n: np.ndarray, terms: int, sources: int) -> np.ndarray:
    """An order of the terms in which equal counts lie together: by the counts in the sources with most entries."""
    fullest = np.argsort(-np.bincount(source, minlength=sources), kind="stable")[:ORDER_BY_SOURCES]
    columns = np.zeros((len(fullest), terms), np.int64)
    for row, s in zip(columns, fullest, strict=True):
        mine = source == s
        row[term[mine]] = n[mine]
    return np.lexsort(columns[::-1]) if len(fullest) else np.arange(terms)


def run_length(place: np.ndarray, n: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal counts of one source: where each ends, counted in terms, and its count.

    ``place`` are the rows with a count, ascending; all others hold 0.  ``ends[i]``
    is the number of terms in the first i rows.
    """
    rows = len(ends) - 1
    edges = np.unique(np.concatenate([place, place + 1, [0, rows]]))
    count = np.zeros(len(edges) - 1, np.int64)
    count[np.searchsorted(edges, place)] = n
    new = np.r_[True, count[1:] != count[:-1]][: len(count)]
    return ends[np.r_[edges[:-1][new][1:], rows]], count[new]


def pair_sums(left: list[int], columns: list[tuple[np.ndarray, np.ndarray]], length: int) -> np.ndarray:
    """For each source of ``left`` and every source: the sum over all terms of ``(p - q)**2 // q``.

    ``columns`` are ``(ends, p)`` of each source.  The columns are laid end to
    end, so that one merge intersects a source's runs with those of all others.
    """
    shift = np.arange(len(columns)) * length
    ends = np.concatenate([e + s for (e, _), s in zip(columns, shift, strict=True)])
    q_of = np.concatenate([p for _, p in columns])
    sums = np.zeros((len(left), len(columns)), np.int64)
    for row, a in enumerate(left):
        own_ends, own = columns[a]
        cuts = np.union1d(ends, (shift[:, None] + own_ends).ravel())
        which = (cuts - 1) // length
        p = own[np.searchsorted(own_ends, cuts - which * length)]
        q = q_of[np.searchsorted(ends, cuts)]
        added = (p - q) ** 2 // q * np.diff(cuts, prepend=0)
        sums[row] = np.add.reduceat(added, np.searchsorted(which, np.arange(len(columns))))
    return sums


def compared(table: pa.Table, members: pa.Table) -> pa.Table:
    """Partial sums of one slice: ``table`` holds its terms, ``members`` the sources of the language."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    order = np.argsort(np.array([x.encode() for x in members["source"].to_pylist()], object), kind="stable")
    members = members.take(pa.array(order))
    names, totals, v = members["source"].combine_chunks(), members["n"].to_numpy(), int(members["v"][0].as_py())
    block = int(members["block"][0].as_py())
    left = list(range(block * SOURCE_BLOCK, min((block + 1) * SOURCE_BLOCK, len(names))))
    sums = np.zeros((len(left), len(names)), np.int64)
    if table.num_rows:
        lists = table["counts"].combine_chunks()
        entries = lists.flatten()
        term = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        source = pa.compute.index_in(entries.field("source"), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
        n = entries.field("n").to_numpy(zero_copy_only=False)
        placed = vocabulary_order(term, source, n, len(lists), len(names))
        ends = np.r_[0, np.cumsum(table["terms"].to_numpy()[placed])]
        place = np.empty(len(placed), np.int64)
        place[placed] = np.arange(len(placed))
        by_source = np.lexsort((place[term], source))
        cut = np.searchsorted(source[by_source], np.arange(len(names) + 1))
        columns = []
        for s in range(len(names)):
            mine = by_source[cut[s] : cut[s + 1]]
            run_ends, counts = run_length(place[term[mine]], n[mine], ends)
            columns.append((run_ends, shares(counts, int(totals[s]) + v)))
        sums = pair_sums(left, columns, int(ends[-1]))
    a, b = np.repeat(left, len(names)), np.tile(np.arange(len(names)), len(left))
    other = a != b
    lang = pa.array([members["lang"][0].as_py()] * int(other.sum()), pa.string())
    return pa.Table.from_arrays([lang, names.take(pa.array(a[other])), names.take(pa.array(b[other])), pa.array(sums.ravel()[other])], schema=schema)


def pair_divergence(vocab: DataFrame, groups: DataFrame, slice_entries: int = SLICE_ENTRIES) -> DataFrame:
    """``(lang, source, item, value)`` of every two sources of a language."""
    alike = staged(vocab.groupBy("lang", "counts").agg(F.count(F.lit(1)).alias("terms")), "divergence-rows")
    slices = alike.groupBy("lang").agg(F.ceil(F.sum(F.size("counts")) / F.lit(slice_entries)).alias("slices"))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / F.lit(SOURCE_BLOCK)).alias("blocks"))
    plan = staged(blocks.join(slices, "lang", "left").select("lang", "blocks", F.coalesce("slices", F.lit(1)).alias("slices")), "divergence-plan")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1))

    dealt = alike.join(plan, "lang").withColumn("slice", F.pmod(F.xxhash64("counts"), F.col("slices")).cast("int"))
    terms = dealt.select("lang", "slice", every("blocks").alias("block"), "counts", "terms")
    members = groups.join(plan, "lang").withColumn("slice", every("slices")).withColumn("block", every("blocks"))
    keys = ("lang", "slice", "block")
    partial = terms.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(compared, "lang string, source string, item string, value bigint")
    return partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_divergence(vocab: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` of each term that a source has more often than its language does."""

    def share(count: str, total: str) -> Column:
        return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + 1 as decimal(19, 0))) div cast({total} + v as decimal(19, 0))")

    rows = vocab.select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", F.col("c.source").alias("source"), "term", "total", F.col("c.n").alias("count"))
    rated = rows.join(groups, ["lang", "source"]).withColumns({"p": share("count", "n"), "q": share("total", "lang_n")})
    return rated.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: a group's divergence from every other source, and its ``top_terms`` most typical terms.

    Ranks go by the value, greatest first, then by the item's bytes.
    """
    vocab = staged(vocabulary(term_counts(docs, text, lang, source), min_docs), "divergence-vocabulary")
    groups = staged(groups_of(docs, vocab, lang, source), "divergence-groups")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    pairs = pair_divergence(vocab, groups).select("*", rank)
    terms = term_divergence(vocab, groups).select("*", rank).where(F.col("rank") <= top_terms)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).union(terms.withColumn("part", F.lit("term")).select(*columns))
