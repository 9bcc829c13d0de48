"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A text is cut into chunks of lines where a rolling hash over the hashes of a few
lines says so.  Where chunks end thus depends on these lines only, so lines that
are put in or taken out upstream don't shift the chunks after them.  Chunks of
two lines or more that occur before, in a smaller key or earlier in the text,
are removed once their bytes have been compared with those of the first
occurrence.  A removed line always stands somewhere before: in the first
occurrence of its chunk, or, if that is removed itself, in that one's.

One chunking (`chunks_of`) finds a repeated passage only if chunks happen to end
at both its ends.  `chunkings_of` makes 64 of them side by side, one for each bit
of 64-bit words: a line's hash says in which chunkings a chunk begins with
it and in which one ends with it.  Both are facts of the passage itself, whatever
stands around it, and two lines on end are a chunk of some chunking with
probability ``1 - (15/16)**64``, 0.98; what repeats in any of them goes.

`windows_of`, all pairs of lines on end, is what the chunkings are measured against.

Occurrences are first counted by hash, without text.  Only chunks whose hash
repeats meet again, as text, in a join with their first occurrence: a chunk in a
third of all rows is one large key of a plain join, which Spark splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.rows import ROW, packed
from tidebars.llm.staging import staged

WINDOW_LINES = 2
DIVISOR = 4
MIN_LINES = 2
#: The longest chunk of `chunkings_of`; a longer one is none, and its lines are left to the other chunkings.
MAX_LINES = 6
NO_KEY = 2**63 - 1


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once for each row.

    A column that lambdas mention may be put into them by the optimiser and so be
    computed for each element; what a lambda gets as its argument is not.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


def lines_of(text: Column) -> Column:
    """What ``\\n`` separates, empty lines included; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def chunks_of(lines: Column) -> Column:
    """``(start, lines, hash)`` of each chunk of an array of lines, in order."""

    def ends_of(hashes: Column) -> Column:
        def ends_chunk(i: Column) -> Column:
            recent = [F.coalesce(F.get(hashes, i - back), F.lit(0)) for back in reversed(range(WINDOW_LINES))]
            return (i == F.size(hashes) - 1) | (F.pmod(F.xxhash64(*recent), F.lit(DIVISOR)) == 0)

        return F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), ends_chunk)

    def cut(hashes: Column, ends: Column) -> Column:
        def chunk(end: Column, k: Column) -> Column:
            start = F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1) + 1)
            size = end - start + 1
            return F.struct(start.alias("start"), size.alias("lines"), F.xxhash64(F.slice(hashes, start + 1, size)).alias("hash"))

        return F.transform(ends, chunk)

    return let(F.transform(lines, lambda x: F.xxhash64(x)), lambda hashes: let(ends_of(hashes), lambda ends: cut(hashes, ends)))


def windows_of(lines: Column) -> Column:
    """``(start, lines, hash)`` of all `MIN_LINES` lines on end of an array of lines, in order."""

    def cut(hashes: Column) -> Column:
        def window(_: Column, i: Column) -> Column:
            return F.struct(i.alias("start"), F.lit(MIN_LINES).alias("lines"), F.xxhash64(F.slice(hashes, i + 1, MIN_LINES)).alias("hash"))

        return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (MIN_LINES - 1), F.lit(0))), window)

    return let(F.transform(lines, lambda x: F.xxhash64(x)), cut)


def chunkings_of(lines: Column) -> Column:
    """``(start, lines, hash)`` of the different chunks of `MIN_LINES` to `MAX_LINES` lines that any of 64 chunkings makes.

    Equal lines on end are told apart by their number modulo 4, or no chunk could begin or end between them.
    """

    def told_apart(hashes: Column) -> Column:
        def tagged(h: Column, i: Column) -> Column:
            alike = F.coalesce(h == F.get(hashes, i - 1), F.lit(False)) | F.coalesce(h == F.get(hashes, i + 1), F.lit(False))
            return F.xxhash64(h, F.when(alike, F.pmod(i, F.lit(4))).otherwise(F.lit(0)))

        return F.transform(hashes, tagged)

    def ends_of(hashes: Column) -> Column:
        """Per line, the chunkings in which a chunk ends after it: by its own mark, by that of the next line, and all at the end."""

        def mark(h: Column, i: Column) -> Column:
            after = F.get(hashes, i + 1)
            return F.when(after.isNull(), F.lit(-1).cast("bigint")).otherwise(F.xxhash64(h, F.lit(1)).bitwiseOR(F.xxhash64(after, F.lit(2))))

        return F.transform(hashes, mark)

    def cut(hashes: Column, ends: Column) -> Column:
        def from_line(_: Column, i: Column) -> Column:
            begins = F.when(i == 0, F.lit(-1).cast("bigint")).otherwise(F.get(ends, i - 1))
            found, open_ = [], begins.bitwiseAND(F.bitwise_not(F.get(ends, i)))
            for size in range(MIN_LINES, MAX_LINES + 1):
                end = F.coalesce(F.get(ends, i + (size - 1)), F.lit(0).cast("bigint"))
                chunk = F.struct(i.alias("start"), F.lit(size).alias("lines"), F.xxhash64(F.slice(hashes, i + 1, size)).alias("hash"))
                found.append(F.when(open_.bitwiseAND(end) != 0, chunk))
                open_ = open_.bitwiseAND(F.bitwise_not(end))
            return F.array_compact(F.array(*found))

        return F.flatten(F.transform(hashes, from_line))

    def chunks(hashes: Column) -> Column:
        return let(let(told_apart(hashes), ends_of), lambda ends: cut(hashes, ends))

    return let(F.transform(lines, lambda x: F.xxhash64(x)), chunks)


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", parts_of: Callable[[Column], Column] = chunks_of) -> DataFrame:
    """``(_k, _copy, at, lines)``: the parts that go, by row (its key and a hash of its text), first line and number of lines.

    A part stays where it occurs first: by key (null last), by the hash of the
    text, by place.  Rows equal in key and text are treated alike.  Parts of
    one line, those without anything but white space, and parts that overlap
    their first occurrence always stay.  Of the parts that begin with one line the longest is enough.
    """
    rows = docs.select(F.coalesce(key, F.lit(NO_KEY)).cast("bigint").alias("_k"), F.xxhash64(text).alias("_copy"), F.col(text).alias("_text"))
    narrow = rows.select("_k", "_copy", F.explode(let(lines_of(F.col("_text")), parts_of)).alias("c"))
    narrow = narrow.where(F.col("c.lines") >= MIN_LINES).select("_k", "_copy", F.col("c.start").alias("at"), F.col("c.lines").alias("lines"), F.col("c.hash").alias("hash"))
    # One entry per row and part: rows equal in key and text come together here.
    seen = narrow.groupBy("hash").agg(F.min(F.struct("_k", "_copy", "at")).alias("first"), F.max(F.struct("_k", "_copy", "at")).alias("last"))
    firsts = staged(seen.where("first < last").select("hash", "first"), "line-chunks")
    clear = (F.col("_k") != F.col("first._k")) | (F.col("_copy") != F.col("first._copy")) | (F.col("at") == F.col("first.at")) | (F.col("at") >= F.col("first.at") + F.col("lines"))
    is_first = F.struct("_k", "_copy", "at") == F.col("first")
    found = narrow.join(firsts, "hash").where(clear).select("_k", "_copy", is_first.alias("is_first"), F.struct("at", "lines", "hash").alias("c"))

    def longest(parts: Column) -> Column:
        return F.filter(parts, lambda c, i: F.coalesce(F.get(parts, i + 1)["at"] != c["at"], F.lit(True)))

    wanted = found.groupBy("_k", "_copy").agg(
        F.sort_array(F.collect_set(F.when(~F.col("is_first"), F.col("c")))).alias("again"), F.collect_set(F.when(F.col("is_first"), F.col("c"))).alias("first")
    )
    again = F.transform(let(F.col("again"), longest), lambda c: c.withField("is_first", F.lit(False)))
    first = F.transform("first", lambda c: c.withField("is_first", F.lit(True)))
    wanted = wanted.select("_k", "_copy", F.concat(again, first).alias("wanted"))

    def spelt(lines: Column) -> Column:
        return F.transform("wanted", lambda c: c.withField("body", F.array_join(F.slice(lines, c["at"] + 1, c["lines"]), "\n")))

    # Rows are dealt by key at every size, so that the plan, and what it costs a row, is the same for all.
    bodies = rows.join(wanted.hint("merge"), ["_k", "_copy"]).select("_k", "_copy", F.explode(let(lines_of(F.col("_text")), spelt)).alias("c"))
    bodies = bodies.select("_k", "_copy", "c.*").where(F.length(F.trim(F.regexp_replace("body", r"[\s]+", " "))) > 0)
    bodies = staged(bodies, "line-bodies")
    kept = bodies.where("is_first").groupBy("hash").agg(F.min("body").alias("first_body"))
    same = bodies.where("not is_first").join(staged(kept, "line-firsts"), "hash").where("body = first_body")
    return same.select("_k", "_copy", "at", "lines")


def _edited(docs: DataFrame, key: str, text: str, parts_of: Callable[[Column], Column]) -> DataFrame:
    """Packed rows with ``made``: the text that stays and its number of lines, null where nothing goes."""
    gone = staged(repeated(docs, key, text, parts_of), "line-repeats").groupBy("_k", "_copy").agg(F.collect_set(F.struct("at", "lines")).alias("_gone"))
    stamped = docs.select(packed(docs.columns), F.coalesce(key, F.lit(NO_KEY)).cast("bigint").alias("_k"), F.xxhash64(text).alias("_copy"))

    def uncovered(lines: Column) -> Column:
        covered = F.flatten(F.transform("_gone", lambda g: F.sequence(g["at"], g["at"] + g["lines"] - 1)))
        stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
        return let(stays, lambda kept: F.struct(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n").alias("text"), F.size(kept).alias("lines")))

    made = F.when(F.col("_gone").isNotNull(), let(lines_of(F.col(ROW)[text]), uncovered)).alias("made")
    return stamped.join(gone.hint("merge"), ["_k", "_copy"], "left").select(ROW, made)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", parts_of: Callable[[Column], Column] = chunks_of) -> DataFrame:
    """Key, text without its repeated chunks or windows, ``n_lines`` of the whole text and ``n_removed`` of these.

    All rows stay; a text of which nothing is left is empty, a null one stays null.
    """
    row, made = F.col(ROW), F.col("made")
    n_lines = F.size(lines_of(row[text])).cast("bigint")
    return _edited(docs, key, text, parts_of).select(
        row[key].alias(key), F.coalesce(made["text"], row[text]).alias(text), n_lines.alias("n_lines"),
        F.coalesce(n_lines - made["lines"], F.lit(0)).cast("bigint").alias("n_removed"),
    )


def without_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: str = "n_chars", parts_of: Callable[[Column], Column] = chunks_of
) -> DataFrame:
    """``docs`` with repeated chunks or windows gone from ``text``; ``size``, if there is such a column, follows edited texts.

    All rows and all other columns stay as they were.
    """
    row, made = F.col(ROW), F.col("made")
    columns = {c: row[c] for c in docs.columns} | {text: F.coalesce(made["text"], row[text])}
    if size in docs.columns:
        columns[size] = F.coalesce(F.char_length(made["text"]).cast(docs.schema[size].dataType), row[size])
    return _edited(docs, key, text, parts_of).select(*[column.alias(c) for c, column in columns.items()])
