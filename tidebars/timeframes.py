"""The one timeframe vocabulary of the library.

A bar belongs to a timeframe code.  Intraday codes count minutes; period codes
name a calendar period whose minute count is the usual approximation (a month
is 30 days, a quarter 90).  ``1m`` is a month, as in the names of bar files; a
minute is ``1min``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code -> minutes.
INTRADAY_MINUTES = {"1min": 1, "5m": 5, "15m": 15, "30m": 30, "60m": 60, "4h": 240}
PERIOD_MINUTES = {"1d": 1440, "1w": 10080, "1mo": 43200, "1q": 129600}
MINUTES = {**INTRADAY_MINUTES, **PERIOD_MINUTES}

# Accepted spellings of a code.
ALIASES = {"1m": "1mo", "1M": "1mo", "1h": "60m", "240m": "4h"}


def canonical(code: str) -> str:
    """Canonical code of a timeframe spelling; raises on an unknown one."""
    code = ALIASES.get(code, code)
    if code not in MINUTES:
        raise ValueError(f"unknown timeframe {code!r}; known: {', '.join(MINUTES)}")
    return code


def lookup(column: Column, table: dict) -> Column:
    """The table's value for a column of its keys, null for others."""
    cases = [F.when(column == key, F.lit(value)) for key, value in table.items()]
    return F.coalesce(*cases)


def canonical_column(column: Column) -> Column:
    return F.coalesce(lookup(column, ALIASES), column)


def known_column(column: Column) -> Column:
    """Canonical codes; a row with an unknown one, or none, is an error."""
    code = canonical_column(column)
    message = F.concat(F.lit("unknown timeframe "), F.coalesce(column, F.lit("null")), F.lit(f"; known: {', '.join(MINUTES)}"))
    return F.when(code.isin(*MINUTES), code).otherwise(F.raise_error(message))


def minutes_of(column: Column) -> Column:
    """Minutes of a timeframe column, null for an unknown code."""
    return lookup(column, MINUTES).cast("bigint")


def is_intraday(column: Column) -> Column:
    return column.isin(*INTRADAY_MINUTES)

