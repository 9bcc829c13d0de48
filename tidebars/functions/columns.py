"""Column functions: symbols, request sizes, dates, scores, risk, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebars.timeframes import INTRADAY_MINUTES

# Most periods asked for, and days taken per period.
PERIOD_LIMITS = {"1w": (6000, 7), "1mo": (2000, 30), "1q": (500, 90)}
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)


def normalize_symbol(code: Column) -> Column:
    """``X.XSHG`` to ``shX``, ``X.XSHE`` to ``szX``, others unchanged."""
    bare = F.replace(F.replace(code, F.lit(".XSHG"), F.lit("")), F.lit(".XSHE"), F.lit(""))
    return (
        F.when(code.contains("XSHG"), F.concat(F.lit("sh"), bare))
        .when(code.contains("XSHE"), F.concat(F.lit("sz"), bare))
        .otherwise(code)
    )


def lookback_window(timeframe: Column, end: Column, count: Column) -> Column:
    """First date to ask for when ``count`` bars up to ``end`` are wanted."""
    days = count
    for code, (limit, length) in PERIOD_LIMITS.items():
        days = F.when(timeframe == code, F.least(count, F.lit(limit)) * length).otherwise(days)
    return F.date_sub(end, days.cast("int"))


def bar_budget(timeframe: Column, start: Column, end: Column) -> Column:
    """Bars to expect between two dates (four trading hours a day)."""
    days = F.datediff(end, start)
    cases = [F.when(timeframe == t, F.floor(days * 240 / m)) for t, m in INTRADAY_MINUTES.items()]
    cases += [
        F.when(timeframe == "1d", days),
        F.when(timeframe == "1w", F.floor(days / 7)),
        F.when(timeframe == "1mo", F.floor(days / 30)),
        F.when(timeframe == "1q", F.floor(days / 90) + 1),
    ]
    return F.coalesce(*[c.cast("bigint") for c in cases])


def _ymd(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month.cast("string"), day.cast("string"))
    return F.when(month.isNotNull() & day.isNotNull(), text.try_cast("date"))


def parse_holiday_date(text: Column, year: Column) -> Column:
    """First reading that is a date: ``1 Jan``, ``Jan 1`` (or full month names),
    ``day.month``, ``month.day``, ``yyyy-mm-dd``."""
    lowered = F.lower(text)

    numbers = F.create_map(
        *[F.lit(v) for i, m in enumerate(MONTHS) for v in ([m, i + 1, m[:3], i + 1] if m != "may" else [m, i + 1])]
    )

    def month_number(name: Column) -> Column:
        return F.try_element_at(numbers, name)

    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(lowered, pattern, group), F.lit(""))

    day_name, name_day = r"^\s*(\d{1,2})\s+([a-z]+)$", r"^\s*([a-z]+)\s+(\d{1,2})$"
    dotted, full = r"^\s*(\d{1,2})\.(\d{1,2})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    return F.coalesce(
        _ymd(year, month_number(part(day_name, 2)), part(day_name, 1)),
        _ymd(year, month_number(part(name_day, 1)), part(name_day, 2)),
        _ymd(year, part(dotted, 2), part(dotted, 1)),
        _ymd(year, part(dotted, 1), part(dotted, 2)),
        _ymd(part(full, 1), part(full, 2), part(full, 3)),
    )


def dynamic_weight(raw: Column, accuracy: Column, trend: Column, volatility: Column) -> Column:
    """Sigmoid of a raw weight scaled by accuracy, trend and volatility."""
    return 1 / (1 + F.exp(-(raw * (1 + accuracy) * (1 + trend) * volatility)))


def entry_level(raw: Column, trend: Column) -> Column:
    return (
        F.when((raw > 0.7) & (trend > 0.05), 2.0)
        .when((raw > 0.5) & (raw <= 0.7) & (trend > 0.03), 1.0)
        .when((raw > 0.3) & (raw <= 0.5) & (trend > 0.01), 0.5)
        .otherwise(0.0)
    )


def entry_strategy(strength: Column, level: Column, consistency: Column, risk: Column) -> Column:
    """Trade label; long bands exclude their lower edge, short bands too."""
    strong = (level > 1.5) & (risk < 0.1)
    medium = (level > 1) & (level <= 1.5) & (risk < 0.2)
    weak = (level > 0.5) & (level <= 1) & (risk < 0.3)
    up, down = consistency > 0, consistency < 0

    def band(low: float, high: float) -> Column:
        return (strength > low) & (strength <= high)

    return (
        F.when(strong & up & (strength > 0.7), "Strong_Long")
        .when(medium & up & band(0.5, 0.7), "Medium_Long")
        .when(weak & up & band(0.3, 0.5), "Weak_Long")
        .when(weak & down & band(-0.5, -0.3), "Weak_Short")
        .when(medium & down & band(-0.7, -0.5), "Medium_Short")
        .when(strong & down & (strength <= -0.7), "Strong_Short")
        .otherwise("Neutral")
    )


def adaptive_stop_loss(entry: Column, atr: Column, risk: Column, k: float = 2) -> Column:
    return entry * (1 - atr * risk * k)


def position_size(balance: Column, risk: Column, entry: Column, stop: Column) -> Column:
    """Units to buy so that a stop costs ``risk`` of the balance; null if there is no distance."""
    return F.try_divide(balance * risk, F.abs(entry - stop))


def circuit_breaker(change: Column, threshold: float = 0.1) -> Column:
    return F.abs(change) > threshold


def split_regex(text: Column, pattern: str) -> Column:
    return F.split(text, pattern, -1)


def join_nonempty(items: Column, separator: str) -> Column:
    """Non-empty items, each followed by the separator."""
    kept = F.filter(items, lambda x: x != "")
    return F.concat(F.array_join(kept, separator), F.when(F.size(kept) > 0, separator).otherwise(""))


def trim_equals(a: Column, b: Column | str) -> Column:
    """Whether ``a`` without surrounding white space is ``b``."""
    return F.regexp_replace(a, r"^\s+|\s+$", "") == b
