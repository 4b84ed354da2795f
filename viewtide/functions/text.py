"""Display expressions of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit suffixes per language, each step a thousand times the last.
SUFFIXES = {"en": ("K", "M", "B", "T"), "vi": ("N", "Tr", "T", "TT")}

# Seconds per age unit, largest first, with the unit's name.
AGE_UNITS = ((31536000, "year"), (2592000, "month"), (604800, "week"),
             (86400, "day"), (3600, "hour"), (60, "min"))


def short_count(n: Column, locale: str = "en_US") -> Column:
    """``1500000`` → ``1.5 M``; one decimal only when there is a fraction."""
    suffixes = SUFFIXES["vi" if locale.startswith("vi") else "en"]
    out = n.cast("bigint").cast("string")
    last = len(suffixes)
    for step, suffix in enumerate(suffixes, start=1):
        scaled = n / F.lit(1000.0**step)
        shown = F.when(scaled > F.floor(scaled), F.format_number(F.round(scaled, 1), 1)) \
            .otherwise(F.format_number(scaled, 0))
        reached = n >= 1000**step
        # A later, larger step overrides this one; the last step has no upper limit.
        below = n < 1000 ** (step + 1) if step < last else F.lit(True)
        out = F.when(reached & below, F.concat(shown, F.lit(f" {suffix}"))).otherwise(out)
    return out


def grouped_count(n: Column) -> Column:
    return F.format_number(n, 0)


def count_text(n: Column, fmt: str = "formatted", locale: str = "en_US") -> Column:
    if fmt == "raw":
        return n.cast("string")
    return short_count(n, locale) if fmt == "short" else grouped_count(n)


def age_text(earlier: Column, later: Column) -> Column:
    """``3 days``: rounded to the nearest unit, at least 1."""
    seconds = F.abs(F.unix_timestamp(later) - F.unix_timestamp(earlier))
    out = F.concat(F.greatest(seconds, F.lit(1)).cast("string"), F.lit(" second"),
                   F.when(seconds > 1, "s").otherwise(""))
    for size, name in reversed(AGE_UNITS):
        n = F.greatest(F.round(seconds / size), F.lit(1.0)).cast("bigint")
        label = F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n > 1, "s").otherwise(""))
        out = F.when(seconds >= size, label).otherwise(out)
    return out


def trim_words(text: Column, words: int = 35, more: str = "...") -> Column:
    """First words of a text, joined by single spaces, with a mark when cut."""
    parts = F.filter(F.split(text, r"[\n\r\t ]+"), lambda w: w != "")
    return F.when(F.size(parts) > words, F.concat(F.array_join(F.slice(parts, 1, words), " "), F.lit(more))) \
        .otherwise(F.array_join(parts, " "))


def fixed(x: Column, digits: int = 6) -> Column:
    """Half-up rounding by plain double arithmetic, the same in every engine."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
