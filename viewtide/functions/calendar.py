"""Site-calendar expressions as SQL text. All of them fold to literals when the input is a
literal, so period limits reach the parquet scan as pushed filters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(as_of: str | datetime) -> str:
    """A timestamp literal; text without a zone is read in the session time zone."""
    text = as_of.isoformat(sep=" ") if isinstance(as_of, datetime) else as_of
    return f"CAST('{text}' AS TIMESTAMP)"


def instant(as_of: str | datetime) -> Column:
    return F.expr(at(as_of))


def period(ts: str, unit: str, offset: int = 1) -> str:
    """First date of the day / week (Monday) / month that ``ts`` counts towards."""
    return f"to_date(date_trunc('{unit}', {ts} - INTERVAL {int(offset)} MINUTE))"


def period_start(as_of, unit: str, offset: int = 1, back: int = 0) -> str:
    """Instant of the rollover that opened the period of ``as_of``, or of an earlier one."""
    first = period(at(as_of), unit, offset)
    earlier = {
        "day": f"date_sub({first}, {back})",
        "week": f"date_sub({first}, {7 * back})",
        "month": f"add_months({first}, {-back})",
    }[unit]
    return f"(CAST({earlier} AS TIMESTAMP) + INTERVAL {int(offset)} MINUTE)"


def hours_between(later: str, earlier: str) -> str:
    return f"((unix_micros({later}) - unix_micros({earlier})) / 3.6e9D)"
