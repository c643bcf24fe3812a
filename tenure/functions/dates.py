"""Calendar arithmetic around a snapshot instant ``t``.

Everything works on DATE or zone-free timestamps, so results do not depend on
the session time zone. ``t`` may be a string, a date or a datetime; it becomes a
literal that Catalyst folds, so range filters on it reach the Parquet scan.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

Instant = str | date | datetime


def as_datetime(t: Instant) -> datetime:
    if isinstance(t, datetime):
        return t
    if isinstance(t, date):
        return datetime(t.year, t.month, t.day)
    return datetime.fromisoformat(t)


def instant(t: Instant) -> Column:
    return F.lit(as_datetime(t).isoformat(sep=" ")).cast("timestamp_ntz")


def snapshot_date(t: Instant) -> Column:
    return F.lit(as_datetime(t).date())


def shifted(t: Instant, weeks: int = 0, months: int = 0, years: int = 0) -> Column:
    """``t`` moved by calendar units; month ends are clamped (Dec 31 + 2 months = Feb 28)."""
    moved = instant(as_datetime(t) + timedelta(weeks=weeks))
    span = 12 * years + months
    return moved + F.expr(f"INTERVAL '{span}' MONTH") if span else moved


def in_lookback(ts: Column, t: Instant, weeks: int) -> Column:
    return ts.between(shifted(t, weeks=-weeks), instant(t))


def week_start(ts: Column) -> Column:
    """Monday of the week, as DATE."""
    day = F.to_date(ts)
    return F.date_sub(day, F.weekday(day))


def _sunday(day: Column) -> Column:
    return F.date_sub(day, F.dayofweek(day) - 1)


def week_number(ts: Column, t: Instant, weeks: int = 8) -> Column:
    """Sunday boundaries crossed between ``t - weeks`` and the Monday of ``ts``."""
    first = _sunday(F.to_date(shifted(t, weeks=-weeks)))
    return F.floor(F.datediff(_sunday(week_start(ts)), first) / 7).cast("long")


def _monday(day: date) -> date:
    return day - timedelta(days=day.weekday())


def week_zero(t: Instant, weeks: int = 8) -> date:
    """The Sunday that ``week_number`` counts from."""
    start = as_datetime(t).date() - timedelta(weeks=weeks)
    return start - timedelta(days=(start.weekday() + 1) % 7)


def week_numbers(t: Instant, weeks: int = 8) -> list[int]:
    """Every value ``week_number`` can take in the lookback window of ``t``.

    They follow from ``t`` alone: -1 .. weeks-1 on a Sunday, 0 .. weeks otherwise,
    so a pivot over weeks never needs a discovery job.
    """
    start = as_datetime(t).date() - timedelta(weeks=weeks)
    base = start - timedelta(days=(start.weekday() + 1) % 7)
    monday = _monday(start)
    first = (monday - timedelta(days=1) - base).days // 7
    return list(range(first, first + (_monday(as_datetime(t).date()) - monday).days // 7 + 1))


def week_offset(ts: Column, t: Instant, weeks: int) -> Column:
    """0-based position of a Monday week inside the lookback window."""
    first = _monday(as_datetime(t).date() - timedelta(weeks=weeks))
    return F.floor(F.datediff(week_start(ts), F.lit(first)) / 7).cast("int")


def previous_week(t: Instant) -> date:
    """Monday of the last complete week before the week of ``t``."""
    return _monday(as_datetime(t).date()) - timedelta(weeks=1)


def year_fraction(day: Column) -> Column:
    return F.year(day) + F.dayofyear(day) / F.lit(365.0)


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(F.to_date(end), F.to_date(start))


def parse_date(text: Column) -> Column:
    """``yyyy-MM-dd`` text to DATE; text that is not a date becomes NULL."""
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
