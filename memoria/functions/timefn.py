"""Date and time expressions.

Timestamps in the inputs are ``timestamp_ntz``; every "now" of the reference is
an explicit ``as_of`` literal of the same type so results repeat.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_AS_OF = dt.datetime(2024, 2, 1, 0, 0, 0)


def as_of_lit(as_of: dt.datetime | str | None = None) -> Column:
    """A timestamp_ntz literal for ``as_of``."""
    if as_of is None:
        as_of = DEFAULT_AS_OF
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def micros_between(later: Column, earlier: Column) -> Column:
    """Exact elapsed microseconds. ``timestamp_ntz`` arithmetic has no time zone,
    so the result does not depend on the session time zone (no DST shifts)."""
    return F.timestamp_diff("MICROSECOND", earlier, later)


def days_between(later: Column, earlier: Column) -> Column:
    """Whole elapsed days, floored on 24-hour units (not calendar midnights).

    Equals Python's ``(later - earlier).days``: negative gaps floor towards
    minus infinity, 23 hours across midnight is 0.
    """
    return F.floor(micros_between(later, earlier) / F.lit(86_400_000_000)).cast("bigint")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Total elapsed seconds as a double (days included)."""
    return micros_between(later, earlier).cast("double") / F.lit(1_000_000.0)


EPOCH_NTZ = "1970-01-01 00:00:00"


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970-01-01 of a ``timestamp_ntz`` (time-zone free)."""
    return F.timestamp_diff("MILLISECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), ts)


def from_epoch_millis(ms: Column) -> Column:
    """``timestamp_ntz`` from milliseconds since 1970-01-01 (time-zone free)."""
    return F.timestamp_add("MILLISECOND", ms, F.lit(EPOCH_NTZ).cast("timestamp_ntz"))


def plus_days(ts: Column, days: Column | int) -> Column:
    days = days if isinstance(days, Column) else F.lit(days)
    return ts + F.make_dt_interval(days.cast("int"))


def plus_hours(ts: Column, hours: Column | int) -> Column:
    hours = hours if isinstance(hours, Column) else F.lit(hours)
    return ts + F.make_dt_interval(F.lit(0), hours.cast("int"))


def time_id(ts: Column, prefix: str = "") -> Column:
    """SC6: an id from a time, ``yyyyMMdd_HHmmss`` (e.g. ``summary_20240201_000000``)."""
    return F.concat(F.lit(prefix), F.date_format(ts, "yyyyMMdd_HHmmss"))


def iso_text(ts: Column) -> Column:
    """SC3: ISO-8601 text of a timestamp (microseconds)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def to_utc(ts: Column, source_tz: str) -> Column:
    """Trap T3: a naive local clock reading (``timestamp_ntz`` in ``source_tz``) as UTC
    ``timestamp_ntz``; apply on ingest so both stores share one clock."""
    return F.convert_timezone(F.lit(source_tz), F.lit("UTC"), ts.cast("timestamp_ntz"))
