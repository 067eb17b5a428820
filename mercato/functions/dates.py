"""Date and period expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Period grains accepted by the revenue trend (fixed values).
GRANULARITIES = ("day", "week", "month")


def check_granularity(granularity: str) -> str:
    if granularity not in GRANULARITIES:
        raise ValueError(f"invalid granularity: {granularity!r}")
    return granularity


def period_start(ts: Column, granularity: str) -> Column:
    """First day (DATE) of the day/week/month holding ``ts``; weeks start Monday."""
    check_granularity(granularity)
    if granularity == "day":
        return F.to_date(ts)
    return F.trunc(F.to_date(ts), granularity)


def iso_dow(d: Column) -> Column:
    """ISO day of week, Monday = 1 ... Sunday = 7."""
    return (F.weekday(d) + 1).cast("int")


def weekday_name_padded(d: Column) -> Column:
    """English day name blank-padded to 9 characters (the 'Day' picture)."""
    return F.rpad(F.date_format(d, "EEEE"), 9, " ")


MICROS_PER_DAY = 86_400_000_000


def _micros_of_day(ts: Column) -> Column:
    return (F.hour(ts).cast("long") * 3_600_000_000
            + F.minute(ts).cast("long") * 60_000_000
            + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long"))


def microseconds_between(start: Column, end: Column) -> Column:
    """``end - start`` in microseconds for wall-clock (timestamp_ntz) values.

    Whole days between the dates plus the difference of the times of day; no
    time zone takes part, so the session's zone (and its daylight-saving
    shifts) cannot change the result.
    """
    days = F.datediff(F.to_date(end), F.to_date(start)).cast("long")
    return days * MICROS_PER_DAY + _micros_of_day(end) - _micros_of_day(start)


def period_date(c: Column) -> Column:
    """Period text (or a date) as a DATE for charting; a no-op on DATE input."""
    return F.to_date(c)
