"""Dates of mixed text formats. All are read in the session's time zone, which the library pins to UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms that dates come in.
_ISO, _DAY_FIRST = "yyyy-MM-dd H:m:s", "d/M/yyyy H:m:s"
_CREATION = (_DAY_FIRST, _ISO, "yyyy-MM-dd")
_FLEXIBLE = (_ISO, "yyyy-MM-dd H:m:s.SSSSSS", "yyyy-MM-dd", _DAY_FIRST, "d/M/yyyy", "yyyy-MM-dd'T'H:m:s", "yyyy-MM-dd'T'H:m:s.SSSSSS'Z'")


def _first(text: Column, formats: tuple[str, ...]) -> list[Column]:
    return [F.try_to_timestamp(text, F.lit(f)) for f in formats]


def _epoch(text: Column) -> Column:
    return F.timestamp_seconds(text.try_cast("double"))


def parse_time(text: Column) -> Column:
    """ISO date-time, with a fraction, ISO date, day-first date-time, day-first date, then seconds since 1970; else null."""
    return F.coalesce(*_first(text, _FLEXIBLE[:5]), _epoch(text))


def parse_creation_time(text: Column) -> Column:
    """Day-first date-time, ISO date-time, ISO date; no epoch."""
    return F.coalesce(*_first(text, _CREATION))


def parse_flexible(text: Column) -> Column:
    """As parse_time, with the T forms; '', '0', 'NULL' and 'None' are null."""
    known = F.when(~text.isin("", "0", "NULL", "None"), text)
    return F.coalesce(*_first(known, _FLEXIBLE), _epoch(known))


def reliable_time(modified: Column, created: Column) -> Column:
    """The modification time if it can be read, else the creation time."""
    return F.coalesce(parse_time(modified), parse_time(created))


def days_before(as_of: str, days: int) -> Column:
    return F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS")


def whole_days(as_of: str, moment: Column) -> Column:
    """Days between, rounded down."""
    return F.floor((F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp(moment)) / 86400).cast("long")
