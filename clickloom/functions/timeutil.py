"""Instants as UTC ``timestamp_ntz``, independent of the session zone."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, functions as F

EPOCH_TEXT = "1970-01-01 00:00:00"


def instant(value: str | datetime | date | Column) -> Column:
    """A UTC instant literal from text, a date or a datetime (aware ones are converted)."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            value = value.astimezone(timezone.utc).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    elif isinstance(value, date):
        value = f"{value.isoformat()} 00:00:00"
    return F.lit(value).cast("timestamp_ntz")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970.

    ``timestampdiff`` would go through the session zone and shift instants that
    fall into its daylight-saving gaps; the interval is free of any zone.
    """
    seconds = (ts - instant(EPOCH_TEXT)).cast("interval second").cast("decimal(20,6)")
    return (seconds * 1_000_000).cast("bigint")


def floor_micros(micros: Column, step: int) -> Column:
    """Largest multiple of ``step`` not above ``micros``."""
    return micros - F.pmod(micros, F.lit(step).cast("bigint"))


def from_epoch_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, instant(EPOCH_TEXT))


def days_before(as_of: str | datetime | date | Column, days: int) -> Column:
    return instant(as_of) - F.make_dt_interval(F.lit(int(days)))


def utc_day(ts: Column) -> Column:
    return ts.cast("date")


def offset_text_to_utc(text: Column, naive_zone: str) -> Column:
    """Parse ISO text to a UTC instant.

    Text with an offset or ``Z`` names an instant; text without one is local
    time in ``naive_zone``.
    """
    has_offset = text.rlike(r"[0-9:.](Z|[+-][0-9]{2}:?[0-9]{2})$")
    aware = from_epoch_micros(F.unix_micros(F.try_to_timestamp(text)))
    local = F.try_to_timestamp(F.concat(text, F.lit("Z")))
    naive = F.convert_timezone(
        F.lit(naive_zone), F.lit("UTC"), from_epoch_micros(F.unix_micros(local))
    )
    return F.when(has_offset, aware).otherwise(naive)
