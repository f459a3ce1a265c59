"""Epoch milliseconds, days and instants; all in UTC (see session.prepare)."""

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# The years a stored timestamp can hold: 0001-01-01 up to the end of 9999.
MIN_MILLIS = -62135596800000
MAX_MILLIS = 253402300799999


def millis_of_seconds(seconds: Column) -> Column:
    """Fractional epoch seconds to whole milliseconds, truncated; null when no calendar holds it."""
    millis = (seconds * 1000.0).try_cast("bigint")
    return F.when(millis.between(MIN_MILLIS, MAX_MILLIS), millis)


def utc(now: datetime) -> datetime:
    """A moment in UTC; without a zone it is taken to be UTC already."""
    return now.astimezone(timezone.utc) if now.tzinfo else now.replace(tzinfo=timezone.utc)


def instant(now: datetime) -> Column:
    """A moment as a literal that does not depend on the session's time zone."""
    delta = utc(now) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(delta.days * 86_400_000_000 + delta.seconds * 1_000_000 + delta.microseconds))


def days_before(moment: Column, days: int) -> Column:
    """Exact 24-hour days, not calendar days."""
    return moment - F.make_dt_interval(days=F.lit(days))


def day_of(moment: Column) -> Column:
    return F.to_date(moment)


def iso_instant(moment: Column) -> Column:
    """ISO-8601 with three fraction digits, or none on a whole second."""
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    millis = F.date_format(moment, ".SSS")
    return F.concat(whole, F.when(millis == ".000", "").otherwise(millis), F.lit("Z"))
