"""Timestamps, days and periods. The report zone is always an explicit argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted ISO-8601 shapes: a date, optionally a time, optionally an offset.
_ISO_SHAPE = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)
_HAS_OFFSET = r":\d{2}(\.\d+)?(Z|[+-]\d{2}(:?\d{2})?)$"
_HAS_TIME = r"^.{10}[T ]"


def instant(ts_raw: Column, zone: str) -> Column:
    """ISO text to an instant; invalid text is null, text without an offset is in ``zone``.

    The zone is attached to the text, so the result does not depend on the session zone.
    """
    text = (
        F.when(ts_raw.rlike(_HAS_OFFSET), ts_raw)
        .when(ts_raw.rlike(_HAS_TIME), F.concat(ts_raw, F.lit(f" {zone}")))
        .otherwise(F.concat(ts_raw, F.lit(f"T00:00:00 {zone}")))
    )
    return F.when(ts_raw.rlike(_ISO_SHAPE), F.try_to_timestamp(text))


def wall_clock(ts: Column, zone: str) -> Column:
    """Instant to local wall-clock time (timestamp without zone)."""
    return F.convert_timezone(F.current_timezone(), F.lit(zone), ts.cast("timestamp_ntz"))


def as_utc(wall: Column) -> Column:
    """The instant at which a UTC clock shows this wall-clock time."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), wall).cast("timestamp")


def local_day(ts_raw: Column, zone: str) -> Column:
    return F.to_date(wall_clock(instant(ts_raw, zone), zone))


def local_hour(ts_raw: Column, zone: str) -> Column:
    return F.hour(wall_clock(instant(ts_raw, zone), zone))


def iso(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def period_start(day: Column, grain: str) -> Column:
    """First day of the period; weeks start on Monday."""
    if grain == "day":
        return F.to_date(day)
    return F.to_date(F.date_trunc(grain, day))


def period_end(start: Column, grain: str) -> Column:
    """Last day of the period that begins on ``start``."""
    if grain == "day":
        return start
    if grain == "week":
        return F.date_add(start, 6)
    return F.last_day(start)


def period_days(start: Column, grain: str) -> Column:
    return F.sequence(start, period_end(start, grain), F.expr("interval 1 day"))


def shift_months(day: Column, months: int) -> Column:
    """Month-aligned shift: the result is always the first of a month."""
    return F.to_date(F.date_trunc("month", F.add_months(day, months)))


def day_distance(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def day_number(day: Column) -> Column:
    return F.unix_date(day)


def weekday(day: Column) -> Column:
    """0 = Monday."""
    return F.weekday(day)
