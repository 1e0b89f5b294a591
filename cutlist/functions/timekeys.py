"""Instants, wall clocks and day keys.

Instants are TIMESTAMP_NTZ read as UTC and wall clocks are TIMESTAMP_NTZ in their own zone, so no
result depends on the session's time zone.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from cutlist.functions.text import bind, strip, strip_field

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def known_zones(spark: SparkSession) -> list[str]:
    """Zone names that both Python's list and the JVM know; any other would fail the job."""
    jvm = spark._jvm
    ids = set(jvm.java.lang.String.join(" ", jvm.java.time.ZoneId.getAvailableZoneIds()).split())
    return sorted(ids & zoneinfo.available_timezones())


def wall_clock(utc: Column, zone: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), zone, utc)


def from_wall_clock(local: Column, zone: Column) -> Column:
    return F.convert_timezone(zone, F.lit("UTC"), local)


def utc_of(instant: Column) -> Column:
    """A TIMESTAMP as its UTC wall clock, by way of its microseconds: no session zone takes part."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr(_EPOCH))


def epoch_ms(ts: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", F.expr(_EPOCH), ts)


def iso_instant(text: Column) -> Column:
    """ISO time to UTC; text without an offset is read as UTC, bad text gives null (F2)."""

    def parse(value: Column) -> Column:
        zoned = F.when(value.rlike(r"([+-]\d{2}:?\d{2}|[Zz])$"), value).otherwise(F.concat(value, F.lit("Z")))
        plain = F.regexp_replace(zoned, r"([+-]\d{2})(\d{2})$", "$1:$2")
        return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), plain.try_cast("timestamp"))

    return utc_of(bind(text, lambda given: bind(strip_field(given), parse)))


def iso_wall_clock(text: Column) -> Column:
    """ISO time as the clock on the wall; an offset in the text is ignored."""
    value = F.regexp_replace(strip(text), r"([+-]\d{2}:?\d{2}|[Zz])$", "")
    return F.when(strip(text).rlike(r"^\d{4}-\d{2}-\d{2}"), value.try_cast("timestamp_ntz"))


def filename_time(name: Column) -> Column:
    """``YYYYMMDD_HHMMSS`` anywhere in a file name, as a wall clock; impossible digits give null (F1)."""

    def read(digits: Column) -> Column:
        part = lambda at, length: F.substring(digits, at, length).try_cast("int")
        # Second 60 would roll over to the next minute.
        seconds = F.when(part(14, 2) < 60, part(14, 2))
        return F.try_make_timestamp_ntz(part(1, 4), part(5, 2), part(7, 2), part(10, 2), part(12, 2), seconds)

    return bind(F.regexp_extract(name, r"(\d{8}_\d{6})", 1), read)


def day_key(local: Column, day_start_hour: Column | int) -> Column:
    """The date a clip belongs to when the day starts ``day_start_hour`` hours after midnight."""
    hours = F.lit(day_start_hour) if isinstance(day_start_hour, int) else day_start_hour
    return F.to_date(F.timestamp_add("HOUR", -F.greatest(F.lit(0), F.coalesce(hours, F.lit(0))), local))
