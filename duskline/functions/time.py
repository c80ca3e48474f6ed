"""Local time, night keys and date labels. now is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Copenhagen"
#: The night of a date lasts until this hour of the next.
CUTOFF_HOUR = 6


def local(ts: Column) -> Column:
    """Wall-clock time of a UTC instant."""
    return F.from_utc_timestamp(ts, ZONE)


def night_key(ts: Column) -> Column:
    """The local date, that of the day before until the cutoff hour."""
    return F.to_date(local(ts) - F.expr(f"INTERVAL {CUTOFF_HOUR} HOURS"))


def wall_to_utc(wall: Column) -> Column:
    """The instant of a wall-clock time. In an hour that occurs twice, the later one, as stepping to a fix point from UTC finds it."""
    first = F.to_utc_timestamp(wall, ZONE)
    later = first + F.expr("INTERVAL 1 HOUR")
    return F.when(local(later) == wall, later).otherwise(first)


def trusted_end(start: Column, end: Column) -> Column:
    return F.coalesce(end > start, F.lit(False))


def effective_end(start: Column, end: Column) -> Column:
    """The end if it is after the start, else the cutoff hour after the night."""
    closing = F.date_add(night_key(start), 1).cast("timestamp") + F.expr(f"INTERVAL {CUTOFF_HOUR} HOURS")
    return F.when(trusted_end(start, end), end).otherwise(wall_to_utc(closing))


def is_past(start: Column, end: Column, now: Column) -> Column:
    return effective_end(start, end) <= now


def in_progress(start: Column, end: Column, now: Column) -> Column:
    return (start <= now) & (now < effective_end(start, end))


def upcoming_candidate(start: Column, end: Column, now: Column) -> Column:
    """A superset of what is not past, in comparisons that a Parquet scan can use."""
    return (start >= now - F.expr("INTERVAL 3 DAYS")) | (end > now)


def public_upcoming(start: Column, end: Column, now: Column) -> Column:
    """The looser rule of stored views: without an end, a day from the start."""
    return F.coalesce(end, start + F.expr("INTERVAL 1 DAY")) > now


def end_is_valid(start: Column, end: Column) -> Column:
    return end.isNull() | (end > start)


def weekday(date: Column) -> Column:
    """0 (Sunday) to 6."""
    return F.dayofweek(date) - 1


def friday_of(night: Column) -> Column:
    """The Friday of the weekend that a night belongs to, or else the coming one."""
    day = weekday(night)
    return F.date_add(night, F.when(day == 0, -2).otherwise(5 - day).cast("int"))


def in_weekend(night: Column, friday: Column) -> Column:
    return night.between(friday, F.date_add(friday, 2))


def iso_week(date: Column) -> Column:
    """YYYY-Www of a date."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), date).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def day_span(start: Column, end: Column) -> Column:
    """Local dates from start to end; 0 without an end."""
    return F.coalesce(F.datediff(F.to_date(local(end)), F.to_date(local(start))), F.lit(0))


def month_key(ts: Column) -> Column:
    return F.date_format(night_key(ts), "yyyy-MM")


def row_label(ts: Column) -> Column:
    """FRI 05 JAN of the night."""
    return F.upper(F.date_format(night_key(ts), "EEE dd MMM"))


def time_label(ts: Column) -> Column:
    return F.date_format(local(ts), "HH:mm")


def range_label(start: Column, end: Column) -> Column:
    return F.when(end.isNull(), time_label(start)).otherwise(F.concat(time_label(start), F.lit("–"), time_label(end)))


def age_label(ts: Column, now: Column) -> Column:
    """just now, Nm ago, Nh ago or Nd ago; halves are rounded up."""
    minutes = F.floor((F.unix_millis(now) - F.unix_millis(ts)) / 60000 + 0.5)
    hours, days = F.floor(minutes / 60 + 0.5), F.floor(F.floor(minutes / 60 + 0.5) / 24 + 0.5)
    return F.when(minutes < 1, "just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago"))).when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago"))).otherwise(F.concat(days.cast("string"), F.lit("d ago")))


def local_input(ts: Column) -> Column:
    """Minute-resolution local text, as a date-time field has it."""
    return F.date_format(local(ts), "yyyy-MM-dd'T'HH:mm")


def from_local_input(text: Column) -> Column:
    return wall_to_utc(F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm"))


def frequency_ms(text: Column) -> Column:
    """Milliseconds of "every N h/m/d", null if it isn't that."""
    pattern = r"(?i)^every\s+(\d+)\s*(h|hr|hrs|hour|hours|m|min|mins|minute|minutes|d|day|days)$"
    n, unit = F.regexp_extract(F.trim(text), pattern, 1), F.lower(F.substring(F.regexp_extract(F.trim(text), pattern, 2), 1, 1))
    return F.when(n != "", n.cast("long") * F.when(unit == "h", 3_600_000).when(unit == "m", 60_000).otherwise(86_400_000))


def cron_is_due(cron_hour: Column, utc_offset: Column, local_hour: int = 10) -> Column:
    """Whether a UTC cron hour is the given local hour at an offset of 1 or 2."""
    return cron_hour + utc_offset == local_hour


def edge_flags(start: Column, first_night: Column, last_night: Column) -> Column:
    """What is odd about a start at the edges of a window of nights."""
    flag = lambda test, name: F.when(test, name)
    night = night_key(start)
    early = (F.to_date(local(start)) == first_night) & (F.hour(local(start)) < CUTOFF_HOUR)
    late = (night == last_night) & (F.to_date(local(start)) > last_night)
    return F.array_compact(F.array(flag(night < first_night, "before-window"), flag(early, "early-first-night"), flag(late, "after-midnight-last-night")))


def sending_hour(now: Column) -> Column:
    return F.hour(local(now)).between(8, 21)
