"""Text forms of events: calendar files, links, JSON-LD, routes; and append-only writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import time


def ics_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def ics_escaped(value: Column) -> Column:
    for plain, escaped in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        value = F.replace(value, F.lit(plain), F.lit(escaped))
    return value


def closing(start: Column, end: Column) -> Column:
    return F.coalesce(end, time.effective_end(start, F.lit(None).cast("timestamp")))


def ics_file(uid: Column, stamp: Column, start: Column, end: Column, title: Column, place: Column, description: Column, url: Column, product: str = "-//duskline//EN") -> Column:
    """An event as a calendar file, lines ended as the format asks."""
    lines = [F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit(f"PRODID:{product}"), F.lit("CALSCALE:GREGORIAN"), F.lit("METHOD:PUBLISH"), F.lit("BEGIN:VEVENT")]
    lines += [F.concat(F.lit("UID:"), uid), F.concat(F.lit("DTSTAMP:"), ics_stamp(stamp)), F.concat(F.lit("DTSTART:"), ics_stamp(start)), F.concat(F.lit("DTEND:"), ics_stamp(closing(start, end)))]
    lines += [F.concat(F.lit("SUMMARY:"), ics_escaped(title)), F.concat(F.lit("LOCATION:"), ics_escaped(place)), F.concat(F.lit("DESCRIPTION:"), ics_escaped(description)), F.concat(F.lit("URL:"), url)]
    return F.concat_ws("\r\n", *lines, F.lit("END:VEVENT"), F.lit("END:VCALENDAR"))


def query_string(**parameters: Column) -> Column:
    return F.concat_ws("&", *[F.concat(F.lit(k + "="), F.url_encode(v)) for k, v in parameters.items()])


def calendar_link(start: Column, end: Column, title: Column, details: Column, place: Column) -> Column:
    dates = F.concat(ics_stamp(start), F.lit("/"), ics_stamp(closing(start, end)))
    return F.concat(F.lit("https://calendar.google.com/calendar/render?"), query_string(action=F.lit("TEMPLATE"), text=title, dates=dates, details=details, location=place))


def event_status(cancelled: Column, postponed: Column, moved: Column) -> Column:
    name = F.when(cancelled, "Cancelled").when(postponed, "Postponed").when(moved, "Rescheduled").otherwise("Scheduled")
    return F.concat(F.lit("https://schema.org/Event"), name)


def json_ld(title: Column, start: Column, end: Column, status: Column, place: Column, artists: Column, url: Column) -> Column:
    """An event as JSON-LD; absent values leave no key."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    performer = F.transform(artists, lambda a: F.struct(F.lit("PerformingGroup").alias("@type"), a.alias("name")))
    location = F.struct(F.lit("Place").alias("@type"), place.alias("name"))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("MusicEvent").alias("@type"), title.alias("name"), iso(start).alias("startDate"), iso(end).alias("endDate"), status.alias("eventStatus"), location.alias("location"), performer.alias("performer"), url.alias("url")))


def change_log(changes: DataFrame, by: str, kind: str, at: Column) -> DataFrame:
    """Rows of the append-only log: event_id, changed_by, change_type, fields_changed (of the column patch), note, created_at."""
    return changes.select("event_id", F.lit(by).alias("changed_by"), F.lit(kind).alias("change_type"), F.array_sort(F.map_keys("patch")).alias("fields_changed"), F.lit(None).cast("string").alias("note"), at.alias("created_at"))


def summary_text(text: Column, most: int = 155) -> Column:
    """One line of at most so many characters, cut between words."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.regexp_replace(F.substring(flat, 1, most), r"\s+\S*$", "")
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(head, F.lit("…")))


def inserted(new: DataFrame, stored: DataFrame, source: str, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, links, log): the three tables' rows of an insert, all of the same new events, those whose id is not stored, each once (the least slug of an id that repeats).

    new: event_id, slug, official_url, ticket_url. A link is written for each role with a URL; each event has one row of the log, with the fields that it was given.
    """
    rest = [c for c in new.columns if c != "event_id"]
    # dealt out before they are aggregated: with structs Spark sorts, and would first sort all of an input split in its task, to no use as ids seldom repeat
    dealt = new.repartition(int(new.sparkSession.conf.get("spark.sql.shuffle.partitions")), "event_id")
    one = dealt.groupBy("event_id").agg(F.min_by(F.struct(*rest), F.struct("slug", *[c for c in rest if c != "slug"])).alias("_e")).select("event_id", "_e.*")
    events = one.join(stored.select("event_id"), "event_id", "left_anti").withColumn("created_at", at)
    roles = F.array(F.struct(F.lit("official").alias("role"), F.col("official_url").alias("url")), F.struct(F.lit("ticket").alias("role"), F.col("ticket_url").alias("url")))
    links = events.select("event_id", F.lit(source).alias("source_id"), F.explode(F.filter(roles, lambda x: x["url"].isNotNull())).alias("_l")).select("event_id", "source_id", "_l.role", "_l.url")
    given = F.array_sort(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), c) for c in rest])))
    log = events.select("event_id", F.lit("sync").alias("changed_by"), F.lit("create").alias("change_type"), given.alias("fields_changed"), F.lit(None).cast("string").alias("note"), at.alias("created_at"))
    return events, links, log
