"""Text sinks and logs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sinks
from ..sources.tables import load
from .registry import listed, now, query


@query("""
SELECT event_id, concat_ws(chr(13) || chr(10), 'BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//duskline//EN', 'CALSCALE:GREGORIAN', 'METHOD:PUBLISH', 'BEGIN:VEVENT', 'UID:' || event_id, 'DTSTAMP:20240115T120000Z', 'DTSTART:' || strftime(start, '%Y%m%dT%H%M%SZ'), 'DTEND:' || strftime(coalesce("end", timezone('UTC', timezone('Europe/Copenhagen', CAST({night} + 1 AS TIMESTAMP) + INTERVAL 6 HOUR))), '%Y%m%dT%H%M%SZ'), 'SUMMARY:' || venue || '\\, user ' || user_id, 'LOCATION:' || venue, 'DESCRIPTION:a\\;b', 'URL:https://example.org/' || event_id, 'END:VEVENT', 'END:VCALENDAR') AS ics FROM {listed}""")
def ics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-9: a calendar file for each event."""
    user = F.col("user_id").cast("string")
    key = F.col("event_id").cast("string")
    ics = sinks.ics_file(key, now(), F.col("start"), F.col("end"), F.concat("venue", F.lit(", user "), user), F.col("venue"), F.lit("a;b"), F.concat(F.lit("https://example.org/"), key))
    return listed(spark, sf_dir).select("event_id", ics.alias("ics"))


@query("""
SELECT o_orderkey, '{{"@context":"https://schema.org","@type":"MusicEvent","name":"' || o_orderpriority || '","startDate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') || '"' || CASE WHEN o_orderkey % 2 = 0 THEN ',"endDate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') || '"' ELSE '' END || ',"eventStatus":"https://schema.org/Event' || CASE WHEN o_orderstatus = 'F' THEN 'Cancelled' WHEN o_orderkey % 3 = 0 THEN 'Postponed' ELSE 'Scheduled' END || '","location":{{"@type":"Place","name":"' || o_custkey || '"}},"performer":[{{"@type":"PerformingGroup","name":"a"}}],"url":"/e/' || o_orderkey || '"}}' AS json FROM orders""")
def json_ld_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-11: nested JSON without absent keys."""
    start = F.col("o_orderdate")
    status = sinks.event_status(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 3 == 0, F.lit(False))
    json = sinks.json_ld(F.col("o_orderpriority"), start, F.when(F.col("o_orderkey") % 2 == 0, start), status, F.col("o_custkey").cast("string"), F.array(F.lit("a")), F.concat(F.lit("/e/"), F.col("o_orderkey").cast("string")))
    return load(spark, sf_dir, "orders").select("o_orderkey", json.alias("json"))


@query("""
SELECT o_orderkey, 'https://calendar.google.com/calendar/render?action=TEMPLATE&text=' || replace(o_orderpriority, ' ', '+') || '&dates=' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '%2F' || strftime(o_orderdate + INTERVAL 1 HOUR, '%Y%m%dT%H%M%SZ') || '&details=d&location=' || o_custkey AS link FROM orders""")
def calendar_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-10: titles are encoded."""
    o = load(spark, sf_dir, "orders")
    link = sinks.calendar_link(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR"), F.col("o_orderpriority"), F.lit("d"), F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", link.alias("link"))


@query("""SELECT doc_id, CASE WHEN length(t) <= 155 THEN t ELSE regexp_replace(substr(t, 1, 155), '\\s+\\S*$', '') || '…' END AS summary FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)""")
def seo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-12: one-line summaries cut between words."""
    return load(spark, sf_dir, "documents").select("doc_id", sinks.summary_text(F.col("text")).alias("summary"))


@query("""SELECT event_id, 'sync' AS changed_by, 'update' AS change_type, CASE WHEN event_id % 2 = 0 THEN 'end,start' ELSE 'start' END AS fields FROM events WHERE event_type = 'purchase'""")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1, STM-10: log rows of changes."""
    one, two = F.create_map(F.lit("start"), F.lit("x")), F.create_map(F.lit("start"), F.lit("x"), F.lit("end"), F.lit("y"))
    changed = load(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", F.when(F.col("event_id") % 2 == 0, two).otherwise(one).alias("patch"))
    return sinks.change_log(changed, "sync", "update", now()).select("event_id", "changed_by", "change_type", F.array_join("fields_changed", ",").alias("fields"))


@query("""
WITH n AS (SELECT o_orderkey AS id, 'o-' || o_orderkey AS slug, CASE WHEN o_orderkey % 4 <> 0 THEN 'https://x.dk/' || o_orderkey END AS o, CASE WHEN o_orderkey % 3 = 0 THEN 'https://t.dk/' || o_custkey END AS t FROM orders WHERE o_orderstatus <> 'F' OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45))
SELECT 'events' AS target, id AS event_id, slug AS detail FROM n UNION ALL SELECT 'links', id, 'official ' || o FROM n WHERE o IS NOT NULL UNION ALL SELECT 'links', id, 'ticket ' || t FROM n WHERE t IS NOT NULL
UNION ALL SELECT 'log', id, concat_ws(',', CASE WHEN o IS NOT NULL THEN 'official_url' END, 'slug', CASE WHEN t IS NOT NULL THEN 'ticket_url' END) FROM n""")
def event_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1: what inserting new events writes to the events, their sources' links and the log; stored ones (closed orders with a large line) are left alone."""
    key = F.col("o_orderkey")
    o = load(spark, sf_dir, "orders")
    large = load(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("event_id")).distinct()
    stored = o.where("o_orderstatus = 'F'").select(key.alias("event_id")).join(large, "event_id", "left_semi")
    new = o.select(key.alias("event_id"), F.concat(F.lit("o-"), key.cast("string")).alias("slug"), F.when(key % 4 != 0, F.concat(F.lit("https://x.dk/"), key.cast("string"))).alias("official_url"), F.when(key % 3 == 0, F.concat(F.lit("https://t.dk/"), F.col("o_custkey").cast("string"))).alias("ticket_url"))
    events, links, log = sinks.inserted(new, stored, "orders", now())
    row = lambda df, name, detail: df.select(F.lit(name).alias("target"), "event_id", detail.alias("detail"))
    return row(events, "events", F.col("slug")).unionByName(row(links, "links", F.concat_ws(" ", "role", "url"))).unionByName(row(log, "log", F.array_join("fields_changed", ",")))
