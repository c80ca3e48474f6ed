"""What goes through the shared folder: feeds of JSON lines, and runs with a journal."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pipeline
from ..sources import connectors
from ..sources.tables import load, shared_folder
from ..streaming import journal
from .registry import NOW_TEXT, listed, query


@query("""
SELECT 'Order ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS start, 'u/' || o_custkey AS url, 'a,b' || o_orderkey % 3 AS lineup, false AS problem FROM orders WHERE o_orderkey % 10 > 1
UNION ALL SELECT NULL, NULL, NULL, NULL, true FROM orders WHERE o_orderkey % 10 <= 1""")
def json_feed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-6: a feed of JSON lines, written and read back as candidates; broken lines and such without a title are problems."""
    key = F.col("o_orderkey").cast("string")
    title = F.when(F.col("o_orderkey") % 10 != 1, F.concat(F.lit("Order "), key))
    item = F.to_json(F.struct(title.alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start"), F.concat(F.lit("u/"), F.col("o_custkey").cast("string")).alias("url"), F.array(F.lit("a"), F.concat(F.lit("b"), (F.col("o_orderkey") % 3).cast("string"))).alias("lineup"), F.lit("more").alias("unheard_of")))
    path = f"{shared_folder(spark)}/duskline/feed-{uuid.uuid4().hex}"
    load(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit('{"title": '), key)).otherwise(item).alias("value")).write.text(path)
    found, problems = connectors.json_feed(spark, path)
    out = found.select("title", "start", "url", F.array_join("lineup", ",").alias("lineup"), F.lit(False).alias("problem"))
    none = F.lit(None).cast("string")
    return out.unionByName(problems.select(none.alias("title"), none.alias("start"), none.alias("url"), none.alias("lineup"), F.lit(True).alias("problem")))


@query("""
WITH d AS (SELECT event_id, user_id AS subscriber_id, start, start - INTERVAL 4 DAY - to_hours(event_id % 60) AS created_at, event_id % 10 <> 0 AS public, event_id % 7 <> 0 AS alertable FROM {listed} WHERE venue = 'view'),
p AS (SELECT *, NOT public OR NOT alertable OR start - INTERVAL 2 HOUR < {now} OR created_at + INTERVAL 3 DAY < {now} AS gone FROM d),
a AS (SELECT subscriber_id, event_id, {now} AS sent_at FROM (SELECT *, row_number() OVER (PARTITION BY subscriber_id, gone ORDER BY start, event_id) AS rn FROM p) WHERE NOT gone AND rn <= 3),
q AS (SELECT *, NOT public OR NOT alertable OR start - INTERVAL 2 HOUR < {now} + INTERVAL 1 DAY OR created_at + INTERVAL 3 DAY < {now} + INTERVAL 1 DAY AS gone FROM d WHERE NOT EXISTS (FROM a WHERE a.subscriber_id = d.subscriber_id AND a.event_id = d.event_id)),
b AS (SELECT subscriber_id, event_id, {now} + INTERVAL 1 DAY AS sent_at FROM (SELECT *, row_number() OVER (PARTITION BY subscriber_id, gone ORDER BY start, event_id) AS rn FROM q) WHERE NOT gone AND rn <= 3)
FROM a UNION ALL FROM b""")
def alert_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-4, STM-11: two daily runs over all pending alerts, each under a lease, and what they have sent; a run an hour after each finds nothing to send."""
    e = listed(spark, sf_dir)
    hours = F.expr("make_dt_interval(0, CAST(event_id % 60 AS INT))")
    pending = e.where("venue = 'view'").select("event_id", F.col("user_id").alias("subscriber_id"), "start", (F.col("start") - F.expr("INTERVAL 4 DAYS") - hours).alias("created_at"), (F.col("event_id") % 10 != 0).alias("public"), (F.col("event_id") % 7 != 0).alias("alertable"))
    log = journal.Journal(spark, f"{shared_folder(spark)}/duskline/alerts-{uuid.uuid4().hex}")
    plan = lambda rows, sent, now: pipeline.alert_run(rows, sent, F.lit(str(now)).cast("timestamp"), per_email=3)
    noon = dt.datetime.fromisoformat(NOW_TEXT)
    for at in (noon, noon + dt.timedelta(hours=1), noon + dt.timedelta(days=1)):
        journal.alert_run(log, "daily", at, lambda: pending, plan, lambda rows: None)
    return journal.all_of(log, "sent", journal.SENT).select("subscriber_id", "event_id", "sent_at")
