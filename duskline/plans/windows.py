"""Window functions, ordering, limits and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import time
from ..operators import joins
from ..sources.tables import load
from .registry import listed, now, query


@query("SELECT DISTINCT ON (user_id, venue) user_id, venue, event_id, value FROM {listed} ORDER BY user_id, venue, start, event_id")
def first_per_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-6: the earliest row of each pair."""
    return joins.first_per_key(listed(spark, sf_dir).select("user_id", "venue", "event_id", "value", "start"), ["user_id", "venue"], [F.col("start"), F.col("event_id")]).drop("start")


@query("SELECT DISTINCT ON (user_id) user_id, event_id, venue FROM {listed} WHERE value > 5 ORDER BY user_id, start DESC, event_id DESC")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-2: the newest row of each key that has something to say."""
    e = listed(spark, sf_dir).where("value > 5").select("user_id", "event_id", "venue", "start")
    return joins.latest_per_key(e, ["user_id"], [F.col("start"), F.col("event_id")]).drop("start")


@query("SELECT venue, event_id, rn FROM (SELECT venue, event_id, CAST(row_number() OVER (PARTITION BY venue ORDER BY start DESC, event_id DESC) AS INTEGER) AS rn FROM {listed}) WHERE rn <= 5")
def top5_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-1: five newest of each group; Spark keeps five per task before it shuffles."""
    w = Window.partitionBy("venue").orderBy(F.desc("start"), F.desc("event_id"))
    return listed(spark, sf_dir).select("venue", "event_id", "start").withColumn("rn", F.row_number().over(w)).where("rn <= 5").drop("start")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) AS rn FROM {listed} WHERE venue IN ('click', 'view')) WHERE rn <= 20")
def quota20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-4: at most twenty a subscriber, in start order."""
    w = Window.partitionBy("user_id").orderBy("start", "event_id")
    return listed(spark, sf_dir).where(F.col("venue").isin("click", "view")).select("user_id", "event_id", "start").withColumn("rn", F.row_number().over(w)).where("rn <= 20").select("user_id", "event_id")


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS start, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS confidence, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS seen FROM orders)
SELECT o_orderkey, row_number() OVER (ORDER BY start ASC NULLS LAST, confidence DESC, coalesce(seen, 0) DESC, o_orderkey) AS upcoming_first, row_number() OVER (ORDER BY coalesce(seen, 0) DESC, o_orderkey) AS freshest_first, row_number() OVER (ORDER BY coalesce(start, TIMESTAMP '1970-01-01') DESC, o_orderkey) AS relevant_first FROM o""")
def null_aware_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-5, WIN-7, WIN-10: a queue's three orders as ranks, each numbered in range partitions and not in one task."""
    o = load(spark, sf_dir, "orders")
    o = o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("start"), F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1).alias("confidence"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("seen"))
    seen = F.coalesce("seen", F.lit(0.0)).desc()
    orders = {"upcoming_first": [F.asc_nulls_last("start"), F.desc("confidence"), seen], "freshest_first": [seen], "relevant_first": [F.coalesce("start", F.lit("1970-01-01").cast("timestamp")).desc()]}
    out = o.select("o_orderkey")
    for name, by in orders.items():
        out = out.join(joins.numbered(o, [*by, F.col("o_orderkey")], name).select("o_orderkey", name), "o_orderkey")
    return out


@query("""
WITH p AS (SELECT p_partkey, p_size > 45 AS likely, p_size FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY likely ORDER BY p_size DESC, p_partkey) AS rn, count(*) FILTER (WHERE likely) OVER () AS n_likely FROM p)
SELECT p_partkey, CASE WHEN likely THEN rn <= 15 ELSE rn <= 15 - least(n_likely, 15) END AS shown FROM r""")
def two_pool_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-8: the first pool fills fifteen places, the second the rest."""
    p = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") > 45).alias("likely"), "p_size")
    top = lambda pool, n: [r[0] for r in p.where(pool).orderBy(F.desc("p_size"), "p_partkey").limit(n).select("p_partkey").collect()]
    first = top("likely", 15)
    return p.select("p_partkey", F.col("p_partkey").isin(*first, *top("NOT likely", 15 - len(first))).alias("shown"))


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE start END AS s FROM {listed})
SELECT event_id, CASE WHEN s IS NULL THEN 'no date' WHEN s <= {now} + INTERVAL 7 DAY THEN 'within 7 days' WHEN s <= {now} + INTERVAL 12 DAY THEN 'within 12 days' ELSE 'later' END AS bucket FROM e""")
def start_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-9."""
    s = F.when(F.col("event_id") % 9 != 0, F.col("start"))
    within = lambda d: s <= now() + F.expr(f"INTERVAL {d} DAYS")
    return listed(spark, sf_dir).select("event_id", F.when(s.isNull(), "no date").when(within(7), "within 7 days").when(within(12), "within 12 days").otherwise("later").alias("bucket"))


@query("""
WITH c AS (SELECT user_id, start, event_id FROM {listed} WHERE venue = 'error')
SELECT user_id, max(n) >= 2 AS flip_flop, max(n) AS most FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY start RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS n FROM c) GROUP BY user_id""")
def flip_flop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-3, STM-7: at least two changes within seven days."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros("start")).rangeBetween(-7 * 86_400_000_000, 0)
    n = listed(spark, sf_dir).where("venue = 'error'").select("user_id", F.count("*").over(w).alias("n"))
    return n.groupBy("user_id").agg((F.max("n") >= 2).alias("flip_flop"), F.max("n").alias("most"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 10 MINUTE PRECEDING AND CURRENT ROW) > 5 AS limited FROM events")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-1: more than five hits in the last ten minutes."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-600_000_000, 0)
    return load(spark, sf_dir, "events").select("event_id", (F.count("*").over(w) > 5).alias("limited"))


@query("""
WITH d AS (SELECT user_id, event_id, start FROM {listed} WHERE start >= {now} + INTERVAL 2 HOUR AND venue = 'purchase'), m AS (SELECT user_id, count(*) AS sent FROM {listed} WHERE venue = 'click' AND start BETWEEN {now} - INTERVAL 24 HOUR AND {now} GROUP BY user_id)
SELECT user_id, event_id FROM (SELECT d.*, row_number() OVER (PARTITION BY d.user_id ORDER BY start, event_id) AS rn FROM d LEFT JOIN m USING (user_id) WHERE coalesce(sent, 0) < 2) WHERE rn <= 3""")
def capped_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-11, DT-15, STM-5: too soon is dropped; who isn't over the daily cap gets the first three, in sending hours."""
    e = listed(spark, sf_dir)
    due = e.where((F.col("start") >= now() + F.expr("INTERVAL 2 HOURS")) & (F.col("venue") == "purchase") & time.sending_hour(now())).select("user_id", "event_id", "start")
    sent = e.where((F.col("venue") == "click") & F.col("start").between(now() - F.expr("INTERVAL 24 HOURS"), now())).groupBy("user_id").agg(F.count("*").alias("sent"))
    ok = due.join(sent, "user_id", "left").where(F.coalesce("sent", F.lit(0)) < 2)
    return ok.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("start", "event_id"))).where("rn <= 3").select("user_id", "event_id")


@query("SELECT DISTINCT ON (l_orderkey) l_orderkey, p_name AS first_accepted FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 20 ORDER BY l_orderkey, l_linenumber, p_partkey")
def first_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-13: of a line-up in order, the first that is accepted."""
    pos = F.struct("l_linenumber", "p_partkey")
    return load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part").where("p_size > 20"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.min_by("p_name", pos).alias("first_accepted"))


@query("SELECT event_id, venue FROM {listed} ORDER BY start DESC, event_id DESC LIMIT 25")
def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-14: the newest rows, as a top-k report."""
    return listed(spark, sf_dir).orderBy(F.desc("start"), F.desc("event_id")).limit(25).select("event_id", "venue")


@query("""
WITH v AS (SELECT event_id, user_id, venue, start AS visible, CASE WHEN event_id % 4 <> 0 THEN start + to_seconds(CAST(trunc(value * 600) AS BIGINT)) END AS confirmed FROM {listed}),
ok AS (SELECT * FROM v WHERE confirmed IS NOT NULL AND confirmed <= visible + INTERVAL 6 HOUR AND visible + INTERVAL 6 HOUR <= {now} AND visible >= TIMESTAMP '2024-01-10 00:00:00')
SELECT DISTINCT ON (user_id, venue) user_id, venue, event_id FROM ok ORDER BY user_id, venue, visible, event_id""")
def hold_window_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-3, JN-17, AGG-6: visible for the hold time and confirmed within it; each pair delivered once."""
    hold = F.expr("INTERVAL 6 HOURS")
    confirmed = F.when(F.col("event_id") % 4 != 0, F.timestamp_micros(F.unix_micros("start") + (F.col("value") * 600).cast("long") * 1_000_000))
    v = listed(spark, sf_dir).select("event_id", "user_id", "venue", F.col("start").alias("visible"), confirmed.alias("confirmed"))
    ok = v.where((F.col("confirmed") <= F.col("visible") + hold) & (F.col("visible") + hold <= now()) & (F.col("visible") >= F.lit("2024-01-10 00:00:00").cast("timestamp")))
    return joins.first_per_key(ok.select("user_id", "venue", "event_id", "visible"), ["user_id", "venue"], [F.col("visible"), F.col("event_id")]).drop("visible")
