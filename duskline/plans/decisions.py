"""Entity resolution, merging and scoring over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genres, text, time
from ..operators import decisions, joins
from ..sources.tables import load
from .registry import listed, now, query


@query("""
WITH e AS (SELECT event_id, user_id, {night} AS night, venue, [venue, CAST(event_id % 4 AS VARCHAR), 'show'] AS w, CASE WHEN event_id % 6 = 0 THEN [] ELSE ['a' || event_id % 5, 'b' || event_id % 3] END AS artists, CASE WHEN event_id % 8 = 0 THEN 'u' || event_id % 16 END AS url FROM {listed}),
p AS (SELECT a.event_id AS a_event_id, b.event_id AS b_event_id, a.venue = b.venue AS same_venue, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS t,
  CASE WHEN len(a.artists) = 0 OR len(b.artists) = 0 THEN 0 ELSE len(list_intersect(a.artists, b.artists)) / least(len(a.artists), len(b.artists)) END AS o, (len(a.artists) > 0 AND len(b.artists) > 0) AS both_, coalesce(a.url = b.url, false) AS u
  FROM e a JOIN e b ON a.night = b.night AND a.user_id = b.user_id AND a.event_id < b.event_id),
c AS (SELECT *, both_ AND o = 0 AND t < 0.6 AS conflict FROM p),
d AS (SELECT *, CASE WHEN u THEN CASE WHEN conflict THEN 'medium' WHEN same_venue THEN 'high' ELSE 'medium' END WHEN conflict THEN 'none' WHEN NOT same_venue THEN CASE WHEN o >= 0.5 AND t >= 0.3 THEN 'medium' ELSE 'none' END WHEN o >= 0.5 AND t >= 0.4 THEN 'high' WHEN o > 0 OR t >= 0.25 THEN 'medium' ELSE 'none' END AS confidence FROM c)
SELECT a_event_id, b_event_id, confidence, round(t, 6) AS title_similarity, round(o, 6) AS artist_overlap FROM d WHERE confidence <> 'none'""")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-11, ER-1: pairs of one night and user, assessed."""
    e = listed(spark, sf_dir)
    words = F.array("venue", (F.col("event_id") % 4).cast("string"), F.lit("show"))
    artists = F.when(F.col("event_id") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("a"), (F.col("event_id") % 5).cast("string")), F.concat(F.lit("b"), (F.col("event_id") % 3).cast("string"))))
    e = e.select("event_id", "user_id", time.night_key(F.col("start")).alias("night"), "venue", words.alias("w"), artists.alias("artists"), F.when(F.col("event_id") % 8 == 0, F.concat(F.lit("u"), (F.col("event_id") % 16).cast("string"))).alias("url"))
    p = joins.blocked_pairs(e, "event_id", ["night", "user_id"])
    p = p.withColumns({"title_similarity": text.jaccard(F.col("a_w"), F.col("b_w")), "artist_overlap": text.overlap(F.col("a_artists"), F.col("b_artists"))})
    no = F.lit(False)
    confidence = decisions.assess_duplicate(same_night=F.lit(True), room_conflict=no, sub_venue_conflict=no, shared_url=F.coalesce(F.col("a_url") == F.col("b_url"), no), same_venue=F.col("a_venue") == F.col("b_venue"), venue_unknown=no, title=F.col("title_similarity"), artists=F.col("artist_overlap"), both_lineups=(F.size("a_artists") > 0) & (F.size("b_artists") > 0))
    out = p.withColumn("confidence", confidence).where("confidence <> 'none'")
    return out.select("a_event_id", "b_event_id", "confidence", F.round("title_similarity", 6).alias("title_similarity"), F.round("artist_overlap", 6).alias("artist_overlap"))


@query("""
WITH e AS (SELECT event_id, user_id, venue, start, {night} AS night FROM {listed}),
p AS (SELECT a.event_id, b.event_id AS match_id, CASE WHEN a.venue = b.venue THEN 'high' WHEN abs(date_diff('second', a.start, b.start)) < 3600 THEN 'medium' ELSE 'none' END AS confidence FROM e a JOIN e b ON a.night = b.night AND a.user_id = b.user_id AND b.event_id < a.event_id)
SELECT DISTINCT ON (event_id) event_id, match_id, confidence FROM p WHERE confidence <> 'none' ORDER BY event_id, CASE confidence WHEN 'high' THEN 3 ELSE 2 END DESC, match_id""")
def best_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-12: the best match of each candidate, the earliest among equals."""
    e = listed(spark, sf_dir).select("event_id", "user_id", "venue", F.unix_seconds("start").alias("sec"), time.night_key(F.col("start")).alias("night"))
    p = joins.blocked_pairs(e, "event_id", ["night", "user_id"])
    near = F.abs(F.col("a_sec") - F.col("b_sec")) < 3600
    p = p.select(F.col("b_event_id").alias("event_id"), F.col("a_event_id").alias("match_id"), F.when(F.col("a_venue") == F.col("b_venue"), "high").when(near, "medium").otherwise("none").alias("confidence"))
    return decisions.best_match(p, "event_id", "confidence", "match_id")


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, CASE WHEN o_orderkey % 9 = 0 THEN 'u' || o_custkey END AS url FROM orders),
p AS (SELECT a.o_orderkey, b.o_orderkey AS earlier, CASE WHEN a.o_orderdate = b.o_orderdate THEN 'none' WHEN a.o_orderpriority <> b.o_orderpriority THEN 'none' WHEN a.url = b.url THEN 'high' WHEN a.o_orderpriority = '1-URGENT' THEN 'medium' ELSE 'none' END AS c FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.o_orderkey < a.o_orderkey)
SELECT o_orderkey, earlier, c AS confidence FROM p WHERE c <> 'none'""")
def moved_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-2: earlier rows of one source that may be the same event at another time."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit("u"), F.col("o_custkey").cast("string"))).alias("url"))
    p = joins.blocked_pairs(o, "o_orderkey", ["o_custkey"])
    same = (F.col("a_o_orderpriority") == F.col("b_o_orderpriority")).cast("double")
    wording = F.when(F.col("b_o_orderpriority") == "1-URGENT", "new date").otherwise("")
    c = decisions.assess_moved(same_start=F.col("a_o_orderdate") == F.col("b_o_orderdate"), venues_differ=F.lit(False), title=same, artists=F.lit(0.0), shared_url=F.coalesce(F.col("a_url") == F.col("b_url"), F.lit(False)), wording=wording)
    return p.select(F.col("b_o_orderkey").alias("o_orderkey"), F.col("a_o_orderkey").alias("earlier"), c.alias("confidence")).where("confidence <> 'none'")


@query("""
WITH j AS (SELECT o_orderkey, o_totalprice AS old_price, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS new_price, o_orderstatus AS old_status, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS new_status, CASE WHEN o_orderkey % 7 = 0 THEN ['price'] ELSE ['title'] END AS locked FROM orders),
c AS (SELECT *, coalesce(new_price <> old_price, false) AND NOT list_contains(locked, 'price') AS pc, coalesce(new_status <> old_status, false) AND NOT list_contains(locked, 'status') AS sc FROM j)
SELECT o_orderkey, concat_ws(',', CASE WHEN pc THEN 'price' END, CASE WHEN sc THEN 'status' END) AS changed, CASE WHEN pc THEN new_price ELSE old_price END AS price, CASE WHEN sc THEN new_status ELSE old_status END AS status FROM c WHERE pc OR sc""")
def sync_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-7, ER-8: the fields that an incoming row changes, locked ones left out."""
    o = load(spark, sf_dir, "orders")
    stored = o.select("o_orderkey", F.col("o_totalprice").alias("old_price"), F.col("o_orderstatus").alias("old_status"), F.when(F.col("o_orderkey") % 7 == 0, genres.strings(["price"])).otherwise(genres.strings(["title"])).alias("locked"))
    price = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") + 1).when(F.col("o_orderkey") % 3 == 0, F.lit(None)).otherwise(F.col("o_totalprice"))
    incoming = o.select("o_orderkey", price.alias("new_price"), F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("new_status"))
    j = stored.join(incoming, "o_orderkey")
    j = j.withColumn("patch", decisions.sync_patch(j, ["price", "status"], F.col("locked"))).where(F.size("patch") > 0)
    kept = lambda f: F.when(F.array_contains(F.map_keys("patch"), f), F.col(f"new_{f}")).otherwise(F.col(f"old_{f}")).alias(f)
    return j.select("o_orderkey", F.array_join(F.map_keys("patch"), ",").alias("changed"), kept("price"), kept("status"))


@query("""
WITH q AS (SELECT o_orderkey, ['startDatetime'] AS locked, o_orderkey % 2 = 0 AS is_locked, CASE WHEN o_orderkey % 3 = 0 THEN 'false' ELSE 'true' END AS postponed FROM orders)
SELECT o_orderkey, concat_ws(',', CASE WHEN NOT is_locked THEN 'dateChanged' END, CASE WHEN NOT (is_locked AND postponed = 'false') THEN 'postponed' END, 'title') AS kept FROM q""")
def override_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-8: flags that follow from the start are held back where the start is locked."""
    locked = F.when(F.col("o_orderkey") % 2 == 0, genres.strings(["startDatetime"])).otherwise(genres.strings(["venueId"]))
    patch = F.create_map(F.lit("dateChanged"), F.lit("true"), F.lit("postponed"), F.when(F.col("o_orderkey") % 3 == 0, "false").otherwise("true"), F.lit("title"), F.lit("t"))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_sort(F.map_keys(decisions.hold_back_start_flags(patch, locked))), ",").alias("kept"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'linked' WHEN o_orderkey % 4 = 0 AND o_orderstatus = 'F' THEN 'high-confidence-duplicate' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey WHEN o_orderkey % 4 = 0 AND o_orderstatus = 'F' THEN o_orderkey END AS event_id FROM orders")
def match_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-9."""
    linked = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey"))
    duplicate = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey"))
    m = decisions.match_kind(linked, duplicate, F.when(F.col("o_orderstatus") == "F", "high").otherwise("medium"))
    return load(spark, sf_dir, "orders").select("o_orderkey", m.alias("m")).select("o_orderkey", "m.kind", "m.event_id")


@query("""
WITH s AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS published, o_orderkey % 5 = 0 AS manual, CASE WHEN o_orderkey % 3 = 0 THEN 'hold' ELSE 'auto_publish' END AS decision, o_orderkey % 4 = 0 AS locked, CASE WHEN o_orderkey % 7 = 0 THEN 'irrelevant' END AS reason, o_custkey % 2 AS by_, o_orderkey % 11 < 6 AS hint, CASE WHEN o_custkey % 3 = 0 THEN 'review' ELSE 'trusted' END AS policy FROM orders)
SELECT o_orderkey, CASE WHEN published AND NOT manual AND decision = 'hold' THEN 'unpublish' ELSE 'no_change' END AS sync_action,
  CASE WHEN policy <> 'trusted' THEN 'no_change' WHEN hint THEN CASE WHEN published AND NOT locked THEN 'unpublish' ELSE 'no_change' END WHEN NOT published AND reason IS NULL AND by_ = 1 THEN 'restore' ELSE 'no_change' END AS cancel_action FROM s""")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-11, SNK-8: what a sync does to a published row, and what a cancellation does."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    published, locked = k % 2 == 0, F.when(k % 4 == 0, genres.strings(["published"])).otherwise(genres.strings(["title"]))
    sync = decisions.sync_action(published, k % 5 == 0, F.when(k % 3 == 0, "hold").otherwise("auto_publish"), F.lit("negative_relevance"))
    cancel = decisions.cancellation_action(published, locked, F.when(k % 7 == 0, "irrelevant"), c % 2, k % 11 < 6, F.lit(1).cast("long"), F.when(c % 3 == 0, "review").otherwise("trusted"))
    return load(spark, sf_dir, "orders").select("o_orderkey", sync.alias("sync_action"), cancel.alias("cancel_action"))


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN start END AS seen, {now} - INTERVAL 5 DAY AS complete, {effend} <= {now} AS past, CASE event_id % 3 WHEN 0 THEN 'auto_publish' WHEN 1 THEN 'hold' END AS decision FROM {listed}),
b AS (SELECT *, CASE WHEN NOT coalesce(seen >= complete, false) THEN 'stale' WHEN past THEN 'current_but_past' WHEN decision = 'auto_publish' THEN 'active' ELSE 'other_blockers' END AS bucket FROM e)
SELECT event_id, bucket FROM b""")
def staleness_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-12, STM-2: current means seen since the last complete run."""
    e = listed(spark, sf_dir)
    current = decisions.is_current(F.when(F.col("event_id") % 10 != 0, F.col("start")), now() - F.expr("INTERVAL 5 DAYS"))
    decision = F.when(F.col("event_id") % 3 == 0, "auto_publish").when(F.col("event_id") % 3 == 1, "hold")
    return e.select("event_id", decisions.venue_block(current, time.is_past(F.col("start"), F.col("end"), now()), decision).alias("bucket"))


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN 's' END AS source, start >= {now} - INTERVAL 5 DAY AS current, {effend} <= {now} AS past, event_id % 17 = 0 AS active, CASE event_id % 5 WHEN 0 THEN 'negative_relevance' WHEN 1 THEN 'incomplete_data' WHEN 2 THEN 'low_confidence' WHEN 3 THEN 'no_genre_evidence' END AS reason, CASE WHEN event_id % 2 = 0 THEN 'low' ELSE 'high' END AS confidence, event_id % 7 = 0 AS positive, event_id % 11 = 0 AS negative, event_id % 19 = 0 AS manual FROM {listed})
SELECT event_id, CASE WHEN source IS NULL THEN CASE WHEN past THEN 'past_stale' ELSE 'needs_review' END WHEN NOT current OR past THEN 'past_stale' WHEN active THEN 'venue_blocked' WHEN reason = 'negative_relevance' THEN 'rejected'
  WHEN NOT manual AND reason IS NOT NULL THEN CASE WHEN positive THEN 'needs_review' WHEN reason <> 'low_confidence' AND negative THEN 'rejected' ELSE 'insufficient' END WHEN NOT manual AND reason IS NULL AND confidence = 'low' THEN CASE WHEN positive THEN 'needs_review' ELSE 'insufficient' END ELSE 'needs_review' END AS category FROM e""")
def queue_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-13."""
    i = F.col("event_id")
    past = time.is_past(F.col("start"), F.col("end"), now())
    block = decisions.venue_block(F.col("start") >= now() - F.expr("INTERVAL 5 DAYS"), past, F.when(i % 17 == 0, "auto_publish"))
    reason = F.when(i % 5 == 0, "negative_relevance").when(i % 5 == 1, "incomplete_data").when(i % 5 == 2, "low_confidence").when(i % 5 == 3, "no_genre_evidence")
    category = decisions.queue_category(F.when(i % 13 != 0, "s"), past, block, reason, F.when(i % 2 == 0, "low").otherwise("high"), i % 7 == 0, i % 11 == 0, i % 19 == 0)
    return listed(spark, sf_dir).select("event_id", category.alias("category"))


@query("""
WITH s AS (SELECT s_suppkey, s_suppkey % 10 <> 0 AS active, CASE WHEN s_suppkey % 7 <> 0 THEN 'a' END AS adapter, CASE WHEN s_suppkey % 5 = 0 THEN 'e' END AS error, CASE WHEN s_suppkey % 3 <> 0 THEN {now} - to_hours(CAST(s_suppkey % 40 AS BIGINT)) END AS last_ok, s_suppkey % 4 AS found FROM supplier)
SELECT s_suppkey, CASE WHEN NOT active THEN 'inactive' WHEN adapter IS NULL THEN 'discovery-only' WHEN error IS NOT NULL OR (last_ok IS NOT NULL AND found = 0) THEN 'degraded' WHEN {now} - last_ok > INTERVAL 12 HOUR THEN 'stale' ELSE 'ok' END AS health FROM s""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-17, DT-12."""
    k = F.col("s_suppkey")
    last = F.when(k % 3 != 0, F.timestamp_micros(F.unix_micros(now()) - (k % 40) * 3_600_000_000))
    health = decisions.source_health(k % 10 != 0, F.when(k % 7 != 0, "a"), F.when(k % 5 == 0, "e"), last, k % 4, F.lit("every 6 h"), now())
    return load(spark, sf_dir, "supplier").select("s_suppkey", health.alias("health"))


@query("""
WITH d AS (SELECT d.doc_id, coalesce(quality, 0) = 1 AS g, contains(lower(text), ' the ') AS t, source IN ('src1', 'src2', 'src3') AS v, lang = 'en' AS c, length(text) > 1000 AS l, coalesce(toxic, 0) = 1 AS x, (doc_id % 300) AS h FROM documents d LEFT JOIN labels USING (doc_id)),
s AS (SELECT *, 3 * g::INT + 2 * t::INT + 3 * v::INT + 2 * c::INT + l::INT - 3 * x::INT AS score FROM d)
SELECT doc_id, score, CASE WHEN score >= 3 AND (g OR t OR v) THEN 'likely' WHEN c AND NOT x THEN 'possible' ELSE 'none' END AS tier, score + CASE WHEN h <= 72 THEN 3 WHEN h <= 168 THEN 1 ELSE 0 END AS priority FROM s""")
def review_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-14, AGG-16: signals, their points, the tier and the priority."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.contains(F.lower("text"), F.lit(" the ")).alias("t"), (F.length("text") > 1000).alias("l"))
    d = d.join(load(spark, sf_dir, "labels"), "doc_id", "left")
    good, bad = F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))
    found = decisions.signals((good, "genre", 3), (F.col("t"), "dj_or_club_description", 2), (F.col("source").isin("src1", "src2", "src3"), "strong_venue", 3), (F.col("lang") == "en", "source_category", 2), (F.col("l"), "lineup", 1), (bad, "conflicting_genre", -3))
    has = lambda *keys: F.exists("found", lambda s: s["key"].isin(*keys))
    d = d.withColumn("found", found).withColumn("score", decisions.score_of(F.col("found")))
    tier = decisions.review_tier(F.col("score"), has("genre", "dj_or_club_description", "strong_venue"), has("source_category"), has("conflicting_genre"))
    return d.select("doc_id", "score", tier.alias("tier"), (F.col("score") + decisions.urgency(F.col("doc_id") % 300)).alias("priority"))


@query("""
WITH e AS (SELECT *, date_diff('microsecond', start, "end") / 3600000000.0 AS hours, date_part('hour', {local}) AS sh, date_part('hour', timezone('Europe/Copenhagen', timezone('UTC', "end"))) AS eh FROM {listed}),
c AS (SELECT user_id, count(*) FILTER (WHERE venue = 'error' AND start >= {now} - INTERVAL 7 DAY) AS n, bool_or(venue = 'signup' AND value > 100) AS u FROM {listed} GROUP BY user_id)
SELECT event_id, concat_ws(',', CASE WHEN "end" <= start THEN 'end_not_after_start' WHEN hours > 36 THEN 'end_far_after_start' WHEN sh >= 20 AND (eh >= 20 OR eh < 1) AND hours <= 5 AND venue IN ('click', 'view') THEN 'early_end_for_evening_start' END, CASE WHEN n >= 2 THEN 'date_flip_flop' END, CASE WHEN u THEN 'date_changed_with_url' END) AS issues FROM e JOIN c USING (user_id)""")
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-16, WIN-12: what looks wrong with an event, given its changes."""
    e = listed(spark, sf_dir)
    c = e.groupBy("user_id").agg(F.count_if((F.col("venue") == "error") & (F.col("start") >= now() - F.expr("INTERVAL 7 DAYS"))).alias("n"), F.bool_or((F.col("venue") == "signup") & (F.col("value") > 100)).alias("u"))
    issues = decisions.quality_issues(F.col("start"), F.col("end"), F.col("venue").isin("click", "view"), F.col("n"), F.col("u"), F.lit(False))
    return e.join(c, "user_id").select("event_id", F.array_join(issues, ",").alias("issues"))


@query("""
WITH h AS (SELECT p_name AS key, p_partkey, p_brand, p_size > 10 AS published, p_size < 3 AS irrelevant FROM part), c AS (SELECT p_partkey, p_name AS key, p_brand FROM part)
SELECT c.p_partkey, count(*) FILTER (WHERE published) AS published, count(*) FILTER (WHERE irrelevant) AS irrelevant, coalesce(bool_or(published AND h.p_brand = c.p_brand), false) AS same_venue,
  CASE WHEN count(*) FILTER (WHERE irrelevant) > 0 THEN 'against' WHEN count(*) FILTER (WHERE published) = 0 THEN 'unsupported' WHEN coalesce(bool_or(published AND h.p_brand = c.p_brand), false) THEN 'strong' WHEN count(*) FILTER (WHERE published) >= 2 THEN 'supporting' ELSE 'unsupported' END AS strength
FROM c JOIN h ON c.key = h.key AND h.p_partkey <> c.p_partkey GROUP BY c.p_partkey""")
def series_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-15, AGG-14: what a candidate's series published before. History is summed by (key, venue) first, so that no candidate meets single rows."""
    p = load(spark, sf_dir, "part")
    h = p.groupBy(F.col("p_name").alias("key"), F.col("p_brand").alias("venue")).agg(F.count_if(F.col("p_size") > 10).alias("pub"), F.count_if(F.col("p_size") < 3).alias("irr"), F.count("*").alias("rows"))
    own = lambda test: test.cast("long")
    c = p.select("p_partkey", F.col("p_name").alias("key"), F.col("p_brand").alias("venue"), own(F.col("p_size") > 10).alias("own_pub"), own(F.col("p_size") < 3).alias("own_irr"))
    by_key = h.groupBy("key").agg(F.sum("pub").alias("pub_all"), F.sum("irr").alias("irr_all"), F.sum("rows").alias("rows"))
    # each row's own share is taken off, and rows without any other of their series leave
    m = c.join(h.select("key", "venue", "pub"), ["key", "venue"]).join(by_key, "key").where("rows > 1")
    m = m.select("p_partkey", (F.col("pub_all") - F.col("own_pub")).alias("published"), (F.col("irr_all") - F.col("own_irr")).alias("irrelevant"), (F.col("pub") - F.col("own_pub") > 0).alias("same_venue"))
    return m.withColumn("strength", decisions.series_strength(F.col("irrelevant"), F.col("published"), F.lit(True), F.col("same_venue"), F.lit(False)))


@query("""SELECT o_orderkey, CASE WHEN NOT (o_totalprice > 1000 AND o_custkey % 3 <> 0) THEN 'hold' WHEN o_orderstatus = 'F' THEN 'auto_publish' WHEN o_orderstatus = 'O' THEN 'review_queue' ELSE 'hold' END AS decision FROM orders""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-6, CLS-14: minimum fields, then confidence."""
    confidence = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low")
    yes = F.lit(True)
    return load(spark, sf_dir, "orders").select("o_orderkey", decisions.quality_gate(yes, F.col("o_totalprice") > 1000, F.col("o_custkey") % 3 != 0, yes, yes, confidence).alias("decision"))


@query("""SELECT DISTINCT ON (l_orderkey) l_orderkey, l_shipdate AS shipped FROM lineitem ORDER BY l_orderkey, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END, l_linenumber, l_partkey, l_shipdate""")
def canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-6: of several sources' values, that of the source named first; ties to the earliest."""
    line = load(spark, sf_dir, "lineitem").withColumn("ord", F.struct("l_linenumber", "l_partkey", "l_shipdate"))
    return decisions.canonical_value(line, "l_orderkey", "l_returnflag", "l_shipdate", ["A", "R", "N"], "ord").withColumnRenamed("l_shipdate", "shipped")


@query("""
WITH c AS (SELECT p_partkey AS k, p_name AS v, {now} + to_days(CAST(p_size - 20 AS INTEGER)) AS expires FROM part WHERE p_partkey % 2 = 0)
SELECT l_partkey, count(*) AS uses, max(v) IS NOT NULL AS hit FROM lineitem LEFT JOIN c ON l_partkey = k AND expires > {now} GROUP BY l_partkey""")
def cache_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-23: cache rows that have not expired are hits, other keys are looked up once."""
    p = load(spark, sf_dir, "part").where("p_partkey % 2 = 0")
    cache = p.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("v"), F.timestamp_micros(F.unix_micros(now()) + (F.col("p_size") - 20).cast("long") * 86_400_000_000).alias("expires_at"))
    uses = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("uses"))
    hits, misses = decisions.cached_lookup(uses, cache, "l_partkey", now())
    return hits.select("l_partkey", "uses", F.lit(True).alias("hit")).unionByName(uses.join(misses, "l_partkey").withColumn("hit", F.lit(False)))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'm' || o_custkey ELSE o_orderpriority END AS shown FROM orders""")
def override_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-21, ER-22: an event's own choice beats the automatic one."""
    mode = F.when(F.col("o_orderkey") % 5 == 0, "hide").when(F.col("o_orderkey") % 3 == 0, "manual").otherwise("auto")
    return load(spark, sf_dir, "orders").select("o_orderkey", decisions.override_decision(mode, F.col("o_orderpriority"), F.concat(F.lit("m"), F.col("o_custkey").cast("string"))).alias("shown"))


@query("""SELECT l_orderkey, l_partkey, count(DISTINCT l_returnflag) AS votes FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) >= 2""")
def headliners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-18: artists that independent signals agree on."""
    return decisions.headliners(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_returnflag")


@query("""
WITH s AS (SELECT c_custkey, min(c_acctbal) AS bal, min(c_mktsegment) AS seg FROM customer WHERE c_custkey % 3 <> 1 GROUP BY 1), n AS (SELECT c_custkey, min(c_acctbal) + 1 AS bal, 'NEW' AS seg FROM customer WHERE c_custkey % 3 <> 2 GROUP BY 1)
SELECT c_custkey, CASE WHEN n.c_custkey IS NOT NULL AND (s.c_custkey IS NULL OR s.bal > 0) THEN n.bal ELSE s.bal END AS bal, coalesce(s.seg, n.seg) AS seg FROM s FULL JOIN n USING (c_custkey)""")
def guarded_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-2, SNK-3: an upsert with a guard and a column that keeps its first value."""
    c = load(spark, sf_dir, "customer")
    stored = c.where("c_custkey % 3 <> 1").groupBy("c_custkey").agg(F.min("c_acctbal").alias("bal"), F.min("c_mktsegment").alias("seg"))
    new = c.where("c_custkey % 3 <> 2").groupBy("c_custkey").agg((F.min("c_acctbal") + 1).alias("bal"), F.lit("NEW").alias("seg"))
    return joins.upsert(stored, new, ["c_custkey"], keep_first=("seg",), guard=F.col("old.bal") > 0)


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 1 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 1""")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-4."""
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return joins.insert_absent(c.where("c_custkey % 3 <> 1"), c.where("c_custkey % 3 <> 2").withColumn("c_name", F.lit("new")), ["c_custkey"])


@query("""SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1998-01-01') AND NOT (o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40))""")
def retention_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-7: what retention keeps: neither old and done, nor open without anything to come."""
    o = load(spark, sf_dir, "orders").where(~((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")))).select("o_orderkey", "o_orderstatus")
    to_come = load(spark, sf_dir, "lineitem").where("l_quantity > 40").select("l_orderkey").distinct().withColumn("_any", F.lit(True))
    return o.join(to_come, F.col("o_orderkey") == F.col("l_orderkey"), "left").where((F.col("o_orderstatus") != "P") | F.col("_any")).select("o_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01') ORDER BY o_orderkey LIMIT 25""")
def claim_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-5: the next rows of a work queue: pending, or claimed too long ago; the claim's size is its feature."""
    o = load(spark, sf_dir, "orders").where("o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01')")
    return o.orderBy("o_orderkey").limit(25).select("o_orderkey")


@query("""SELECT s_suppkey, s_suppkey % 3 = 0 OR {now} > {now} + to_minutes(CAST(s_suppkey % 11 - 5 AS BIGINT)) AS acquired FROM supplier""")
def lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-6: a lease is taken if there is none or it has run out."""
    expires = F.when(F.col("s_suppkey") % 3 != 0, F.timestamp_micros(F.unix_micros(now()) + (F.col("s_suppkey") % 11 - 5) * 60_000_000))
    return load(spark, sf_dir, "supplier").select("s_suppkey", (expires.isNull() | (expires < now())).alias("acquired"))
