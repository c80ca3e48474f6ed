"""Scans, filters and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genres, time
from ..operators import joins
from ..sources import connectors
from ..sources.tables import by_key, by_keys, load
from .registry import listed, now, query


@query("""
WITH e AS (SELECT *, {effend} AS eff FROM {listed} WHERE start >= {now} - INTERVAL 3 DAY OR "end" > {now})
SELECT venue, count(*) AS n FROM e WHERE eff > {now} GROUP BY venue""")
def upcoming_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-1, FLT-2, AGG-1, DT-2, DT-3: events per venue that are not over."""
    # ends are derived, so a bound on the start alone, by the longest event there is, is what the scan can use
    longest = load(spark, sf_dir, "events").agg(F.max("value")).first()[0] or 0
    started = F.col("start") >= now() - F.expr(f"INTERVAL {max(3 * 1440, int(longest) + 1)} MINUTES")
    e = listed(spark, sf_dir).where(started & time.upcoming_candidate(F.col("start"), F.col("end"), now()))
    return e.where(~time.is_past(F.col("start"), F.col("end"), now())).groupBy("venue").agg(F.count("*").alias("n"))


@query("SELECT n_name, n_nationkey FROM nation ORDER BY n_name")
def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1, SRC-4: a registry table, name-ordered, needed columns only."""
    return load(spark, sf_dir, "nation").select("n_name", "n_nationkey").orderBy("n_name")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2: the row of a unique key."""
    return by_key(load(spark, sf_dir, "orders"), "o_orderkey", 7).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 5, 9, 100000000)")
def in_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3: the rows of a few keys."""
    return by_keys(load(spark, sf_dir, "customer"), "c_custkey", [1, 5, 9, 100_000_000]).select("c_custkey", "c_name")


@query("""SELECT event_id, strftime(start, '%Y-%m-%dT%H:%M:%S') || 'Z' AS start_text, coalesce(strftime("end", '%Y-%m-%dT%H:%M:%S') || 'Z', '') AS end_text, venue FROM {listed}""")
def record_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14: stored rows to records with ISO text."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return listed(spark, sf_dir).select("event_id", iso("start").alias("start_text"), F.coalesce(iso("end"), F.lit("")).alias("end_text"), "venue")


@query("""SELECT event_id, {effend} <= {now} AS past, start <= {now} AND {now} < {effend} AS in_progress, coalesce("end", start + INTERVAL 1 DAY) > {now} AS public_upcoming, (start >= {now} - INTERVAL 3 DAY OR "end" > {now}) IS TRUE AS candidate FROM {listed}""")
def past_and_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-1, FLT-2, FLT-3: the three upcoming rules side by side."""
    s, e = F.col("start"), F.col("end")
    return listed(spark, sf_dir).select("event_id", time.is_past(s, e, now()).alias("past"), time.in_progress(s, e, now()).alias("in_progress"), time.public_upcoming(s, e, now()).alias("public_upcoming"), F.coalesce(time.upcoming_candidate(s, e, now()), F.lit(False)).alias("candidate"))


@query("""
WITH e AS (SELECT event_id, {night} AS night FROM {listed}), w AS (SELECT DATE '2024-01-15' AS today, DATE '2024-01-19' AS friday)
SELECT event_id, night = today AS tonight, night BETWEEN friday AND friday + 2 AS this_weekend, night BETWEEN friday + 7 AND friday + 9 AS next_weekend FROM e, w""")
def weekend_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-4, DT-5: tonight, this and next weekend."""
    today = time.night_key(now())
    friday = time.friday_of(today)
    night = F.col("night")
    return listed(spark, sf_dir).select("event_id", time.night_key(F.col("start")).alias("night")).select("event_id", (night == today).alias("tonight"), time.in_weekend(night, friday).alias("this_weekend"), time.in_weekend(night, F.date_add(friday, 7)).alias("next_weekend"))


@query("""SELECT event_id FROM {listed} WHERE venue = 'click' AND {night} BETWEEN DATE '2024-01-19' AND DATE '2024-01-21' AND contains(lower(concat_ws(' ', venue, user_id)), 'click 1')""")
def combined_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-5, FLT-6: mode, venue and free text together."""
    e = listed(spark, sf_dir)
    e = e.where(F.col("venue") == "click").where(time.in_weekend(time.night_key(F.col("start")), time.friday_of(time.night_key(now()))))
    return e.where(F.contains(F.lower(F.concat_ws(" ", "venue", "user_id")), F.lower(F.trim(F.lit(" Click 1 "))))).select("event_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', source, lang, text)), 'en the')")
def free_text_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-6: substring over fields joined by a space, across their borders too."""
    return load(spark, sf_dir, "documents").where(F.contains(F.lower(F.concat_ws(" ", "source", "lang", "text")), F.lit("en the"))).select("doc_id")


GENRE_OF = {"click": ["hard-techno", "house"], "view": ["deep-house"], "purchase": ["jungle"], "error": ["ambient-experimental"], "signup": ["garage", "trance"]}
_tags = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in GENRE_OF.items()) + " END"


def tags_of(event_type):
    out = None
    for k, v in GENRE_OF.items():
        out = F.when(event_type == k, genres.strings(v)) if out is None else out.when(event_type == k, genres.strings(v))
    return out


@query(f"""
WITH t AS (SELECT event_id, {_tags} AS tags FROM events)
SELECT event_id, list_has_any(tags, {genres.matched_by("techno")}) AS techno, list_has_any(tags, {genres.matched_by("house")}) AS house, list_has_any(tags, {genres.matched_by("ambient")}) AS ambient, list_has_any(tags, {genres.matched_by("garage-bass")}) AS garage_bass FROM t""")
def tag_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-7: tags against filter values of two levels, legacy ones included."""
    t = load(spark, sf_dir, "events").select("event_id", tags_of(F.col("event_type")).alias("tags"))
    return t.select("event_id", *[genres.matches(F.col("tags"), s).alias(s.replace("-", "_")) for s in ("techno", "house", "ambient", "garage-bass")])


@query("""SELECT event_id FROM {listed} WHERE start < TIMESTAMP '2024-01-22 05:00:00' AND (start >= TIMESTAMP '2024-01-19 00:00:00' OR ("end" IS NOT NULL AND "end" >= TIMESTAMP '2024-01-19 00:00:00'))""")
def window_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-9: what overlaps a window that is padded to the cutoff hour after its last day."""
    lo, hi = F.lit("2024-01-19 00:00:00").cast("timestamp"), time.wall_to_utc(F.lit("2024-01-22 06:00:00").cast("timestamp"))
    return listed(spark, sf_dir).where((F.col("start") < hi) & ((F.col("start") >= lo) | (F.col("end") >= lo))).select("event_id")


@query(f"""
WITH t AS (SELECT event_id, {_tags} AS tags FROM events)
SELECT event_id, list_contains(tags, 'house') AS has_house FROM t WHERE list_has_any(tags, ['house', 'jungle'])""")
def array_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-10, FLT-11: array overlap as a filter, membership as a column."""
    t = load(spark, sf_dir, "events").select("event_id", tags_of(F.col("event_type")).alias("tags"))
    return t.where(F.arrays_overlap("tags", genres.strings(["house", "jungle"]))).select("event_id", F.array_contains("tags", "house").alias("has_house"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word FROM part WHERE p_type = 'SMALL' AND split_part(p_name, ' ', 1) = 'blue' ORDER BY lower(p_name), p_partkey")
def registry_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-12: a registry filtered by its columns and a first word, in case-insensitive name order."""
    p = load(spark, sf_dir, "part").where((F.col("p_type") == "SMALL") & (F.split("p_name", " ")[0] == "blue"))
    return p.orderBy(F.lower("p_name"), "p_partkey").select("p_partkey", F.split("p_name", " ")[0].alias("first_word"))


@query("SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'none' WHEN lang = 'de' THEN 'hidden' ELSE 'shown' END AS kind, CASE WHEN trim(coalesce(text, '')) <> '' AND lang <> 'de' THEN length(text) END AS n FROM documents")
def conditional_blanking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-13: blank texts and those of one language are hidden."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    return load(spark, sf_dir, "documents").select("doc_id", F.when(blank, "none").when(F.col("lang") == "de", "hidden").otherwise("shown").alias("kind"), F.when(~blank & (F.col("lang") != "de"), F.length("text").cast("long")).alias("n"))


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%Widget%'")
def like_any_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-14."""
    return load(spark, sf_dir, "part").where(F.col("p_name").ilike("%Widget%")).select("p_partkey")


@query("""SELECT event_id FROM {listed} WHERE start >= {now} AND start < {now} + INTERVAL 7 DAY AND {effend} > {now} AND event_id % 11 <> 0 ORDER BY start, event_id""")
def newsletter_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-16, STM-7: the coming seven days without postponed ones, in start order."""
    e = listed(spark, sf_dir).where((F.col("start") >= now()) & (F.col("start") < now() + F.expr("INTERVAL 7 DAYS")) & (F.col("event_id") % 11 != 0))
    return e.where(~time.is_past(F.col("start"), F.col("end"), now())).orderBy("start", "event_id").select("event_id")


@query("SELECT c_custkey FROM customer WHERE lower(trim(c_mktsegment)) IN ('building', 'machinery')")
def allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-17, SRC-13: rows whose key is on a list that comes as data."""
    allowed = connectors.static_relation(spark, [("building",), ("machinery",)], "segment string")
    c = load(spark, sf_dir, "customer")
    return c.join(joins.small_side(allowed), F.lower(F.trim("c_mktsegment")) == F.col("segment"), "left_semi").select("c_custkey")


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey < 10")
def list_with_venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-1, JN-2, FLT-15: rows with what they refer to; unmatched ones go."""
    c = load(spark, sf_dir, "customer").where("c_nationkey < 10")
    c = c.join(joins.small_side(load(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return load(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 10) ON o_custkey = c_custkey")
def left_keep_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-3."""
    c = load(spark, sf_dir, "customer").where("c_nationkey < 10")
    return joins.keep_unknown(load(spark, sf_dir, "orders"), c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("""
WITH a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey - c_custkey % 7 END AS merged FROM customer)
SELECT m.id AS canonical, count(*) AS n FROM orders o JOIN a ON o.o_custkey = a.id JOIN a m ON (a.merged IS NULL AND m.id = a.id) OR m.id = a.merged GROUP BY m.id""")
def identity_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-4: the OR join over merged identities as an equi-join."""
    merged = F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") - F.col("c_custkey") % 7)
    nodes = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), merged.alias("merged"))
    found = joins.identity_closure(nodes, load(spark, sf_dir, "orders").select("o_custkey"), "id", "merged", "o_custkey")
    return found.where("canonical IS NOT NULL").groupBy("canonical").agg(F.count("*").alias("n"))


@query("""
SELECT DISTINCT here.l_orderkey, other.l_orderkey AS from_order, here.l_partkey FROM lineitem here JOIN lineitem other ON here.l_partkey = other.l_partkey AND here.l_suppkey = other.l_suppkey AND here.l_orderkey <> other.l_orderkey
WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = here.l_partkey AND p_size > 25)""")
def self_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-5, JN-6: what another order of the same part and supplier has, blocked parts left out before the join."""
    line = joins.excluding(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct(), load(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey")), "l_partkey")
    here, other = line.alias("here"), line.alias("other")
    on = (F.col("here.l_partkey") == F.col("other.l_partkey")) & (F.col("here.l_suppkey") == F.col("other.l_suppkey")) & (F.col("here.l_orderkey") != F.col("other.l_orderkey"))
    return here.join(other, on).select(F.col("here.l_orderkey").alias("l_orderkey"), F.col("other.l_orderkey").alias("from_order"), F.col("here.l_partkey").alias("l_partkey")).distinct()


@query("SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.095 AND l_quantity > 49 AND l_linenumber = 1)")
def blocked_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-6: NOT EXISTS."""
    blocked = load(spark, sf_dir, "lineitem").where("l_discount > 0.095 AND l_quantity > 49 AND l_linenumber = 1").select(F.col("l_suppkey").alias("s_suppkey"))
    return joins.excluding(load(spark, sf_dir, "supplier"), blocked, "s_suppkey").select("s_suppkey")


@query("""SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS first_order, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has_open,
  coalesce((SELECT string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FROM orders WHERE o_custkey = c_custkey), '') AS priorities FROM customer""")
def correlated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-7: correlated subqueries as one aggregate and a left join."""
    o = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"), F.max(F.col("o_orderstatus") == "P").alias("has_open"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))
    c = load(spark, sf_dir, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", "first_order", F.coalesce("has_open", F.lit(False)).alias("has_open"), F.coalesce("priorities", F.lit("")).alias("priorities"))


@query("""
WITH l AS (SELECT l_orderkey, string_agg(p_name, '|' ORDER BY l_linenumber, p_partkey) AS names FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
SELECT name, count(*) AS total, count(*) FILTER (WHERE l_orderkey % 2 = 0) AS even FROM (SELECT l_orderkey, unnest(string_split(names, '|')) AS name FROM l) GROUP BY name""")
def lineup_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-8, AGG-3: a row for each name of a line-up, counted with a filter."""
    line = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    # a joined row is an unnested name already: no line-up is built to be taken apart
    return line.select("l_orderkey", F.col("p_name").alias("name")).groupBy("name").agg(F.count("*").alias("total"), F.count_if(F.col("l_orderkey") % 2 == 0).alias("even"))


@query("""
WITH keys AS (SELECT lower(n_name) AS key, 0 AS tier, n_nationkey AS ord, n_nationkey AS venue_id, '' AS room FROM nation UNION ALL SELECT lower('room ' || (s_suppkey % 40)), 1, s_suppkey, s_nationkey, 'room ' || (s_suppkey % 40) FROM supplier),
best AS (SELECT DISTINCT ON (key) key, venue_id, room FROM keys ORDER BY key, tier, ord),
names AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'ROOM ' || (c_custkey % 60) ELSE upper(n_name) END AS raw FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, venue_id, room AS sub_venue FROM names LEFT JOIN best ON lower(raw) = key""")
def venue_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-10, JN-16: a name against names, then rooms, the first registry row winning."""
    nation, supplier = load(spark, sf_dir, "nation"), load(spark, sf_dir, "supplier")
    room = F.concat(F.lit("room "), (F.col("s_suppkey") % 40).cast("string"))
    keys = nation.select(F.lower("n_name").alias("key"), F.lit(0).alias("priority"), F.col("n_nationkey").cast("long").alias("ord"), F.col("n_nationkey").alias("venue_id"), F.lit("").alias("sub_venue"))
    keys = keys.unionByName(supplier.select(room.alias("key"), F.lit(2).alias("priority"), F.col("s_suppkey").alias("ord"), F.col("s_nationkey").alias("venue_id"), room.alias("sub_venue")))
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("ROOM "), (F.col("c_custkey") % 60).cast("string"))).otherwise(F.upper("n_name"))
    names = load(spark, sf_dir, "customer").join(joins.small_side(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lower(raw).alias("name_key"))
    return joins.resolve_by_key(names, keys, "name_key").select("c_custkey", "venue_id", "sub_venue")


@query("""
WITH m AS (SELECT o_custkey, max_by(o_orderkey, o_orderkey) AS linked FROM orders GROUP BY o_custkey)
SELECT c_custkey, linked, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AS has_o FROM customer LEFT JOIN m ON c_custkey = o_custkey""")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-14: membership in key sets; of repeated keys the last counts."""
    o = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("linked"), F.max(F.col("o_orderstatus") == "O").alias("has_o"))
    return load(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "linked", F.coalesce("has_o", F.lit(False)).alias("has_o"))


@query("""
WITH q AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'merged' WHEN o_orderkey % 3 = 0 THEN 'published' ELSE 'pending' END AS status, o_custkey FROM orders)
SELECT o_orderkey, CASE WHEN status = 'merged' THEN o_custkey WHEN status = 'published' THEN (SELECT min(l_partkey) FROM lineitem l WHERE l.l_orderkey = q.o_orderkey) END AS canonical FROM q""")
def queue_to_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-15: a merged row's own target, a published row's first match."""
    status = F.when(F.col("o_orderkey") % 5 == 0, "merged").when(F.col("o_orderkey") % 3 == 0, "published").otherwise("pending")
    q = load(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), "o_custkey")
    first = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("first"))
    out = q.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select("o_orderkey", F.when(F.col("status") == "merged", F.col("o_custkey")).when(F.col("status") == "published", F.col("first")).alias("canonical"))
