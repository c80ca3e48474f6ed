"""Operators of names, links, connectors, deliveries and identities, applied to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters, genres, rules, text
from ..operators import decisions, lineups, pipeline, sinks
from ..sources import connectors, html
from ..sources.tables import load
from ..streaming import runs
from .reads import _tags, tags_of
from .registry import listed, now, query


def _listed_strings(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("""
WITH f AS (SELECT user_id, event_id % (SELECT count(*) FROM part) AS part, min(ts) AS since FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT user_id, o_orderkey, min(l_partkey) AS first_artist, count(DISTINCT l_partkey) AS artists FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN f ON f.part = l_partkey JOIN customer ON c_custkey = user_id
WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate <= o_orderdate + INTERVAL 60 DAY AND p_size > 5 AND c_acctbal > 0 AND since < TIMESTAMP '2024-01-20 00:00:00' GROUP BY ALL""")
def alert_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-9: events, their appearances, the artists, those who follow them and are subscribed, as one row for each follower and event."""
    stamp = lambda s: F.lit(s).cast("timestamp")
    parts = load(spark, sf_dir, "part").count()
    follows = load(spark, sf_dir, "events").where("event_type = 'view'").groupBy("user_id", (F.col("event_id") % parts).alias("l_partkey")).agg(F.min("ts").alias("since")).where(F.col("since") < stamp("2024-01-20 00:00:00"))
    subscribed = follows.join(load(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id")), "user_id")
    artists = load(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    orders = load(spark, sf_dir, "orders").where(F.col("o_orderdate") >= stamp("1996-01-01 00:00:00")).select("o_orderkey", "o_orderdate")
    appearances = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_shipdate")
    # artists and followers cut the appearances down before events are joined
    out = appearances.join(artists, "l_partkey").join(subscribed, "l_partkey").join(orders, "o_orderkey").where(F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS"))
    return out.groupBy("user_id", "o_orderkey").agg(F.min("l_partkey").alias("first_artist"), F.countDistinct("l_partkey").alias("artists"))


@query(f"""
WITH w AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), 'https?://\\S+|www\\.\\S+', ' ', 'g'), '\\p{{{{L}}}}+') AS w FROM documents),
v AS (SELECT doc_id, len(list_filter(w, lambda x: list_contains({_listed_strings(rules.DANISH)}, x))) AS danish, len(list_filter(w, lambda x: list_contains({_listed_strings(rules.ENGLISH)}, x))) AS english FROM w)
SELECT doc_id, danish, english, danish >= 2 AND danish > english AS reads_as_danish, english >= 3 AND danish * 10 <= english AS clearly_english FROM v""")
def language_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-9: function words of two languages, and the verdicts from them."""
    danish, english = rules.language_votes(F.col("text"))
    d, e = F.col("danish"), F.col("english")
    votes = load(spark, sf_dir, "documents").select("doc_id", danish.cast("long").alias("danish"), english.cast("long").alias("english"))
    return votes.withColumns({"reads_as_danish": (d >= 2) & (d > e), "clearly_english": (e >= 3) & (d * 10 <= e)})


@query("""
WITH t AS (SELECT p_partkey, p_brand, CASE p_partkey % 4 WHEN 0 THEN p_brand || ': ' || p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || ' – ' || p_brand ELSE upper(p_brand) || ' | ' || p_name END AS title FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(title, '^[^:|–-]+\\s*[:|–-]\\s*(.+)$') AND lower(trim(regexp_extract(title, '^([^:|–-]+)\\s*[:|–-]\\s*.+$', 1))) = lower(p_brand) THEN regexp_extract(title, '^[^:|–-]+\\s*[:|–-]\\s*(.+)$', 1) ELSE title END AS shown,
  CASE WHEN title = upper(title) OR title = lower(title) THEN array_to_string(list_transform(string_split(title, ' '), lambda w: CASE WHEN length(w) <= 2 THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ') ELSE title END AS cased FROM t""")
def title_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-7, STR-8: titles without their venue's name, and names written in one case."""
    name, brand, k = F.col("p_name"), F.col("p_brand"), F.col("p_partkey") % 4
    title = F.when(k == 0, F.concat(brand, F.lit(": "), name)).when(k == 1, F.upper(name)).when(k == 2, F.concat(name, F.lit(" – "), brand)).otherwise(F.concat(F.upper(brand), F.lit(" | "), name))
    t = load(spark, sf_dir, "part").select("p_partkey", "p_brand", title.alias("title"))
    return t.select("p_partkey", pipeline.display_title(F.col("title"), F.col("p_brand")).alias("shown"), text.title_cased(F.col("title")).alias("cased"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT l_orderkey, list(p_name) AS names, 'Live: ' || string_agg(p_name, ' & ' ORDER BY l_linenumber, p_name) FILTER (WHERE l_linenumber % 2 = 1) AS title FROM l GROUP BY l_orderkey)
SELECT l_orderkey, len(names) AS n, len(list_filter(names, lambda x: contains(lower(title), lower(x)))) AS in_title, len(list_filter(names, lambda x: contains(lower(title), lower(x)))) * 2 >= len(names) AS redundant FROM g WHERE title IS NOT NULL""")
def preview_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-9: how many of a line-up's names a title of some of them holds, and whether a preview of them would say nothing new. A line-up has few names."""
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(load(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    billed = F.when(F.col("l_linenumber") % 2 == 1, F.struct("l_linenumber", "p_name"))
    g = line.groupBy("l_orderkey").agg(F.collect_list("p_name").alias("names"), F.array_sort(F.collect_list(billed)).alias("billed")).where(F.size("billed") > 0)
    title = F.concat(F.lit("Live: "), F.array_join(F.transform("billed", lambda b: b["p_name"]), " & "))
    g = g.select("l_orderkey", F.size("names").cast("long").alias("n"), text.names_in_title(title, F.col("names")).cast("long").alias("in_title"))
    return g.withColumn("redundant", F.col("in_title") * 2 >= F.col("n"))


@query(f"""
WITH t AS (SELECT event_id, {_tags} AS tags, CASE WHEN event_id % 3 = 0 THEN 'house' ELSE ({_tags})[1] END AS primary_, CASE WHEN event_id % 4 = 0 THEN list_reverse({_tags}) ELSE {_tags} END AS other FROM events)
SELECT event_id, tags[1] IS DISTINCT FROM primary_ AS mismatch, tags = other AS same_tags FROM t""")
def genre_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-4, ARR-5: tags that don't agree with the stored primary genre, and element-wise equality of tag lists."""
    tags = tags_of(F.col("event_type"))
    t = load(spark, sf_dir, "events").select("event_id", tags.alias("tags"))
    primary = F.when(F.col("event_id") % 3 == 0, "house").otherwise(F.get("tags", F.lit(0)))
    other = F.when(F.col("event_id") % 4 == 0, F.reverse("tags")).otherwise(F.col("tags"))
    return t.select("event_id", genres.fields_mismatch(primary, F.col("tags")).alias("mismatch"), (F.col("tags") == other).alias("same_tags"))


_SEPARATORS = [" b2b ", " VS. ", " & ", ", ", " "]


@query("""
WITH e AS (SELECT p_partkey, p_brand || [' b2b ', ' VS. ', ' & ', ', ', ' '][p_partkey % 5 + 1] || p_name AS entry FROM part)
SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(entry, '(?i)\\s+(?:b2b|b3b|vs\\.?)\\s+'), lambda x: trim(x)), lambda x: x <> ''), '|') AS names, regexp_matches(entry, '(?i)\\s(?:&|and|x|\\+|feat\\.?|ft\\.?)\\s|,') AS weak FROM e""")
def lineup_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-6: strong separators split an entry, weak ones are only noted."""
    between = F.get(F.array(*map(F.lit, _SEPARATORS)), (F.col("p_partkey") % 5).cast("int"))
    e = load(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", between, "p_name").alias("entry"))
    return e.select("p_partkey", F.array_join(text.split_lineup(F.col("entry")), "|").alias("names"), text.has_weak_separator(F.col("entry")).alias("weak"))


@query("""
WITH n AS (SELECT p_partkey, p_size, CASE p_partkey % 8 WHEN 0 THEN 'TBA' WHEN 1 THEN 'special guests' WHEN 2 THEN p_name || ' (live)' WHEN 3 THEN p_name || ' https://x.dk/a' WHEN 4 THEN 'Doors 22' WHEN 5 THEN p_name WHEN 6 THEN '!!' ELSE p_brand || ' [DK]' END AS name FROM part),
v AS (SELECT *, CASE WHEN regexp_matches(name, '(?i)^(?:tba|tbc|tbd|special guests?|more|and more|support|line-?up|resident djs?|\\W*)$') OR regexp_matches(name, '(?i)(^|[^a-z0-9_])(?:tickets?|doors?|entry|free entry)($|[^a-z0-9_])') THEN 'not_artist' WHEN regexp_matches(name, 'https?://|\\([^)]*\\)\\s*$|\\[[^\\]]*\\]\\s*$') THEN 'cleanable' ELSE 'artist' END AS verdict FROM n)
SELECT p_partkey, verdict, CASE WHEN verdict = 'not_artist' THEN 'not_artist' WHEN p_size % 7 = 0 THEN 'venue' WHEN p_size % 11 = 0 THEN 'handle' WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'title_marker' WHEN p_size % 3 = 0 THEN 'marker' WHEN p_size % 5 = 0 THEN 'weak_split' WHEN p_size < 10 THEN 'short' WHEN p_size % 2 = 0 THEN 'title_copy' ELSE 'distinct' END AS bucket FROM v""")
def name_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-11, CLS-13: whether a billed name is an artist's, and the bucket of its appearance."""
    k, name, size = F.col("p_partkey") % 8, F.col("p_name"), F.col("p_size")
    billed = F.when(k == 0, "TBA").when(k == 1, "special guests").when(k == 2, F.concat(name, F.lit(" (live)"))).when(k == 3, F.concat(name, F.lit(" https://x.dk/a"))).when(k == 4, "Doors 22").when(k == 5, name).when(k == 6, "!!").otherwise(F.concat("p_brand", F.lit(" [DK]")))
    v = load(spark, sf_dir, "part").select("p_partkey", "p_size", rules.name_verdict(billed).alias("verdict"))
    bucket = rules.appearance_bucket(F.col("verdict") == "not_artist", size % 7 == 0, size % 11 == 0, size % 2 == 0, size % 3 == 0, size % 5 == 0, size < 10)
    return v.select("p_partkey", "verdict", bucket.alias("bucket"))


@query("""
WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 1 THEN ' Red  Box! ' WHEN c_custkey % 3 = 0 THEN 'SUPPLIER ' || c_custkey % 400 || '!' WHEN c_custkey % 3 = 1 THEN 'the old hall of ' || c_custkey % 400 ELSE 'Hall & Bar ' || c_custkey END AS name, c_custkey % 4 = 0 AS confirmed FROM customer),
k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS key FROM n),
r AS (SELECT 'supplier ' || s_suppkey AS key, 0 AS t, s_suppkey FROM supplier UNION ALL SELECT 'the old hall of ' || s_suppkey * 2, 0, s_suppkey FROM supplier),
b AS (SELECT DISTINCT ON (key) key, s_suppkey FROM r ORDER BY key, s_suppkey)
SELECT c_custkey, CASE WHEN s_suppkey IS NOT NULL THEN 'existing' WHEN key = 'red box' AND NOT confirmed THEN 'needs_confirmation' ELSE 'create' END AS plan,
  CASE WHEN s_suppkey IS NOT NULL THEN 's' || s_suppkey WHEN key = 'red box' AND NOT confirmed THEN NULL ELSE 'v-' || regexp_replace(regexp_replace(replace(lower(name), '&', 'and'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END AS venue_id FROM k LEFT JOIN b USING (key)""")
def venue_creation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-24: what becomes of a venue that a source names, by the venues there are, under their names and aliases."""
    k = F.col("c_custkey")
    number = (k % 400).cast("string")
    name = F.when(k % 50 == 1, " Red  Box! ").when(k % 3 == 0, F.concat(F.lit("SUPPLIER "), number, F.lit("!"))).when(k % 3 == 1, F.concat(F.lit("the old hall of "), number)).otherwise(F.concat(F.lit("Hall & Bar "), k.cast("string")))
    wanted = load(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), (k % 4 == 0).alias("confirmed"))
    s = load(spark, sf_dir, "supplier")
    row = lambda key, priority: s.select(key.alias("key"), F.lit(priority).alias("priority"), F.col("s_suppkey").cast("long").alias("ord"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("venue_id"), F.lit(None).cast("string").alias("sub_venue"))
    registry = row(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")), 0).unionByName(row(F.concat(F.lit("the old hall of "), (F.col("s_suppkey") * 2).cast("string")), 1))
    return lineups.planned_venues(wanted, registry).select("c_custkey", "plan", "venue_id")


@query("""
WITH l AS (SELECT l_orderkey AS event_id, l_linenumber AS place, CASE WHEN l_partkey % 13 = 0 THEN 'dj ' || l_partkey || ' b2b x' ELSE 'dj ' || l_partkey END AS name, l_partkey, l_suppkey, l_quantity AS q, l_extendedprice AS e FROM lineitem),
f AS (SELECT event_id, name, min(place) AS place, min(l_partkey) AS part FROM l GROUP BY ALL),
o AS (SELECT DISTINCT ON (event_id, name) event_id, name, 'u/' || l_suppkey AS url FROM l WHERE l_suppkey % 4 < 2 ORDER BY event_id, name, l_suppkey % 4 = 1 DESC, place DESC, l_suppkey DESC, q DESC, e DESC),
s AS (SELECT l_partkey AS part, min('p/' || l_suppkey) AS lo, max('p/' || l_suppkey) AS hi FROM l WHERE l_suppkey % 4 = 2 AND l_partkey % 13 <> 0 GROUP BY l_partkey)
SELECT f.event_id, place, f.name, coalesce(o.url, CASE WHEN lo = hi AND f.part % 13 <> 0 THEN lo END) AS url FROM f LEFT JOIN o ON o.event_id = f.event_id AND o.name = f.name LEFT JOIN s ON s.part = f.part WHERE coalesce(o.url, CASE WHEN lo = hi AND f.part % 13 <> 0 THEN lo END) IS NOT NULL""")
def lineup_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-22: the links that each order shows for the acts of its lines: set by hand, its source's own, or reused from an act with one profile."""
    part = F.col("l_partkey")
    name = F.when(part % 13 == 0, F.concat(F.lit("dj "), part.cast("string"), F.lit(" b2b x"))).otherwise(F.concat(F.lit("dj "), part.cast("string")))
    line = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("place"), name.alias("name"), part.alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("e"))
    events = line.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("a"))
    url = lambda p: F.concat(F.lit(p), F.col("supp").cast("string"))
    own = line.where("supp % 4 < 2").select("event_id", "name", url("u/").alias("url"), (F.col("supp") % 4 == 1).alias("manual"), F.struct("place", "supp", "q", "e").alias("ord"))
    # an act's profiles are reduced to the least and the greatest before they meet its appearances
    known = line.where("supp % 4 = 2").groupBy("part").agg(F.min("name").alias("other_entry"), F.array_distinct(F.array(F.min(url("p/")), F.max(url("p/")))).alias("urls"))
    rows = line.select("event_id", F.col("name").alias("entry"), "part").distinct().join(known, "part").select("event_id", "entry", "other_entry", F.explode("urls").alias("url"))
    out = lineups.shown_links(events.select("event_id", F.transform("a", lambda x: x["name"]).alias("artists")), own, lineups.reused_links(rows))
    places = line.groupBy("event_id", "name").agg(F.min("place").alias("place"))
    return out.drop("place").join(places, ["event_id", "name"]).select("event_id", "place", "name", "url")


@query("""
WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS name, c_mktsegment AS segment, CASE WHEN c_custkey % 5 <> 0 THEN ['n' || c_nationkey, 's' || c_custkey % 3] END AS tags FROM customer)
SELECT a.c_custkey, coalesce(a.name, b.name) AS name, coalesce(a.segment, b.segment) AS segment, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.tags, []), coalesce(b.tags, [])))), ',') AS tags FROM v a JOIN v b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_custkey % 2 = 0""")
def consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-25: a survivor's row with what the other row adds."""
    tags = F.when(F.col("c_custkey") % 5 != 0, F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.concat(F.lit("s"), (F.col("c_custkey") % 3).cast("string"))))
    v = load(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("segment"), tags.alias("tags"))
    both = v.where("c_custkey % 2 = 0").alias("a").join(v.alias("b"), F.col("b.c_custkey") == F.col("a.c_custkey") + 1)
    out = both.select(F.col("a.c_custkey").alias("c_custkey"), *decisions.consolidated("a", "b", ["name", "segment"], ["tags"]))
    return out.withColumn("tags", F.array_join(F.array_sort("tags"), ","))


@query("""
WITH r AS (SELECT user_id, count(*) FILTER (WHERE value > 100) AS found, count(*) FILTER (WHERE value > 300) AS problems, count(*) FILTER (WHERE event_type = 'error' AND value > 200) AS failures FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN found = 0 THEN 'failed' WHEN problems > 0 OR failures > 0 THEN 'partial_failure' ELSE 'ok' END AS outcome FROM r""")
def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-8: a run that finds nothing has failed."""
    r = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 100).alias("found"), F.count_if(F.col("value") > 300).alias("problems"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 200)).alias("failures"))
    return r.select("user_id", runs.run_outcome(F.col("found"), F.col("problems"), F.col("failures")).alias("outcome"))


@query("""
WITH t AS (SELECT p_partkey, 'Entré ' || p_size * 10 || ' kr. / ' || p_size * 7 || ',50 DKK' || CASE WHEN p_size % 2 = 0 THEN ' medlem 25 kr' ELSE '' END AS t FROM part)
SELECT p_partkey, list_min(list_transform(regexp_extract_all(t, '(?i)(\\d{{1,5}})(?:[.,]\\d{{2}})?\\s*(?:kr\\.?|dkk)', 1), lambda x: x::INT)) AS price FROM t""")
def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11: the lowest price that a text names."""
    s = F.col("p_size")
    t = F.concat(F.lit("Entré "), (s * 10).cast("string"), F.lit(" kr. / "), (s * 7).cast("string"), F.lit(",50 DKK"), F.when(s % 2 == 0, " medlem 25 kr").otherwise(""))
    return load(spark, sf_dir, "part").select("p_partkey", text.lowest_price(t).alias("price"))


@query("""SELECT p_partkey, trim(regexp_replace(lower('  ' || p_name || '   ' || upper(p_brand)), '\\s+', ' ', 'g')) AS cache_key, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '(' || p_brand || ')' END AS search_name FROM part""")
def lookup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-4: the form of the artist cache, and names as they are searched for."""
    raw = F.concat(F.lit("  "), "p_name", F.lit("   "), F.upper("p_brand"))
    searched = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") [live]"))).otherwise(F.concat(F.lit("("), "p_brand", F.lit(")")))
    return load(spark, sf_dir, "part").select("p_partkey", text.cache_key(raw).alias("cache_key"), text.search_name(searched).alias("search_name"))


@query(f"""
SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(string_split(lower(p_name || ' live house night ' || p_type), ' ')), lambda w: length(w) > 1 AND NOT list_contains({_listed_strings(text.GENERIC_TITLE_WORDS)}, w))), ' ') AS words FROM part""")
def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-6: the words of a title that tell it from others."""
    plain = text.plain_name(F.concat_ws(" ", "p_name", F.lit("live house night"), "p_type"))
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(text.title_words(plain)), " ").alias("words"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'official,listing,other' ELSE 'official,ticket,listing,other' END AS roles, 'official=https://x.dk/' || p_partkey AS first_link FROM part""")
def link_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-13: a row's links, each normal URL once under its first role."""
    key = F.col("p_partkey").cast("string")
    official = F.concat(F.lit("https://x.dk/"), key)
    ticket = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("http://www.x.dk/"), key, F.lit("/?utm_source=a"))).otherwise(F.concat(F.lit("https://tix.dk/"), key))
    others = F.array(official, F.concat(F.lit("https://o.dk/?fbclid=1&b="), key), F.concat(F.lit("https://o.dk?b="), key))
    p = load(spark, sf_dir, "part").select("p_partkey", pipeline.external_links(official, ticket, F.concat(F.lit("https://list.dk/"), key), others).alias("links"))
    return p.select("p_partkey", F.array_join(F.transform("links", lambda x: x["role"]), ",").alias("roles"), F.concat(F.col("links")[0]["role"], F.lit("="), F.col("links")[0]["url"]).alias("first_link"))


_KINDS = list(decisions.EVIDENCE)


@query(f"""
WITH e AS (SELECT doc_id, {_listed_strings([*_KINDS, "unheard-of"])}[doc_id % {len(_KINDS) + 1} + 1] AS kind, n_chars FROM documents),
t AS (SELECT *, MAP {{{{{", ".join(f"'{k}': '{v}'" for k, v in decisions.EVIDENCE.items())}}}}}[kind] AS tier FROM e)
SELECT doc_id, tier, CASE WHEN n_chars <= 20 OR doc_id % 9 = 0 THEN 'hold' WHEN tier = 'high' THEN 'auto_publish' WHEN tier = 'medium' THEN 'review_queue' ELSE 'hold' END AS gate FROM t""")
def evidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-14: the confidence of each kind of evidence, and the gate that it opens."""
    kind = F.get(F.array(*map(F.lit, [*_KINDS, "unheard-of"])), (F.col("doc_id") % (len(_KINDS) + 1)).cast("int"))
    tier = F.try_element_at(F.create_map(*[F.lit(x) for p in decisions.EVIDENCE.items() for x in p]), kind)
    d = load(spark, sf_dir, "documents").select("doc_id", "n_chars", tier.alias("tier"))
    yes = F.lit(True)
    return d.select("doc_id", "tier", decisions.quality_gate(F.col("n_chars") > 20, yes, yes, yes, F.col("doc_id") % 9 != 0, F.coalesce("tier", F.lit("none"))).alias("gate"))


_ASKED = {"mode": "this-weekend", "genre": "house", "venue": "click", "q": "  Click 1 ", "page": "2"}


@query(f"""
WITH e AS (SELECT event_id, {{night}} AS night, venue, {_tags.replace("event_type", "venue")} AS tags, concat_ws(' ', venue, user_id) AS words FROM {{listed}})
SELECT event_id FROM e WHERE night BETWEEN DATE '2024-01-19' AND DATE '2024-01-21' AND list_has_any(tags, {genres.matched_by("house")}) AND venue = 'click' AND contains(lower(words), 'click 1')""")
def explorer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-5, FLT-8: filters read from a URL's parameters and applied together."""
    e = listed(spark, sf_dir).select("event_id", "start", tags_of(F.col("venue")).alias("tags"), F.col("venue").alias("venue_slug"), F.concat_ws(" ", "venue", "user_id").alias("search_text"))
    return filters.apply(e, filters.parse(_ASKED), now()).select("event_id")


@query(f"""
WITH m AS (SELECT l_orderkey, MAP {{{{{", ".join(f"'{k}': '{v}'" for k, v in pipeline.STYLES.items())}}}}}[{_listed_strings([*pipeline.STYLES, "Unmapped"])}[(l_partkey * l_linenumber) % {len(pipeline.STYLES) + 1} + 1]] AS g FROM lineitem)
SELECT l_orderkey, CASE WHEN min(g) = max(g) THEN min(g) END AS genre FROM m GROUP BY l_orderkey""")
def style_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-12: the one genre that all mapped styles of an artist's releases stand for."""
    names = [*pipeline.STYLES, "Unmapped"]
    style = F.get(F.array(*map(F.lit, names)), ((F.col("l_partkey") * F.col("l_linenumber")) % len(names)).cast("int"))
    return pipeline.style_genre(load(spark, sf_dir, "lineitem").select("l_orderkey", F.array(style).alias("styles")), "l_orderkey")


@query("""
WITH a AS (SELECT l_orderkey AS event_id, l_linenumber AS place, 'k' || l_partkey % 97 AS name_key, CASE WHEN l_partkey % 3 = 0 THEN 'p' || l_partkey % 5 END AS profile FROM lineitem),
r AS (SELECT 'a' || s_suppkey AS artist_id, 'k' || s_suppkey % 150 AS name_key, CASE WHEN s_suppkey % 2 = 0 THEN 'p' || s_suppkey % 5 END AS profile FROM supplier),
known AS (SELECT name_key, count(*) AS n, min(artist_id) AS only_, max(profile) AS only_profile FROM r GROUP BY name_key), by_ AS (SELECT name_key, profile, min(artist_id) AS artist FROM r WHERE profile IS NOT NULL GROUP BY ALL),
j AS (SELECT a.*, n, only_, by_.artist, coalesce(n = 1 AND a.profile <> only_profile, false) AS conflict FROM a LEFT JOIN known USING (name_key) LEFT JOIN by_ ON by_.name_key = a.name_key AND by_.profile = a.profile)
SELECT event_id, place, name_key, coalesce(artist, CASE WHEN n = 1 AND NOT conflict THEN only_ END, 'artist-' || substr(sha256(name_key || '|' || coalesce(profile, '')), 1, 12)) AS artist_id,
  CASE WHEN artist IS NOT NULL THEN 'high' WHEN conflict OR coalesce(n, 0) > 1 THEN 'review' WHEN profile IS NOT NULL THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN artist IS NULL AND (n IS DISTINCT FROM 1 OR conflict) THEN 'create' ELSE 'link' END AS action FROM j""")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-19: appearances with the artists they belong to, by name and profile."""
    a = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.concat(F.lit("k"), (F.col("l_partkey") % 97).cast("string")).alias("name_key"), F.col("l_linenumber").cast("string").alias("name"), F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("p"), (F.col("l_partkey") % 5).cast("string"))).alias("profile"))
    s = F.col("s_suppkey")
    r = load(spark, sf_dir, "supplier").select(F.concat(F.lit("a"), s.cast("string")).alias("artist_id"), F.concat(F.lit("k"), (s % 150).cast("string")).alias("name_key"), F.when(s % 2 == 0, F.concat(F.lit("p"), (s % 5).cast("string"))).alias("profile"))
    return runs.reconcile_names(a, r).select("event_id", F.col("name").cast("int").alias("place"), "name_key", "artist_id", "confidence", "action")


@query("""
WITH seen AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 30), s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate END AS removed_at FROM orders)
SELECT o_orderkey, CASE WHEN l_orderkey IS NOT NULL THEN NULL ELSE coalesce(removed_at, {now}) END AS removed_at FROM s LEFT JOIN seen ON o_orderkey = l_orderkey""")
def removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-19: rows that a run no longer has are marked, those that came back unmarked."""
    stored = load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate")).alias("removed_at"))
    seen = load(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return runs.soft_removed(stored, seen, ["o_orderkey"], now())


@query("""
WITH d AS (SELECT event_id, user_id AS subscriber_id, start, start - INTERVAL 4 DAY - to_hours(event_id % 60) AS created_at, event_id % 10 <> 0 AS public, event_id % 7 <> 0 AS alertable FROM {listed} WHERE venue = 'view'),
sent AS (SELECT user_id AS subscriber_id, count(*) AS n FROM {listed} WHERE venue = 'signup' AND start > {now} - INTERVAL 24 HOUR AND event_id % 3 = 0 GROUP BY user_id),
p AS (SELECT d.*, n, NOT public OR NOT alertable OR start - INTERVAL 2 HOUR < {now} OR created_at + INTERVAL 3 DAY < {now} AS gone FROM d LEFT JOIN sent USING (subscriber_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY subscriber_id, gone ORDER BY start, event_id) AS rn FROM p)
SELECT event_id, subscriber_id, CASE WHEN gone THEN 'drop' WHEN coalesce(n, 0) < 1 AND rn <= 10 THEN 'send' ELSE 'wait' END AS plan FROM r""")
def alert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-11, STM-5: what a run makes of each pending alert: sent, dropped or kept for later."""
    e = listed(spark, sf_dir)
    hours = F.expr("make_dt_interval(0, CAST(event_id % 60 AS INT))")
    d = e.where("venue = 'view'").select("event_id", F.col("user_id").alias("subscriber_id"), "start", (F.col("start") - F.expr("INTERVAL 4 DAYS") - hours).alias("created_at"), (F.col("event_id") % 10 != 0).alias("public"), (F.col("event_id") % 7 != 0).alias("alertable"))
    sent = e.where("venue = 'signup' AND event_id % 3 = 0").select(F.col("user_id").alias("subscriber_id"), F.col("start").alias("sent_at"))
    return pipeline.alert_run(d, sent, now()).select("event_id", "subscriber_id", "plan")


@query("""
SELECT o_orderkey AS page_id, 'Order ' || o_orderkey AS title, o_orderdate AS start, 'Hall ' || o_custkey AS venue, '/e/' || o_orderkey AS url, 'a,b' || o_orderkey % 3 AS lineup FROM orders WHERE o_orderkey % 4 <> 0""")
def page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10, SNK-11: pages that hold events as JSON-LD, read back; pages without give none."""
    key = F.col("o_orderkey").cast("string")
    artists = F.array(F.lit("a"), F.concat(F.lit("b"), (F.col("o_orderkey") % 3).cast("string")))
    json = sinks.json_ld(F.concat(F.lit("Order "), key), F.col("o_orderdate"), F.lit(None).cast("timestamp"), F.lit("x"), F.concat(F.lit("Hall "), F.col("o_custkey").cast("string")), artists, F.concat(F.lit("/e/"), key))
    script = F.concat(F.lit('<html><script type="application/ld+json">'), json, F.lit("</script><p>text</p></html>"))
    pages = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.when(F.col("o_orderkey") % 4 != 0, script).otherwise("<html><p>nothing</p></html>").alias("html"))
    return connectors.jsonld_events(pages).select("page_id", "title", F.col("start").cast("timestamp").alias("start"), "venue", "url", F.array_join("lineup", ",").alias("lineup"))


@query("""
SELECT o_orderkey AS page_id, 'Artist ' || o_custkey AS title, date_trunc('day', o_orderdate) + to_minutes(CAST(20 * 60 + o_orderkey % 60 AS BIGINT)) AS start FROM orders UNION ALL
SELECT o_orderkey, 'Second night', make_timestamp(2024, 10, 3, 20, 0, 0) FROM orders WHERE o_orderkey % 2 = 0""")
def free_text_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12: candidates from the dated lines of a free text."""
    at = F.concat(F.lit("20:"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"))
    line = F.concat(F.date_format("o_orderdate", "d/M yyyy"), F.lit(" kl. "), at, F.lit(": Artist "), F.col("o_custkey").cast("string"))
    body = F.concat(F.lit("Welcome\n"), line, F.when(F.col("o_orderkey") % 2 == 0, "\n3. okt – Second night\nnot a date 4/5").otherwise(""))
    pages = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), body.alias("body"))
    return connectors.free_text_candidates(pages, "body", 2024)


def _clean(column: str) -> str:
    """SQL of a text with its entities decoded and white space collapsed."""
    out = column
    for entity, character in html.ENTITIES.items():
        quoted = character.replace("'", "''")
        out = f"replace({out}, '{entity}', '{quoted}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query(f"""
WITH r AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', '', 'g'), '(?s)<style.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS x FROM pages),
q AS (SELECT page_id, regexp_extract_all(x, '<[^>]*>|[^<]+') AS ps FROM r),
u AS (SELECT page_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM q),
t AS (SELECT *, lower(regexp_extract(p, '^</?([A-Za-z][A-Za-z0-9-]*)', 1)) AS tag, CASE WHEN starts_with(p, '</') THEN -1 ELSE 1 END AS d FROM u),
w AS (SELECT *, sum(CASE WHEN tag = 'article' THEN d ELSE 0 END) OVER o AS art, sum(CASE WHEN tag = 'h1' THEN d ELSE 0 END) OVER o AS h1, sum(CASE WHEN tag = 'article' AND d = 1 THEN 1 ELSE 0 END) OVER o AS item FROM t WINDOW o AS (PARTITION BY page_id ORDER BY i)),
n AS (SELECT page_id, item, string_agg(p, ' ' ORDER BY i) FILTER (WHERE tag = '' AND h1 > 0) AS title, string_agg(p, ' ' ORDER BY i) FILTER (WHERE tag = '') AS body, count(*) FILTER (WHERE tag = 'a' AND d = 1 AND regexp_matches(p, 'href="[^"]')) AS links FROM w WHERE art > 0 GROUP BY page_id, item)
SELECT page_id, CAST(item AS INTEGER) AS item, nullif({_clean("title")}, '') AS title, md5(nullif({_clean("body")}, '')) AS body, links FROM n WHERE body IS NOT NULL OR links > 0""")
def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-8, SRC-9: the articles of pages as candidates, their fields found by the elements around them."""
    found = html.items(load(spark, sf_dir, "pages").select("page_id", "html"), "html", "article", {"title": ["h1"], "body": []})
    return found.select("page_id", "item", "title", F.md5("body").alias("body"), F.size("href").cast("long").alias("links"))


@query("""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1)) AS target, generate_subscripts(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1), 1) - 1 AS pos, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
f AS (SELECT DISTINCT ON (target) target, page_id, pos FROM l ORDER BY target, page_id, pos), d AS (SELECT DISTINCT ON (target) target, title FROM l WHERE pos = 0 ORDER BY target, page_id)
SELECT f.target, page_id, CAST(pos AS BIGINT) AS pos, title, CASE WHEN d.target IS NULL THEN 'not fetched: ' || f.target END AS problem FROM f LEFT JOIN d USING (target)""")
def detail_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-9: the detail pages that listings link to, each once, with what was fetched under that address (a page is under its own first link here), and problems for the others."""
    pages = load(spark, sf_dir, "pages").select("page_id", "html")
    address, title = F.get(text.anchors(F.col("html")), F.lit(0)), F.regexp_extract("html", r"(?i)<title>([^<]*)</title>", 1)
    fetched = pages.select(address.alias("target"), "page_id", title.alias("title"), "html").where("target IS NOT NULL")
    fetched = fetched.groupBy("target").agg(F.min_by(F.struct("title", "html"), "page_id").alias("p")).select("target", "p.*")
    return connectors.details(connectors.listing_links(pages), fetched, "target").select("target", "page_id", F.col("at").cast("long").alias("pos"), "title", "problem")


@query("""
WITH i AS (SELECT o_custkey % 50 AS source, o_orderkey % 7 AS page, CASE WHEN o_orderkey % 97 = 0 THEN 'timeout' END AS problem FROM orders), s AS (SELECT source, count(*) FILTER (WHERE problem IS NULL) AS items, 200 + source % 3 * 300 AS declared, count(problem) AS problems FROM i GROUP BY source)
SELECT source, items, declared, problems, items > 0 AND problems = 0 AND items >= declared AS complete FROM s""")
def fetch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-7, SRC-11: which sources were read in whole, by their declared counts and problems."""
    source = F.col("o_custkey") % 50
    feed = load(spark, sf_dir, "orders").select(source.alias("source"), F.when(F.col("o_orderkey") % 97 == 0, "timeout").alias("problem"), (200 + source % 3 * 300).alias("declared"))
    return connectors.fetch_state(feed, "source")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN {now} + INTERVAL 90 DAY ELSE {now} + INTERVAL 7 DAY END AS expires_at, CASE o_orderstatus WHEN 'F' THEN 'auto_merge_if_safe' WHEN 'O' THEN 'review_queue' ELSE 'keep_separate' END AS action FROM orders""")
def cache_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-23, ER-1: how long a looked-up answer is kept, and what is done with a duplicate."""
    level = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("none")
    return load(spark, sf_dir, "orders").select("o_orderkey", decisions.expiry(F.col("o_orderkey") % 3 == 0, now()).alias("expires_at"), decisions.duplicate_action(level).alias("action"))


@query("""
WITH t AS (SELECT p_partkey, p_name, CASE WHEN p_size > 20 THEN 'high' ELSE 'medium' END AS c FROM part), o AS (SELECT p_name FROM t GROUP BY p_name HAVING count(*) >= 2)
SELECT p_partkey, CASE WHEN c = 'high' AND p_name IN (FROM o) THEN 'medium' ELSE c END AS confidence FROM t""")
def recurring_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-1: a title that recurs proves less."""
    t = load(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 20, "high").otherwise("medium").alias("confidence"))
    return decisions.recurring_guard(t, t, "p_name").select("p_partkey", "confidence")


@query("""
WITH e AS (SELECT event_id, start, 'n' || user_id % 40 AS k1, 'N' || user_id % 70 AS n1 FROM {listed} WHERE start >= {now}), n AS (SELECT event_id, start, 0 AS pos, k1 AS key, k1 AS name FROM e UNION ALL SELECT event_id, start, 1, lower(n1), n1 FROM e),
o AS (SELECT * FROM n WHERE key NOT IN (SELECT 'n' || s_suppkey % 9 FROM supplier)), f AS (SELECT DISTINCT ON (key) key, name, start, event_id, pos FROM o ORDER BY key, start, event_id, pos)
SELECT key, name FROM f ORDER BY start, event_id, pos LIMIT 20""")
def lookup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-26: the artists to look up next, as a top-k report."""
    name = lambda p, m: F.concat(F.lit(p), (F.col("user_id") % m).cast("string"))
    e = listed(spark, sf_dir).where(F.col("start") >= now()).select("event_id", "start", F.array(name("n", 40), name("N", 70)).alias("lineup"))
    shown = load(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), (F.col("s_suppkey") % 9).cast("string")).alias("key"))
    return pipeline.link_plan(e, shown, 20)


@query("""
WITH n AS (SELECT lower(p_name) AS key, count(*) AS events, min(p_name) AS name FROM part GROUP BY 1), c AS (SELECT lower(p_name) AS key, min(p_type) AS status, min(p_brand) AS match_rule, bool_or(p_size > 49) AS manual FROM part WHERE p_size > 25 GROUP BY 1)
SELECT key, events, name, CASE WHEN manual THEN 'manual' ELSE coalesce(status, 'not_looked_up') END AS status, match_rule FROM n LEFT JOIN c USING (key)""")
def name_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-27: names with how many events bear them and what the cache knows of them."""
    p = load(spark, sf_dir, "part").withColumn("key", F.lower("p_name"))
    cache = p.where("p_size > 25").groupBy("key").agg(F.min("p_type").alias("status"), F.min("p_brand").alias("match_rule"), F.bool_or(F.col("p_size") > 49).alias("manual"))
    return pipeline.name_report(p.select("key", F.col("p_name").alias("name")), cache).select("key", "events", "name", "status", "match_rule")
