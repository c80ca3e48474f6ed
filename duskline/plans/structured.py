"""Texts with structure: rooms, blocks, labelled links, videos under versions of rules. Texts are made of the tables' own rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import descriptions, rooms
from ..operators import evidence, headliners
from ..sources.tables import load
from .registry import query

# ------------------------------------------------------------------ rooms

#: SQL of an order's description: its lines under the heading of their room, and what listings add, by order.
_ROOMS = """
l AS (SELECT DISTINCT l_orderkey AS k, 'act ' || l_partkey AS name, CASE WHEN l_returnflag = 'N' THEN 'Den Anden Side' ELSE 'Den Anden Ende' END AS room FROM lineitem),
a AS (SELECT k, list(DISTINCT name ORDER BY name) AS artists FROM l GROUP BY k),
b AS (SELECT k, room, replace(string_agg(name, chr(31) ORDER BY name), chr(31), CASE WHEN k % 2 = 0 THEN ', ' ELSE chr(10) END) AS names FROM l GROUP BY k, room),
d AS (SELECT k, CASE k % 7 WHEN 3 THEN 'a night with ' || string_agg(names, ' and ' ORDER BY room) WHEN 4 THEN 'in the second room' WHEN 5 THEN 'DEN ANDEN ENDE' || chr(10) || chr(10) || 'Tickets:' || chr(10) || string_agg(names, chr(10) ORDER BY room)
  ELSE replace(string_agg(CASE WHEN k % 2 = 0 THEN room || ': ' || names ELSE CASE WHEN k % 3 = 0 AND room = 'Den Anden Side' THEN 'Main floor:' ELSE '◈ ' || room || ' ◈' END || chr(10) || names END, chr(31) ORDER BY room), chr(31), chr(10) || CASE WHEN k % 5 = 0 THEN '----' || chr(10) ELSE chr(10) END) || CASE WHEN k % 7 = 6 THEN chr(10) || 'Room 2:' || chr(10) || min(names) ELSE '' END END AS description FROM b GROUP BY k),
e AS (SELECT k, artists, description, CASE WHEN k % 11 = 0 THEN 'Night @ Den Anden Ende' ELSE 'Night' END AS title FROM a JOIN d USING (k))"""


@query(f"""
WITH RECURSIVE {_ROOMS},
x AS (SELECT k, artists, generate_subscripts(string_split(description, chr(10)), 1) AS i, trim(unnest(string_split(description, chr(10)))) AS line FROM e),
w AS (SELECT *, trim(regexp_replace(lower(line), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+', ' ', 'g')) AS plain FROM x),
h AS (SELECT *, CASE WHEN contains(plain, 'den anden ende') THEN 'Den Anden Ende' WHEN contains(plain, 'den anden side') OR regexp_matches(line, '(?i)^main floor:') THEN 'Den Anden Side' END AS r, trim(regexp_replace(line, '(?i)^(.*?)(den anden (side|ende)|main floor)\\s*[:]?\\s*', '')) AS after FROM w),
t AS (SELECT k, i, CASE WHEN line = '' THEN 'blank' WHEN line = '----' OR line = 'Tickets:' THEN 'break' WHEN r IS NOT NULL AND (after IN ('', '◈') OR contains(after, ',') OR len(string_split(after, ' ')) <= 6) THEN 'room' WHEN line = 'Room 2:' THEN 'other' ELSE 'text' END AS kind, r, starts_with(line, '◈') AS decorated,
  list_filter(artists, lambda n: contains(' ' || plain || ' ', ' ' || n || ' ')) AS names FROM h),
f AS (SELECT k, 0::BIGINT AS i, NULL::VARCHAR AS room, false AS saw, false AS section, 0 AS headings, []::VARCHAR[] AS names FROM e
  UNION ALL
  SELECT f.k, t.i, CASE t.kind WHEN 'blank' THEN CASE WHEN saw AND NOT section THEN NULL ELSE room END WHEN 'room' THEN r WHEN 'text' THEN room END,
    CASE t.kind WHEN 'room' THEN len(t.names) > 0 WHEN 'text' THEN saw OR (room IS NOT NULL AND len(t.names) > 0) ELSE saw END, CASE t.kind WHEN 'room' THEN decorated ELSE section END, headings + CASE t.kind WHEN 'room' THEN 1 ELSE 0 END,
    CASE WHEN t.kind = 'room' OR (t.kind = 'text' AND room IS NOT NULL) THEN t.names ELSE [] END FROM f JOIN t ON t.k = f.k AND t.i = f.i + 1),
p AS (SELECT k, max(headings) AS headings, coalesce(list_sort(list_distinct(flatten(list(names) FILTER (WHERE room = 'Den Anden Side')))), []) AS m, coalesce(list_sort(list_distinct(flatten(list(names) FILTER (WHERE room = 'Den Anden Ende')))), []) AS s FROM f GROUP BY k),
v AS (SELECT e.k, artists, m, s, len(m) + len(s) = 0 AS nobody, CASE
  WHEN len(m) + len(s) = 0 THEN CASE WHEN title <> 'Night' THEN 'small-room-only' WHEN headings > 0 OR contains(description, 'second room') THEN 'unresolved' ELSE 'no-room-info' END
  WHEN len(list_intersect(m, s)) > 0 OR len(list_filter(artists, lambda n: NOT list_contains(m, n) AND NOT list_contains(s, n))) > 0 OR (title <> 'Night' AND len(m) > 0) THEN 'unresolved'
  WHEN len(m) > 0 AND len(s) > 0 THEN 'two-rooms' WHEN len(s) > 0 THEN 'small-room-only' ELSE 'main-room-only' END AS verdict FROM e JOIN p USING (k))
SELECT k AS order_id, verdict, CASE WHEN verdict IN ('two-rooms', 'main-room-only') THEN array_to_string(m, '|') ELSE '' END AS main_room, CASE WHEN verdict = 'small-room-only' AND nobody THEN array_to_string(artists, '|') WHEN verdict IN ('two-rooms', 'small-room-only') THEN array_to_string(s, '|') ELSE '' END AS small_room FROM v""")
def room_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-15: which room each act of an order plays in, by its description's headings. An order has few lines."""
    k = F.col("k")
    flag = F.when(F.col("l_returnflag") == "N", rooms.MAIN).otherwise(rooms.SMALL)
    line = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat(F.lit("act "), F.col("l_partkey").cast("string")).alias("name"), flag.alias("room")).distinct()
    a = line.groupBy("k").agg(F.sort_array(F.collect_set("name")).alias("artists"))
    sep = F.when(k % 2 == 0, ", ").otherwise("\n")
    b = line.groupBy("k", "room").agg(F.sort_array(F.collect_list("name")).alias("names")).withColumn("names", F.array_join("names", "\x1f")).withColumn("names", F.replace("names", F.lit("\x1f"), sep))
    b = b.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("room", "names"))).alias("b"))
    head = lambda x: F.when((k % 3 == 0) & (x["room"] == rooms.MAIN), F.lit("Main floor:")).otherwise(F.concat(F.lit("◈ "), x["room"], F.lit(" ◈")))
    block = F.transform("b", lambda x: F.when(k % 2 == 0, F.concat(x["room"], F.lit(": "), x["names"])).otherwise(F.concat(head(x), F.lit("\n"), x["names"])))
    names = F.transform("b", lambda x: x["names"])
    listed = F.array_join(block, "\x1f")
    listed = F.replace(listed, F.lit("\x1f"), F.when(k % 5 == 0, "\n----\n").otherwise("\n\n"))
    listed = F.concat(listed, F.when(k % 7 == 6, F.concat(F.lit("\nRoom 2:\n"), F.array_min(names))).otherwise(""))
    said = F.when(k % 7 == 3, F.concat(F.lit("a night with "), F.array_join(names, " and "))).when(k % 7 == 4, "in the second room").when(k % 7 == 5, F.concat(F.lit("DEN ANDEN ENDE\n\nTickets:\n"), F.array_join(names, "\n"))).otherwise(listed)
    e = a.join(b.select("k", said.alias("description")), "k").withColumns({"title": F.when(k % 11 == 0, "Night @ Den Anden Ende").otherwise("Night"), "venue": F.lit("Hall")})
    out = rooms.with_rooms(e)
    return out.select(k.alias("order_id"), F.col("room_verdict").alias("verdict"), F.array_join("main_room", "|").alias("main_room"), F.array_join("small_room", "|").alias("small_room"))


# ------------------------------------------------------------------ descriptions

_TITLES = "[" + ", ".join("'" + t + "'" for t in descriptions.SECTION_TITLES) + "]"


@query(f"""
WITH d AS (SELECT doc_id, '## About ' || source || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'LINEUP' || chr(10) || 'act ' || doc_id || ' https://x.dk/' || doc_id || '.' || chr(10) || 'www.y.dk/a?b, then more' || chr(10) || chr(10) || 'Tickets:' || chr(10) || '100 kr' || chr(10) || 'Wardrobe' || chr(10) || '20 kr' AS x FROM documents),
n AS (SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(replace(replace(x, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda l: trim(regexp_replace(l, '[ \\t ]+', ' ', 'g'), ' ')), chr(10)), '\\n{{{{3,}}}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') AS x FROM d),
p AS (SELECT doc_id, generate_subscripts(list_filter(string_split(x, chr(10) || chr(10)), lambda y: y <> ''), 1) AS para, unnest(list_filter(string_split(x, chr(10) || chr(10)), lambda y: y <> '')) AS y FROM n),
l AS (SELECT doc_id, para, generate_subscripts(string_split(y, chr(10)), 1) AS j, unnest(string_split(y, chr(10))) AS line FROM p),
m AS (SELECT *, row_number() OVER w AS i, lead(line) OVER w AS nxt, lag(line) OVER w AS prv, lag(para) OVER w AS ppara, row_number() OVER w = count(*) OVER (PARTITION BY doc_id) AS final FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY para, j)),
s AS (SELECT *, length(regexp_replace(line, '\\P{{{{L}}}}', '', 'g')) >= 3 AND NOT regexp_matches(line, '\\p{{{{Ll}}}}') AS shout, length(regexp_replace(coalesce(nxt, ''), '\\P{{{{L}}}}', '', 'g')) >= 3 AND NOT regexp_matches(coalesce(nxt, ''), '\\p{{{{Ll}}}}') AS nshout, regexp_replace(line, '^#{{{{1,6}}}}\\s+', '') AS bare FROM m),
g AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{{{1,6}}}}\\s+\\S') THEN length(bare) <= 80 AND NOT regexp_matches(bare, '[.!?]\\s+\\S') AND NOT regexp_matches(bare, '(?i)https?://|www\\.') WHEN length(line) > 80 OR regexp_matches(line, '(?i)(https?://|www\\.)[^\\s<>"''`]') OR trim(regexp_replace(line, ':$', '')) = '' THEN false
  WHEN list_contains({_TITLES}, lower(trim(regexp_replace(line, ':$', '')))) THEN true ELSE coalesce(length(nxt) >= 40, false) AND NOT regexp_matches(line, '[.!?,;…]$|\\d') AND shout AND length(line) <= 50 AND len(regexp_split_to_array(line, '\\s+')) <= 7 AND NOT nshout END AS heading FROM s),
o AS (SELECT *, heading OR coalesce(lag(heading) OVER (PARTITION BY doc_id ORDER BY i), true) OR ppara <> para OR length(line) >= 80 OR length(prv) >= 80 AS opens FROM g),
b AS (SELECT doc_id, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block, heading AND NOT final AS head, CASE WHEN heading THEN bare ELSE line END AS line, i FROM o),
k AS (SELECT doc_id, block, bool_or(head) AS head, string_agg(line, chr(10) ORDER BY i) AS body, sum(length(line)) AS chars, sum(len(regexp_extract_all(line, '(?i)(^|[^a-z0-9_])(https?://|www\\.)[^\\s<>"''`]*[^\\s<>"''`.,;:!?)\\]]'))) AS links FROM b GROUP BY doc_id, block)
SELECT doc_id, count(*) AS n_blocks, count(*) FILTER (WHERE head) AS n_headings, CAST(sum(links) AS BIGINT) AS n_links, CAST(sum(chars) AS BIGINT) AS chars, md5(string_agg(body, chr(10) || chr(10) ORDER BY block)) AS rebuilt FROM k GROUP BY doc_id""")
def description_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-12: whole documents, with sections around them, as nested blocks; the text rebuilt from the blocks as a digest."""
    key = F.col("doc_id").cast("string")
    x = F.concat(F.lit("## About "), "source", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n\nLINEUP\nact "), key, F.lit(" https://x.dk/"), key, F.lit(".\nwww.y.dk/a?b, then more\n\nTickets:\n100 kr\nWardrobe\n20 kr"))
    d = load(spark, sf_dir, "documents").select("doc_id", descriptions.normal(x).alias("x"))
    d = d.withColumn("b", descriptions.blocks(F.col("x"))).withColumn("tree", descriptions.nested(F.col("b")))
    count = lambda t, ok: F.size(F.filter(t, ok)).cast("long")
    tokens = F.flatten(F.flatten(F.transform("tree", lambda b: b["lines"])))
    chars = F.aggregate("b", F.lit(0).cast("long"), lambda n, b: n + F.aggregate(b["lines"], F.lit(0), lambda k, s: k + F.length(s)))
    return d.select("doc_id", F.size("b").cast("long").alias("n_blocks"), count(F.col("b"), lambda b: b["type"] == "heading").alias("n_headings"), count(tokens, lambda t: t["type"] == "link").alias("n_links"), chars.alias("chars"), F.md5(descriptions.rebuilt(F.col("tree"))).alias("rebuilt"))


# ------------------------------------------------------------------ labelled links


@query("""
WITH l AS (SELECT l_orderkey AS event_id, l_linenumber AS n, min('dj ' || l_partkey) AS entry, min(CASE WHEN l_suppkey % 6 = 0 THEN 'p' || l_partkey || 'x' ELSE 'p' || l_partkey END) AS handle FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, CASE (event_id + n) % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'plain' WHEN 2 THEN 'brackets' WHEN 3 THEN 'other' ELSE 'two' END AS form FROM l),
t AS (SELECT event_id, entry, list(handle) AS hs FROM (SELECT event_id, entry, handle FROM r WHERE form IN ('plain', 'brackets', 'two') UNION SELECT event_id, entry, handle || '-2' FROM r WHERE form = 'two') GROUP BY ALL),
u AS (SELECT event_id, entry, unnest(hs) AS h, len(hs) AS here FROM t WHERE entry IN (SELECT entry FROM r q WHERE q.event_id = t.event_id GROUP BY entry HAVING count(*) = 1)),
k AS (SELECT entry, min(h) <> max(h) AS differ FROM u GROUP BY entry)
SELECT event_id, entry, 'https://soundcloud.com/' || h AS url, CASE WHEN here > 1 THEN 'two_handles_same_event' WHEN differ THEN 'two_handles_same_key' END AS conflict FROM u JOIN k USING (entry)""")
def profile_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-18: profiles that an order's text links to the acts it bills, with what speaks against them. An order has few lines."""
    part, one = F.col("l_partkey").cast("string"), F.col("n")
    handle = F.concat(F.lit("p"), part, F.when(F.col("l_suppkey") % 6 == 0, "x").otherwise(""))
    line = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("n")).agg(F.min(F.concat(F.lit("dj "), part)).alias("entry"), F.min(handle).alias("handle"))
    url = F.concat(F.lit("https://soundcloud.com/"), "handle")
    form = (F.col("event_id") + one) % 5
    said = (
        F.when(form == 0, F.concat("entry", F.lit(" plays")))
        .when(form == 1, F.concat("entry", F.lit(": "), url))
        .when(form == 2, F.concat(F.upper("entry"), F.lit(" (Some Label) http://www."), F.substring(url, 9, 500), F.lit("/.")))
        .when(form == 3, F.concat(F.lit("somebody else "), url))
        .otherwise(F.concat("entry", F.lit(" - "), url, F.lit(" "), url, F.lit("-2")))
    )
    events = line.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "entry"))), lambda x: x["entry"]).alias("artists"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", said.alias("s")))), lambda x: x["s"]), "\n").alias("text"))
    return evidence.paired_profiles(events).select("event_id", "entry", "url", "conflict")


# ------------------------------------------------------------------ rules over stored evidence

RULE_VERSIONS = [(1, "channel", None), (1, "name", None), (2, "channel", None), (2, "name", None), (2, "performance", None), (2, "cue", None), (3, "channel", None), (3, "name", None), (3, "performance", None), (3, "cue", None), (3, "billed", None), (3, "continuation", None), (3, "position", None), (4, "channel", None), (4, "name", None), (4, "reject", r"\bhall\b")]


@query("""
WITH c AS (SELECT p_partkey AS artist, p_name AS name, l_orderkey * 8 + l_linenumber AS video, l_shipdate AS published, l_suppkey, l_quantity AS q,
  CASE (l_orderkey + l_linenumber) % 9 WHEN 0 THEN p_name || ' live at Hall' WHEN 1 THEN p_name || ' podcast' WHEN 2 THEN 'warm up set for ' || p_name WHEN 3 THEN p_name || ' B | Boiler Room' WHEN 4 THEN p_name || ', A, B & C live' WHEN 5 THEN 'else entirely' WHEN 6 THEN 'Hall | ' || p_name || ' dj set' WHEN 7 THEN '[FULL SET] ' || p_name || ' b2b A' ELSE p_name || ' riding' END AS title,
  (l_orderkey + l_linenumber) % 9 AS f, CASE l_suppkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'Boiler Room' ELSE 'a fan' END AS channel, CASE WHEN l_linenumber < 5 THEN 'primary' ELSE 'fallback' END AS attempt, CASE WHEN l_quantity <= 45 THEN l_quantity > 10 END AS verified, CASE WHEN p_size = 7 THEN 'manual' ELSE 'A' END AS match_rule FROM lineitem JOIN part ON p_partkey = l_partkey),
u AS (SELECT DISTINCT ON (artist, video) * FROM c ORDER BY artist, video, published, l_suppkey, q),
w AS (SELECT *, min(video) FILTER (WHERE l_suppkey % 3 < 2 AND f NOT IN (2, 5)) OVER (PARTITION BY artist) AS chosen FROM u),
r AS (SELECT *, max(attempt) FILTER (WHERE video = chosen) OVER (PARTITION BY artist) AS owner, l_suppkey % 3 < 2 AND f NOT IN (2, 5) AS v1 FROM w),
s AS (SELECT *, v1 AND f <> 1 AND (l_suppkey % 3 = 1 OR f IN (0, 3, 4, 6, 7)) AS v2 FROM r),
t AS (SELECT *, unnest([1, 2, 3, 4]) AS version, unnest([v1, v2, v2 AND f <> 4 AND f <> 6 AND NOT (f = 3 AND l_suppkey % 3 = 1) AND NOT (f = 8 AND l_suppkey % 3 = 1), v1 AND f NOT IN (0, 6)]) AS ok FROM s),
g AS (SELECT artist, version, max(match_rule) AS rule, max(owner) AS owner, bool_or(ok) FILTER (WHERE video = chosen AND attempt = owner) AS mine, bool_or(ok AND video IS DISTINCT FROM chosen AND coalesce(verified, false) AND attempt = owner) AS other, bool_or(attempt = 'fallback') AS fallback FROM t GROUP BY ALL),
o AS (SELECT artist, version, CASE WHEN rule = 'manual' THEN 'manual_pin' WHEN mine IS NULL THEN 'not_replayable' WHEN mine THEN 'unchanged' WHEN coalesce(other, false) THEN 'other_candidate_available' WHEN owner = 'primary' AND NOT fallback THEN 'needs_fallback_query' ELSE 'would_abstain' END AS outcome FROM g),
b AS (SELECT *, lag(outcome) OVER (PARTITION BY artist ORDER BY version) AS prior FROM o)
SELECT version, outcome, count(*) AS artists, count(*) FILTER (WHERE prior = 'unchanged' AND outcome <> 'unchanged') AS lost, count(*) FILTER (WHERE prior <> 'unchanged' AND outcome = 'unchanged') AS gained FROM b GROUP BY ALL""")
def rule_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-16, CLS-17: videos found for each part, under four versions of the rules: what would change, and whose video is lost or gained."""
    name, form = F.col("p_name"), (F.col("l_orderkey") + F.col("l_linenumber")) % 9
    say = lambda *parts: F.concat(*[name if p is None else F.lit(p) for p in parts])
    title = F.when(form == 0, say(None, " live at Hall")).when(form == 1, say(None, " podcast")).when(form == 2, say("warm up set for ", None)).when(form == 3, say(None, " B | Boiler Room")).when(form == 4, say(None, ", A, B & C live")).when(form == 5, "else entirely").when(form == 6, say("Hall | ", None, " dj set")).when(form == 7, say("[FULL SET] ", None, " b2b A")).otherwise(say(None, " riding"))
    supp = F.col("l_suppkey") % 3
    # a video is chosen among the rows of one part and video before anything is told of it
    line = load(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("video"), "l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey", "l_quantity")
    first = Window.partitionBy("l_partkey", "video").orderBy("l_shipdate", "l_suppkey", "l_quantity")
    line = line.repartition("l_partkey").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    chosen = line.where((supp < 2) & ~form.isin(2, 5)).groupBy(F.col("l_partkey").alias("artist")).agg(F.min("video").alias("chosen"))
    c = line.join(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("artist"), name.alias("name"), "video", F.col("l_shipdate").alias("published"), title.alias("title"),
        F.when(supp == 0, name).when(supp == 1, "Boiler Room").otherwise("a fan").alias("channel"), F.when(F.col("l_linenumber") < 5, "primary").otherwise("fallback").alias("attempt"),
        F.when(F.col("l_quantity") <= 45, F.col("l_quantity") > 10).alias("verified"), F.when(F.col("p_size") == 7, "manual").otherwise("A").alias("match_rule"),
    )
    return evidence.replay_report(evidence.replayed(c.join(chosen, "artist", "left"), RULE_VERSIONS, alternatives=False))


# ------------------------------------------------------------------ headliners


@query("""
WITH l AS (SELECT l_orderkey AS k, 'Act ' || l_partkey AS name, min(l_linenumber) AS place, l_partkey AS part FROM lineitem GROUP BY l_orderkey, l_partkey),
a AS (SELECT k, list(name ORDER BY place, name) AS names, list(part ORDER BY place, name) AS parts FROM l GROUP BY k),
h AS (SELECT k, CASE WHEN len(names) = 1 OR k % 4 = 0 THEN names[1] WHEN k % 4 = 1 THEN names[2] WHEN k % 4 = 2 AND k % 3 = 0 AND parts[-1] >= 10 THEN names[-1] END AS artist, len(names) = 1 OR k % 4 < 2 AS strong FROM a)
SELECT k AS order_id, artist, CASE WHEN strong THEN 'documented' ELSE 'supported_prioritized' END AS confidence FROM h WHERE artist IS NOT NULL""")
def event_headliners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-18: who headlines each order, by its title, description, picture and the order of its acts. An order has few lines."""
    line = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("part")).agg(F.min("l_linenumber").alias("place"))
    line = line.withColumn("name", F.concat(F.lit("Act "), F.col("part").cast("string")))
    e = line.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("place", "name", "part"))).alias("a"))
    k, first, second, last = F.col("k"), F.get("a", F.lit(0))["name"], F.get("a", F.lit(1))["name"], F.element_at("a", -1)
    title = F.when(k % 4 == 0, F.concat(F.lit("A night with "), F.lower(first))).otherwise("Night")
    said = F.when(k % 4 == 1, F.concat(second, F.lit(" headlines, with "), first, F.lit(" warming up."))).when(k % 4 == 2, F.concat(F.lit("Tonight: "), last["name"], F.lit(" and more")))
    image = F.when(k % 3 == 0, F.concat(F.lit("https://x.dk/i/act-"), last["part"].cast("string"), F.lit(".jpg?w=1")))
    events = e.select(k.alias("event_id"), title.alias("title"), F.transform("a", lambda x: x["name"]).alias("artists"), said.alias("description"), image.alias("image"))
    return headliners.headliners(headliners.signals(events)).withColumnRenamed("event_id", "order_id")
