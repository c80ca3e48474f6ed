"""Order-dependent matching, and relevance in context, over the driver's tables. Their SQL walks the rows of a block one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import relevance
from ..operators import matching
from ..sources.tables import checkpointed, load
from .registry import listed, query

#: SQL of the events that are compared: title words, line-up and URLs follow from the row; its user is the venue.
_EVENTS = """
e AS (SELECT event_id, venue AS source, user_id AS venue, start, value, {night} AS night, CASE WHEN event_id % 10 < 2 THEN 'r' || event_id % 10 END AS room, list_distinct([venue, 'k' || event_id % 4, 'show']) AS w,
  CASE WHEN event_id % 6 = 0 THEN [] ELSE list_distinct(['a' || (user_id + event_id % 3), 'b' || user_id // 2]) END AS l, CASE WHEN event_id % 8 = 0 THEN 'https://x.dk/e/' || event_id // 16 WHEN event_id % 8 = 1 THEN 'https://x.dk/n/' || event_id // 24 || '#' || event_id % 3 END AS u FROM {listed})"""
#: SQL of the confidence that rows a and b of one night are one event.
_CONFIDENCE = """
CASE WHEN coalesce(contains(a.u, '#') AND contains(b.u, '#') AND split_part(a.u, '#', 1) = split_part(b.u, '#', 1) AND split_part(a.u, '#', 2) <> split_part(b.u, '#', 2), false) OR (a.venue = b.venue AND coalesce(a.room <> b.room, false)) THEN 'none'
  WHEN coalesce(a.u = b.u, false) THEN CASE WHEN conflict THEN 'medium' WHEN a.venue = b.venue THEN 'high' ELSE 'medium' END
  WHEN conflict THEN 'none' WHEN a.venue <> b.venue THEN CASE WHEN o >= 0.5 AND t >= 0.3 THEN 'medium' ELSE 'none' END
  WHEN o >= 0.5 AND t >= 0.4 THEN 'high' WHEN o > 0 OR t >= 0.25 THEN 'medium' ELSE 'none' END"""
_PAIRS = f"""
m AS (SELECT a, b, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS t, CASE WHEN len(a.l) = 0 OR len(b.l) = 0 THEN 0 ELSE len(list_intersect(a.l, b.l)) / least(len(a.l), len(b.l)) END AS o FROM e a JOIN e b ON a.night = b.night AND a.event_id < b.event_id),
c AS (SELECT a, b, t, o, len(a.l) > 0 AND len(b.l) > 0 AND o = 0 AND t < 0.6 AS conflict FROM m),
d AS (SELECT a.event_id AS x, b.event_id AS y, a.source AS xs, b.source AS ys, a.venue = b.venue AS one_venue, abs(date_diff('microsecond', a.start, b.start)) AS gap, {_CONFIDENCE} AS confidence FROM c)"""


def compared_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all events, with source, value and eligible. Events are as _EVENTS has them."""
    k, user = F.col("event_id"), F.col("user_id")
    e = listed(spark, sf_dir)
    title = F.concat_ws(" ", "venue", F.concat(F.lit("k"), (k % 4).cast("string")), F.lit("show"))
    lineup = F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("a"), (user + k % 3).cast("string")), F.concat(F.lit("b"), F.floor(user / 2).cast("string"))))
    url = F.when(k % 8 == 0, F.concat(F.lit("http://www.x.dk/e/"), F.floor(k / 16).cast("string"), F.lit("/?utm_source=a"))).when(k % 8 == 1, F.concat(F.lit("https://x.dk/n/"), F.floor(k / 24).cast("string"), F.lit("#"), (k % 3).cast("string")))
    room = F.when(k % 10 < 2, F.concat(F.lit("r"), (k % 10).cast("string")))
    return matching.features(e, "event_id", F.col("start"), user, room, title, lineup, F.array(url), F.col("venue").alias("source"), F.col("value"), (k % 7 != 0).alias("eligible"))


@query(f"""
WITH RECURSIVE {_EVENTS}, {_PAIRS},
f AS (SELECT * FROM d WHERE confidence <> 'none'),
s AS (SELECT CASE WHEN xs = 'error' THEN y ELSE x END AS id, CASE WHEN xs = 'error' THEN x ELSE y END AS other, 'stored' AS place, confidence FROM f WHERE (xs = 'error') <> (ys = 'error')),
n AS (SELECT night, event_id, row_number() OVER (PARTITION BY night ORDER BY event_id) AS k, event_id % 7 <> 0 AND NOT EXISTS (FROM s WHERE s.id = event_id) AS able, coalesce((SELECT list(x) FROM f WHERE y = event_id AND xs <> 'error'), []) AS rivals FROM e WHERE source <> 'error'),
r AS (SELECT DISTINCT night, 0::BIGINT AS k, []::BIGINT[] AS there FROM n
  UNION ALL SELECT r.night, n.k, CASE WHEN able AND NOT list_has_any(there, rivals) THEN list_append(there, event_id) ELSE there END FROM r JOIN n ON n.night = r.night AND n.k = r.k + 1),
p AS (SELECT unnest(there) AS id FROM (SELECT DISTINCT ON (night) there FROM r ORDER BY night, k DESC)),
b AS (FROM s UNION ALL SELECT y, x, 'batch', confidence FROM f JOIN p ON p.id = x WHERE ys <> 'error'),
best AS (SELECT DISTINCT ON (id) * FROM b ORDER BY id, CASE confidence WHEN 'high' THEN 0 ELSE 1 END, place DESC, other)
SELECT event_id, event_id IN (SELECT id FROM p) AS published, other AS duplicate_of, place AS duplicate_in, coalesce(confidence, 'none') AS duplicate_confidence FROM n LEFT JOIN best ON id = event_id""")
def batch_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-9, ER-1, ER-4: candidates against stored events (those of one source) and against what their own batch has published before them."""
    rows = compared_events(spark, sf_dir)
    return matching.visible_in_batch(rows.where("source <> 'error'"), rows.where("source = 'error'")).withColumnRenamed("id", "event_id")


@query(f"""
WITH RECURSIVE {_EVENTS}, {_PAIRS},
h AS (SELECT x, y FROM d WHERE confidence = 'high' AND one_venue AND xs <> ys AND gap <= 7200000000),
q AS (SELECT event_id, source, night, venue, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM e),
n AS (SELECT q.*, row_number() OVER (PARTITION BY night, venue ORDER BY rank) AS k, coalesce((SELECT list(CASE WHEN x = event_id THEN y ELSE x END) FROM h WHERE x = event_id OR y = event_id), []) AS same FROM q),
r AS (SELECT DISTINCT night, venue, 0::BIGINT AS k, []::STRUCT(p BIGINT, s VARCHAR[])[] AS groups, NULL::BIGINT AS id, NULL::BIGINT AS first FROM n
  UNION ALL
  SELECT night, venue, k, CASE WHEN place IS NULL THEN list_append(groups, {{{{'p': event_id, 's': [source]}}}}) ELSE list_transform(groups, lambda g, i: CASE WHEN i = place THEN {{{{'p': g.p, 's': list_append(g.s, source)}}}} ELSE g END) END, event_id, CASE WHEN place IS NULL THEN event_id ELSE groups[place].p END
  FROM (SELECT r.night, r.venue, n.k, groups, event_id, source, list_position(list_transform(groups, lambda g: list_contains(same, g.p) AND NOT list_contains(g.s, source)), true) AS place FROM r JOIN n ON n.night = r.night AND n.venue = r.venue AND n.k = r.k + 1))
SELECT id AS event_id, first AS group_id FROM r WHERE id IS NOT NULL""")
def source_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-3: listings of one event by several sources, in the order of their value: each joins the first group that it fits. The number of each row in that order is a count in range partitions."""
    from ..operators.joins import numbered

    rows = compared_events(spark, sf_dir)
    rows = checkpointed(numbered(rows, [F.desc("value"), F.col("id")], "rank"))
    groups = matching.first_fit_groups(matching.same_event_edges(rows))
    return rows.select("id").join(groups, "id", "left").select(F.col("id").alias("event_id"), F.coalesce("group", "id").alias("group_id"))


@query("""
WITH RECURSIVE l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i, l_returnflag AS room, l_quantity AS q FROM lineitem),
n AS (SELECT a.l_orderkey, a.i, coalesce((SELECT list(b.i ORDER BY b.i) FROM l b WHERE b.l_orderkey = a.l_orderkey AND b.i > a.i AND b.room <> a.room AND abs(b.q - a.q) <= 12), []) AS fits FROM l a),
r AS (SELECT DISTINCT l_orderkey, 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS j FROM n
  UNION ALL
  SELECT l_orderkey, i, CASE WHEN pick IS NULL THEN used ELSE list_concat(used, [i, pick]) END, pick
  FROM (SELECT r.l_orderkey, n.i, used, CASE WHEN NOT list_contains(used, n.i) THEN list_filter(fits, lambda f: NOT list_contains(used, f))[1] END AS pick FROM r JOIN n ON n.l_orderkey = r.l_orderkey AND n.i = r.i + 1))
SELECT l_orderkey, i AS survivor, j AS obsolete FROM r WHERE j IS NOT NULL""")
def room_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-13: rows of one order in different rooms, each in one pair at most, the earliest first. An order has few lines; they are numbered within it."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(order).cast("long").alias("i"), F.col("l_returnflag").alias("room"), F.col("l_quantity").alias("q"))
    li = checkpointed(li.withColumn("id", F.struct("l_orderkey", "i")))
    a, b = (li.select("l_orderkey", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "i", "room", "q")]) for s in "ab")
    edges = a.join(b, "l_orderkey").where("i_a < i_b AND room_a <> room_b AND abs(q_a - q_b) <= 12").select(F.col("id_a").alias("left"), F.col("id_b").alias("right"))
    return matching.exclusive_pairs(edges).select("left.l_orderkey", F.col("left.i").alias("survivor"), F.col("right.i").alias("obsolete"))


#: What is said of an event beside its document: a sentence for each case of the rules.
SAID = [
    "a night of grime and acid",
    "influenced by jazz, house all night",
    "Han har tidligere spillet punk i byen",
    "on stage with Daft Punk in Paris",
    "hiphop-event KØL er noget andet, techno er det her",
    "metalscenens mest unikke navne og techno",
    "drawing on jazz, folk, reggae and electronic music",
    "a jazz trio of trumpet, voice and electronics and house",
    "vernissage med techno",
    "EDM med R&B- og K-pop-inspirerede toplines",
    "en pop-up bar med techno",
    "elektronisk musik og popmusik",
    "Bingo Fuel live, house",
    "Punk! Rock. Ska og techno",
    "mørk electronica",
    "drum machines and electronics, hip hop",
    "a long house set, nothing else",
    "",
]
_NAMES = "Bingo Fuel"


def _sql_strings(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_kept(sources: list[str], more: str = "false") -> str:
    """SQL for how many of the patterns have a match in m that no rule drops."""
    ci = lambda p: "'(?i)" + p.replace(r"\z", "$").replace("'", "''") + "'"
    starts = "list_sum(list_transform(b[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda y: length(y))), 0)"
    dropped = f"regexp_matches(right(head, {relevance.NEAR}), {ci(relevance.COMPARISON)}) OR regexp_matches(regexp_extract(head, '[^.!?:\\n]*$'), {ci(relevance.PAST_CREDIT)}) OR (word[1] <> lower(word[1]) AND rtrim(head, E' \\t\\n\\r') <> '' AND NOT regexp_matches(rtrim(head, E' \\t\\n\\r'), '[.!?:]$')) OR regexp_matches(tail[1:{relevance.AHEAD}], '{relevance.OTHER_EVENT}') OR {more}"
    found = f"SELECT doc_id, p, f[i] AS word, m[1:place] AS head, m[place + length(f[i]) + 1:place + length(f[i]) + {relevance.FAR_AHEAD}] AS tail FROM (SELECT doc_id, p, m, f, i, CAST({starts} AS BIGINT) AS place FROM (SELECT doc_id, p, m, f, b, unnest(range(1, len(f) + 1)) AS i FROM (SELECT doc_id, p, m, regexp_extract_all(m, '(?i)' || p) AS f, string_split_regex(m, '(?i)' || p) AS b FROM (SELECT doc_id, m, unnest({_sql_strings(sources)}) AS p FROM t))))"
    return f"SELECT doc_id, count(DISTINCT p) AS n FROM ({found}) WHERE NOT ({dropped}) GROUP BY doc_id"


def _context_sql() -> str:
    ci = lambda p: "'(?i)" + p.replace("'", "''") + "'"
    near = relevance.NEAR
    around = f"right(m[1:place], {near}) || m[place + 1:place + length(f[i]) + {near}]"
    starts = "list_sum(list_transform(b[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda y: length(y))), 0)"
    pop_up = f"lower(word) = 'pop' AND lower(tail[1:3]) = '{relevance.NOT_POP}' OR regexp_matches(tail, {ci(relevance.INFLUENCE_AFTER)})"
    any_ = lambda sources: ci("|".join(f"(?:{p})" for p in sources))
    return f"""
WITH s AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN said || '. ' || coalesce(text, '') ELSE coalesce(text, '') || '. ' || said END AS x, said FROM (SELECT *, {_sql_strings(SAID)}[doc_id % {len(SAID)} + 1] AS said FROM documents)),
t AS (SELECT doc_id, x, regexp_replace(regexp_replace(x, '(?i){_NAMES}', ' ', 'g'), '(?i)' || regexp_escape(source), ' ', 'g') AS m FROM s),
fam AS ({_sql_kept(relevance.CONTRARY_GENRES)}),
cross_ AS ({_sql_kept(relevance.CROSSOVER_GENRES, pop_up)}),
ins AS (SELECT doc_id, bool_and(regexp_matches(regexp_replace({around}, {ci(relevance.DRUM_MACHINES)}, ' ', 'g'), {ci(relevance.INSTRUMENTS)})) AS only_ FROM (SELECT doc_id, m, f, i, CAST({starts} AS BIGINT) AS place FROM (SELECT doc_id, m, f, b, unnest(range(1, len(f) + 1)) AS i FROM (SELECT doc_id, m, regexp_extract_all(m, {ci(relevance.ELECTRONICS)}) AS f, string_split_regex(m, {ci(relevance.ELECTRONICS)}) AS b FROM t))) GROUP BY doc_id),
g AS (SELECT t.doc_id, coalesce(fam.n, 0) AS families, coalesce(cross_.n, 0) > 0 AS crossover, regexp_matches(m, {any_(relevance.CONTRARY_CATEGORIES)}) AS category, regexp_matches(m, {ci(relevance.CONTRARY_IDENTITY)}) AS identity, regexp_matches(x, {ci(relevance.ELECTRONIC_CLAIM)}) AS claim, coalesce(only_, false) AS instruments, CASE WHEN regexp_matches(x, '(?i)\\btechno\\b') THEN 'techno' WHEN regexp_matches(x, '(?i)\\bhouse\\b') THEN 'house' WHEN contains(lower(x), 'electroni') THEN 'electronic-other' END AS genre FROM t LEFT JOIN fam USING (doc_id) LEFT JOIN cross_ USING (doc_id) LEFT JOIN ins USING (doc_id)),
h AS (SELECT *, CASE WHEN genre <> 'electronic-other' THEN 1 ELSE 0 END + claim::INT AS strong FROM g)
SELECT doc_id, families, crossover, category AS contrary_category, identity AS contrary_identity, claim AS electronic_claim, instruments AS instruments_only,
  CASE WHEN families > 0 OR category THEN CASE WHEN strong = 0 OR (strong = 1 AND (identity OR families >= {relevance.BROAD_MIX} OR instruments)) THEN 'none' ELSE 'weak' END WHEN strong > 0 THEN 'strong' WHEN genre IS NOT NULL THEN 'weak' ELSE 'none' END AS relevance FROM h"""


@query(_context_sql().replace("{", "{{").replace("}", "}}"))
def relevance_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-7, CLS-8: contrary genres in their context, over whole documents with a sentence said of each, and the relevance that follows."""
    said = F.get(F.array(*map(F.lit, SAID)), (F.col("doc_id") % len(SAID)).cast("int"))
    body = F.coalesce("text", F.lit(""))
    x = F.when(F.col("doc_id") % 2 == 0, F.concat(said, F.lit(". "), body)).otherwise(F.concat(body, F.lit(". "), said))
    d = load(spark, sf_dir, "documents").select("doc_id", x.alias("x"), F.array(F.lit(_NAMES), F.col("source")).alias("names"))
    named = lambda p: F.col("x").rlike(r"(?i)(?<!\w)" + p + r"(?!\w)")
    genre: Column = F.when(named("techno"), "techno").when(named("house"), "house").when(F.lower("x").contains("electroni"), relevance.GENERIC_GENRE)
    out = relevance.with_signals(d, "x", "names")
    no = F.lit(False)
    return out.select("doc_id", F.col("families").cast("long").alias("families"), "crossover", "contrary_category", "contrary_identity", "electronic_claim", "instruments_only", relevance.assessed(genre, F.lit(True), no, no).alias("relevance"))
