"""Aggregations and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genres, text, time
from ..operators import joins, sketches
from ..sources.tables import checkpointed, load
from .reads import GENRE_OF, _tags, tags_of
from .registry import listed, query


@query("SELECT venue AS source_id, count(*) AS n FROM {listed} WHERE start < TIMESTAMP '2024-01-20 00:00:00' GROUP BY venue ORDER BY venue NULLS FIRST")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-2: counts per source in a window, the unknown first."""
    e = listed(spark, sf_dir).where(F.col("start") < F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return e.groupBy(F.col("venue").alias("source_id")).agg(F.count("*").alias("n")).orderBy(F.asc_nulls_first("source_id"))


@query("SELECT {night} AS night, count(*) AS n FROM {listed} GROUP BY 1")
def night_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT-1, DT-2, STM-6."""
    return listed(spark, sf_dir).groupBy(time.night_key(F.col("start")).alias("night")).agg(F.count("*").alias("n"))


@query("SELECT strftime({night}, '%Y-%m') AS month_key, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY start, event_id) AS ids FROM {listed} GROUP BY 1")
def month_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12, WIN-6: events by month of their night, in start order."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("start", "event_id"))), lambda x: x["event_id"].cast("string"))
    return listed(spark, sf_dir).groupBy(time.month_key(F.col("start")).alias("month_key")).agg(F.count("*").alias("n"), F.array_join(in_order, ",").alias("ids"))


@query("""
WITH e AS (SELECT *, CAST({local} AS DATE) AS d FROM {listed}), f AS (SELECT user_id, venue, min(start) AS first FROM {listed} GROUP BY ALL)
SELECT week, n, users, mean_value, new_pairs FROM (SELECT isoyear(d) || '-W' || lpad(CAST(weekofyear(d) AS VARCHAR), 2, '0') AS week, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value FROM e GROUP BY 1)
LEFT JOIN (SELECT isoyear(d) || '-W' || lpad(CAST(weekofyear(d) AS VARCHAR), 2, '0') AS w2, count(*) AS new_pairs FROM (SELECT CAST(timezone('Europe/Copenhagen', timezone('UTC', first)) AS DATE) AS d FROM f) GROUP BY 1) ON week = w2""")
def iso_week_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-9, DT-8, STM-6: weekly counts, means and first sightings, from one aggregate by (user, venue)."""
    e = listed(spark, sf_dir).withColumn("week", time.iso_week(F.to_date(time.local(F.col("start")))))
    weekly = e.groupBy("week").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean_value"))
    first = e.groupBy("user_id", "venue").agg(F.min("start").alias("first")).groupBy(time.iso_week(F.to_date(time.local(F.col("first")))).alias("week")).agg(F.count("*").alias("new_pairs"))
    return weekly.join(first, "week", "left")


@query("SELECT user_id, count(*) FILTER (WHERE venue = 'purchase') AS purchases, count(DISTINCT venue) FILTER (WHERE value > 10) AS venues FROM {listed} GROUP BY user_id HAVING bool_or(start > {now})")
def followable_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-3, AGG-4: filtered counts, distinct ones too, of keys that have any row to come."""
    from .registry import now

    g = listed(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("venue") == "purchase").alias("purchases"), F.countDistinct(F.when(F.col("value") > 10, F.col("venue"))).alias("venues"), F.bool_or(F.col("start") > now()).alias("_any"))
    return g.where("_any").drop("_any")


@query("""
WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]+)', 1)), '^(www|m|blog)\\.', '') AS host FROM pages)
SELECT host, count(*) AS n, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) AS ids FROM p GROUP BY host HAVING count(*) > 1 AND count(*) FILTER (WHERE page_id % 2 = 0) > 0""")
def dup_url_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-5, AGG-10: ordered members of the groups that have several."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", "://([^/?#]+)", 1)), r"^(www|m|blog)\.", "")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("page_id")), lambda x: x.cast("string")), ",")
    g = load(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("n"), ids.alias("ids"), F.count_if(F.col("page_id") % 2 == 0).alias("_even"))
    return g.where("n > 1 AND _even > 0").drop("_even")


@query("SELECT event_type, count(*) AS n, md5(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) AS fingerprint FROM events GROUP BY event_type")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-7: count and digest of the ordered ids, for change detection. It needs a group's ids in one row; fingerprint_sum is the form without that."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.md5(ids.cast("binary")).alias("fingerprint"))


@query("SELECT event_type, count(*) AS n, CAST(sum(('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT) AS BIGINT) AS digest FROM events GROUP BY event_type")
def fingerprint_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-7 for groups of any size: a sum of the ids' digests, which adds up on the map side."""
    digest = F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(digest).alias("digest"))


@query("SELECT CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM orders GROUP BY 1")
def count_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-8: counts by a derived key."""
    band = F.when(F.col("o_totalprice") < 100000, "low").when(F.col("o_totalprice") < 300000, "mid").otherwise("high")
    return load(spark, sf_dir, "orders").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("""
WITH o AS (SELECT o_orderkey, o_orderpriority, count(l_partkey) > 2 AS covered, max(l_returnflag = 'R') AS review, max(l_returnflag = 'A') AS high FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT o_orderpriority, count(*) AS n, CAST(sum(CASE WHEN covered THEN 1 ELSE 0 END) AS BIGINT) AS with_lineup, CAST(sum(CASE WHEN high THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN review THEN 1 ELSE 0 END) AS BIGINT) AS review FROM o GROUP BY o_orderpriority""")
def lineup_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11: conditional sums per source of flags per event."""
    line = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("c"), F.bool_or(F.col("l_returnflag") == "R").alias("review"), F.bool_or(F.col("l_returnflag") == "A").alias("high"))
    o = load(spark, sf_dir, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("c") > 2).alias("with_lineup"), F.count_if("high").alias("high"), F.count_if("review").alias("review"))


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS status FROM orders GROUP BY o_custkey")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13: the one value that all rows share, else null."""
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.when(F.min("o_orderstatus") == F.max("o_orderstatus"), F.min("o_orderstatus")).alias("status"))


@query("SELECT word, count(*) AS parts, string_agg(CASE WHEN rn <= 20 THEN CAST(p_partkey AS VARCHAR) END, ',' ORDER BY p_partkey) AS ids FROM (SELECT p_partkey, word, row_number() OVER (PARTITION BY word ORDER BY p_partkey) AS rn FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)) GROUP BY word")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14: phrase words with how many rows have them, and the first twenty of each (a head, so that no word gathers all its rows)."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    counts = p.groupBy("word").agg(F.count("*").alias("parts"))
    # a first row_number within salted parts keeps twenty of each, so that the second sees few
    salted = joins.top_per_key(p.withColumn("salt", F.spark_partition_id()), ["word", "salt"], [F.col("p_partkey")], 20).drop("salt")
    heads = joins.top_per_key(salted, ["word"], [F.col("p_partkey")], 20)
    ids = heads.groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",").alias("ids"))
    return counts.join(ids, "word")


@query("SELECT event_type, CASE WHEN count(*) FILTER (WHERE value > 200) = 0 THEN 'ok' ELSE count(*) FILTER (WHERE value > 200) || '/' || count(*) || ' failed: ' || string_agg(CASE WHEN value > 200 THEN 'event ' || event_id END, '; ' ORDER BY event_id) END AS summary FROM events GROUP BY event_type")
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15: n of m failures with their messages."""
    bad = F.col("value") > 200
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(bad, F.col("event_id")))), lambda x: F.concat(F.lit("event "), x.cast("string"))), "; ")
    g = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(bad).alias("k"), F.count("*").alias("n"), said.alias("said"))
    return g.select("event_type", F.when(F.col("k") == 0, "ok").otherwise(F.concat(F.col("k").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" failed: "), F.col("said"))).alias("summary"))


@query("SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, l_suppkey, l_returnflag, l_linestatus LIMIT 15")
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17: the largest groups of several keys."""
    g = load(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "l_suppkey", "l_returnflag", "l_linestatus").limit(15)


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18, SET-1."""
    one = lambda n: load(spark, sf_dir, n).agg(F.lit(n).alias("name"), F.count("*").alias("n"))
    return one("orders").unionByName(one("customer")).unionByName(one("part"))


@query("SELECT source, lang, count(*) AS performers, count(DISTINCT text) AS spellings, count(*) - count(DISTINCT text) AS repeats FROM documents GROUP BY ALL")
def evidence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19: counts and conflicts per source and key; texts are compared by digest, so that they aren't shuffled."""
    d = load(spark, sf_dir, "documents").select("source", "lang", F.sha2("text", 256).alias("sha"))
    return d.groupBy("source", "lang").agg(F.count("*").alias("performers"), F.countDistinct("sha").alias("spellings")).withColumn("repeats", F.col("performers") - F.col("spellings"))


@query("SELECT '/' || lower(n_name) AS path FROM nation UNION ALL SELECT '/customer/' || c_custkey FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT unnest(['/', '/about'])")
def route_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-1, SET-2, SNK-12: static and table-made routes together."""
    fixed = spark.createDataFrame([("/",), ("/about",)], "path string")
    n = load(spark, sf_dir, "nation").select(F.concat(F.lit("/"), F.lower("n_name")).alias("path"))
    c = load(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.concat(F.lit("/customer/"), F.col("c_custkey").cast("string")).alias("path"))
    return n.unionByName(c).unionByName(fixed)


_text_words = "list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 1)))"


def text_words(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """doc_id, source, lang and the sorted set of words of a document's whole text, of all documents or those of ids (doc_id); it may be empty.

    Filters on w belong after an aggregation or a checkpoint: before one, Spark would work the words out a second time for them.
    """
    d = load(spark, sf_dir, "documents")
    d = d if ids is None else d.join(ids, "doc_id", "left_semi")
    d = d.select("doc_id", "source", "lang", F.lower("text").alias("line"))
    plain = F.regexp_replace("line", r"[^a-z0-9 \t\n\f\r]+", "")
    for space in "\t\n\f\r":
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    return d.select("doc_id", "source", "lang", F.sort_array(F.array_distinct(F.filter(F.split(plain, " "), lambda x: F.length(x) > 1))).alias("w"))


@query(f"""
WITH t AS (SELECT doc_id, source, lang, {_text_words} AS w FROM documents)
SELECT min(doc_id) AS class_id, count(*) AS members, any_value(source) AS source, any_value(lang) AS lang FROM t WHERE len(w) > 0 GROUP BY source, lang, w""")
def token_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-3: documents of one source and language whose texts have the same words, as one class named by its smallest id. Sets are grouped by digest, so that they aren't shuffled."""
    g = text_words(spark, sf_dir).groupBy("source", "lang", F.sha2(F.array_join("w", " "), 256).alias("key")).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members"), F.max(F.size("w")).alias("n")).where("n > 0")
    return g.select("class_id", "members", "source", "lang")


#: From which Jaccard similarity on word sets are put out as a pair.
SIMILAR = 0.8


_SPACED = bytes.maketrans(b"\t\n\f\r", b"    ")
_NO_WORDS = bytes(x for x in range(256) if x not in b"abcdefghijklmnopqrstuvwxyz0123456789 \t\n\f\r")


def ascii_words(line: bytes) -> set[bytes]:
    """The set of words that text_words finds in a lower-cased text."""
    return {x for x in line.translate(_SPACED, _NO_WORDS).split() if len(x) > 1}


@query(f"""
WITH t AS (SELECT doc_id, source, lang, {_text_words} AS w FROM documents), c AS (SELECT min(doc_id) AS id, source, lang, w FROM t WHERE len(w) > 0 GROUP BY source, lang, w),
p AS (SELECT a.id AS a_class, b.id AS b_class, len(list_intersect(a.w, b.w)) AS k, len(a.w) AS na, len(b.w) AS nb FROM c a JOIN c b ON a.source = b.source AND a.lang = b.lang AND a.id < b.id AND len(a.w) >= {SIMILAR} * len(b.w) AND len(b.w) >= {SIMILAR} * len(a.w))
SELECT a_class, b_class, round(k / (na + nb - k), 6) AS jaccard, round(k / least(na, nb), 6) AS overlap FROM p WHERE k / (na + nb - k) >= {SIMILAR}""")
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-3, STR-6: similar word sets of whole texts within a source and language, as pairs of token_classes.

    Texts of the same words are one class, so copies make no pairs. No words are
    shuffled: sketches of the sets meet (operators.sketches), and only pairs whose
    sketches allow the similarity get their sets, from the texts again.
    """
    d = load(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    w = d.select("doc_id", "source", "lang", sketches.digested(F.lower("text"), ascii_words, SIMILAR).alias("d")).select("doc_id", "source", "lang", "d.*")
    one = w.where("key IS NOT NULL").groupBy("source", "lang", "key").agg(F.min("doc_id").alias("id"), F.first("sketches").alias("sketches"))
    one = one.where("id IS NOT NULL").withColumn("key", F.xxhash64("key"))
    met = checkpointed(sketches.meeting(one, ["source", "lang"], SIMILAR))
    # texts are read again, and those of pairs only are split; an id may be repeated over other texts
    wanted = checkpointed(met.select(F.explode(F.array(F.struct(F.col("a_id").alias("id"), F.col("a_key").alias("key")), F.struct(F.col("b_id").alias("id"), F.col("b_key").alias("key")))).alias("e")).select("e.*").distinct())
    line = F.when(F.spark_partition_id() >= 0, F.array_join("w", " "))
    found = text_words(spark, sf_dir, wanted.select(F.col("id").alias("doc_id")).distinct()).select(F.col("doc_id").alias("id"), line.alias("line"))
    found = found.withColumn("key", F.xxhash64(F.sha2("line", 256))).join(wanted, ["id", "key"], "left_semi")
    sets = checkpointed(found.groupBy("id", "key").agg(F.first("line").alias("line")))
    k, both, least = F.col("shared"), F.col("a_n") + F.col("b_n"), F.least("a_n", "b_n")
    out = sketches.shared(met, sets).select(F.col("a_id").alias("a_class"), F.col("b_id").alias("b_class"), (k / (both - k)).alias("j"), (k / least).alias("o"))
    return out.where(F.col("j") >= SIMILAR).select("a_class", "b_class", F.round("j", 6).alias("jaccard"), F.round("o", 6).alias("overlap"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS q FROM lineitem WHERE l_orderkey % 3 <> 1), o AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity + 1 ELSE l_quantity END AS q FROM lineitem WHERE l_orderkey % 3 <> 2),
ss AS (SELECT l_orderkey, l_linenumber, min(q) AS q FROM s GROUP BY ALL), oo AS (SELECT l_orderkey, l_linenumber, min(q) AS q FROM o GROUP BY ALL)
SELECT l_orderkey, l_linenumber, CASE WHEN ss.q IS NULL THEN 'insert' WHEN oo.q IS NULL THEN CASE WHEN l_orderkey % 4 = 0 THEN 'delete' ELSE 'suppressed-delete' END WHEN ss.q = oo.q THEN 'keep' ELSE 'update' END AS action, coalesce(oo.q, ss.q) AS q FROM ss FULL JOIN oo USING (l_orderkey, l_linenumber)""")
def set_diff_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-4: stored against observed rows; deletes only where the run was complete."""
    line = load(spark, sf_dir, "lineitem")
    q = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    keys = ["l_orderkey", "l_linenumber"]
    stored = line.where("l_orderkey % 3 <> 1").groupBy(*keys).agg(F.min("l_quantity").alias("q"))
    observed = line.where("l_orderkey % 3 <> 2").groupBy(*keys).agg(F.min(q).alias("q"))
    return joins.set_plan(stored, observed, keys, "q", F.col("l_orderkey") % 4 == 0)


@query("SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-5."""
    return load(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct()


@query("""
WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ['title'] ELSE ['primaryGenre', 'title'] END AS locked, CASE WHEN o_orderkey % 3 = 0 THEN ['venueId'] ELSE ['title'] END AS edited FROM orders)
SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_concat(locked, edited, CASE WHEN list_contains(list_concat(locked, edited), 'primaryGenre') THEN ['primaryGenre', 'subgenres'] ELSE CAST([] AS VARCHAR[]) END))), ',') AS locks, array_to_string(list_filter(edited, lambda x: NOT list_contains(locked, x)), ',') AS added FROM f""")
def lock_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-6: locked fields with those edited now, either genre field locking both."""
    locked = F.when(F.col("o_orderkey") % 2 == 0, genres.strings(["title"])).otherwise(genres.strings(["primaryGenre", "title"]))
    edited = F.when(F.col("o_orderkey") % 3 == 0, genres.strings(["venueId"])).otherwise(genres.strings(["title"]))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_sort(genres.lock_group(F.array_union(locked, edited))), ",").alias("locks"), F.array_join(F.array_except(edited, locked), ",").alias("added"))


@query("""
WITH l AS (SELECT l_orderkey, lower(trim(p_name)) AS key, p_name, l_linenumber, p_partkey, row_number() OVER (PARTITION BY l_orderkey, lower(trim(p_name)) ORDER BY l_linenumber, p_partkey) AS rn FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, string_agg(p_name, '|' ORDER BY l_linenumber, p_partkey) AS names FROM l WHERE rn = 1 GROUP BY l_orderkey""")
def first_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-7: the first spelling of each name of a line-up, in order."""
    pos = F.struct("l_linenumber", "p_partkey")
    n = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey", F.lower(F.trim("p_name")).alias("key")).agg(F.min(pos).alias("pos"), F.min_by("p_name", pos).alias("name"))
    return n.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), "|").alias("names"))


_parents = "MAP {" + ", ".join(f"'{s}': '{p}'" for s, (_, p) in genres.TAXONOMY.items() if p) + "}"


@query(f"""
WITH t AS (SELECT event_id, {_tags} AS tags FROM events)
SELECT event_id, array_to_string(list_distinct_ordered, ',') AS expanded, tags[1] AS primary_genre, len(tags) > 2 AS too_many FROM (SELECT event_id, tags, list_filter(flatten(list_transform(tags, lambda t: [t, {_parents}[t]])), lambda x, i: x IS NOT NULL AND list_position(flatten(list_transform(tags, lambda t: [t, {_parents}[t]])), x) = i) AS list_distinct_ordered FROM t)""".replace("{", "{{").replace("}", "}}"))
def tag_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-1, ARR-2, ARR-3: tags with their parents, the first as primary."""
    t = load(spark, sf_dir, "events").select("event_id", tags_of(F.col("event_type")).alias("tags"))
    return t.select("event_id", F.array_join(genres.with_parents(F.col("tags")), ",").alias("expanded"), genres.primary_of(F.col("tags")).alias("primary_genre"), F.array_contains(genres.tag_problems(F.col("tags")), "too-many").alias("too_many"))


assert set(GENRE_OF) == {"click", "view", "purchase", "error", "signup"}
