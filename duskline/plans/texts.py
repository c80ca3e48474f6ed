"""Dates, strings, URLs, arrays and text rules over the driver's tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text, time
from ..sources.tables import load
from .registry import listed, now, query


@query("""
SELECT event_id, strftime({local}, '%H:%M') AS time_label, upper(strftime({night}, '%a %d %b')) AS row_label, strftime({local}, '%Y-%m-%dT%H:%M') AS local_input,
  coalesce(date_diff('day', CAST({local} AS DATE), CAST(timezone('Europe/Copenhagen', timezone('UTC', "end")) AS DATE)), 0) AS span, "end" IS NULL OR "end" > start AS end_valid,
  isodow({night}) % 7 AS weekday, isoyear(CAST({local} AS DATE)) || '-W' || lpad(CAST(weekofyear(CAST({local} AS DATE)) AS VARCHAR), 2, '0') AS iso_week FROM {listed}""")
def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT-1, DT-4, DT-6 to DT-9, DT-11."""
    s, e = F.col("start"), F.col("end")
    return listed(spark, sf_dir).select("event_id", time.time_label(s).alias("time_label"), time.row_label(s).alias("row_label"), time.local_input(s).alias("local_input"), time.day_span(s, e).cast("long").alias("span"), time.end_is_valid(s, e).alias("end_valid"), time.weekday(time.night_key(s)).cast("long").alias("weekday"), time.iso_week(F.to_date(time.local(s))).alias("iso_week"))


@query("""
WITH a AS (SELECT event_id, CAST(floor(date_diff('millisecond', start, {now}) / 60000.0 + 0.5) AS BIGINT) AS m FROM {listed} WHERE start <= {now}), h AS (SELECT *, CAST(floor(m / 60.0 + 0.5) AS BIGINT) AS h FROM a)
SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN h < 24 THEN h || 'h ago' ELSE CAST(floor(h / 24.0 + 0.5) AS BIGINT) || 'd ago' END AS age FROM h""")
def age_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT-10."""
    return listed(spark, sf_dir).where(F.col("start") <= now()).select("event_id", time.age_label(F.col("start"), now()).alias("age"))


@query("""
SELECT event_id, concat_ws(',', CASE WHEN {night} < DATE '2024-01-10' THEN 'before-window' END, CASE WHEN CAST({local} AS DATE) = DATE '2024-01-10' AND date_part('hour', {local}) < 6 THEN 'early-first-night' END, CASE WHEN {night} = DATE '2024-01-20' AND CAST({local} AS DATE) > DATE '2024-01-20' THEN 'after-midnight-last-night' END) AS flags FROM {listed}""")
def edge_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT-14."""
    flags = time.edge_flags(F.col("start"), F.lit("2024-01-10").cast("date"), F.lit("2024-01-20").cast("date"))
    return listed(spark, sf_dir).select("event_id", F.array_join(flags, ",").alias("flags"))


@query("""SELECT s_suppkey, s_suppkey % 24 + 1 = 10 AS winter_due, s_suppkey % 24 + 2 = 10 AS summer_due, CASE s_suppkey % 4 WHEN 0 THEN (s_suppkey + 1) * 3600000 WHEN 1 THEN (s_suppkey + 1) * 60000 WHEN 2 THEN (s_suppkey + 1) * 86400000 END AS frequency FROM supplier""")
def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT-12, DT-13, STM-1."""
    k = F.col("s_suppkey")
    unit = F.when(k % 4 == 0, " hours").when(k % 4 == 1, "min").when(k % 4 == 2, " d").otherwise(" moons")
    hour = k % 24
    return load(spark, sf_dir, "supplier").select("s_suppkey", time.cron_is_due(hour, F.lit(1)).alias("winter_due"), time.cron_is_due(hour, F.lit(2)).alias("summer_due"), time.frequency_ms(F.concat(F.lit("Every "), (k + 1).cast("string"), unit)).alias("frequency"))


@query("""
WITH u AS (SELECT page_id, trim(url) AS t FROM pages),
p AS (SELECT page_id, t, regexp_replace(lower(regexp_extract(split_part(t, '#', 1), '^[a-zA-Z][a-zA-Z0-9_+.-]*://([^/?]+)', 1)), '^www\\.', '') AS host, regexp_replace(regexp_extract(split_part(t, '#', 1), '^[a-zA-Z][a-zA-Z0-9_+.-]*://[^/?]+([^?]*)', 1), '/+$', '') AS path, regexp_extract(split_part(t, '#', 1), '\\?(.*)$', 1) AS q, CASE WHEN instr(t, '#') > 0 THEN substr(t, instr(t, '#') + 1) ELSE '' END AS frag FROM u),
k AS (SELECT *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_') AND lower(split_part(x, '=', 1)) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'affiliate', 'igshid'))), '&') AS kept FROM p)
SELECT page_id, CASE WHEN host = '' THEN t ELSE 'https://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept = '' THEN '' ELSE '?' || kept END || CASE WHEN frag = '' THEN '' ELSE '#' || frag END END AS normal FROM k""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-5."""
    return load(spark, sf_dir, "pages").select("page_id", text.normal_url(F.col("url")).alias("normal"))


@query("""SELECT page_id, regexp_matches(url, '^https?://([^/?#]*\\.)?example\\.org([/?#]|$)') AS on_org, regexp_matches(url, '^https?://[^\\s/?#]+') AS valid FROM pages""")
def url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-14, STR-13: whose host a link is on."""
    return load(spark, sf_dir, "pages").select("page_id", text.is_host(F.col("url"), "example.org").alias("on_org"), text.valid_url(F.col("url")).alias("valid"))


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' & ' || p_brand), '&', 'and', 'g'), '[^a-z0-9]+', '-', 'g'), '-') AS slug, trim(regexp_replace(regexp_replace(lower(p_brand || ' (' || p_name || ')'), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS venue_key, lower(p_brand) AS artist_key FROM part""")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-1 to STR-4 on names that are ASCII, which decompose to themselves."""
    both = F.concat("p_brand", F.lit(" ("), "p_name", F.lit(")"))
    return load(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit(" & "), "p_brand")).alias("slug"), text.plain_name(both).alias("venue_key"), text.artist_key(both).alias("artist_key"))


@query("""SELECT doc_id, CASE WHEN length(t) > 400 THEN rtrim(substr(t, 1, 400)) || '…' ELSE t END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)""")
def shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-15."""
    return load(spark, sf_dir, "documents").select("doc_id", text.shortened(F.col("text")).alias("short"))


#: Rules with which documents of invented prose can be told apart.
DOCUMENT_RULES = [(f"{rules.B}ththe{rules.E}", "first"), (f"{rules.B}erth{rules.E}", "second"), (f"{rules.B}tion{rules.E}", "third"), (f"{rules.B}le{rules.E}", "fourth")]


@query("""
WITH t AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^a-z0-9_]', ' ', 'g') || ' ' AS t FROM documents)
SELECT doc_id, CASE WHEN contains(t, ' ththe ') THEN 'first' WHEN contains(t, ' erth ') THEN 'second' WHEN contains(t, ' tion ') THEN 'third' WHEN contains(t, ' le ') THEN 'fourth' END AS genre FROM t""")
def genre_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-1: the first of ordered word rules; words end at what is no ASCII word character."""
    return load(spark, sf_dir, "documents").select("doc_id", rules.first_genre(F.replace(F.col("text"), F.lit('"'), F.lit(" ")), DOCUMENT_RULES).alias("genre"))


@query("""
SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'tion', ''))) // 4 >= 2 AS rich FROM documents""")
def evidence_richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-5: at least two mentions."""
    return load(spark, sf_dir, "documents").select("doc_id", (F.regexp_count(F.lower("text"), F.lit("tion")) >= 2).alias("rich"))


@query("""SELECT page_id, len(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1)) AS links, array_to_string(regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1), ' ') AS targets FROM pages""")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-9: the links of a page, as listing connectors follow them."""
    return load(spark, sf_dir, "pages").select("page_id", text.anchors(F.col("html")).alias("a")).select("page_id", F.size("a").cast("long").alias("links"), F.array_join("a", " ").alias("targets"))


_SKIPPED = ["(?is)<script\\b.*?</script\\s*>", "(?is)<style\\b.*?</style\\s*>", "(?is)<head\\b.*?</head\\s*>", "(?s)<!--.*?-->"]
#: SQL: each step is a pattern and what it becomes; characters by number.
_STEPS = [
    *[(p, "''") for p in _SKIPPED],
    (r"(?i)</p\s*>|<p\b[^>]*>", "chr(10) || chr(10)"),
    (r"(?i)<br\s*/?>|</?(?:div|li|ul|ol|h[1-6]|tr|article|section|nav|header|footer)\b[^>]*>", "chr(10)"),
    (r"<[^>]*>", "''"),
]
_TIDY = [(r"[ \t]+", "' '"), (r" ?\n ?", "chr(10)"), (r"\n{{3,}}", "chr(10) || chr(10)"), (r"^\s+|\s+$", "''")]


def _plain_html(column: str) -> str:
    replaced = lambda steps, out: functools.reduce(lambda x, s: f"regexp_replace({x}, '{s[0]}', {s[1]}, 'g')", steps, out)
    out = replaced(_STEPS, column)
    for entity, character in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        out = f"replace({out}, '{entity}', {character})"
    return replaced(_TIDY, out)


@query(f"""
WITH t AS (SELECT page_id, {_plain_html("html")} AS t FROM pages),
h AS (SELECT page_id, t, substr(t, 1, 2000) AS head FROM t),
c AS (SELECT *, regexp_extract(head, '(?s)^(.*[.!?])(\\s|$)', 1) AS sentence, regexp_extract(head, '(?s)^(.*\\S)\\s', 1) AS word FROM h)
SELECT page_id, CAST(length(t) AS INTEGER) AS n, CASE WHEN length(t) <= 2000 THEN t WHEN length(sentence) >= 1000 THEN sentence WHEN word <> '' THEN word ELSE head END AS text FROM c""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-10, STR-11: the text of a page, in paragraphs, cut at a boundary."""
    return load(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("t")).select("page_id", F.length("t").alias("n"), text.at_boundary(F.col("t"), 2000).alias("text"))


_PRACTICAL_SQL = rules.PRACTICAL.removeprefix("(?iu)").replace(r"(?<![\p{L}\d])", r"(?:^|[^\p{L}\d])").replace(r"(?![\p{L}\d])", r"(?:$|[^\p{L}\d])")


@query(
    r"""
WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Billet 120 kr. Doors open at 22! Garderobe i kælderen.' WHEN 1 THEN 'Entré 100,-' || chr(10) || chr(10) || 'Kontakt: info@x.dk' || chr(10) || '22.00 - 05.00' WHEN 2 THEN 'Tickets at the door. ' || coalesce(text, '') WHEN 3 THEN 'Freedom is not free' ELSE text END AS t FROM documents),
s AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(trim(t), '([^\d\s][.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: regexp_matches(x, '\p{L}')) AS ss FROM d)
SELECT doc_id, len(list_filter(ss, lambda x: NOT regexp_matches(x, '(?i)""".replace("{", "{{").replace("}", "}}")
    + _PRACTICAL_SQL.replace("{", "{{").replace("}", "}}")
    + "'))) = 0 AS practical FROM s"
)
def practical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-10: texts of which every sentence is about tickets, doors and the like; whole documents among them."""
    k, body = F.col("doc_id") % 5, F.coalesce("text", F.lit(""))
    t = F.when(k == 0, "Billet 120 kr. Doors open at 22! Garderobe i kælderen.").when(k == 1, "Entré 100,-\n\nKontakt: info@x.dk\n22.00 - 05.00").when(k == 2, F.concat(F.lit("Tickets at the door. "), body)).when(k == 3, "Freedom is not free").otherwise(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", rules.practical_only(t).alias("practical"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-1."""
    return load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
