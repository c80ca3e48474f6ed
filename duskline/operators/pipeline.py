"""The ingest pipeline: candidates, cleaned, placed, classified, compared and decided, as one chain of transforms.

Inputs are DataFrames; nothing is looked up row by row. stored holds published
events, registry the venue keys, cache the artists' known genres.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genres, relevance, rules, spans, text, time
from ..sources.tables import checkpointed
from . import decisions, joins, matching

#: Styles of a release catalogue and the genre each stands for.
STYLES = {"Techno": "techno", "Hard Techno": "hard-techno", "Minimal": "minimal-techno", "House": "house", "Deep House": "deep-house", "Tech House": "tech-house", "Progressive House": "progressive-house", "Disco": "disco", "Trance": "trance", "Psy-Trance": "psytrance", "Drum n Bass": "drum-and-bass", "Jungle": "jungle", "Breakbeat": "breakbeat", "UK Garage": "garage", "Dubstep": "dubstep", "Hardstyle": "hardstyle", "Hardcore": "hardcore", "Electro": "electro", "Industrial": "industrial", "Ambient": "ambient", "Experimental": "experimental"}


def cleaned(raw: DataFrame) -> DataFrame:
    """title, description and line-up in the form in which they are stored."""
    return raw.withColumns({"title": F.substring(text.squeezed(F.col("title")), 1, 200), "description": text.at_boundary(F.col("description"), 20_000), "lineup": text.first_spellings(F.coalesce("lineup", F.array().cast("array<string>")))})


def placed(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """With venue_id and sub_venue by name, alias or room."""
    return joins.resolve_by_key(rows.withColumn("_venue_key", text.plain_name(F.col("venue"))), registry, "_venue_key").drop("_venue_key")


def refined(genre: Column, words: Column) -> Column:
    """A broad genre as the more specific one of its family that the words name."""
    inner = rules.first_genre(words, [(p, g) for p, g in rules.GENRE_PATTERNS if genres.TAXONOMY[g][1]])
    return F.when(genres.parent_of(inner) == genre, inner).otherwise(genre)


def classified(rows: DataFrame) -> DataFrame:
    """With genre and genre_confidence: the source's own word, then title and line-up, then description."""
    title = rules.first_genre(F.concat_ws(" ", "title", F.array_join("lineup", " ")))
    body = rules.first_genre(F.coalesce("description", F.lit("")))
    own = F.when(F.col("genre_hint").isin(*genres.TAXONOMY), F.col("genre_hint"))
    out = rows.withColumn("_title_genre", title).withColumn("_body_genre", body).withColumn("_own", own)
    genre = F.coalesce("_own", "_title_genre", "_body_genre")
    evidence = F.when(F.col("_own").isNotNull(), "official-source-metadata").when(F.col("_title_genre").isNotNull(), "official-description").when(F.col("_body_genre").isNotNull(), "deterministic-mapping")
    words = F.concat_ws(" ", "title", "description")
    return out.withColumns({"genre": refined(genre, words), "genre_confidence": F.coalesce(decisions.evidence_confidence(evidence), F.lit("low"))}).drop("_title_genre", "_body_genre", "_own")


def secondary_genre(mentions: Column, primary: Column) -> Column:
    """The second of exactly two genres that a text names, if the other is of the primary's family."""
    found = F.array_distinct(F.transform(mentions, lambda m: m["name"]))
    family = lambda g: F.coalesce(genres.parent_of(g), g)
    other = F.get(F.filter(found, lambda g: family(g) != family(primary)), F.lit(0))
    anchored = F.exists(found, lambda g: family(g) == family(primary))
    return F.when((F.size(found) == 2) & anchored, other)


def compared(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """With published, duplicate_of, duplicate_in (stored or batch) and duplicate_confidence: each candidate against stored events and those of the batch published before it, in the order of candidate_id."""
    room = lambda df: F.col("sub_venue") if "sub_venue" in df.columns else F.lit(None).cast("string")
    made = lambda df, key: matching.features(df, key, F.col("start"), F.col("venue_id"), room(df), F.col("title"), F.col("lineup"), F.array("url"))
    able = rows.select(F.col("candidate_id").alias("id"), (F.col("decision") == "auto_publish").alias("eligible"))
    own = checkpointed(made(rows, "candidate_id").join(able, "id"))
    found = matching.visible_in_batch(own, made(stored, "event_id"))
    return rows.join(found.withColumnRenamed("id", "candidate_id"), "candidate_id")


def decided(rows: DataFrame) -> DataFrame:
    """With relevance, decision and hold_reason, from what the text says in its context."""
    words = F.concat_ws(". ", "title", "description")
    out = relevance.with_signals(rows.withColumn("_words", words), "_words", "lineup")
    no = F.lit(False)
    out = out.withColumn("relevance", relevance.assessed(F.col("genre"), F.lit(True), no, no))
    here = lambda c: F.col(c).isNotNull()
    out = out.withColumn("decision", decisions.quality_gate(F.coalesce(F.col("title") != "", F.lit(False)), here("start"), here("venue_id"), here("url"), F.col("relevance") != "none", F.col("genre_confidence")))
    reason = F.when(F.col("contrary") & (F.col("relevance") == "none"), "negative_relevance").when(~(here("start") & here("venue_id") & here("url")), "incomplete_data").when(F.col("genre").isNull(), "no_genre_evidence").otherwise("low_confidence")
    return out.withColumn("hold_reason", F.when(F.col("decision") == "hold", reason)).drop("_words", *relevance.SIGNALS)


def ingest_pipeline(raw: DataFrame, registry: DataFrame, stored: DataFrame) -> DataFrame:
    """raw: candidate_id (the order of the batch), title, venue, start, url, lineup, description, genre_hint. stored: event_id, title, venue_id, start, url, lineup and, if known, sub_venue."""
    return raw.transform(cleaned).transform(placed, registry).transform(classified).transform(decided).transform(compared, stored)


def enriched(rows: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Decisions again with the line-up's cached genre, where the row has none of its own: one genre that all known artists share, never of high confidence."""
    names = rows.where("genre IS NULL").select("candidate_id", F.explode("lineup").alias("name")).withColumn("key", text.cache_key(F.col("name")))
    known = names.join(cache.where(F.col("expires_at") > now).where("genre IS NOT NULL").select("key", F.col("genre").alias("_g")), "key")
    one = known.groupBy("candidate_id").agg(F.when(F.min("_g") == F.max("_g"), F.min("_g")).alias("_artist_genre"))
    out = rows.join(one, "candidate_id", "left")
    out = out.withColumn("genre_confidence", F.when(F.col("genre").isNull() & F.col("_artist_genre").isNotNull(), "medium").otherwise(F.col("genre_confidence")))
    return out.withColumn("genre", F.coalesce("genre", "_artist_genre")).drop("_artist_genre", "relevance", "decision", "hold_reason").transform(decided)


def style_genre(releases: DataFrame, key: str) -> DataFrame:
    """The one genre that all mapped styles of an artist's releases stand for, else null."""
    mapping = F.create_map(*[F.lit(x) for pair in STYLES.items() for x in pair])
    g = releases.select(key, F.explode("styles").alias("s")).withColumn("g", F.try_element_at(mapping, F.col("s")))
    return g.groupBy(key).agg(F.when(F.min("g") == F.max("g"), F.min("g")).alias("genre"))


def queue_patch(joined: DataFrame) -> DataFrame:
    """What a new classification changes in pending queue rows: title, venue and start unless locked; the genre only if its source speaks for itself or none was set."""
    authoritative = (F.col("new_genre_confidence") == "high") | F.col("old_genre").isNull()
    genre = F.when(authoritative, F.col("new_genre")).otherwise(F.col("old_genre"))
    j = joined.where("status = 'pending'").withColumn("new_genre", genre)
    return j.withColumn("patch", decisions.sync_patch(j, ["title", "venue_id", "start", "genre"], F.col("locked")))


def merged_urls(urls: Column, other: Column) -> Column:
    return F.array_union(F.coalesce(urls, F.array().cast("array<string>")), F.array_compact(F.array(other)))


def external_links(official: Column, ticket: Column, listing: Column, others: Column) -> Column:
    """array<struct<role, url>>: each normal URL once, the first role winning."""
    entry = lambda role, u: F.struct(F.lit(role).alias("role"), u.alias("url"))
    every = F.concat(F.array(entry("official", official), entry("ticket", ticket), entry("listing", listing)), F.transform(F.coalesce(others, F.array().cast("array<string>")), lambda u: entry("other", u)))
    known = F.transform(F.filter(every, lambda x: x["url"].isNotNull()), lambda x: F.struct(x.alias("link"), text.normal_url(x["url"]).alias("normal")))
    first = lambda v: F.filter(v, lambda x, i: F.array_position(v["normal"], x["normal"]) == i + 1)
    return spans.let(known, first)["link"]


def display_title(title: Column, venue: Column) -> Column:
    """A title without its venue's name before a colon or bar."""
    rest = F.regexp_extract(title, r"^[^:|–-]+\s*[:|–-]\s*(.+)$", 1)
    head = F.trim(F.regexp_extract(title, r"^([^:|–-]+)\s*[:|–-]\s*.+$", 1))
    return F.when((rest != "") & (F.lower(head) == F.lower(venue)), rest).otherwise(title)


def link_plan(events: DataFrame, shown: DataFrame, most: int) -> DataFrame:
    """The artists to look up next: those of coming events without a link, by their first event, most at most."""
    names = events.select("event_id", "start", F.posexplode("lineup").alias("pos", "name")).withColumn("key", text.cache_key(F.col("name")))
    open_ = names.join(shown.select("key").distinct(), "key", "left_anti")
    first = open_.groupBy("key").agg(F.min(F.struct("start", "event_id", "pos", "name")).alias("f"))
    return first.orderBy("f.start", "f.event_id", "f.pos").limit(most).select("key", "f.name")


def name_report(names: DataFrame, cache: DataFrame) -> DataFrame:
    """Names with how many events bear them and what the cache knows: status, rule, manual choice; counts are joined after they are summed."""
    n = names.groupBy("key").agg(F.count("*").alias("events"), F.min("name").alias("name"))
    out = n.join(cache.select("key", "status", "match_rule", "manual"), "key", "left")
    return out.withColumn("status", F.when(F.col("manual"), "manual").otherwise(F.coalesce("status", F.lit("not_looked_up"))))


def alert_run(deliveries: DataFrame, sent: DataFrame, now: Column, lead: str = "2 HOURS", age: str = "3 DAYS", per_day: int = 1, per_email: int = 10) -> DataFrame:
    """What each pending delivery (subscriber_id, event_id, start, created_at, public, alertable) becomes: send, drop or wait."""
    from pyspark.sql import Window

    soon = F.col("start") - F.expr(f"INTERVAL {lead}") < now
    old = F.col("created_at") + F.expr(f"INTERVAL {age}") < now
    recent = sent.where(F.col("sent_at") > now - F.expr("INTERVAL 24 HOURS")).groupBy("subscriber_id").agg(F.count("*").alias("_sent"))
    d = deliveries.withColumn("_drop", ~F.col("public") | ~F.col("alertable") | soon | old).join(recent, "subscriber_id", "left")
    rank = F.row_number().over(Window.partitionBy("subscriber_id", "_drop").orderBy("start", "event_id"))
    ok = (F.coalesce("_sent", F.lit(0)) < per_day) & time.sending_hour(now) & (rank <= per_email)
    return d.withColumn("plan", F.when(F.col("_drop"), "drop").when(ok, "send").otherwise("wait")).drop("_drop", "_sent")
