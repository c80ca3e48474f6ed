"""Decision tables of the ingest pipeline as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genres, text, time

#: Thresholds of the duplicate and moved-event rules.
STRONG_ARTISTS, STRONG_TITLE, REVIEW_TITLE = 0.5, 0.4, 0.25
CROSS_ARTISTS, CROSS_TITLE, HEADLINER_TITLE = 0.5, 0.3, 0.6
MOVED_TITLE, MOVED_ARTISTS = 0.6, 0.8
RESCHEDULED = r"(?i)(?<![A-Za-z0-9_])(?:resched(?:uled|uling)|new date|date change(?:d)?|has (?:been )?moved|postponed|udskudt|flyttet|ny dato)(?![A-Za-z0-9_])"
#: Where a genre comes from, and how far it is trusted.
EVIDENCE = {"official-source-metadata": "high", "official-description": "high", "venue-promoter-metadata": "medium", "artist-lineup-metadata": "medium", "deterministic-mapping": "medium", "ai-assisted": "low", "manual-review": "low"}
RANK = {"high": 3, "medium": 2, "low": 1, "none": 0}


def confidence_rank(level: Column) -> Column:
    out = F.lit(0)
    for name, rank in RANK.items():
        out = F.when(level == name, rank).otherwise(out)
    return out


def assess_duplicate(*, same_night: Column, room_conflict: Column, sub_venue_conflict: Column, shared_url: Column, same_venue: Column, venue_unknown: Column, title: Column, artists: Column, both_lineups: Column) -> Column:
    """Confidence that two listings are one event: vetoes first, then a shared URL, then line-up and title."""
    conflict = both_lineups & (artists == 0) & (title < HEADLINER_TITLE)
    by_url = F.when(conflict, "medium").when(same_venue | venue_unknown, "high").otherwise("medium")
    elsewhere = F.when((artists >= CROSS_ARTISTS) & (title >= CROSS_TITLE), "medium").otherwise("none")
    here = F.when((artists >= STRONG_ARTISTS) & (title >= STRONG_TITLE), "high").when((artists > 0) | (title >= REVIEW_TITLE), "medium").otherwise("none")
    return F.when(~same_night | room_conflict | sub_venue_conflict, "none").when(shared_url, by_url).when(conflict, "none").when(~same_venue, elsewhere).otherwise(here)


def duplicate_action(confidence: Column) -> Column:
    return F.when(confidence == "high", "auto_merge_if_safe").when(confidence == "medium", "review_queue").otherwise("keep_separate")


def assess_moved(*, same_start: Column, venues_differ: Column, title: Column, artists: Column, shared_url: Column, wording: Column) -> Column:
    strong = (title >= MOVED_TITLE) | (artists >= MOVED_ARTISTS)
    return F.when(same_start | venues_differ | ~strong, "none").when(shared_url, "high").when(wording.rlike(RESCHEDULED), "medium").otherwise("none")


def best_match(pairs: DataFrame, key: str, confidence: str, order: str) -> DataFrame:
    """For each key the pair of highest confidence, the earliest in order among equals; none of confidence none."""
    rest = [c for c in pairs.columns if c != key]
    ranked = pairs.where(F.col(confidence) != "none")
    return ranked.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(-confidence_rank(F.col(confidence)), F.col(order))).alias("_m")).select(key, "_m.*")


def quality_gate(title: Column, date: Column, venue: Column, url: Column, relevant: Column, confidence: Column) -> Column:
    met = title & date & venue & url & relevant
    return F.when(~met, "hold").when(confidence == "high", "auto_publish").when(confidence == "medium", "review_queue").otherwise("hold")


def evidence_confidence(source: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in EVIDENCE.items() for x in pair]), source)


def match_kind(linked: Column, duplicate: Column, confidence: Column) -> Column:
    """struct<kind, event_id>: a linked event first, else a duplicate of high confidence; null without either."""
    as_kind = lambda kind, e: F.struct(F.lit(kind).alias("kind"), e.alias("event_id"))
    return F.when(linked.isNotNull(), as_kind("linked", linked)).when(duplicate.isNotNull() & (confidence == "high"), as_kind("high-confidence-duplicate", duplicate))


def sync_patch(joined: DataFrame, fields: list[str], locked: Column) -> Column:
    """map of field -> new value for the fields (columns old_*, new_*) that a sync changes and no lock protects. An unknown new value changes nothing."""
    held = genres.lock_group(locked)
    entry = lambda f: F.when(F.col(f"new_{f}").isNotNull() & ~F.col(f"new_{f}").eqNullSafe(F.col(f"old_{f}")) & ~F.array_contains(held, f), F.struct(F.lit(f).alias("key"), F.col(f"new_{f}").cast("string").alias("value")))
    return F.map_from_entries(F.array_compact(F.array(*[entry(f) for f in fields])))


def hold_back_start_flags(patch: Column, locked: Column) -> Column:
    """A patch without the flags that follow from the start, where the start itself is locked."""
    derived = lambda k, v: k.isin("dateChanged", "timeChanged") | ((k == "postponed") & (v == "false"))
    return F.when(F.array_contains(locked, "startDatetime"), F.map_filter(patch, lambda k, v: ~derived(k, v))).otherwise(patch)


def sync_action(published: Column, manual: Column, decision: Column, reason: Column) -> Column:
    return F.when(published & ~manual & (decision == "hold") & (reason == "negative_relevance"), "unpublish").otherwise("no_change")


def cancellation_action(published: Column, locked: Column, admin_reason: Column, cancelled_by: Column, hint: Column, source: Column, policy: Column) -> Column:
    """What a source's word on a cancellation does; only a trusted source's counts."""
    out = F.when(hint & published & ~F.array_contains(locked, "published"), "unpublish")
    out = out.when(~hint & ~published & admin_reason.isNull() & cancelled_by.eqNullSafe(source), "restore")
    return F.when(policy == "trusted", F.coalesce(out, F.lit("no_change"))).otherwise("no_change")


def is_current(last_seen: Column, last_complete: Column) -> Column:
    return F.coalesce(last_seen >= last_complete, F.lit(False))


def venue_block(current: Column, past: Column, decision: Column) -> Column:
    return F.when(~current, "stale").when(F.coalesce(past, F.lit(False)), "current_but_past").when(F.coalesce(decision.isin("auto_publish", "review_queue"), F.lit(False)), "active").otherwise("other_blockers")


def queue_category(source: Column, past: Column, block: Column, reason: Column, confidence: Column, positive: Column, negative: Column, manual: Column) -> Column:
    """One of five groups of the review queue."""
    past = F.coalesce(past, F.lit(False))
    thin = F.coalesce(reason.isin("incomplete_data", "low_confidence", "no_genre_evidence"), F.lit(False))
    ruled = F.coalesce(reason.isin("incomplete_data", "no_genre_evidence"), F.lit(False)) & negative
    out = F.when(source.isNull(), F.when(past, "past_stale").otherwise("needs_review"))
    out = out.when(block.isin("stale", "current_but_past"), "past_stale").when(block == "active", "venue_blocked")
    out = out.when(F.coalesce(reason.isin("negative_relevance", "source_cancelled"), F.lit(False)), "rejected")
    out = out.when(~manual & thin, F.when(positive, "needs_review").when(ruled, "rejected").otherwise("insufficient"))
    return out.when(~manual & reason.isNull() & (confidence == "low"), F.when(positive, "needs_review").otherwise("insufficient")).otherwise("needs_review")


def source_health(active: Column, adapter: Column, error: Column, last_ok: Column, found: Column, frequency: Column, now: Column) -> Column:
    stale = F.unix_millis(now) - F.unix_millis(last_ok) > 2 * time.frequency_ms(frequency)
    return F.when(~active, "inactive").when(adapter.isNull(), "discovery-only").when(error.isNotNull() | (last_ok.isNotNull() & (found == 0)), "degraded").when(F.coalesce(stale, F.lit(False)), "stale").otherwise("ok")


def signals(*entries: tuple[Column, str, int]) -> Column:
    """array<struct<key, points>> of the signals whose test holds."""
    return F.array_compact(F.array(*[F.when(test, F.struct(F.lit(key).alias("key"), F.lit(points).alias("points"))) for test, key, points in entries]))


def score_of(found: Column) -> Column:
    return F.aggregate(found, F.lit(0), lambda acc, s: acc + s["points"])


def review_tier(score: Column, qualifying: Column, category: Column, conflicting: Column) -> Column:
    return F.when((score >= 3) & qualifying, "likely").when(category & ~conflicting, "possible").otherwise("none")


def urgency(hours: Column) -> Column:
    return F.when(hours <= 72, 3).when(hours <= 168, 1).otherwise(0)


def quality_issues(start: Column, end: Column, club_night: Column, sync_starts: Column, start_with_url: Column, venue_changed: Column) -> Column:
    """Keys of what looks wrong with an event, in the order in which they are reported."""
    hours = (F.unix_micros(end) - F.unix_micros(start)) / 3_600_000_000
    ends = F.hour(time.local(end))
    early = (F.hour(time.local(start)) >= 20) & ((ends >= 20) | (ends < 1)) & (hours <= 5) & club_night
    about_end = F.when(end <= start, "end_not_after_start").when(hours > 36, "end_far_after_start").when(early, "early_end_for_evening_start")
    return F.array_compact(F.array(about_end, F.when(sync_starts >= 2, "date_flip_flop"), F.when(start_with_url, "date_changed_with_url"), F.when(venue_changed, "venue_changed_by_sync")))


def canonical_value(candidates: DataFrame, key: str, source_type: str, value: str, priority: list[str], order: str) -> DataFrame:
    """For each key the value from the source type named first in priority; ties go to the earliest in order."""
    rank = F.coalesce(F.array_position(genres.strings(priority), F.col(source_type)), F.lit(0))
    return candidates.groupBy(key).agg(F.min_by(value, F.struct(rank, F.col(order))).alias(value))


def override_decision(mode: Column, automatic: Column, manual: Column) -> Column:
    """An event's own choice beats the automatic one; hidden beats both."""
    return F.when(mode == "hide", F.lit(None)).when(mode == "manual", manual).otherwise(automatic)


def cached_lookup(names: DataFrame, cache: DataFrame, key: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): names whose cache row has not expired, with it, and the others' distinct keys."""
    live = cache.where(F.col("expires_at") > now)
    return names.join(live, key), names.select(key).distinct().join(live, key, "left_anti")


def expiry(found: Column, now: Column) -> Column:
    """90 days for what was found, 7 for what was not."""
    return now + F.when(found, F.expr("INTERVAL 90 DAYS")).otherwise(F.expr("INTERVAL 7 DAYS"))


def series_keys(title: Column, excluded: Column) -> Column:
    """Phrases of two words and more, or one of five letters and more, that a title's segments leave once excluded words are gone."""
    segments = F.split(F.lower(title), r"\s*(?::|//|\s[-–—|+×]\s|\sx\s|\sw/\s)\s*")
    content = F.transform(segments, lambda s: F.filter(F.regexp_extract_all(s, F.lit(r"[\p{L}0-9]+"), F.lit(0)), lambda w: ~F.array_contains(excluded, w) & ~w.rlike(r"\d")))
    kept = F.filter(content, lambda c: (F.size(c) >= 2) | ((F.size(c) == 1) & (F.length(F.get(c, F.lit(0))) >= 5)))
    return F.array_distinct(F.transform(kept, lambda c: F.array_join(c, " ")))


def series_strength(irrelevant: Column, published: Column, own: Column, same_venue: Column, shared_artist: Column) -> Column:
    weak = (published == 0) | ~own
    return F.when(irrelevant > 0, "against").when(weak, "unsupported").when(same_venue, "strong").when(shared_artist | (published >= 2), "supporting").otherwise("unsupported")


def headliners(signals_: DataFrame, event: str, artist: str, group: str, least: int = 2) -> DataFrame:
    """Artists of an event that at least so many independent groups of signals name."""
    votes = signals_.groupBy(event, artist).agg(F.countDistinct(group).alias("votes"))
    return votes.where(F.col("votes") >= least)


def recurring_guard(matches: DataFrame, titles: DataFrame, title_key: str) -> DataFrame:
    """matches with high lowered to medium where the title occurs twice or more in titles."""
    often = titles.groupBy(title_key).agg(F.count("*").alias("_n")).where("_n >= 2").select(title_key, F.lit(True).alias("_often"))
    return matches.join(often, title_key, "left").withColumn("confidence", F.when(F.col("_often") & (F.col("confidence") == "high"), "medium").otherwise(F.col("confidence"))).drop("_often")


def consolidated(survivor: str, other: str, scalars: list[str], arrays: list[str]) -> list[Column]:
    """Columns of a merged row: the survivor's values, the other's where it has none, arrays joined."""
    own = [F.coalesce(F.col(f"{survivor}.{c}"), F.col(f"{other}.{c}")).alias(c) for c in scalars]
    return own + [F.array_union(F.coalesce(F.col(f"{survivor}.{c}"), F.array().cast("array<string>")), F.coalesce(F.col(f"{other}.{c}"), F.array().cast("array<string>"))).alias(c) for c in arrays]
