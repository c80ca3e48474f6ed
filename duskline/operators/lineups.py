"""What is shown beside a line-up, and what becomes of the venues that sources name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import joins

#: Rooms and corners of venues, which are no venues of their own.
SUB_VENUES = ["byhaven", "black box", "red box", "den anden ende"]


def reused_links(rows: DataFrame, key: str = "event_id") -> DataFrame:
    """key, name, url of entries whose artist has exactly one profile over all its other appearances. rows: key, entry, other_entry, url; an entry of several performers is shown no one's."""
    alone = lambda c: F.size(text.split_lineup(F.col(c))) == 1
    one = rows.where(alone("entry") & alone("other_entry")).groupBy(key, F.col("entry").alias("name")).agg(F.min("url").alias("url"), F.max("url").alias("_most"))
    return one.where("url = _most").drop("_most")


def shown_links(events: DataFrame, own: DataFrame, reused: DataFrame, key: str = "event_id", artists: str = "artists") -> DataFrame:
    """key, place, name, url of the links that an event shows: of names in its line-up as it is now, each once, at its first place; its own link before a reused one, and of its own one set by hand before others, then the last.

    own: key, name, url, manual, ord. reused: key, name, url.
    """
    names = events.select(key, F.posexplode(artists).alias("place", "name")).groupBy(key, "name").agg(F.min("place").alias("place"))
    mine = own.groupBy(key, "name").agg(F.max_by("url", F.struct("manual", "ord")).alias("_own"))
    theirs = reused.select(key, "name", F.col("url").alias("_reused"))
    out = names.join(mine, [key, "name"], "left").join(theirs, [key, "name"], "left")
    return out.select(key, "place", "name", F.coalesce("_own", "_reused").alias("url")).where("url IS NOT NULL")


def with_availability(events: DataFrame, shown: DataFrame, key: str = "event_id") -> DataFrame:
    """events with has_links: whether any link is shown."""
    return events.join(shown.select(key).distinct().withColumn("has_links", F.lit(True)), key, "left").withColumn("has_links", F.coalesce("has_links", F.lit(False)))


def planned_venues(wanted: DataFrame, registry: DataFrame, name: str = "name", confirmed: str = "confirmed") -> DataFrame:
    """wanted with plan and venue_id: a venue known by name or alias is existing; a name that is a room's needs confirmation unless it is confirmed; any other is created, with an id made of its name.

    registry: as joins.resolve_by_key takes it. Names must be without accents, or decomposed.
    """
    w = wanted.withColumn("_key", text.plain_name(F.col(name)))
    found = joins.resolve_by_key(w, registry, "_key")
    room: Column = F.col("_key").isin(*SUB_VENUES)
    plan = F.when(F.col("venue_id").isNotNull(), "existing").when(room & ~F.col(confirmed), "needs_confirmation").otherwise("create")
    made = F.when(plan == "create", F.concat(F.lit("v-"), text.slug(F.col(name)))).otherwise(F.col("venue_id"))
    return found.withColumn("plan", plan).withColumn("venue_id", made).drop("_key", "sub_venue")
