"""Who headlines an event: signals of independent groups, from its title, line-up, description and picture.

One strong signal is enough. Without any, an artist needs signals of two
supporting groups, and must be the only one who has them. Rows are signals, so an
event's artists are compared by grouping, not one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, spans, text

#: Wording of headline cues, what joins names, and how many names a list in alphabetical order has at least.
CUE = r"\bheadlin\w*|\bhovednavn\w*|\bmain act\b|\btop of the bill\b|\ball night long\b"
JOINED = r"^\s*(?:,|&|\+|and|og|b2b|x)\s*$"
ALPHABETICAL = 4
SLUG_LETTERS = 5
STRONG = "strong"


def fold(value: Column) -> Column:
    """Lower case, the Danish letters as plain ones, single spaces."""
    return text.squeezed(F.replace(F.translate(F.lower(value), "øåéèäöü", "oaeeaou"), F.lit("æ"), F.lit("ae")))


def _whole(name: Column) -> Column:
    quoted = F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])"), quoted, F.lit(r"(?![\p{L}\p{N}])"))


def mention(value: Column, name: Column) -> Column:
    """Characters before the first whole mention of a folded name in a folded text, or null."""
    found = F.split(value, _whole(name), 2)
    return F.when((name != "") & (F.size(found) > 1), F.length(F.get(found, F.lit(0))))


def cue_subjects(sentence: Column, names: Column) -> Column:
    """array of the folded names that a headline cue in a sentence is about: the nearest before it and those joined to that one, or else the first after it."""
    return spans.let(fold(sentence), lambda said: _subjects(said, names))


def _subjects(said: Column, names: Column) -> Column:
    told = F.transform(names, lambda n: F.struct(mention(said, n).alias("start"), n.alias("name")))
    placed = F.sort_array(F.filter(told, lambda m: m["start"].isNotNull()))
    within = lambda c, m: (c["start"] >= m["start"]) & (c["start"] < m["start"] + F.length(m["name"]))
    cues = lambda ms: F.filter(spans.spans(said, F.lit(spans.word(CUE))), lambda c: ~F.exists(ms, lambda m: within(c, m)))

    def subjects(v: Column) -> Column:
        at, ms = v["cue"], v["mentions"]
        before = F.reverse(F.filter(ms, lambda m: m["start"] + F.length(m["name"]) <= at))
        start = F.struct(F.lit(True).alias("open"), F.lit(-1).alias("left"), F.array().cast("array<string>").alias("names"))

        def step(acc: Column, m: Column) -> Column:
            end = m["start"] + F.length(m["name"])
            gap = F.substr(said, end + 1, acc["left"] - end)
            joins = (F.size(acc["names"]) == 0) | gap.rlike(JOINED)
            taken = F.struct(F.lit(True).alias("open"), m["start"].alias("left"), F.concat(acc["names"], F.array(m["name"])).alias("names"))
            return F.when(acc["open"] & joins, taken).otherwise(F.struct(F.lit(False).alias("open"), acc["left"].alias("left"), acc["names"].alias("names")))

        first_after = F.transform(F.slice(F.filter(ms, lambda m: m["start"] >= at), 1, 1), lambda m: m["name"])
        return F.when(F.size(before) > 0, F.aggregate(before, start, step, lambda acc: acc["names"])).otherwise(first_after)

    none = F.array().cast("array<string>")
    found = spans.let(placed, lambda ms: spans.let(F.struct(F.get(cues(ms), F.lit(0))["start"].alias("cue"), ms.alias("mentions")), lambda v: F.when(v["cue"].isNotNull(), subjects(v)).otherwise(none)))
    return F.when(F.coalesce(said.rlike(spans.word(CUE)), F.lit(False)), found).otherwise(none)


def signals(events: DataFrame, key: str = "event_id", title: str = "title", artists: str = "artists", description: str = "description", image: str = "image") -> DataFrame:
    """key, name (folded), place, artist, signal, group: every sign that an artist headlines."""
    listed = events.select(key, fold(F.coalesce(title, F.lit(""))).alias("_title"), F.coalesce(description, F.lit("")).alias("_text"), F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(image, F.lit("")), r"([^/?#]+?)(?:\.[A-Za-z0-9]+)?(?:[?#].*)?$", 1), r"[^\p{L}\p{N}]+", "_")).alias("_file"), F.coalesce(artists, F.array().cast("array<string>")).alias("_all"))
    real = F.filter(F.transform("_all", lambda a: F.struct(fold(a).alias("name"), a.alias("artist"))), lambda x: (x["name"] != "") & (rules.name_verdict(x["artist"]) != "not_artist"))
    # each list is bound before a lambda refers to it, or its texts would be folded again for every element
    once = spans.let(real, lambda v: F.filter(v, lambda x, i: F.array_position(v["name"], x["name"]) == i + 1))
    listed = listed.withColumn("_real", once).withColumn("_names", F.transform("_real", lambda x: x["name"])).withColumn("_n", F.size("_real"))
    ordered = F.transform("_all", fold)
    listed = listed.withColumn("_sorted", (F.size("_all") >= ALPHABETICAL) & spans.let(ordered, lambda v: v == F.sort_array(v)))
    named = spans.let(F.col("_title"), lambda t: F.filter("_names", lambda n: mention(t, n).isNotNull()))
    listed = listed.withColumn("_in_title", named)
    # a title that is the whole line-up says nothing
    listed = listed.withColumn("_in_title", F.when((F.size("_in_title") >= 2) & (F.size("_in_title") == F.col("_n")), F.array().cast("array<string>")).otherwise(F.col("_in_title")))
    sentences = F.filter(F.split("_text", r"(?<=[.!?])\s+|\n+"), lambda s: s.rlike(spans.word(CUE)))
    listed = listed.withColumn("_cued", spans.let(F.col("_names"), lambda names: F.flatten(F.transform(sentences, lambda s: cue_subjects(s, names)))))
    places = spans.let(fold(F.col("_text")), lambda said: F.filter(F.transform("_names", lambda n: F.struct(mention(said, n).alias("start"), n.alias("name"))), lambda m: m["start"].isNotNull()))
    listed = listed.withColumn("_first", F.array_min(places)["name"])
    rows = listed.select(key, "_n", "_title", "_file", "_sorted", "_in_title", "_cued", "_first", F.posexplode("_real").alias("place", "_r"))
    name, several = F.col("_r.name"), F.col("_n") > 1
    slug = F.regexp_replace(name, r"[^\p{L}\p{N}]+", "_")
    on_file = F.contains(F.concat(F.lit("_"), "_file", F.lit("_")), F.concat(F.lit("_"), slug, F.lit("_"))) & (F.length(F.replace(slug, F.lit("_"), F.lit(""))) >= SLUG_LETTERS)
    sign = lambda test, signal, group: F.when(test, F.struct(F.lit(signal).alias("signal"), F.lit(group).alias("group")))
    found = F.array_compact(
        F.array(
            sign(F.col("_n") == 1, "only_performer", STRONG),
            sign(several & F.array_contains("_in_title", name), "title_names_artist", STRONG),
            sign(F.array_contains("_cued", name), "description_headline_cue", STRONG),
            sign(several & ~F.col("_sorted") & (F.col("place") == 0), "lineup_first", "order"),
            sign(several & on_file, "poster_filename", "asset"),
            sign(several & (F.col("_first") == name), "description_first_mention", "prose"),
        )
    )
    return rows.select(key, "place", name.alias("name"), F.col("_r.artist").alias("artist"), F.explode(found).alias("_s")).select(key, "place", "name", "artist", "_s.signal", "_s.group")


def headliners(found: DataFrame, key: str = "event_id") -> DataFrame:
    """key, artist, confidence: documented by a strong signal, or supported_prioritized as the only one with two supporting groups. found: as signals gives it."""
    votes = found.groupBy(key, "name").agg(F.min_by("artist", "place").alias("artist"), F.max(F.col("group") == STRONG).alias("strong"), F.size(F.collect_set(F.when(F.col("group") != STRONG, F.col("group")))).alias("groups"))
    # an event has few artists; a join of what they add up to would find all signals a second time
    event = Window.partitionBy(key)
    out = votes.withColumns({"_any": F.max("strong").over(event), "_supported": F.count_if(F.col("groups") >= 2).over(event)})
    alone = ~F.col("_any") & (F.col("groups") >= 2) & (F.col("_supported") == 1)
    confidence = F.when(F.col("strong"), "documented").when(alone, "supported_prioritized")
    return out.select(key, "artist", confidence.alias("confidence")).where("confidence IS NOT NULL")
