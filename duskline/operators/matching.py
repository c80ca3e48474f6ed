"""Which rows are one event: pairs worth assessing, and what follows from them in order.

Pairs come from an equi-join on keys of which any pair of confidence medium or more
must share one; rows bring what is compared along, so that a pair is assessed where
it is made. What depends on the order of rows (what is published first, which
group a row joins, which of two partners is taken) is settled in rounds over the
pairs: a round settles every row whose earlier rivals are settled, so all
independent cases advance together and no block of rows has to fit in a task. In
the worst case, a chain in which each row rivals only the one before it, there are
as many rounds as rows in the chain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, time
from ..sources.tables import checkpointed
from . import decisions
from .joins import small_side

FEATURES = ["id", "night", "start", "venue", "sub_venue", "words", "keys", "urls"]
#: Of a venue's night with so many rows at most all meet; in a larger one only those that share a rare title word, a line-up key or a URL.
CROWD = 32


def features(df: DataFrame, id_col: str, start: Column, venue: Column, sub_venue: Column, title: Column, lineup: Column, urls: Column, *others: Column) -> DataFrame:
    """What is compared of an event, computed once a row: id, night, start, venue, sub_venue, title words, line-up keys, normal URLs. Then the others, as they are."""
    normal = F.array_distinct(F.array_compact(F.transform(F.array_compact(F.coalesce(urls, F.array().cast("array<string>"))), text.normal_url)))
    words = F.coalesce(text.title_words(text.plain_name(title)), F.array().cast("array<string>"))
    keys = F.coalesce(text.lineup_keys(lineup), F.array().cast("array<string>"))
    return df.select(F.col(id_col).alias("id"), time.night_key(start).alias("night"), start.alias("start"), venue.alias("venue"), sub_venue.alias("sub_venue"), words.alias("words"), keys.alias("keys"), normal.alias("urls"), *others)


def _rare_words(rows: DataFrame) -> DataFrame:
    """side, id, word: the rarest title words of each event: enough that two of one venue whose titles are similar share one.

    A title of n words needs the n - ceil(t * n) + 1 rarest for a similarity of t.
    """
    own = rows.select("side", "id", "night", "venue", F.size("words").alias("n"), F.explode("words").alias("word"))
    common = own.groupBy("night", "venue", "word").agg(F.count("*").alias("often"))
    ranked = own.join(common, ["night", "venue", "word"]).groupBy("side", "id", "n").agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("w"))
    most = F.col("n") - F.ceil(F.col("n") * decisions.REVIEW_TITLE).cast("int") + 1
    return ranked.select("side", "id", F.explode(F.slice("w", 1, most)["word"]).alias("word"))


def _meetings(rows: DataFrame, *others: str) -> DataFrame:
    """a_* and b_*: the features of all events of one night that share a URL, a line-up key or a venue (in a crowded one a rare title word): no other pair can be a duplicate.

    rows: FEATURES, side and other columns that come along; a comes before b in the
    order of (side, id). Some pairs are given more than once. Keys are hashes of a night and what is shared; what
    meets by chance is told apart when it is assessed.
    """
    compared = [*(c for c in FEATURES if c != "start"), *others]
    rows = rows.where("night IS NOT NULL").select("side", *compared)
    placed = rows.where("venue IS NOT NULL")
    crowds = checkpointed(placed.groupBy("night", "venue").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("night", "venue"))
    many = not crowds.isEmpty()
    if many:
        crowds = small_side(crowds)
        rows = rows.join(crowds.withColumn("crowd", F.lit(True)), ["night", "venue"], "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
    else:
        rows = rows.withColumn("crowd", F.lit(False))
    key = lambda kind, x: F.xxhash64("night", F.lit(kind), x)
    elsewhere = F.concat(F.transform("urls", lambda u: key("u", u)), F.transform("keys", lambda k: key("a", k)))
    settled = F.col("venue").isNotNull() & ~F.col("crowd")
    here = F.when(settled, F.array(key("v", F.col("venue")))).otherwise(F.array().cast("array<bigint>"))
    keyed = rows.select("*", F.posexplode(F.concat(here, elsewhere)).alias("place", "key"))
    # rows of one venue that is not crowded meet by its key, and by no other
    keyed = keyed.withColumn("at_venue", F.col("crowd") | (settled & (F.col("place") == 0))).drop("place", "crowd")
    if many:
        crowded = placed.join(crowds, ["night", "venue"], "left_semi")
        rare = crowded.join(_rare_words(crowded), ["side", "id"]).withColumn("key", F.xxhash64("night", F.lit("w"), "venue", "word")).drop("word")
        keyed = keyed.unionByName(rare.withColumn("at_venue", F.lit(True)))
    # both sides of the join take the same columns, so that Spark makes and shuffles them once
    a, b = (keyed.select([F.col(c).alias(f"{s}_{c}") for c in ("key", "at_venue", "side", *compared)]) for s in "ab")
    earlier = (F.col("a_side") < F.col("b_side")) | ((F.col("a_side") == F.col("b_side")) & (F.col("a_id") < F.col("b_id")))
    once = (F.col("a_at_venue") & F.col("b_at_venue")) | ~F.coalesce(F.col("a_venue") == F.col("b_venue"), F.lit(False))
    return a.join(b, F.col("a_key") == F.col("b_key")).where(earlier & once)


def _fragments(urls: Column) -> Column:
    """array<struct<base, room>> of the URLs that name a room by a fragment."""
    return F.transform(F.filter(urls, lambda u: F.contains(u, F.lit("#"))), lambda u: F.struct(F.substring_index(u, "#", 1).alias("base"), F.substring_index(u, "#", -1).alias("room")))


def confident(p: DataFrame) -> DataFrame:
    """Pairs of features a_* and b_* with confidence (medium or high; others are left out), title_similarity and artist_overlap.

    Vetoes first: one page under two room anchors, or two known rooms of one venue.
    """
    # tied to the partition id: else the filter would work them out again
    once = lambda c: F.when(F.spark_partition_id() >= 0, c)
    p = p.withColumn("_shared", once(F.size(F.array_intersect("a_words", "b_words"))))
    apart = F.size("a_words") + F.size("b_words") - F.col("_shared")
    p = p.withColumns({"title_similarity": F.when(F.col("_shared") == 0, 0.0).otherwise(F.col("_shared") / apart), "artist_overlap": once(text.overlap(F.col("a_keys"), F.col("b_keys")))}).drop("_shared")
    no, one_venue = F.lit(False), F.coalesce(F.col("a_venue") == F.col("b_venue"), F.lit(False))
    rooms = (F.size("a_urls") > 0) & (F.size("b_urls") > 0) & F.exists(_fragments(F.col("a_urls")), lambda x: F.exists(_fragments(F.col("b_urls")), lambda y: (x["base"] == y["base"]) & (x["room"] != y["room"])))
    confidence = decisions.assess_duplicate(
        same_night=F.col("a_night") == F.col("b_night"),
        room_conflict=rooms,
        sub_venue_conflict=one_venue & F.coalesce(F.col("a_sub_venue") != F.col("b_sub_venue"), no),
        shared_url=F.arrays_overlap("a_urls", "b_urls"),
        same_venue=one_venue,
        venue_unknown=F.col("a_venue").isNull() | F.col("b_venue").isNull(),
        title=F.col("title_similarity"),
        artists=F.col("artist_overlap"),
        both_lineups=(F.size("a_keys") > 0) & (F.size("b_keys") > 0),
    )
    return p.withColumn("confidence", once(confidence)).where("confidence <> 'none'")


def assessed(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs left_id, right_id as `confident` has them, from the features of both."""
    a = left.select([F.col(c).alias("left_id" if c == "id" else f"a_{c}") for c in FEATURES])
    b = right.select([F.col(c).alias("right_id" if c == "id" else f"b_{c}") for c in FEATURES])
    return confident(pairs.join(a, "left_id").join(b, "right_id"))


def _sided(left: DataFrame, right: DataFrame) -> DataFrame:
    """Features of both, those on the right first in order."""
    made = lambda df, side: df.select(F.lit(side).alias("side"), *FEATURES)
    return made(left, 1).unionByName(made(right, 0))


def duplicates(left: DataFrame, right: DataFrame, within: bool = False) -> DataFrame:
    """left_id, right_id, confidence, title_similarity, artist_overlap of all duplicates of medium confidence or more.

    within: left and right are one table, and a pair is given once, the smaller id left.
    """
    if within:
        met, first, second = _meetings(left.select(F.lit(1).alias("side"), *FEATURES)), "a_id", "b_id"
    else:
        met, first, second = _meetings(_sided(left, right)).where("a_side < b_side"), "b_id", "a_id"
    found = confident(met).select(F.col(first).alias("left_id"), F.col(second).alias("right_id"), "confidence", "title_similarity", "artist_overlap")
    return found.distinct()


def ruled_out(edges: DataFrame) -> DataFrame:
    """id of the rows that do not stand when rows come in order and one stands if no earlier row that it rivals stands.

    edges: early, late (each pair of rivals once). A round rules out whom a row
    without an open earlier rival rivals, and closes the edges of those; who is never
    ruled out stands.
    """
    edges, found = checkpointed(edges.select("early", "late").distinct()), []
    while not edges.isEmpty():
        late = edges.select("late").distinct()
        heads = edges.select("early").distinct().join(late, F.col("early") == F.col("late"), "left_anti")
        out = checkpointed(edges.join(heads, "early", "left_semi").select(F.col("late").alias("id")).distinct())
        found.append(out)
        if len(found) == 16:
            found = [checkpointed(reduce(DataFrame.union, found))]
        edges = checkpointed(edges.join(out.withColumnRenamed("id", "late"), "late", "left_anti").join(out.withColumnRenamed("id", "early"), "early", "left_anti"))
    return reduce(DataFrame.union, found) if found else edges.select(F.col("late").alias("id"))


def first_come(edges: DataFrame) -> DataFrame:
    """id of the rows of edges that stand, as `ruled_out` has it. Rows without rivals are not in edges, and stand."""
    both = edges.select(F.col("early").alias("id")).unionByName(edges.select(F.col("late").alias("id"))).distinct()
    return both.join(ruled_out(edges), "id", "left_anti")


def visible_in_batch(rows: DataFrame, stored: DataFrame, eligible: str = "eligible") -> DataFrame:
    """Candidates of one batch, each compared with what is stored and with those of the batch published before it.

    rows: FEATURES and a boolean; ids are the order of the batch. Returns id,
    published (eligible, and no duplicate of what was there at its turn),
    duplicate_of, duplicate_in (stored or batch) and duplicate_confidence: the
    best match, what is stored first and then the smallest id among equals.
    """
    # one search finds both: what is stored comes first, and two stored rows are no pair
    able = F.coalesce(F.col(eligible), F.lit(False))
    sides = rows.select(F.lit(1).alias("side"), *FEATURES, able.alias("able")).unionByName(stored.select(F.lit(0).alias("side"), *FEATURES, F.lit(False).alias("able")))
    found = confident(_meetings(sides, "able").where("a_side + b_side > 0"))
    found = checkpointed(found.select("a_side", F.col("a_id").alias("early"), F.col("b_id").alias("late"), "a_able", "b_able", "confidence"))
    own = found.where("a_side = 1")
    old = found.where("a_side = 0").select(F.col("late").alias("id"), F.lit("stored").alias("where"), F.col("early").alias("other"), "confidence")
    known = old.select("id").distinct()
    rivals = own.where("a_able AND b_able").select("early", "late").join(known.withColumnRenamed("id", "early"), "early", "left_anti").join(known.withColumnRenamed("id", "late"), "late", "left_anti")
    fallen = ruled_out(rivals)
    gone = known.unionByName(fallen).withColumnRenamed("id", "early")
    seen = own.where("a_able").join(gone, "early", "left_anti").select(F.col("late").alias("id"), F.lit("batch").alias("where"), F.col("early").alias("other"), "confidence")
    nothing = lambda name, like: F.lit(None).cast(like.schema[name].dataType).alias(name)
    fell = fallen.select("id", F.lit("fallen").alias("where"), *[nothing(c, old) for c in ("other", "confidence")])
    match = F.col("where") != "fallen"
    order = F.struct(-decisions.confidence_rank(F.col("confidence")), F.when(F.col("where") == "stored", 0).otherwise(1), "other")
    best = old.unionByName(seen).unionByName(fell).groupBy("id").agg(F.min_by(F.struct("where", "other", "confidence"), F.when(match, order)).alias("m"), F.bool_or(F.col("where") != "batch").alias("_gone"))
    out = rows.select("id", able.alias("_able")).join(best, "id", "left")
    published = F.col("_able") & ~F.coalesce("_gone", F.lit(False))
    return out.select("id", published.alias("published"), F.col("m.other").alias("duplicate_of"), F.col("m.where").alias("duplicate_in"), F.coalesce("m.confidence", F.lit("none")).alias("duplicate_confidence"))


def near_starts(left: DataFrame, hours: int = 2) -> DataFrame:
    """left_id, right_id of rows at one venue, at most so many hours apart, that share a URL or a line-up key: buckets of that length meet, each with the next one too."""
    seconds = hours * 3600
    keys = F.concat(F.transform("urls", lambda u: F.concat(F.lit("u\x1f"), u)), F.transform("keys", lambda k: F.concat(F.lit("a\x1f"), k)))
    at = F.unix_seconds("start")
    rows = left.where("venue IS NOT NULL").select("id", "venue", at.alias("at"), F.floor(at / seconds).alias("bucket"), F.explode(keys).alias("key"))
    a = rows.withColumnRenamed("id", "left_id").withColumnRenamed("at", "a_at")
    near = rows.withColumnRenamed("id", "right_id").withColumnRenamed("at", "b_at").withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    pairs = a.join(near, ["venue", "key", "bucket"]).where((F.col("left_id") != F.col("right_id")) & (F.abs(F.col("a_at") - F.col("b_at")) <= seconds))
    return pairs.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).distinct()


def same_event_edges(rows: DataFrame, hours: int = 2) -> DataFrame:
    """first, first_rank, later, later_rank, source: pairs of rows of different sources that are one event with high confidence, by rank. rows: FEATURES, source and rank (distinct)."""
    found = assessed(near_starts(rows, hours), rows, rows).where("confidence = 'high'").select("left_id", "right_id")
    about = rows.where("source IS NOT NULL").select("id", "source", "rank")
    a = about.select(F.col("id").alias("left_id"), F.col("source").alias("a"), F.col("rank").alias("ar"))
    b = about.select(F.col("id").alias("right_id"), F.col("source").alias("b"), F.col("rank").alias("br"))
    p = found.join(a, "left_id").join(b, "right_id").where("a <> b")
    earlier = F.col("ar") < F.col("br")
    pick = lambda x, y, name: F.when(earlier, F.col(x)).otherwise(F.col(y)).alias(name)
    return p.select(pick("left_id", "right_id", "first"), pick("ar", "br", "first_rank"), pick("a", "b", "first_source"), pick("right_id", "left_id", "later"), pick("br", "ar", "later_rank"), pick("b", "a", "source"))


def first_fit_groups(edges: DataFrame) -> DataFrame:
    """id, group of the rows that join another one, when rows come by rank and each joins the first group that it fits, or begins one.

    A row fits a group whose first row it has an edge with and which has no row
    of its source yet. edges: as same_event_edges gives them. Rows that are not in
    the result begin a group of their own.

    In a round a row whose first open group has surely begun joins if no
    earlier undecided row of its source is after the same group; a row without an
    open group begins one. Groups that can't begin, or have its source, are closed.
    """
    live, joined, begun = checkpointed(edges), None, None
    while not live.isEmpty():
        waiting = live.select(F.col("later").alias("id")).distinct()
        heads = live.select(F.col("first").alias("id")).distinct().join(waiting, "id", "left_anti").select(F.col("id").alias("first"), F.lit(True).alias("sure"))
        choice = live.groupBy("later", "later_rank", "source").agg(F.min_by("first", "first_rank").alias("first"))
        rivals = live.groupBy("first", "source").agg(F.min("later_rank").alias("next"))
        join = choice.join(heads, "first").join(rivals, ["first", "source"]).where(F.col("next") == F.col("later_rank")).select(F.col("later").alias("id"), F.col("first").alias("group"), "source")
        join = checkpointed(join)
        joined = join if joined is None else checkpointed(joined.unionByName(join))
        # those that joined wait no more and begin no group; the group takes no more of their source
        live = live.join(join.select(F.col("id").alias("later")), "later", "left_anti").join(join.select(F.col("id").alias("first")), "first", "left_anti")
        live = checkpointed(live.join(join.select(F.col("group").alias("first"), "source"), ["first", "source"], "left_anti"))
    return joined.select("id", "group") if joined is not None else edges.select(F.col("later").alias("id"), F.col("first").alias("group")).limit(0)


def exclusive_pairs(edges: DataFrame) -> DataFrame:
    """left, right: pairs in which each row is used once, when edges are taken in the order of (left, right).

    edges: left < right. An edge that is the first of all open edges at both its ends is taken; its ends' other edges close.
    """
    live, taken = checkpointed(edges.select("left", "right").distinct()), None
    while not live.isEmpty():
        ends = live.select(F.col("left").alias("id"), "left", "right").unionByName(live.select(F.col("right").alias("id"), "left", "right"))
        first = ends.groupBy("id").agg(F.min(F.struct("left", "right")).alias("e"))
        both = first.groupBy("e").count().where("count = 2").select(F.col("e.left").alias("left"), F.col("e.right").alias("right"))
        now = checkpointed(both)
        taken = now if taken is None else checkpointed(taken.unionByName(now))
        used = now.select(F.col("left").alias("id")).unionByName(now.select(F.col("right").alias("id")))
        live = checkpointed(live.join(used.withColumnRenamed("id", "left"), "left", "left_anti").join(used.withColumnRenamed("id", "right"), "right", "left_anti"))
    return taken if taken is not None else edges.select("left", "right").limit(0)
