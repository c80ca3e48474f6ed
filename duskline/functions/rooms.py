"""Which room of a two-room venue each artist plays in, read from a description line by line.

A line is first told what it is and whom it names; a fold over the lines then
keeps the room that is open. Nothing is placed that the text does not say: a name
in both rooms, or in none beside others that are placed, leaves all unresolved.
Letters are compared in lower case, as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans

#: The rooms, and how listings write headings, breaks and hints.
MAIN, SMALL = "Den Anden Side", "Den Anden Ende"
MAIN_HEADING = r"(?i)^(?:main ?(?:floor|room|stage|dancefloor)|hovedrum(?:met)?|hovedgulv(?:et)?)\s*(?::\s*(.*))?$"
SMALL_HEADING = r"(?i)^(?:small(?:er)? ?(?:floor|room|dancefloor)|lille ?rum(?:met)?)\s*(?::\s*(.*))?$"
NAMED_HEADING = r"(?i)^(.*?)den anden (?:side|ende)\)?\s*[:\-–—]?\s*(?:\([^)]*\)\s*:?\s*)?(.*)$"
DECORATED = "^[◈◆◇❖]"
SEPARATOR = r"^(?:[—–]{3,}|-{4,}|_{4,}|={4,}|\*{3,})$"
PRACTICAL = r"(?iu)^(?:admission|entry|entrance|tickets?|ticket info(?:rmation)?|billetter|entr[ée]e?|prices?|priser|age(?: limit)?|aldersgrænse|wardrobe|garderobe|cloakroom|door ?policy|dørpolitik|code of conduct|house rules|vibe vision|awareness|safer? spaces?(?: policy)?|accessibility|tilgængelighed|practical info(?:rmation)?|praktisk info(?:rmation)?|praktiske oplysninger)$"
OTHER_ROOM = r"\b(?:room|rum|floor|dancefloor|dansegulv|stage|scene|takeover|area)\b"
OTHER_ROOM_FORM = r"(?i):$|^\S+(?:\s+\S+)?\s*\d*\s*[:(]|^(?:room|rum|floor)\s*\d"
TITLE_SMALL = r"(?i)^Den Anden Ende:\s*|\s*(?:\bat\b|@|[-–—|])\s*Den Anden Ende\s*$"
HINT = r"\b(?:den anden ende|second (?:room|floor|dancefloor)|small(?:er)? (?:room|floor|dancefloor)|room ?(?:2|two|ii)|two rooms|both rooms|andet rum|lille rum|det lille|takeover of the second)\b"


def plain(text: Column, brackets: bool = False) -> Column:
    """Letters and digits in lower case, single spaces; what is in brackets left out unless asked for."""
    bare = F.lower(text) if brackets else F.regexp_replace(F.lower(text), r"[\[(][^\])]*[\])]", " ")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), plain(text), F.lit(" "))


def _word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def is_practical(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"[\s:.\-–—]+$", "")).rlike(PRACTICAL)


def _heading(line: Column) -> Column:
    """struct<room, inline> of a line that names exactly one room, else null."""
    words = plain(line, brackets=True)
    rooms = lambda w: F.struct(F.contains(w, F.lit("den anden side")).alias("side"), F.contains(w, F.lit("den anden ende")).alias("end"))
    return spans.let(spans.let(words, rooms), lambda v: _heading_of(line, v["side"], v["end"]))


def _heading_of(line: Column, side: Column, end: Column) -> Column:
    parts = F.struct(F.regexp_extract(line, NAMED_HEADING, 1).alias("before"), F.trim(F.regexp_extract(line, NAMED_HEADING, 2)).alias("after"))
    named = F.when(line.rlike(NAMED_HEADING), spans.let(parts, lambda v: _named_heading(v["before"], v["after"], end)))
    other = F.when(line.rlike(MAIN_HEADING), _made(MAIN, F.trim(F.regexp_extract(line, MAIN_HEADING, 1)))).when(line.rlike(SMALL_HEADING), _made(SMALL, F.trim(F.regexp_extract(line, SMALL_HEADING, 1))))
    return F.when(side & end, F.lit(None)).when(side | end, named).otherwise(other)


def _made(room: str, rest: Column) -> Column:
    return F.struct(F.lit(room).alias("room"), rest.alias("inline"))


def _named_heading(before: Column, after: Column, end: Column) -> Column:
    short = (_word_count(before) <= 4) & ~before.rlike(r"[.!?]\s") & ~F.trim(before).rlike(r"[.!?]$")
    lineup = (after == "") | (~after.rlike(r"[.!?]$") & ((_word_count(after) <= 6) | F.contains(after, F.lit(","))))
    return F.when(short & lineup, F.when(end, _made(SMALL, after)).otherwise(_made(MAIN, after)))


def _told(line: Column, known: Column) -> Column:
    """struct<kind, room, decorated, names>: what a line is, and which artists it names. known: array<struct<own, artist>>, own in plain form between spaces."""
    return spans.let(_heading(line), lambda h: _told_of(line, h, known))


def _told_of(line: Column, h: Column, known: Column) -> Column:
    other = (_word_count(line) <= 6) & line.rlike(spans.word(OTHER_ROOM)) & line.rlike(OTHER_ROOM_FORM)
    kind = F.when(line == "", "blank").when(line.rlike(SEPARATOR) | is_practical(line), "break").when(h.isNotNull(), "room").when(other, "other").otherwise("text")
    named = lambda where: spans.let(_padded(where), lambda w: F.filter(known, lambda x: F.contains(w, x["own"])))["artist"]
    return F.struct(kind.alias("kind"), h["room"].alias("room"), line.rlike(DECORATED).alias("decorated"), named(F.coalesce(h["inline"], line)).alias("names"))


_STATE = "struct<room:string,saw:boolean,section:boolean,headings:int,placed:array<struct<room:string,artist:string>>>"


def _step(acc: Column, line: Column) -> Column:
    def now(room: Column, saw: Column, section: Column, headings: Column, names: Column) -> Column:
        placed = F.concat(acc["placed"], F.transform(names, lambda a: F.struct(room.alias("room"), a.alias("artist"))))
        return F.struct(room.alias("room"), saw.alias("saw"), section.alias("section"), headings.alias("headings"), placed.alias("placed")).cast(_STATE)

    nobody, shut = F.array().cast("array<string>"), F.lit(None).cast("string")
    saw, section, headings = acc["saw"], acc["section"], acc["headings"]
    some = F.size(line["names"]) > 0
    return (
        F.when(line["kind"] == "blank", now(F.when(saw & ~section, shut).otherwise(acc["room"]), saw, section, headings, nobody))
        .when(line["kind"].isin("break", "other"), now(shut, saw, section, headings, nobody))
        .when(line["kind"] == "room", now(line["room"], some, line["decorated"], headings + 1, line["names"]))
        .when(acc["room"].isNotNull(), now(acc["room"], saw | some, section, headings, line["names"]))
        .otherwise(acc)
    )


def with_rooms(df: DataFrame, title: str = "title", description: str = "description", artists: str = "artists", venue: str = "venue") -> DataFrame:
    """Adds room_verdict (two-rooms, small-room-only, main-room-only, no-room-info or unresolved), main_room, small_room (arrays of artists) and room_reason."""
    names = F.coalesce(artists, F.array().cast("array<string>"))
    lines = F.split(F.coalesce(description, F.lit("")), "\n")
    start = F.struct(F.lit(None).cast("string").alias("room"), F.lit(False).alias("saw"), F.lit(False).alias("section"), F.lit(0).alias("headings"), F.array().cast("array<struct<room:string,artist:string>>").alias("placed")).cast(_STATE)
    # the names' plain forms, and each line, are bound once
    known = F.filter(F.transform(names, lambda a: F.struct(_padded(a).alias("own"), a.alias("artist"))), lambda x: F.trim(x["own"]) != "")
    told = spans.let(known, lambda k: F.transform(F.transform(lines, lambda x: F.trim(x)), lambda x: _told(x, k)))
    out = df.withColumn("_told", told)
    out = out.withColumn("_fold", F.aggregate("_told", start, _step))
    placed = F.col("_fold.placed")
    within = lambda room: F.filter(names, lambda a: F.exists(placed, lambda p: (p["artist"] == a) & (p["room"] == room)))
    out = out.withColumns({"_main": within(MAIN), "_small": within(SMALL), "_by_title": F.coalesce(F.col(title).rlike(TITLE_SMALL), F.lit(False)) | F.coalesce(plain(F.col(venue)) == plain(F.lit(SMALL)), F.lit(False))})
    m, s, by_title = F.col("_main"), F.col("_small"), F.col("_by_title")
    both, left = F.array_intersect(m, s), F.array_except(names, F.array_union(m, s))
    hint = F.concat_ws("\n", title, F.coalesce(description, F.lit(""))).rlike(spans.word(HINT))
    case = lambda verdict, reason: F.struct(F.lit(verdict).alias("verdict"), reason.alias("reason"))
    found = (
        F.when(F.size(placed) == 0, F.when(by_title, case("small-room-only", F.lit("title or venue"))).when((F.col("_fold.headings") > 0) & (F.size(names) > 0), case("unresolved", F.lit("headings without names"))).when(hint, case("unresolved", F.lit("a second room without names"))).otherwise(case("no-room-info", F.lit("nothing said"))))
        .when(F.size(both) > 0, case("unresolved", F.concat(F.lit("in both rooms: "), F.array_join(both, ", "))))
        .when(F.size(left) > 0, case("unresolved", F.concat(F.lit("in no room: "), F.array_join(left, ", "))))
        .when(by_title & (F.size(m) > 0), case("unresolved", F.lit("title against headings")))
        .when((F.size(m) > 0) & (F.size(s) > 0), case("two-rooms", F.lit("headings")))
        .when(F.size(s) > 0, case("small-room-only", F.lit("headings")))
        .otherwise(case("main-room-only", F.lit("headings")))
    )
    out = out.withColumn("_found", found)
    none, verdict = F.array().cast("array<string>"), F.col("_found.verdict")
    small = F.when((verdict == "small-room-only") & (F.size(placed) == 0), names).when(verdict.isin("two-rooms", "small-room-only"), s).otherwise(none)
    main = F.when(verdict.isin("two-rooms", "main-room-only"), m).otherwise(none)
    return out.withColumns({"room_verdict": verdict, "main_room": main, "small_room": small, "room_reason": F.col("_found.reason")}).drop("_told", "_fold", "_main", "_small", "_by_title", "_found")
