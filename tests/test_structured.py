"""Rooms, descriptions, labelled links and video rules, case by case."""

import pytest
from pyspark.sql import functions as F

from duskline.functions import descriptions, rooms
from duskline.operators import evidence

SIDE, END = rooms.MAIN, rooms.SMALL


@pytest.mark.parametrize(
    ("title", "text", "artists", "venue", "verdict", "main", "small"),
    [
        ("Night", f"{SIDE}\nAnn\nBob [she/her]\n\n{END}\nCy (live)", ["Ann", "Bob", "Cy"], None, "two-rooms", ["Ann", "Bob"], ["Cy"]),
        ("Night", f"Main floor ({SIDE}): Ann, Bob\nFEUM TAKEOVER @ {END.upper()}: Cy", ["Ann", "Bob", "Cy"], None, "two-rooms", ["Ann", "Bob"], ["Cy"]),
        ("Night", "MAIN FLOOR:\nAnn\nSmall room: Bob", ["Ann", "Bob"], None, "two-rooms", ["Ann"], ["Bob"]),
        ("Night", f"{END}\nAnn B2B Bob", ["Ann", "Bob"], None, "small-room-only", [], ["Ann", "Bob"]),
        ("Night", f"{SIDE}:\nAnn", ["Ann"], None, "main-room-only", ["Ann"], []),
        (f"X @ {END}", None, ["Ann"], None, "small-room-only", [], ["Ann"]),
        ("X", "words", ["Ann"], END, "small-room-only", [], ["Ann"]),
        (f"X @ {END}", f"{SIDE}\nAnn", ["Ann"], None, "unresolved", [], []),
        ("Night", f"{SIDE}\nAnn\n{END}\nAnn", ["Ann"], None, "unresolved", [], []),
        ("Night", f"{SIDE}\nAnn\n\nBob", ["Ann", "Bob"], None, "unresolved", [], []),
        ("Night", f"◈ {SIDE} ◈\nAnn is\n\nBob is", ["Ann", "Bob"], None, "main-room-only", ["Ann", "Bob"], []),
        ("Night", f"{SIDE}\nRoom 2:\nAnn", ["Ann"], None, "unresolved", [], []),
        ("Night", f"{SIDE}\n----\nAnn", ["Ann"], None, "unresolved", [], []),
        ("Night", f"{SIDE}\nTickets:\nAnn", ["Ann"], None, "unresolved", [], []),
        ("Night", f"Below you find what to know before you go to {SIDE}.\nAnn", ["Ann"], None, "no-room-info", [], []),
        ("Night", "a takeover of the second floor", ["Ann"], None, "unresolved", [], []),
        ("Night", f"{SIDE}\nAnnabel", ["Ann"], None, "unresolved", [], []),
        ("Night", None, None, None, "no-room-info", [], []),
        (None, "", [], None, "no-room-info", [], []),
    ],
)
def test_rooms(spark, title, text, artists, venue, verdict, main, small):
    df = spark.createDataFrame([(title, text, artists, venue)], "title string, description string, artists array<string>, venue string")
    r = rooms.with_rooms(df).first()
    assert (r.room_verdict, r.main_room, r.small_room) == (verdict, main, small), r.room_reason


PROSE = "This is a line of prose that goes on for a good while, so that it counts as a body."
TEXT = f"""## About the night

{PROSE}
{PROSE} again
short one
short two

ANN AND FRIENDS
{PROSE}

Ann
{PROSE} See https://x.dk/ann?a=b. And www.y.dk/z, too

----

Tickets:
100 kr

Prices
20 kr https://cut.dk/abc… more"""


def tree_of(spark, text, hints=()):
    df = spark.createDataFrame([(text,)], "t string").select(descriptions.normal(F.col("t")).alias("t"))
    b = descriptions.blocks(F.col("t"), F.array(*map(F.lit, hints)).cast("array<string>"))
    df = df.withColumn("b", b)
    return df.select("t", "b", descriptions.nested(F.col("b")).alias("tree"), descriptions.preview_count(F.col("b")).alias("preview"), descriptions.practical_start(F.col("b")).alias("tail"), descriptions.rebuilt(descriptions.nested(F.col("b"))).alias("again")).first()


def test_description_tree(spark):
    r = tree_of(spark, TEXT, ["ann"])
    kinds = [(b["type"], b["level"], len(b["lines"])) for b in r["b"]]
    p = ("paragraph", None, 1)
    assert kinds == [("heading", "section", 1), p, p, ("paragraph", None, 2), ("heading", "section", 1), p, ("heading", "entry", 1), p, p, ("heading", "section", 1), p, ("heading", "section", 1), p]
    links = [(t["text"], t["href"]) for b in r["tree"] for line in b["lines"] for t in line if t["type"] == "link"]
    assert links == [("https://x.dk/ann?a=b", "https://x.dk/ann?a=b"), ("www.y.dk/z", "https://www.y.dk/z")]
    # nothing but the mark of the heading and the breaks differs
    assert r["again"].split() == r["t"].removeprefix("## ").split()
    assert r["tail"] == 8


@pytest.mark.parametrize("text", [None, "", " \n\n ", "one", "LINEUP", "a\r\nb\rc", "\n\n\nx\n\n\n\ny", "https://a.b", "see www.x.dk/(a)."])
def test_odd_descriptions_are_rebuilt(spark, text):
    r = tree_of(spark, text)
    assert r["again"].split() == r["t"].split() and r["preview"] is None and r["tail"] is None
    assert all(b["type"] == "paragraph" for b in r["b"])


def test_previews_fold_between_blocks(spark):
    long = "\n\n".join(["A sentence of sixty characters, which is not a heading at all."] * 20)
    assert tree_of(spark, long)["preview"] == 9
    assert tree_of(spark, "\n\n".join([PROSE] * 3))["preview"] is None
    headed = "\n\n".join(["x" * 494 + ".", "LINEUP", "y" * 600 + "."])
    assert tree_of(spark, headed)["preview"] == 1
    label = descriptions.link_label
    assert spark.range(1).select(label(F.lit("https://www.x.dk/a/?b#c")).alias("a"), label(F.lit("http://x.dk/" + "y" * 50)).alias("b")).first()[:] == ("x.dk/a", "x.dk/" + "y" * 34 + "…")


def pairs(spark, *rows):
    df = spark.createDataFrame(list(rows), "event_id int, artists array<string>, text string")
    return sorted((r.event_id, r.part, r.url.removeprefix("https://soundcloud.com/"), r.conflict) for r in evidence.paired_profiles(df).collect())


def test_labels_name_whom_they_stand_before(spark):
    sc = "https://soundcloud.com/"
    assert pairs(spark, (1, ["Kromagon", "mirr"], f"Kromagon: {sc}aragon\nmirr (Zeitgeist) {sc}MirUlstrup/.")) == [(1, "Kromagon", "aragon", None), (1, "mirr", "mirulstrup", None)]
    assert pairs(spark, (1, ["SEID"], f"SEID - Label https://mixcloud.com/x {sc}seid")) == [(1, "SEID", "seid", None)]
    assert pairs(spark, (1, ["SEID"], f"somebody {sc}a\n{sc}b\nSEID {sc}c/track")) == []
    assert pairs(spark, (1, ["Ingvil B2B DJ Void"], f"DJ Void: {sc}void")) == [(1, "DJ Void", "void", None)]


def test_conflicting_labels_give_none(spark):
    sc = "https://soundcloud.com/"
    assert pairs(spark, (1, ["DJ Void", "Ingvil B2B DJ Void"], f"DJ Void: {sc}void")) == []
    assert pairs(spark, (1, ["Ann"], f"Ann: {sc}a {sc}b")) == [(1, "Ann", "a", "two_handles_same_event"), (1, "Ann", "b", "two_handles_same_event")]
    assert pairs(spark, (1, ["LELE"], f"LELE {sc}a"), (2, ["LeLe"], f"LeLe {sc}b")) == [(1, "LELE", "a", "two_handles_same_key"), (2, "LeLe", "b", "two_handles_same_key")]
    assert pairs(spark, (1, ["A & B"], f"A & B: {sc}ab")) == [(1, "A & B", "ab", "entry_not_single_artist")]
    assert pairs(spark, (1, None, f"Ann {sc}a"), (2, [], None), (3, ["Ann"], "")) == []


@pytest.mark.parametrize(
    ("name", "title", "channel", "failed"),
    [
        ("Ann", "Ann live set", "Ann", []),
        ("Ann", "Anna live", "Ann", ["name", "position"]),
        ("Ann", "Ann Podcast", "Ann", ["performance", "cue"]),
        ("Radio Slave", "Radio Slave live", "radio slave", []),
        ("Album", "Album dj set", "Album", []),
        ("Meute", "warm up set for MEUTE live", "Meute", ["name", "position"]),
        ("Benji", "Benji B | Boiler Room London", "Boiler Room", ["continuation"]),
        ("Stenny", "Stenny Boiler Room Munich DJ Set", "Boiler Room", []),
        ("Ann", "Ann, Bo & Cy at X", "Boiler Room", ["billed"]),
        ("Ann", "[FULL SET] Ann | Boiler Room", "Boiler Room", []),
        ("Ann", "Hall | Ann live", "Ann", ["position"]),
        ("Ann", "Ann live", "a fan", ["channel"]),
        ("Nat", "Nat live", "Nat", ["channel"]),
        (None, None, None, ["channel", "name", "position"]),
        ("A.B", "AxB live", "A.B", ["name", "position"]),
    ],
)
def test_videos(spark, name, title, channel, failed):
    df = spark.createDataFrame([(name, title, channel)], "n string, t string, c string")
    r = df.select(evidence.video_match(F.col("n"), F.col("t"), F.col("c")).alias("v")).first()["v"]
    assert (r["accepted"], r["failed"]) == (not failed, failed)


def test_rules_are_replayed_over_stored_candidates(spark):
    c = [
        ("a", "Ann", 1, "Ann vlog", "Ann", 1, "primary", True, 1, "A"),
        ("a", "Ann", 2, "Ann live", "Ann", 2, "primary", True, 1, "A"),
        ("a", "Ann", 3, "Ann live", "Ann", 3, "primary", None, 1, "A"),
        ("b", "Bo", 4, "Bo vlog", "Bo", 1, "primary", True, 4, "A"),
        ("c", "Cy", 5, "Cy vlog", "Cy", 1, "primary", True, 5, "A"),
        ("c", "Cy", 6, "Cy talk", "Cy", 1, "fallback", True, 5, "A"),
        ("d", "Di", 7, "Di vlog", "Di", 1, "primary", True, 7, "manual"),
        ("e", "Ed", 8, "Ed live", "Ed", 1, "primary", True, None, "A"),
    ]
    df = spark.createDataFrame(c, "artist string, name string, video long, title string, channel string, published long, attempt string, verified boolean, chosen long, match_rule string")
    rules = [(1, "channel", None), (1, "name", None), (2, "channel", None), (2, "name", None), (2, "cue", None)]
    out = evidence.replayed(df, rules)
    got = {(r.artist, r.version): (r.outcome, r.alternative) for r in out.collect()}
    assert {k: v[0] for k, v in got.items() if k[1] == 1} == {("a", 1): "unchanged", ("b", 1): "unchanged", ("c", 1): "unchanged", ("d", 1): "manual_pin", ("e", 1): "not_replayable"}
    assert got["a", 2] == ("other_candidate_available", 2) and got["b", 2][0] == "needs_fallback_query" and got["c", 2][0] == "would_abstain"
    report = {(r.version, r.outcome): (r.artists, r.lost, r.gained) for r in evidence.replay_report(out).collect()}
    assert report[2, "would_abstain"] == (1, 1, 0) and report[1, "unchanged"] == (3, 0, 0)
    with pytest.raises(ValueError):
        evidence.replayed(df, [(1, "name", None)] * 1001)
