"""Contrary genres in context, sentence by sentence."""

import pytest
from pyspark.sql import functions as F

from duskline.functions import relevance, spans


def signals(spark, rows):
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(rows)], "i int, t string, n array<string>")
    return [r.asDict() for r in relevance.with_signals(df, "t", "n").orderBy("i").collect()]


CASES = [
    # (text, names, families)
    ("a grime night", [], 1),
    ("blander chiptune, sludge metal, techno og hardcore punk", [], 3),
    ("indierock og elektroniske beats", [], 1),
    ("postpunk and goth", [], 2),
    ("Bingo Fuel plays all night", ["Bingo Fuel"], 0),
    ("bingo with Bingo Fuel", ["Bingo Fuel"], 1),
    ("Al plays jazz", ["Al"], 1),
    ("shaped by jazz, soul and disco roots", [], 0),
    ("influenced by house. A jazz night", [], 1),
    ("the way Nu Metal once redefined rock", [], 0),
    ("Han har tidligere spillet punk. Nu techno", [], 0),
    ("kunne han igen opleves på scenen til hiphop", [], 0),
    ("opened for a friend. Then punk", [], 1),
    ("just think of Daft Punk, Air and Justice", [], 0),
    ("Punk all night! Rock too", [], 2),
    ("det udsolgte hiphop-event KØL", [], 0),
    ("a hiphop event for all", [], 1),
    ("house and techno", [], 0),
    ("", [], 0),
    (None, None, 0),
]


def test_contrary_genres_in_context(spark):
    got = signals(spark, [c[:2] for c in CASES])
    assert [(c[0], r["families"]) for c, r in zip(CASES, got, strict=True)] == [(c[0], c[2]) for c in CASES]


def test_crossover_categories_and_claims(spark):
    rows = [
        ("a pop night", []),
        ("a pop-up bar", []),
        ("popular and popcorn", []),
        ("maksimalistisk EDM med R&B- og K-pop-inspirerede toplines", []),
        ("dansk popmusik", []),
        ("like pop", []),
    ]
    assert [r["crossover"] for r in signals(spark, rows)] == [True, False, False, False, True, False]
    rows = [("en vernissage", []), ("Kammermusikforeningen", []), ("Byvandring", []), ("Ølsmagning", []), ("wine after the show", []), ("workshop", ["Workshop"])]
    assert [r["contrary_category"] for r in signals(spark, rows)] == [True, True, True, True, False, False]
    rows = [("To af metalscenens navne", []), ("den britiske rapscene", []), ("a rock night", [])]
    assert [r["contrary_identity"] for r in signals(spark, rows)] == [True, True, False]
    rows = [("mørk electronica", []), ("spiller elektroniske beats", []), ("elektronisk produktion", [])]
    assert [r["electronic_claim"] for r in signals(spark, rows)] == [True, False, True]
    rows = [("trumpet, voice and electronics", []), ("drum machines and electronics", []), ("trumpet and electronics. " + "x" * 60 + " an electronic night", []), ("nothing", [])]
    assert [r["instruments_only"] for r in signals(spark, rows)] == [True, False, False, False]


@pytest.mark.parametrize(
    ("text", "genre", "rich", "ticketing", "artists", "level"),
    [
        ("techno", "techno", True, False, False, "strong"),
        ("a jazz night", None, True, False, False, "none"),
        ("EDM og trance, pop-punk og rock", "trance", True, False, False, "weak"),
        ("metalscenens navne med death metal og techno", "techno", True, False, False, "none"),
        ("jazz, folk, reggae and electronic music", None, True, False, False, "none"),
        ("trumpet, electronics, jazz, house", "house", True, False, False, "none"),
        ("nothing", "electronic-other", True, False, False, "weak"),
        ("nothing", None, True, True, False, "strong"),
        ("a pop night", "electronic-other", True, True, True, "weak"),
        ("a pop night of electronica", "electronic-other", True, False, False, "strong"),
        ("house-inspireret popmusik", "house", False, False, False, "weak"),
        ("house-inspireret popmusik", "house", False, True, False, "strong"),
        ("house popmusik", "house", True, False, False, "strong"),
        ("nothing", None, True, False, False, "none"),
    ],
)
def test_levels(spark, text, genre, rich, ticketing, artists, level):
    df = relevance.with_signals(spark.createDataFrame([(text, [], genre)], "t string, n array<string>, g string"), "t", "n")
    assert df.select(relevance.assessed(F.col("g"), F.lit(rich), F.lit(ticketing), F.lit(artists)).alias("r")).first()["r"] == level


def test_spans_and_masks(spark):
    df = spark.createDataFrame([("one two, ONE. none one",)], "t string")
    s = spans.spans(F.col("t"), F.lit(spans.word(r"\bone\b")))
    r = df.select(s.alias("s"), F.transform(s, lambda x: spans.before(F.col("t"), x, 4)).alias("b"), F.transform(s, lambda x: spans.after(F.col("t"), x, 3)).alias("a"), F.transform(s, lambda x: spans.sentence_before(F.col("t"), x)).alias("h")).first()
    assert [(x["start"], x["text"]) for x in r["s"]] == [(0, "one"), (9, "ONE"), (19, "one")]
    assert r["b"] == ["", "wo, ", "one "] and r["a"] == [" tw", ". n", ""] and r["h"] == ["", "one two, ", " none "]
    names = F.array(F.lit(" a.b "), F.lit(r"x\Ey"), F.lit("no"))
    assert spark.range(1).select(spans.masked(F.lit(r"A.B and aXb, X\eY no"), names).alias("m")).first()["m"] == "  and aXb,   no"


def test_word_edges_are_ascii_in_any_case(spark):
    """The long s and the Kelvin sign are s and k in any case, but no ASCII letters."""
    assert [r["families"] for r in signals(spark, [("ſjazz", []), ("jazzK", []), ("sjazz", []), ("jazz_", [])])] == [1, 1, 0, 0]
