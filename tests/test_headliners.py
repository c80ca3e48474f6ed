"""Headliners by their signals, case by case."""

import pytest
from pyspark.sql import functions as F

from duskline.operators import headliners

EVENT = "event_id int, title string, artists array<string>, description string, image string"


@pytest.mark.parametrize(
    ("title", "artists", "description", "image", "expected"),
    [
        ("Night", ["Ann"], None, None, {"Ann": "documented"}),
        ("Kasper Bjørke live", ["Opener", "Kasper Bjørke"], None, None, {"Kasper Bjørke": "documented"}),
        ("Ann + Bo", ["Ann", "Bo"], None, None, {}),
        ("Annabel", ["Ann", "Bo"], None, None, {}),
        ("Night", ["Opener", "Animal Trainer"], "Animal Trainer jets in to headline, with Opener warming up.", None, {"Animal Trainer": "documented"}),
        ("Night", ["Opener", "Ann", "Bo"], "Ann and Bo headline. Opener opens.", None, {"Ann": "documented", "Bo": "documented"}),
        ("Night", ["Opener", "Ann"], "Aftenens hovednavn er Ann efter Opener.", None, {"Ann": "documented"}),
        ("Night", ["Real Headliner", "Ann"], "With Real Headliner and more.", None, {"Real Headliner": "supported_prioritized"}),
        ("Night", ["Annika", "Bo"], "Bo plays too", "https://x.dk/i/annika-poster.jpg?w=1", {"Annika": "supported_prioritized"}),
        ("Night", ["Annika", "Boris"], "Boris, Annika", "https://x.dk/boris.png", {"Boris": "supported_prioritized"}),
        ("Night", ["Annika", "Boris"], "Annika, Boris", "https://x.dk/boris_annika.png", {"Annika": "supported_prioritized"}),
        ("Night", ["Annika", "Boris"], None, None, {}),
        ("Night", ["A one", "B two", "C three", "D four"], "A one", None, {}),
        ("Night", ["TBA", "Ann"], None, None, {"Ann": "documented"}),
        ("Night", ["ANN", "ann", "Bo"], "Ann", None, {"ANN": "supported_prioritized"}),
        (None, None, None, None, {}),
        ("", [], "", "", {}),
    ],
)
def test_headliners(spark, title, artists, description, image, expected):
    df = spark.createDataFrame([(1, title, artists, description, image)], EVENT)
    assert {r.artist: r.confidence for r in headliners.headliners(headliners.signals(df)).collect()} == expected


def test_two_with_as_much_support_are_none(spark):
    rows = [(1, 0, "a", "A", "x", "order"), (1, 0, "a", "A", "y", "asset"), (1, 1, "b", "B", "z", "prose"), (1, 1, "b", "B", "y", "asset"), (2, 0, "a", "A", "x", "order"), (2, 0, "a", "A", "w", "order")]
    assert headliners.headliners(spark.createDataFrame(rows, "event_id int, place int, name string, artist string, signal string, group string")).count() == 0


def test_subjects_of_cues(spark):
    said = lambda s, *names: spark.range(1).select(headliners.cue_subjects(F.lit(s), F.array(*map(F.lit, names))).alias("s")).first()["s"]
    assert sorted(said("A one, B two & C three headline, then D", "a one", "b two", "c three", "d")) == ["a one", "b two", "c three"]
    assert said("A one warms up before B two headlines", "a one", "b two") == ["b two"]
    assert said("no cue for A one", "a one") == [] and said("the headliner", "a one") == []
