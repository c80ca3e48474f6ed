import datetime as dt

from pyspark.sql import functions as F

from duskline.functions import filters, rules
from duskline.operators import pipeline

T = dt.datetime
RAW = "candidate_id int, title string, venue string, start timestamp, url string, lineup array<string>, description string, genre_hint string"
STORED = "event_id int, title string, venue_id string, start timestamp, url string, lineup array<string>"
REGISTRY = "key string, priority int, ord long, venue_id string, sub_venue string"


def test_ingest_chain(spark):
    night = T(2024, 1, 20, 22)
    raw = [
        (1, "Warehouse  Rave", "The Hall", night, "https://x.y/1", ["Ann", "ann", "Bob"], "hard techno all night", None),
        (2, "Deep Sea Sessions", "red room", night, "https://x.y/2", ["Cleo"], None, "techno"),
        (3, "Rock evening", "The Hall", night, "https://x.y/3", [], "a rock show", None),
        (4, "Deep Sea", "nowhere", night, None, [], "", None),
        (5, "Silent", "The Hall", night, "https://x.y/5", ["Known"], "soft sounds", None),
    ]
    registry = spark.createDataFrame([("the hall", 0, 1, "v1", None), ("red room", 2, 1, "v1", "Red Room")], REGISTRY)
    stored = spark.createDataFrame([(10, "Deep Sea Sessions", "v1", night, "http://www.x.y/2/", ["Cleo"]), (11, "Other", "v1", night, None, ["Zed"])], STORED)
    out = pipeline.ingest_pipeline(spark.createDataFrame(raw, RAW), registry, stored)
    got = {r["candidate_id"]: r for r in out.collect()}
    assert (got[1]["genre"], got[1]["title"], got[1]["lineup"], got[1]["venue_id"]) == ("hard-techno", "Warehouse Rave", ["Ann", "Bob"], "v1")
    assert (got[1]["relevance"], got[1]["decision"]) == ("strong", "review_queue")
    assert (got[2]["sub_venue"], got[2]["duplicate_of"], got[2]["duplicate_confidence"], got[2]["decision"]) == ("Red Room", 10, "high", "auto_publish")
    assert (got[3]["decision"], got[3]["hold_reason"]) == ("hold", "negative_relevance")
    assert (got[4]["venue_id"], got[4]["hold_reason"]) == (None, "incomplete_data")
    assert got[5]["hold_reason"] == "no_genre_evidence"
    cache = spark.createDataFrame([("known", "disco", T(2024, 3, 1)), ("bob", "house", T(2023, 1, 1))], "key string, genre string, expires_at timestamp")
    again = {r["candidate_id"]: r for r in pipeline.enriched(out, cache, F.lit("2024-01-15").cast("timestamp")).collect()}
    assert (again[5]["genre"], again[5]["genre_confidence"], again[5]["decision"]) == ("disco", "medium", "review_queue")
    assert again[1]["genre"] == "hard-techno"


def test_filters_round_trip(spark):
    f = filters.parse({"mode": "tonight", "genre": "techno", "venue": "the-hall", "q": "  Ann "})
    assert filters.parse(f.parameters()) == f and f.parameters() == {"mode": "tonight", "genre": "techno", "venue": "the-hall", "q": "Ann"}
    assert filters.parse({"mode": "x", "genre": "polka", "venue": "A b", "q": "y" * 300}) == filters.Filters(query="y" * 200, unknown_genre="polka")
    events = spark.createDataFrame([(1, T(2024, 1, 15, 21), ["hard-techno"], "the-hall", "Ann live"), (2, T(2024, 1, 16, 21), ["techno"], "the-hall", "Ann"), (3, T(2024, 1, 15, 21), ["house"], "the-hall", "Ann")], "id int, start timestamp, tags array<string>, venue_slug string, search_text string")
    assert [r["id"] for r in filters.apply(events, f, F.lit("2024-01-15 12:00:00").cast("timestamp")).collect()] == [1]


def test_small_decisions(spark):
    df = spark.createDataFrame([("techno then disco", "techno"), ("techno, house, disco", "techno"), ("deep house and tech house", "house")], "t string, p string")
    got = df.select(pipeline.secondary_genre(rules.all_genres(F.col("t")), F.col("p")).alias("s")).collect()
    assert [r["s"] for r in got] == ["disco", None, None]
    releases = spark.createDataFrame([("a", ["Techno", "Odd"]), ("a", ["Techno"]), ("b", ["House", "Disco"])], "k string, styles array<string>")
    assert {r["k"]: r["genre"] for r in pipeline.style_genre(releases, "k").collect()} == {"a": "techno", "b": None}
    links = spark.range(1).select(pipeline.external_links(F.lit("https://a.b/x"), F.lit("http://www.a.b/x/"), F.lit(None).cast("string"), F.array(F.lit("https://c.d"))).alias("l")).first()["l"]
    assert [(x["role"], x["url"]) for x in links] == [("official", "https://a.b/x"), ("other", "https://c.d")]
    assert spark.range(1).select(pipeline.display_title(F.lit("The Hall: Night"), F.lit("the hall")).alias("t")).first()["t"] == "Night"


def test_alert_plan(spark):
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    d = [(1, i, T(2024, 1, 16 + i), T(2024, 1, 14), True, True) for i in range(3)] + [(1, 9, T(2024, 1, 15, 13), T(2024, 1, 14), True, True), (2, 1, T(2024, 1, 17), T(2024, 1, 14), True, True), (3, 1, T(2024, 1, 17), T(2024, 1, 1), True, True)]
    deliveries = spark.createDataFrame(d, "subscriber_id int, event_id int, start timestamp, created_at timestamp, public boolean, alertable boolean")
    sent = spark.createDataFrame([(2, T(2024, 1, 15, 1))], "subscriber_id int, sent_at timestamp")
    got = {(r["subscriber_id"], r["event_id"]): r["plan"] for r in pipeline.alert_run(deliveries, sent, now, per_email=2).collect()}
    assert got == {(1, 0): "send", (1, 1): "send", (1, 2): "wait", (1, 9): "drop", (2, 1): "wait", (3, 1): "drop"}


def test_reports_and_plans(spark):
    events = spark.createDataFrame([(1, T(2024, 1, 2), ["B", "A"]), (2, T(2024, 1, 1), ["A", "C"])], "event_id int, start timestamp, lineup array<string>")
    plan = pipeline.link_plan(events, spark.createDataFrame([("c",)], "key string"), 5)
    assert [r["key"] for r in plan.collect()] == ["a", "b"]
    names = spark.createDataFrame([("a", "A"), ("a", "A"), ("b", "B")], "key string, name string")
    cache = spark.createDataFrame([("a", "accepted", "exact", False)], "key string, status string, match_rule string, manual boolean")
    assert {r["key"]: (r["events"], r["status"]) for r in pipeline.name_report(names, cache).collect()} == {"a": (2, "accepted"), "b": (1, "not_looked_up")}
    q = spark.createDataFrame([("pending", "t", "x", None, "v", "v", None, None, "house", "low", []), ("published", "t", "x", None, "v", "v", None, None, None, "low", [])], "status string, old_title string, new_title string, old_genre string, old_venue_id string, new_venue_id string, old_start timestamp, new_start timestamp, new_genre string, new_genre_confidence string, locked array<string>")
    assert [r["patch"] for r in pipeline.queue_patch(q).collect()] == [{"title": "x", "genre": "house"}]
