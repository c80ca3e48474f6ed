"""Costly expressions and texts are worked out once, whatever refers to them."""

from pyspark.sql import functions as F

from duskline.functions import rooms, text
from duskline.operators import evidence, headliners, pipeline, sinks
from duskline.plans import catalogue


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_normal_url_reads_each_part_once(spark):
    df = spark.createDataFrame([("https://x.dk/a?b=1#c",)], "u string")
    assert optimized(df.select(text.normal_url(F.col("u")).alias("n"))).count("regexp_extract") == 3


def test_links_are_made_normal_once(spark):
    df = spark.createDataFrame([("https://x.dk/a", "http://www.x.dk/a/?utm_source=b", None, ["https://x.dk/a#c", " ", None])], "o string, t string, l string, m array<string>")
    out = df.select(pipeline.external_links(F.col("o"), F.col("t"), F.col("l"), F.col("m")).alias("links"))
    assert optimized(out).count("regexp_extract") == 3
    assert [tuple(x) for x in out.first()["links"]] == [("official", "https://x.dk/a"), ("other", "https://x.dk/a#c")]


def test_a_line_is_told_once(spark):
    df = spark.createDataFrame([("Night", "Main floor:\nAda (live)\n\nDen Anden Ende: Bo", ["Ada", "Bo", "(x)"], "Hall")], "title string, description string, artists array<string>, venue string")
    out = rooms.with_rooms(df).select("room_verdict", "main_room", "small_room", "room_reason")
    assert optimized(out).count("den anden (?:side|ende)") == 3
    assert out.first()[3] == "in no room: (x)"


def test_signals_are_found_once(spark):
    df = spark.createDataFrame([(1, "A night with ada", ["Ada", "Bo", "ada"], "Bo headlines.", None)], "event_id long, title string, artists array<string>, description string, image string")
    out = headliners.headliners(headliners.signals(df))
    assert optimized(out).count("posexplode") == 1
    assert {tuple(r) for r in out.collect()} == {(1, "Ada", "documented"), (1, "Bo", "documented")}


def test_labels_are_found_once(spark):
    df = spark.createDataFrame([(1, ["Ada", "Bo"], "Ada: https://soundcloud.com/a\nBo (x): https://soundcloud.com/b https://soundcloud.com/c"), (2, ["Ada", "ada"], "Ada: https://soundcloud.com/d"), (3, ["Ada"], "ADA https://soundcloud.com/e")], "event_id long, artists array<string>, text string")
    out = evidence.paired_profiles(df)
    assert optimized(out).count("posexplode") == 0  # pairs are stored
    assert {(r["event_id"], r["entry"], r["url"][-1], r["conflict"]) for r in out.collect()} == {(1, "Ada", "a", "two_handles_same_key"), (1, "Bo", "b", "two_handles_same_event"), (1, "Bo", "c", "two_handles_same_event"), (3, "Ada", "e", "two_handles_same_key")}


def test_words_of_texts_are_found_once(spark, tmp_path):
    rows = [(1, "s", "en", "Ab, cd\tAB\x0bcd\r\nx é1"), (2, "s", "en", "cd ab"), (3, "s", "en", "é x"), (4, "s", None, None), (5, None, "en", "ab-cd ef"), (6, "s", "en", "ab\xa0cd")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = catalogue.QUERIES["token_classes"](spark, str(tmp_path))
    assert optimized(out).count("regexp_replace") == 1
    import duckdb

    from duskline.plans.catalogue import ORACLES

    with duckdb.connect() as c:
        c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        known = c.execute("select class_id, members, source, lang from (" + ORACLES["token_classes"] + ")").fetchall()
    assert sorted(map(tuple, out.collect()), key=str) == sorted(known, key=str)


def test_new_events_are_not_sorted_by_split(spark):
    new = spark.createDataFrame([(1, "b", "u", None), (1, "a", None, "t"), (2, "c", None, None)], "event_id long, slug string, official_url string, ticket_url string")
    events, links, log = sinks.inserted(new, new.where("event_id = 2"), "s", F.lit(None).cast("timestamp"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = events._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    dealt = next(i for i, x in enumerate(plan) if "REPARTITION_BY_NUM" in x)
    assert not any("Aggregate" in x for x in plan[dealt:])
    assert [tuple(r) for r in links.select("event_id", "role", "url").collect()] == [(1, "ticket", "t")]
    assert [r[0] for r in log.select("fields_changed").collect()] == [["slug", "ticket_url"]]
