from pyspark.sql import functions as F

from duskline.operators import decisions, joins, lineups, sinks


def test_upsert_twice_changes_nothing(spark):
    stored = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (None, "n", "n")], "k int, v string, first string")
    new = spark.createDataFrame([(2, "c", "y"), (3, "d", "z")], "k int, v string, first string")
    once = joins.upsert(stored, new, ["k"], keep_first=("first",))
    twice = joins.upsert(once, new, ["k"], keep_first=("first",))
    expected = {(1, "a", "x"), (2, "c", "y"), (3, "d", "z"), (None, "n", "n")}
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in twice.collect()} == expected


def test_insert_absent_and_set_plan(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    b = spark.createDataFrame([(2, 3.0), (3, 4.0), (3, 4.0)], "k int, v double")
    assert {tuple(r) for r in joins.insert_absent(a, b, ["k"]).collect()} == {(1, 1.0), (2, 2.0), (3, 4.0)}
    plan = joins.set_plan(a, b.distinct(), ["k"], "v", F.lit(False))
    assert {tuple(r) for r in plan.collect()} == {(1, "suppressed-delete", 1.0), (2, "update", 3.0), (3, "insert", 4.0)}


def test_series_keys(spark):
    df = spark.createDataFrame([("Deep Sea Sessions: Nina",), ("Nina x Otto",)], "t string")
    got = df.select(decisions.series_keys(F.col("t"), F.array(F.lit("sessions"))).alias("k")).collect()
    assert [sorted(r["k"]) for r in got] == [["deep sea"], []]


def test_large_side_is_not_broadcast(spark):
    small, large = spark.range(5), spark.range(1000)
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(joins.small_side(small, 10)) and not hinted(joins.small_side(large, 10))


def test_links_beside_a_lineup(spark):
    events = spark.createDataFrame([(1, ["Ann", "Bo", "Ann", "Cy b2b Di"]), (2, ["Ann"]), (3, None)], "event_id int, artists array<string>")
    own = spark.createDataFrame([(1, "Ann", "a1", False, 1), (1, "Ann", "a2", True, 0), (1, "Gone", "g", True, 0)], "event_id int, name string, url string, manual boolean, ord int")
    rows = [(1, "Bo", "Bo", "b"), (1, "Bo", "bo", "b"), (1, "Cy b2b Di", "Cy", "c"), (2, "Ann", "Ann", "x"), (2, "Ann", "Ann", "y")]
    reused = lineups.reused_links(spark.createDataFrame(rows, "event_id int, entry string, other_entry string, url string"))
    shown = lineups.shown_links(events, own, reused)
    assert sorted(map(tuple, shown.collect())) == [(1, 0, "Ann", "a2"), (1, 1, "Bo", "b")]
    assert {r.event_id: r.has_links for r in lineups.with_availability(events, shown).collect()} == {1: True, 2: False, 3: False}
    assert lineups.shown_links(events, own.limit(0), reused.limit(0)).count() == 0


def test_venues_are_planned_by_those_there_are(spark):
    registry = spark.createDataFrame([("the hall", 0, 1, "v1", None), ("black box", 2, 2, "v2", "Black Box")], "key string, priority int, ord long, venue_id string, sub_venue string")
    rows = [(1, " The  HALL! ", False), (2, "Red Box", False), (3, "Red Box", True), (4, "Black Box", False), (5, "New & Old", False), (6, None, False)]
    got = lineups.planned_venues(spark.createDataFrame(rows, "id int, name string, confirmed boolean"), registry)
    assert {r.id: (r.plan, r.venue_id) for r in got.collect()} == {1: ("existing", "v1"), 2: ("needs_confirmation", None), 3: ("create", "v-red-box"), 4: ("existing", "v2"), 5: ("create", "v-new-and-old"), 6: ("create", None)}


def test_an_insert_writes_three_tables_of_the_same_events(spark):
    new = spark.createDataFrame([(1, "a", "o1", "t1"), (2, "b", None, None), (2, "a2", None, "t2"), (3, "c", "o3", None)], "event_id int, slug string, official_url string, ticket_url string")
    events, links, log = sinks.inserted(new, spark.createDataFrame([(3,)], "event_id int"), "src", F.lit("2024-01-15").cast("timestamp"))
    assert {(r.event_id, r.slug) for r in events.collect()} == {(1, "a"), (2, "a2")}
    assert {(r.event_id, r.role, r.url) for r in links.collect()} == {(1, "official", "o1"), (1, "ticket", "t1"), (2, "ticket", "t2")}
    assert {(r.event_id, tuple(r.fields_changed)) for r in log.collect()} == {(1, ("official_url", "slug", "ticket_url")), (2, ("slug", "ticket_url"))}
