import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from duskline.functions import rules, text
from duskline.sources import connectors
from duskline.streaming import runs


def test_paged_feed_knows_whether_it_is_whole(spark, tmp_path):
    item = lambda i: {"title": f"t{i}", "start": "2024-01-01T20:00:00Z", "lineup": ["a"]}
    for n in (1, 2):
        (tmp_path / f"page-{n}.json").write_text(json.dumps({"total": 4, "items": [item(2 * n), item(2 * n + 1)]}))
    feed = connectors.paged_feed(spark, str(tmp_path))
    assert {(r["title"], tuple(r["lineup"])) for r in connectors.candidates(feed).collect()} == {(f"t{i}", ("a",)) for i in range(2, 6)}
    assert connectors.fetch_state(feed).first()["complete"]
    (tmp_path / "page-3.json").write_text("{broken")
    state = connectors.fetch_state(connectors.paged_feed(spark, str(tmp_path))).first()
    assert (state["complete"], state["problems"], state["items"]) == (False, 1, 4)


def test_paged_feed_has_no_cap_and_tells_of_gaps(spark, tmp_path):
    for n in [*range(1, 41), 43]:
        (tmp_path / f"page-{n}.json").write_text(json.dumps({"items": [{"title": f"t{n}", "start": "2024-01-01T20:00:00Z"}] * (n != 40)}))
    feed = connectors.paged_feed(spark, str(tmp_path))
    assert sorted(r["page"] for r in feed.where("problem IS NOT NULL").collect()) == [41, 42]
    assert tuple(connectors.fetch_state(feed).first()) == (40, None, 2, False)


class Api:
    """A feed of so many items, 3 a page, that fails when told to."""

    def __init__(self, items):
        self.items, self.calls, self.failing = items, [], {}

    def __call__(self, after):
        self.calls.append(after)
        if self.failing.get(after, 0):
            self.failing[after] -= 1
            raise ConnectionError("503")
        at = 0 if after is None else int(after) + 1
        return {"items": [{"id": str(i), "title": f"t{i}", "start": "2024-01-01"} for i in range(at, min(at + 3, self.items))]}


def test_a_feed_cut_at_page_seven_goes_on_there(spark, tmp_path):
    api, pages = Api(100), connectors.Pages(spark, f"file://{tmp_path}/pages")
    api.failing = {"2": 1, "17": 5}
    land = lambda: connectors.land_pages(pages, api, 3, lambda x: x["id"], wait=0)

    def taken():
        stream = connectors.page_stream(spark, f"{tmp_path}/pages", each=4)
        keep = lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
        runs.run_available(stream, keep, f"{tmp_path}/checkpoint").awaitTermination(60)
        return sorted(json.loads(r["item"])["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    with pytest.raises(connectors.FetchFailed, match="page 7"):
        land()
    assert pages.last() == 6 and taken() == sorted(map(str, range(18)))
    api.failing, api.calls = {}, []
    assert land() == 34 and api.calls[0] == "17" and len(api.calls) == 28
    assert taken() == sorted(map(str, range(100)))
    assert land() == 34 and connectors.fetch_state(connectors.paged_feed(spark, f"{tmp_path}/pages")).first()["items"] == 100


def test_feeds_that_end_early_or_are_refused(spark, tmp_path):
    def pages(name):
        return connectors.Pages(spark, f"file://{tmp_path}/{name}")

    assert connectors.land_pages(pages("empty"), Api(0), 3, lambda x: x["id"]) == 1
    assert connectors.land_pages(pages("full"), Api(6), 3, lambda x: x["id"]) == 2
    stuck = lambda after: {"items": [{"id": "9"}] * 3}
    assert connectors.land_pages(pages("stuck"), stuck, 3, lambda x: x["id"]) == 1
    calls = []

    def refused(after):
        calls.append(after)
        raise PermissionError("401")

    with pytest.raises(connectors.FetchFailed):
        connectors.land_pages(pages("refused"), refused, 3, lambda x: x["id"], wait=0)
    assert len(calls) == 1


def test_cities_and_categories(spark):
    rows = [(1, "København K", None), (2, "Aarhus", "1050"), (3, None, "DK-2100"), (4, None, None), (5, " ", "8000")]
    df = spark.createDataFrame(rows, "id int, city string, postal string")
    assert [r.id for r in connectors.in_city(df, F.col("city"), ["københavn", "copenhagen"], F.col("postal"), (1000, 2500)).orderBy("id").collect()] == [1, 3]
    df = spark.createDataFrame([("edm", None), ("jazz", "house"), (None, "house"), ("jazz", None)], "c string, g string")
    genre, kind = connectors.category_genre(F.col("c"), {"edm": "electronic-other"}, F.col("g"))
    assert [tuple(r) for r in df.select(genre.alias("g"), kind.alias("k")).collect()] == [("electronic-other", "official-source-metadata"), ("house", "deterministic-mapping"), ("house", "official-description"), (None, None)]


def test_json_ld(spark):
    block = json.dumps({"@type": "MusicEvent", "name": "Night", "startDate": "2024-01-01", "location": {"name": "Hall"}, "offers": {"url": "t", "price": 90}, "performer": [{"name": "A"}]})
    html = f'<script type="application/ld+json">{block}</script><script type="application/ld+json">{{"@type":"Place"}}</script><script>x</script>'
    rows = connectors.jsonld_events(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).collect()
    assert [(r["page_id"], r["title"], r["venue"], r["price"], r["lineup"]) for r in rows] == [(1, "Night", "Hall", 90.0, ["A"])]


def test_listing_and_details(spark):
    pages = spark.createDataFrame([(1, '<a href="/e/1">x</a><a href="/e/2">y</a>'), (2, '<a href="/e/1">x</a>')], "page_id long, html string")
    links = connectors.listing_links(pages, pattern="/e/")
    assert {tuple(r) for r in links.collect()} == {("/e/1", 1, 0), ("/e/2", 1, 1)}
    out = connectors.details(links.select("target"), spark.createDataFrame([("/e/1", "<p>")], "url string, html string"), F.col("target") == F.col("url"))
    assert {(r["target"], r["problem"]) for r in out.collect()} == {("/e/1", None), ("/e/2", "not fetched: /e/2")}


def test_free_text_dates(spark):
    df = spark.createDataFrame([(1, "Welcome\n12. jan 2024 kl. 22.30 Deep Night\n3/2: Other")], "page_id long, t string")
    got = {(r["title"], r["start"]) for r in connectors.free_text_candidates(df, "t", 2024).collect()}
    assert got == {("Deep Night", dt.datetime(2024, 1, 12, 22, 30)), ("Other", dt.datetime(2024, 2, 3, 20, 0))}
    assert spark.range(1).select(connectors.decoded(F.lit(bytearray("blåbær".encode("latin-1")))).alias("t")).first()["t"] == "blåbær"


def test_genre_claims_and_profiles(spark):
    rows = [("hard techno and techno, then house", ["House Of Lords"]), ("Disco by House of Lords", ["House of Lords"]), (None, None)]
    df = spark.createDataFrame(rows, "t string, n array<string>")
    got = df.select(rules.all_genres(F.col("t")).alias("g"), rules.genre_names_masked(F.col("t"), F.col("n")).alias("m")).collect()
    assert [[(x["name"], x["start"]) for x in r["g"]] for r in got] == [[("hard-techno", 0), ("techno", 16), ("house", 29)], [("disco", 0), ("house", 9)], []]
    assert got[1]["m"] == "Disco by  "
    p = spark.createDataFrame([("https://www.soundcloud.com/Ann/",), ("https://soundcloud.com/ann/track",), ("",)], "u string").select(text.profile(F.col("u")).alias("p")).collect()
    assert [(r["p"]["url"], r["p"]["rejected"]) for r in p] == [("https://soundcloud.com/ann", None), (None, "not-a-profile"), (None, "empty")]


def test_stream_delivers_each_key_once(spark, tmp_path):
    schema = "user_id long, event_id long"
    spark.createDataFrame([(1, 1), (1, 1), (1, 2)], schema).write.parquet(f"{tmp_path}/in")
    out = runs.Deliveries(spark, f"{tmp_path}/out", ["user_id", "event_id"], f"{schema}, batch int")
    go = lambda name: runs.run_available(runs.log_stream(spark, f"{tmp_path}/in", schema), out.deliver, f"{tmp_path}/{name}").awaitTermination(60)
    assert go("c1")
    spark.createDataFrame([(1, 2), (2, 2)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    assert go("c1") and sorted(map(tuple, out.stored().select("user_id", "event_id").collect())) == [(1, 1), (1, 2), (2, 2)]
    out.deliver(spark.createDataFrame([(2, 2)], schema), 1)
    assert out.stored().count() == 3


def test_incomplete_runs_make_nothing_stale(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    sources = spark.createDataFrame([("a", t(1)), ("b", t(1)), ("c", t(1))], "source_id string, last_complete_at timestamp")
    ran = spark.createDataFrame([("a", True, 5, t(3)), ("b", False, 5, t(3)), ("c", True, 0, t(3))], "source_id string, complete boolean, found int, ran_at timestamp")
    after = runs.mark_complete(sources, ran)
    assert {r[0]: r[1] for r in after.collect()} == {"a": t(3), "b": t(1), "c": t(1)}
    rows = spark.createDataFrame([(i, s, t(2)) for i, s in enumerate("abc")], "id int, source_id string, last_seen_at timestamp")
    assert [r["source_id"] for r in runs.stale(rows, after).collect()] == ["a"]


def test_identity_reconciliation(spark):
    artists = spark.createDataFrame([("ann", "u/ann", "A1"), ("bob", None, "B1"), ("cy", "u/c1", "C1"), ("cy", "u/c2", "C2")], "name_key string, profile string, artist_id string")
    seen = spark.createDataFrame([(1, "ann", "Ann", None), (2, "ann", "Ann", "u/other"), (3, "cy", "Cy", "u/c2"), (4, "cy", "Cy", None), (5, "new", "New", None), (6, "bob", "Bob", "u/bob")], "event_id long, name_key string, name string, profile string")
    got = {r["event_id"]: (r["artist_id"], r["confidence"], r["action"]) for r in runs.reconcile_names(seen, artists).collect()}
    assert got[1] == ("A1", "medium", "link") and got[3] == ("C2", "high", "link") and got[6] == ("B1", "high", "link")
    assert [got[i][1:] for i in (2, 4, 5)] == [("review", "create"), ("review", "create"), ("medium", "create")]


def test_ingest_splits_a_batch(spark):
    stored = spark.createDataFrame([("u1", "a", 1, ["title"]), ("u2", "b", 2, [])], "url string, title string, price int, locked array<string>")
    new = spark.createDataFrame([("u1", "x", 5, 1), ("u2", "b", 2, 2), ("u3", "c", 3, 3), ("u3", "d", 4, 4)], "url string, title string, price int, ord int")
    create, patches = runs.ingest(new, stored, "url", ["title", "price"])
    assert [tuple(r) for r in create.collect()] == [("u3", "d", 4)]
    assert {r["url"]: r["patch"] for r in patches.collect()} == {"u1": {"price": "5"}}
