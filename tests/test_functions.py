import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from duskline.functions import genres, rules, text, time

CPH = ZoneInfo("Europe/Copenhagen")


def values(spark, rows, schema, **columns):
    return [r.asDict() for r in spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()]


def utc(*parts):
    return dt.datetime(*parts)


def night(ts):
    local = ts.replace(tzinfo=dt.UTC).astimezone(CPH).replace(tzinfo=None)
    return (local - dt.timedelta(days=local.hour < 6)).date()


def test_night_keys_around_clock_changes(spark):
    stamps = [utc(2026, 3, 29, h, m) for h in range(6) for m in (0, 30, 59)] + [utc(2026, 10, 25, h, m) for h in range(6) for m in (0, 30)] + [utc(2024, 1, 1, 4, 59), utc(2024, 1, 1, 5, 0)]
    got = values(spark, [(x,) for x in stamps], "t timestamp", n=time.night_key(F.col("t")))
    assert [g["n"] for g in got] == [night(x) for x in stamps]


def test_wall_clock_in_repeated_and_skipped_hours(spark):
    got = values(spark, [(utc(2026, 10, 25, 2, 30),), (utc(2026, 3, 29, 2, 30),), (utc(2026, 7, 1, 6, 0),), (utc(2026, 1, 1, 6, 0),)], "t timestamp", u=time.wall_to_utc(F.col("t")))
    assert [g["u"] for g in got] == [utc(2026, 10, 25, 1, 30), utc(2026, 3, 29, 1, 30), utc(2026, 7, 1, 4, 0), utc(2026, 1, 1, 5, 0)]


def test_prefilter_holds_all_that_is_not_past(spark):
    base = utc(2026, 10, 24, 0, 0)
    rows = [(base + dt.timedelta(hours=s), None if e is None else base + dt.timedelta(hours=s + e), base + dt.timedelta(hours=n)) for s in range(0, 96, 5) for e in (None, -3, 0, 4, 50) for n in range(0, 96, 7)]
    s, e, n = F.col("s"), F.col("e"), F.col("n")
    bad = spark.createDataFrame(rows, "s timestamp, e timestamp, n timestamp").where(~time.is_past(s, e, n) & ~F.coalesce(time.upcoming_candidate(s, e, n), F.lit(False)))
    assert bad.count() == 0


def test_urls(spark):
    cases = {
        "http://www.Example.org/a/?utm_source=x&b=2&a=1#room": "https://example.org/a?a=1&b=2#room",
        "https://example.org": "https://example.org/",
        " not a url ": "not a url",
        "https://example.org/x///?fbclid=1": "https://example.org/x",
        "": None,
        None: None,
    }
    got = values(spark, [(u,) for u in cases], "u string", n=text.normal_url(F.col("u")))
    assert [g["n"] for g in got] == list(cases.values())


def test_names(spark):
    rows = [("DJ Ö (DK)",), ("Ben  Klock https://x.y/z",), ("A: - a",), ("x.com/live Nina",), ("",), (None,)]
    got = values(spark, rows, "n string", k=text.artist_key(text.nfkd(F.col("n"))), s=text.slug(text.nfkd(F.col("n"))))
    assert [g["k"] for g in got] == ["dj o\u0308", "ben klock", "a", "nina", "", None]
    assert got[0]["s"] == "dj-o-dk"


def test_short_ways_give_what_the_long_ones_do(spark):
    """Plain names and single spaces pass by patterns; odd ones must not."""
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    rows = ["Moon Garden", "moon\n", "moon\tgarden", " moon", "moon ", "a  b", "a \n b", "a\u00a0b", "", " ", "\n", "The the DJ x Moon moon", "Moon (live)", "moon.com/x", "A: - a", "K\u00d8L night", "x" * 50 + " " * 3, None]
    words = F.array_distinct(F.filter(F.split("n", " "), lambda w: F.length(w) > 1))
    old = {"s": squeezed(F.col("n")), "p": squeezed(F.regexp_replace(F.lower("n"), r"[^a-z0-9\s]", "")), "a": squeezed(F.lower(F.regexp_replace(text.without_url_noise(F.col("n")), r"\s*\([^)]*\)\s*$", ""))), "w": F.array_except(words, F.array(*map(F.lit, text.GENERIC_TITLE_WORDS)))}
    n = F.col("n")
    new = {"s": text.squeezed(n), "p": text.plain_name(n), "a": text.artist_key(n), "w": text.title_words(n)}
    assert values(spark, [(r,) for r in rows], "n string", **new) == values(spark, [(r,) for r in rows], "n string", **old)
    assert "array_except" not in spark.createDataFrame([("a",)], "n string").select(new["w"])._jdf.queryExecution().optimizedPlan().toString()


def test_similarity_of_empty_sets_is_zero(spark):
    got = values(spark, [([], ["a"]), (["a", "b"], ["b"]), ([], [])], "a array<string>, b array<string>", j=text.jaccard(F.col("a"), F.col("b")), o=text.overlap(F.col("a"), F.col("b")))
    assert [(g["j"], g["o"]) for g in got] == [(0.0, 0.0), (0.5, 1.0), (0.0, 0.0)]


def test_tags(spark):
    rows = [(["hard-techno", "techno"],), (["house", "house"],), (["x", "electronic-other", "disco"],), ([],), (["ambient-experimental"],)]
    got = values(spark, rows, "t array<string>", p=genres.tag_problems(F.col("t")), w=genres.with_parents(F.col("t")), m=genres.primary_of(F.col("t")))
    assert [g["p"] for g in got] == [["parent-and-subgenre"], ["duplicate"], ["too-many", "unknown", "fallback-combined"], [], ["legacy"]]
    assert got[0]["w"] == ["hard-techno", "techno"] and got[3]["m"] == "electronic-other"
    assert set(genres.matched_by("ambient")) == {"ambient", "ambient-experimental"}


def test_genre_words_end_at_ascii_borders(spark):
    rows = [("éhouse night",), ("warehouse",), ('"Techno" and disco',), ("hard techno",), ("trance-like",), ("nothing",)]
    got = values(spark, rows, "t string", g=rules.first_genre(F.col("t")))
    assert [g["g"] for g in got] == ["house", None, "disco", "hard-techno", None, None]


def test_practical_sentences_and_languages(spark):
    rows = [("Doors 20:00.\nTickets 100 kr.", True, False), ("She plays slow records. Tickets at the door.", False, False), ("Det er en aften med musik og vi har det godt", False, True)]
    got = values(spark, [(r[0],) for r in rows], "t string", p=rules.practical_only(F.col("t")), d=rules.reads_as_danish(F.col("t")))
    assert [(g["p"], g["d"]) for g in got] == [r[1:] for r in rows]


def test_html(spark):
    got = values(spark, [("<head><title>x</title></head><p>a &amp; b<br>c</p><script>z</script><p>d</p>",), (None,)], "h string", t=text.html_text(F.col("h")), a=text.anchors(F.lit('<a class="k" href="/q">')))
    assert got[0] == {"t": "a & b\nc\n\nd", "a": ["/q"]} and got[1]["t"] is None
