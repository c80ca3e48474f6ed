"""What depends on the order of rows, against sequential loops over random batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from duskline.operators import matching
from duskline.sources.tables import checkpointed

RAW = "id long, start timestamp, venue string, sub_venue string, title string, lineup array<string>, urls array<string>, eligible boolean, source string, rank int"


def made(spark, rows):
    df = spark.createDataFrame(rows, RAW).repartition(3)
    f = matching.features(df, "id", F.col("start"), F.col("venue"), F.col("sub_venue"), F.col("title"), F.col("lineup"), F.col("urls"))
    return f.join(df.select("id", "eligible", "source", "rank"), "id").cache()


def random_rows(rng, n, first=0, spread=600):
    words = ["deep", "sea", "moon", "warehouse", "garden", "acid", "night"]
    out = []
    for i in range(first, first + n):
        start = dt.datetime(2024, 1, 20, 20) + dt.timedelta(minutes=rng.choice([0, 30, 90, 150, spread * 3]))
        url = rng.choice([None, f"https://x.dk/{rng.randint(0, 5)}", f"https://box.dk/a#{rng.choice(['red', 'black'])}"])
        out.append((i, start, rng.choice(["v1", "v1", "v2", None]), rng.choice([None, None, "r1", "r2"]), " ".join(rng.sample(words, rng.randint(0, 3))), rng.sample(["Ann", "Bob", "Cy", "Di"], rng.randint(0, 2)), [url] if url else None, rng.random() < 0.7, rng.choice(["s1", "s2", "s3"]), None))
    ranks = rng.sample(range(n), n)
    return [(*r[:-1], k) for r, k in zip(out, ranks, strict=True)]


def night(start):
    return (start + dt.timedelta(hours=1) - dt.timedelta(hours=6)).date()


def confidence(a, b):
    """The rules on rows of plain Python."""
    base = lambda u: u.split("#")[0]
    room = lambda u: u.split("#")[1] if "#" in u else None
    ua, ub = a[6] or [], b[6] or []
    if night(a[1]) != night(b[1]) or any(base(x) == base(y) and room(x) and room(y) and room(x) != room(y) for x in ua for y in ub):
        return "none"
    same = a[2] is not None and a[2] == b[2]
    if same and a[3] and b[3] and a[3] != b[3]:
        return "none"
    generic = {"night", "deep"}
    wa, wb = (({*r[4].split()} - generic) for r in (a, b))
    t = len(wa & wb) / len(wa | wb) if wa and wb else 0
    la, lb = ({x.lower() for x in r[5]} for r in (a, b))
    o = len(la & lb) / min(len(la), len(lb)) if la and lb else 0
    conflict = bool(la) and bool(lb) and o == 0 and t < 0.6
    if set(ua) & set(ub):
        return "medium" if conflict else "high" if same or a[2] is None or b[2] is None else "medium"
    if conflict:
        return "none"
    if not same:
        return "medium" if o >= 0.5 and t >= 0.3 else "none"
    return "high" if o >= 0.5 and t >= 0.4 else "medium" if o > 0 or t >= 0.25 else "none"


@pytest.mark.parametrize("seed", range(3))
def test_duplicates_are_all_pairs_that_the_rules_name(spark, seed):
    rows = random_rows(random.Random(seed), 40)
    f = made(spark, rows)
    got = {(r.left_id, r.right_id): r.confidence for r in matching.duplicates(f, f, within=True).collect()}
    every = {(a[0], b[0]): confidence(a, b) for a in rows for b in rows if a[0] < b[0]}
    assert got == {k: c for k, c in every.items() if c != "none"} and len(set(got.values())) == 2


@pytest.mark.parametrize("seed", range(3))
def test_batch_sees_its_own_writes_as_a_loop_does(spark, seed):
    rng = random.Random(10 + seed)
    rows, stored = random_rows(rng, 40), random_rows(rng, 4, first=1000)
    rank = {"high": 0, "medium": 1}
    there, expected = [("stored", s) for s in stored], {}
    for r in rows:
        found = [(rank[c], where != "stored", o[0], where, c) for where, o in there if (c := confidence(r, o)) != "none"]
        stands = r[7] and not found
        best = min(found) if found else (None, None, None, None, "none")
        expected[r[0]] = (stands, best[2], best[3], best[4])
        if stands:
            there.append(("batch", r))
    got = {r.id: tuple(r[1:]) for r in matching.visible_in_batch(made(spark, rows), made(spark, stored)).collect()}
    assert got == expected


@pytest.mark.parametrize("crowd", [0, 3])
def test_crowded_nights_of_a_venue_meet_by_rare_words(spark, monkeypatch, crowd):
    monkeypatch.setattr(matching, "CROWD", crowd)
    test_duplicates_are_all_pairs_that_the_rules_name(spark, 5)
    test_batch_sees_its_own_writes_as_a_loop_does(spark, 5)


def test_what_is_compared_meets_in_one_join(spark):
    """A pair is assessed where it is made: ids don't go back for words, keys and URLs, and candidates and stored rows are shuffled once."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        f = checkpointed(made(spark, random_rows(random.Random(6), 40)))
        found = matching.duplicates(f, f, within=True)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
        found.collect()
        assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, kept)


def test_events_without_a_night_are_no_duplicates(spark):
    rows = [(i, None, "v1", None, "Moon Garden", ["Ann"], ["https://x.dk/1"], True, "s", i) for i in range(3)]
    f = made(spark, rows)
    assert matching.duplicates(f, f, within=True).isEmpty()
    assert {r.published for r in matching.visible_in_batch(f, f.limit(0)).collect()} == {True}


def test_an_id_may_be_stored_and_a_candidate(spark):
    at = dt.datetime(2024, 1, 20, 22)
    row = lambda i, who: (i, at, "v1", None, "", [who], None, True, "s", i)
    got = {r.id: tuple(r[1:]) for r in matching.visible_in_batch(made(spark, [row(1, "Ann"), row(2, "Ann"), row(3, "Bob")]), made(spark, [row(1, "Bob")])).collect()}
    assert got == {1: (True, None, None, "none"), 2: (False, 1, "batch", "medium"), 3: (False, 1, "stored", "medium")}


def test_one_event_under_two_urls_is_published_once(spark):
    at = dt.datetime(2024, 1, 20, 22)
    rows = [(i, at, "v1", None, "Moon Garden", ["Ann"], [f"https://x.dk/{i}"], True, "s", i) for i in range(3)]
    got = {r.id: (r.published, r.duplicate_of) for r in matching.visible_in_batch(made(spark, rows), made(spark, rows).limit(0)).collect()}
    assert got == {0: (True, None), 1: (False, 0), 2: (False, 0)}


def test_first_come_on_a_chain_and_random_graphs(spark):
    rng = random.Random(4)
    graphs = [[(i, i + 1) for i in range(6)], [tuple(sorted(rng.sample(range(30), 2))) for _ in range(60)], []]
    for edges in graphs:
        nodes = sorted({x for e in edges for x in e})
        stands = []
        for n in nodes:
            if not any((m, n) in edges for m in stands):
                stands.append(n)
        got = matching.first_come(spark.createDataFrame(edges, "early long, late long"))
        assert sorted(r.id for r in got.collect()) == stands


def test_a_long_chain_takes_turns(spark):
    got = matching.first_come(spark.createDataFrame([(i, i + 1) for i in range(36)], "early long, late long"))
    assert sorted(r.id for r in got.collect()) == list(range(0, 37, 2))


@pytest.mark.parametrize("seed", range(3))
def test_groups_of_one_event_from_several_sources(spark, seed):
    rows = random_rows(random.Random(20 + seed), 50)
    same = lambda a, b: a[2] and b[2] and a[8] != b[8] and abs(a[1] - b[1]) <= dt.timedelta(hours=2) and confidence(a, b) == "high"
    groups, expected = [], {}
    for r in sorted(rows, key=lambda r: r[9]):
        group = next((g for g in groups if all(m[8] != r[8] for m in g) and same(g[0], r)), None)
        if group:
            group.append(r)
            expected[r[0]] = group[0][0]
        else:
            groups.append([r])
    got = matching.first_fit_groups(matching.same_event_edges(made(spark, rows)))
    assert {r.id: r.group for r in got.collect()} == expected and expected


def test_exclusive_pairs_are_those_of_a_loop(spark):
    rng = random.Random(7)
    for n, m in ((12, 25), (40, 200), (2, 0)):
        edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
        used, expected = set(), []
        for a, b in sorted(edges):
            if a not in used and b not in used:
                used |= {a, b}
                expected.append((a, b))
        got = matching.exclusive_pairs(spark.createDataFrame(list(edges), "left long, right long"))
        assert sorted(map(tuple, got.collect())) == expected
