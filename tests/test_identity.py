"""Identities with state across batches, against one pass over all messages."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from duskline.streaming import identity

T = dt.datetime


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def message(key, number, minute, kind, event=None, name=None, profile=None, bucket=None, artist=None, status=None):
    return (key, number, T(2024, 1, 1) + dt.timedelta(minutes=minute), kind, event, name, profile, bucket, artist, status)


def in_one_pass(messages):
    """{(name, event): appearance} of all messages in order."""
    names, out = {}, {}
    fields = [c.split()[0] for c in identity.MESSAGE.split(", ")]
    for m in {m[1]: m for m in sorted(messages, key=lambda m: m[1])}.values():
        m = dict(zip(fields, m, strict=True))
        known = names.setdefault(m["name_key"], identity.Names({}, {}, {}, {}))
        if changed := known.take(m["name_key"], m):
            out[m["name_key"], changed[0]] = changed[1:]
    return out


def run(spark, at, batches, again=()):
    """The appearances after batches, each a run of its own; those named in again are given once more."""
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, identity.MESSAGE).coalesce(1).write.mode("append").parquet(f"{at}/in")
        if i in again:
            spark.createDataFrame(batch, identity.MESSAGE).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = identity.reconciled(spark.readStream.schema(identity.MESSAGE).parquet(f"{at}/in"))
        keep = lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}")
        query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    changes = spark.read.schema(identity.APPEARANCE).parquet(f"{at}/out")
    return {(r.name_key, r.event_id): tuple(r)[2:] for r in identity.current(changes.select(*[c.split()[0] for c in identity.APPEARANCE.split(", ")])).collect()}


def random_messages(rng, n):
    out = []
    for i in range(n):
        key = rng.choice("abc")
        kind = rng.choices(["seen", "gone", "verdict", "artist"], [8, 2, 1, 1])[0]
        event, profile = f"e{rng.randint(0, 4)}", rng.choice([None, None, "u/1", "u/2"])
        if kind == "seen":
            out.append(message(key, i, i, kind, event, key.upper(), profile, rng.choice(["distinct", "short", "title_copy", "marker", "venue"])))
        elif kind == "gone":
            out.append(message(key, i, i, kind, event))
        elif kind == "verdict":
            out.append(message(key, i, i, kind, event, status=rng.choice(["confirmed", "rejected"])))
        else:
            out.append(message(key, i, i, kind, profile=profile, artist=f"A{rng.randint(0, 1)}", status=rng.choice(["auto", "requested", "merged"])))
    return out


def test_three_batches_one_given_twice_are_one_pass_over_all(rocks, tmp_path):
    messages = random_messages(random.Random(3), 90)
    expected = in_one_pass(messages)
    assert len(expected) > 8 and {a[2] for a in expected.values()} >= {"high", "review"}
    batches = [messages[:30], messages[30:60], messages[60:]]
    assert run(rocks, str(tmp_path / "three"), [*batches, batches[0]], again=(1,)) == expected
    assert run(rocks, str(tmp_path / "one"), [messages]) == expected


def test_handles_conflicts_and_removal_last_across_batches(rocks, tmp_path):
    first = [
        message("ann", 1, 0, "seen", "e1", "Ann", "u/ann", "distinct"),
        message("bo", 2, 0, "seen", "e1", "Bo", None, "short"),
        message("cy", 3, 0, "artist", artist="C1", status="auto"),
        message("cy", 4, 0, "artist", artist="C2", status="auto"),
        message("di", 5, 0, "artist", profile="u/di", artist="D1", status="requested"),
    ]
    second = [
        message("ann", 6, 10, "seen", "e2", "Ann", "u/other", "distinct"),
        message("ann", 7, 10, "gone", "e1"),
        message("bo", 8, 10, "verdict", "e1", status="confirmed"),
        message("cy", 9, 10, "seen", "e2", "Cy", None, "distinct"),
        message("di", 10, 10, "seen", "e2", "Di", None, "distinct"),
    ]
    third = [
        message("ann", 11, 20, "seen", "e1", "Ann", None, "title_copy"),
        message("bo", 12, 20, "seen", "e3", "Bo", None, "short"),
        message("cy", 13, 20, "artist", artist="C2", status="merged"),
        message("cy", 14, 21, "seen", "e2", "Cy", None, "distinct"),
        message("di", 15, 20, "seen", "e4", "Di", "u/di", "distinct"),
        message("eve", 16, 20, "seen", "e4", "Eve", None, "venue"),
    ]
    got = run(rocks, str(tmp_path), [first, second, third], again=(1,))
    assert {k: (a[1], a[2]) for k, a in got.items() if k[0] != "eve"} == {
        ("ann", "e1"): (got["ann", "e1"][1], "high"), ("ann", "e2"): (got["ann", "e1"][1], "review"),
        ("bo", "e1"): (got["bo", "e1"][1], "confirmed"), ("bo", "e3"): (got["bo", "e1"][1], "high"),
        ("cy", "e2"): ("C1", "high"), ("di", "e2"): ("D1", "review"), ("di", "e4"): ("D1", "high"),
    }
    assert got["eve", "e4"][1:3] == (None, "excluded")
    # back again: no longer removed, and visible since it was first seen
    assert got["ann", "e1"][4] == T(2024, 1, 1) and got["ann", "e1"][6] is None
    assert got == in_one_pass([*first, *second, *second, *third])


def test_the_state_store_must_be_named(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        identity.reconciled(spark.createDataFrame([], identity.MESSAGE))


def test_messages_of_a_run(spark):
    stored = spark.createDataFrame([("e1", "a"), ("e1", "b"), ("e2", "a")], "event_id string, name_key string")
    seen = spark.createDataFrame([("e1", "a", "A", None, "distinct")], "event_id string, name_key string, name string, profile string, bucket string")
    got = identity.lineup_messages(stored, seen, F.lit("2024-01-01").cast("timestamp")).collect()
    assert {(r.event_id, r.name_key, r.kind) for r in got} == {("e1", "a", "seen"), ("e1", "b", "gone")}
