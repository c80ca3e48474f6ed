"""Runs that are done once: leases, refused writes, crashes between steps."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from duskline.operators import pipeline
from duskline.streaming import journal

NOW = dt.datetime(2024, 1, 15, 12)
MINUTE = dt.timedelta(minutes=1)


@pytest.fixture()
def log(spark, tmp_path):
    return journal.Journal(spark, f"file://{tmp_path}")


def test_one_holder_at_a_time(log):
    run = journal.Run.open(log, "a", NOW, 5 * MINUTE)
    assert run and journal.Run.open(log, "b", NOW + MINUTE, 5 * MINUTE) is None
    run.close()
    assert journal.Run.open(log, "b", NOW + MINUTE, 5 * MINUTE)


def test_a_stale_holder_is_refused(spark, log):
    old = journal.Run.open(log, "a", NOW, MINUTE)
    new = journal.Run.open(log, "b", NOW + 2 * MINUTE, MINUTE)
    assert new.token == old.token + 1
    with pytest.raises(journal.StaleRun):
        old.step("plan", lambda: spark.range(1))
    assert [r.id for r in new.step("plan", lambda: spark.range(2, 3)).collect()] == [2]
    with pytest.raises(journal.StaleRun):
        old.close()
    assert journal.all_of(log, "plan", "id long").count() == 1


def test_a_step_is_made_once_whoever_goes_on(spark, log):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    first = journal.Run.open(log, "a", NOW, MINUTE)
    first.step("plan", make)
    again = journal.Run.open(log, "b", NOW + 2 * MINUTE, MINUTE)
    assert again.key == first.key and again.step("plan", make).count() == 3 and len(made) == 1
    again.close()
    later = journal.Run.open(log, "a", NOW + 3 * MINUTE, MINUTE)
    assert later.key != first.key and later.step("plan", make).count() == 3 and len(made) == 2


def test_an_entry_cut_short_is_void(log):
    journal.Run.open(log, "a", NOW, MINUTE)
    log._fs.create(log._file(2), False).close()
    assert [e["kind"] for e in log.entries()] == ["open", "void"]
    assert journal.Run.open(log, "b", NOW + 2 * MINUTE, MINUTE).number == 4


DELIVERY = "subscriber_id long, event_id long, start timestamp, created_at timestamp, public boolean, alertable boolean"


def test_a_crash_between_plan_and_send_delivers_once(spark, log):
    day = dt.timedelta(days=1)
    rows = [(s, e, NOW + 3 * day, NOW - MINUTE, True, True) for s in (1, 2) for e in (10, 11)] + [(3, 10, NOW + MINUTE, NOW, True, True)]
    pending = lambda: spark.createDataFrame(rows, DELIVERY)
    plan = lambda d, sent, now: pipeline.alert_run(d, sent, F.lit(str(now)).cast("timestamp"), per_email=1)
    handed = []

    def send(df):
        handed.extend((r.subscriber_id, r.event_id, r.delivery_id) for r in df.collect())

    def crash(df):
        raise RuntimeError("gone")

    with pytest.raises(RuntimeError):
        journal.alert_run(log, "a", NOW, pending, plan, crash)
    assert journal.alert_run(log, "b", NOW + MINUTE, pending, plan, send) is None and not handed
    late = NOW + dt.timedelta(hours=1)
    # the plan of the crashed run is taken over: it isn't made again of other rows
    sent = journal.alert_run(log, "b", late, lambda: spark.createDataFrame([], DELIVERY), plan, send)
    assert sorted(h[:2] for h in handed) == [(1, 10), (2, 10)] and sent.count() == 2
    assert journal.alert_run(log, "b", late + MINUTE, pending, plan, send).count() == 0
    assert journal.alert_run(log, "b", late + day, pending, plan, send).count() == 2
    assert sorted(h[:2] for h in handed) == [(1, 10), (1, 11), (2, 10), (2, 11)] and len({h[2] for h in handed}) == 4
    assert journal.all_of(log, "sent", journal.SENT).count() == 4
