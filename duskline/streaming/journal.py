"""A run that is done once, whoever holds it: a numbered journal, a lease in it, and an outbox.

The journal is a folder of entries, each created under the next number and
only if nobody else has: its one atomic act. A run opens with an entry that
names its holder and how long it may take. A holder whose lease has run out, and
whom another has followed, does not know of the other's entry; its next entry takes
a number that is taken, and is refused. Each step writes its table to a folder of
its own and then enters it, so a table counts only once it is whole. A run that
follows a crashed one takes over the steps that were entered.

Folders go through Hadoop's file systems, so the path may be any that Spark
can read, if its store can create a file exclusively.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StaleRun(RuntimeError):
    """Another holder has gone on with the journal."""


class Journal:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/journal")
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at)

    def _file(self, number: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._at, f"{number:08d}.json")

    def entries(self) -> list[dict]:
        """All entries; one whose writer died before its text was whole is void."""
        out = []
        while self._fs.exists(self._file(len(out) + 1)):
            stream = self._fs.open(self._file(len(out) + 1))
            try:
                text = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()
            try:
                out.append(json.loads(text))
            except ValueError:
                out.append({"kind": "void"})
        return out

    def append(self, number: int, entry: dict) -> None:
        """Makes an entry the numbered one, or raises StaleRun if there is one."""
        try:
            out = self._fs.create(self._file(number), False)
        except Exception as e:  # noqa: BLE001  Py4J gives the class in the text only
            if "AlreadyExists" not in str(e) and "already exists" not in str(e):
                raise
            raise StaleRun(f"entry {number} is taken") from e
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()


class Run:
    """A holder's hold of a journal."""

    def __init__(self, journal: Journal, number: int, key: str, token: int, steps: dict[str, str]):
        self.journal, self.number, self.key, self.token, self.steps = journal, number, key, token, steps

    @classmethod
    def open(cls, journal: Journal, holder: str, now: dt.datetime, lease: dt.timedelta) -> Run | None:
        """A run for the holder, or none while another's lease lasts. What a crashed run has entered is taken over under its key."""
        entries = journal.entries()
        key, steps, until, token = uuid.uuid4().hex, {}, None, 0
        for e in entries:
            if e["kind"] == "open":
                until, token = dt.datetime.fromisoformat(e["until"]), e["token"]
                if e["key"] != key:
                    key, steps = e["key"], {}
            elif e["kind"] == "step":
                steps[e["step"]] = e["path"]
            elif e["kind"] == "close":
                key, steps, until = uuid.uuid4().hex, {}, None
        if until is not None and until > now:
            return None
        run = cls(journal, len(entries) + 1, key, token + 1, steps)
        try:
            run._enter({"kind": "open", "holder": holder, "until": (now + lease).isoformat()})
        except StaleRun:
            return None
        return run

    def _enter(self, entry: dict) -> None:
        self.journal.append(self.number, entry | {"key": self.key, "token": self.token})
        self.number += 1

    def step(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of a step: made, written and entered, unless the run already has it."""
        if name not in self.steps:
            path = f"{self.journal.path}/steps/{self.key}/{name}-{self.token}"
            make().write.mode("overwrite").parquet(path)
            self._enter({"kind": "step", "step": name, "path": path})
            self.steps[name] = path
        return self.journal.spark.read.parquet(self.steps[name])

    def close(self) -> None:
        self._enter({"kind": "close"})


def all_of(journal: Journal, step: str, schema: str) -> DataFrame:
    """The union of a step's tables over all runs so far."""
    paths = [e["path"] for e in journal.entries() if e["kind"] == "step" and e["step"] == step]
    return journal.spark.read.schema(schema).parquet(*paths) if paths else journal.spark.createDataFrame([], schema)


SENT = "delivery_id string, subscriber_id long, event_id long, sent_at timestamp"


def alert_run(journal: Journal, holder: str, now: dt.datetime, reconcile: Callable[[], DataFrame], plan: Callable[[DataFrame, DataFrame, dt.datetime], DataFrame], send: Callable[[DataFrame], None], lease: dt.timedelta = dt.timedelta(minutes=30), keep: dt.timedelta = dt.timedelta(days=90)) -> DataFrame | None:
    """Reconcile, retain, plan and send, each once; the rows sent, or none while another holder is at it.

    reconcile() gives the deliveries pending; plan(deliveries, sent, now) adds a
    column plan; send(rows) hands over those of plan `send`, each with a
    delivery_id that is the same whenever the row is sent again, for the
    receiver to know it by. What was sent within `keep` is retained for plans.
    """
    run = Run.open(journal, holder, now, lease)
    if run is None:
        return None
    stamp = F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    deliveries = run.step("reconcile", reconcile)
    retained = run.step("retain", lambda: all_of(journal, "sent", SENT).where(F.col("sent_at") >= stamp - F.expr(f"INTERVAL {int(keep.total_seconds())} SECONDS")))
    new = deliveries.join(retained.select("subscriber_id", "event_id"), ["subscriber_id", "event_id"], "left_anti")
    planned = run.step("plan", lambda: plan(new, retained, now).withColumn("delivery_id", F.sha2(F.concat_ws("|", "subscriber_id", "event_id"), 256)))
    outbox = planned.where("plan = 'send'")

    def hand_over() -> DataFrame:
        send(outbox)
        return outbox.select("delivery_id", F.col("subscriber_id").cast("long").alias("subscriber_id"), F.col("event_id").cast("long").alias("event_id"), stamp.alias("sent_at"))

    sent = run.step("sent", hand_over)
    run.close()
    return sent
