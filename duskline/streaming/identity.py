"""Identities kept across runs: which artist each billed name is, as a stream with state.

Messages about names come from an append-only log and are keyed by the name.
State holds, for each name, its known artists, the profiles that were linked to each, and
its appearances; so a run changes what earlier ones decided only by what it
has learnt. Messages are numbered in the order of the log and taken in it; one whose
number a name has had is passed over, so what is given twice changes nothing. How
messages are cut into batches does not matter, as long as batches come in that order.

kind, and what it uses:
  artist   artist_id, status (auto, verified, requested, rejected or merged), profile
  seen     event_id, name, profile (the source's own link, or null), bucket
  gone     event_id: the event no longer bills the name
  verdict  event_id, status (confirmed or rejected): an editor's word, which stays
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MESSAGE = "name_key string, number long, at timestamp, kind string, event_id string, name string, profile string, bucket string, artist_id string, status string"
APPEARANCE = "name_key string, number long, event_id string, name string, artist_id string, confidence string, reason string, visible_since timestamp, confirmed_at timestamp, removed_at timestamp"
_FIELDS = ["name", "artist_id", "confidence", "reason", "visible_since", "confirmed_at", "removed_at"]
#: Confidences on which alerts are sent, and buckets of names that are no performer's.
ALERTABLE, NO_PERFORMER = ("high", "confirmed"), ("not_artist", "venue")
_NEVER = None


class Names:
    """What is known of one name; dictionaries here, state variables in a stream."""

    def __init__(self, artists, profiles, confirmed, appearances):
        self.artists, self.profiles, self.confirmed, self.appearances = artists, profiles, confirmed, appearances

    def of(self, artist: str) -> set[str]:
        return {url for owner, url in self.profiles if owner == artist}

    def documented(self, artist: str) -> bool:
        """Whether anything but the name says who the artist is."""
        return self.artists[(artist,)][0] == "verified" or bool(self.of(artist)) or any(owner == artist for owner, _ in self.confirmed)

    def decided(self, key: str, profile: str | None, bucket: str) -> tuple[str | None, str, str]:
        """(artist, confidence, reason) of a billed name."""
        known = [a for (a,), (status, _) in self.artists.items() if status not in ("rejected", "merged")]
        if len(known) > 1:
            return None, "review", "several artists share this name"
        artist = known[0] if known else "artist-" + hashlib.sha256(key.encode()).hexdigest()[:12]
        if not known:
            self.artists[(artist,)] = ("auto", None)
        status, asked = self.artists[(artist,)]
        mine = self.of(artist)
        if len(mine) > 1:
            return artist, "review", "conflicting profiles"
        if status == "requested" and not (profile and profile == asked):
            return artist, "review", "requested artist, by name only"
        if status == "requested":
            self.artists[(artist,)] = ("verified", asked)
        elif profile and mine and profile not in mine:
            return artist, "review", "another profile than the known one"
        if profile:
            self.profiles[(artist, profile)] = (True,)
            return artist, "high", "profile"
        if bucket == "distinct":
            return artist, "high", "distinct name"
        if bucket in ("short", "title_copy") and self.documented(artist):
            return artist, "high", f"{bucket}, documented elsewhere"
        return artist, "review", bucket

    def take(self, key: str, m: dict) -> tuple | None:
        """Takes a message in; the appearance it changes, as event_id and _FIELDS."""
        if m["kind"] == "artist":
            old = self.artists.get((m["artist_id"],))
            # what a run has verified is not undone by the request being repeated
            if not (old and old[0] == "verified" and m["status"] == "requested"):
                self.artists[(m["artist_id"],)] = (m["status"], m["profile"])
            return None
        prior = self.appearances.get((m["event_id"],))
        if m["kind"] == "seen":
            if prior and prior[2] in ("confirmed", "rejected"):
                artist, confidence, reason = prior[1:4]
            elif m["bucket"] in NO_PERFORMER:
                artist, confidence, reason = None, "excluded", m["bucket"]
            else:
                artist, confidence, reason = self.decided(key, m["profile"], m["bucket"])
            confirmed = prior[5] if prior and prior[5] else (m["at"] if confidence in ALERTABLE else _NEVER)
            now = (m["name"], artist, confidence, reason, prior[4] if prior else m["at"], confirmed, _NEVER)
        elif prior is None:
            return None
        elif m["kind"] == "gone":
            now = (*prior[:6], prior[6] or m["at"])
        else:
            if m["status"] == "confirmed" and prior[1]:
                self.confirmed[(prior[1], m["event_id"])] = (True,)
            else:
                self.confirmed.pop((prior[1], m["event_id"]), None)
            now = (*prior[:2], m["status"], "editor", prior[4], prior[5] or (m["at"] if m["status"] in ALERTABLE else _NEVER), prior[6])
        if now == prior:
            return None
        self.appearances[(m["event_id"],)] = now
        return (m["event_id"], *now)


class _MapState:
    """A state variable with the few dictionary methods that Names uses."""

    def __init__(self, state):
        self.state = state

    def __contains__(self, key):
        return self.state.containsKey(key)

    def __getitem__(self, key):
        return tuple(self.state.getValue(key))

    def get(self, key):
        return self[key] if key in self else None

    def __setitem__(self, key, value):
        self.state.updateValue(key, value)

    def pop(self, key, default):
        if key in self:
            self.state.removeKey(key)

    def __iter__(self):
        return iter([tuple(k) for k in self.state.keys()])

    def items(self):
        return [(tuple(k), tuple(v)) for k, v in self.state.iterator()]


_TYPES = {"string": T.StringType(), "timestamp": T.TimestampType(), "long": T.LongType(), "boolean": T.BooleanType()}


def _schema(text: str) -> T.StructType:
    """A schema as written above; workers have no session that could parse it."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in text.split(", "))])


class Reconciler(StatefulProcessor):
    """Keeps Names for each name, and gives the appearances that change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = {f.name: f for f in _schema(APPEARANCE)}
        self.names = Names(
            _MapState(handle.getMapState("artists", _schema("artist_id string"), _schema("status string, profile string"))),
            _MapState(handle.getMapState("profiles", _schema("artist_id string, profile string"), _schema("linked boolean"))),
            _MapState(handle.getMapState("confirmed", _schema("artist_id string, event_id string"), _schema("confirmed boolean"))),
            _MapState(handle.getMapState("appearances", _schema("event_id string"), T.StructType([fields[f] for f in _FIELDS]))),
        )
        self.last = handle.getValueState("last", _schema("number long"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("number", kind="stable")
        plain = lambda x: None if x is None or x is pd.NaT or x != x else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x
        out, last = [], self.last.get()[0] if self.last.exists() else -1
        for m in pdf.to_dict("records"):
            if m["number"] <= last:
                continue
            last = m["number"]
            changed = self.names.take(key[0], {k: plain(v) for k, v in m.items()})
            if changed:
                out.append((key[0], m["number"], *changed))
        self.last.update((last,))
        columns = [f.name for f in _schema(APPEARANCE)]
        frame = pd.DataFrame(out, columns=columns, dtype=object)
        for c in ("visible_since", "confirmed_at", "removed_at"):
            frame[c] = pd.to_datetime(frame[c])
        yield frame.astype({"number": "int64"})

    def close(self) -> None:
        pass


def reconciled(messages: DataFrame) -> DataFrame:
    """The stream of appearances as they change, of a stream of messages. State variables need the RocksDB state store, which the session must name."""
    provider = messages.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    if not provider.endswith("RocksDBStateStoreProvider"):
        raise ValueError("spark.sql.streaming.stateStore.providerClass must be the RocksDB provider")
    return messages.groupBy("name_key").transformWithStateInPandas(Reconciler(), _schema(APPEARANCE), "Update", "None")


def current(changes: DataFrame) -> DataFrame:
    """The last state of each appearance, from all changes."""
    rest = [c for c in changes.columns if c not in ("name_key", "event_id", "number")]
    last = changes.groupBy("name_key", "event_id").agg(F.max_by(F.struct(*rest), F.col("number")).alias("a"))
    return last.select("name_key", "event_id", "a.*")


def lineup_messages(stored: DataFrame, run: DataFrame, at: Column) -> DataFrame:
    """seen and gone messages of a run: event_id, name_key and the columns of run for what it has; the names that its events have lost.

    stored: event_id, name_key of appearances not yet removed. run: event_id, name_key, name, profile, bucket. Events that the run did not look at lose nothing.
    """
    looked = run.select("event_id").distinct()
    lost = stored.select("event_id", "name_key").join(looked, "event_id", "left_semi").join(run.select("event_id", "name_key").distinct(), ["event_id", "name_key"], "left_anti")
    seen = run.select("event_id", "name_key", "name", "profile", "bucket", F.lit("seen").alias("kind"))
    gone = lost.select("event_id", "name_key", *[F.lit(None).cast("string").alias(c) for c in ("name", "profile", "bucket")], F.lit("gone").alias("kind"))
    return seen.unionByName(gone).withColumn("at", at)
