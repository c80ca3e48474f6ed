"""Micro-batches over append-only tables: triggers, exactly-once sinks, completeness and holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import decisions, joins


def log_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The change log as a stream of its files."""
    return spark.readStream.schema(schema).parquet(path)


def run_available(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """One scheduled run: all that is there, in micro-batches. The checkpoint makes it the only writer."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Deliveries:
    """An append-only table that takes each key once, whatever is run again."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str):
        self.spark, self.path, self.keys, self.schema = spark, path, keys, schema

    def stored(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).option("mergeSchema", "false").parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def deliver(self, rows: DataFrame, batch: int) -> None:
        """Appends the rows whose key is new, as one folder of the batch, so that a batch that is run again replaces itself."""
        before = self.stored().where(F.col("batch") != batch).select(*self.keys)
        new = rows.dropDuplicates(self.keys).join(before, self.keys, "left_anti")
        new.drop("batch").write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


def held(rows: DataFrame, visible: str, confirmed: str, hold: str, now: Column) -> DataFrame:
    """Rows visible for the hold time and confirmed within it."""
    until = F.col(visible) + F.expr(f"INTERVAL {hold}")
    return rows.where((F.col(confirmed) <= until) & (until <= now))


def mark_complete(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """sources with last_complete_at moved on by runs that were complete and found something; others leave it."""
    done = runs.where("complete AND found > 0").groupBy("source_id").agg(F.max("ran_at").alias("_at"))
    return sources.join(done, "source_id", "left").withColumn("last_complete_at", F.greatest("last_complete_at", "_at")).drop("_at")


def run_outcome(found: Column, problems: Column, failures: Column) -> Column:
    """A run that finds nothing has failed; it never means that all rows are gone."""
    return F.when(found == 0, "failed").when((problems > 0) | (failures > 0), "partial_failure").otherwise("ok")


def stale(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows not seen since their source's last complete run."""
    s = sources.select("source_id", "last_complete_at")
    return rows.join(s, "source_id", "left").where(~decisions.is_current(F.col("last_seen_at"), F.col("last_complete_at"))).drop("last_complete_at")


APPEARANCE = "event_id long, name_key string, name string, profile string, artist_id string, confidence string, action string"


def reconcile_names(appearances: DataFrame, artists: DataFrame) -> DataFrame:
    """Appearances with the artist they belong to: event_id, name_key, name, profile, artist_id, confidence, action.

    One artist under the name: his. Several, or none: the one with the profile,
    else a new one for the (name, profile), named after both. Conflicting
    profiles lower the confidence. All joins are on the name key.
    """
    known = artists.groupBy("name_key").agg(F.count("*").alias("n"), F.min("artist_id").alias("only"), F.max("profile").alias("only_profile"))
    by_profile = artists.where("profile IS NOT NULL").groupBy("name_key", "profile").agg(F.min("artist_id").alias("by_profile"))
    a = appearances.join(known, "name_key", "left").join(by_profile, ["name_key", "profile"], "left")
    conflict = F.coalesce((F.col("n") == 1) & F.col("profile").isNotNull() & F.col("only_profile").isNotNull() & (F.col("profile") != F.col("only_profile")), F.lit(False))
    fresh = F.concat(F.lit("artist-"), F.substring(F.sha2(F.concat_ws("|", "name_key", F.coalesce("profile", F.lit(""))), 256), 1, 12))
    found = F.coalesce("by_profile", F.when((F.col("n") == 1) & ~conflict, F.col("only")))
    confidence = F.when(F.col("by_profile").isNotNull(), "high").when(conflict | (F.coalesce("n", F.lit(0)) > 1), "review").when(F.col("profile").isNotNull(), "high").otherwise("medium")
    return a.select("event_id", "name_key", "name", "profile", F.coalesce(found, fresh).alias("artist_id"), confidence.alias("confidence"), F.when(found.isNull(), "create").otherwise("link").alias("action"))


def soft_removed(stored: DataFrame, seen: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """stored with removed_at set on rows that the run no longer has, and cleared on those that came back."""
    now = seen.select(*keys, F.lit(True).alias("_seen")).dropDuplicates(keys)
    out = stored.join(now, keys, "left")
    return out.withColumn("removed_at", F.when(F.col("_seen"), F.lit(None).cast("timestamp")).otherwise(F.coalesce("removed_at", at))).drop("_seen")


def ingest(candidates: DataFrame, stored: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to create, patches of stored rows) of a batch of candidates, each key once, the last of a batch winning."""
    last = joins.latest_per_key(candidates, [key], [F.col("ord")]).drop("ord")
    create = last.join(stored.select(key), key, "left_anti")
    both = stored.select(key, "locked", *[F.col(f).alias(f"old_{f}") for f in fields]).join(last.select(key, *[F.col(f).alias(f"new_{f}") for f in fields]), key)
    patch = decisions.sync_patch(both, fields, F.col("locked"))
    return create, both.select(key, patch.alias("patch")).where(F.size("patch") > 0)
