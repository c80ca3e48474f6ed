"""Registers queries with their SQL, and derives the event model from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The instant at which all queries look at the tables.
NOW_TEXT = "2024-01-15 12:00:00"


def now() -> Column:
    return F.lit(NOW_TEXT).cast("timestamp")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with SQL over the same tables if it has any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.format(**SQL) if "{" in sql else sql
        return f

    return add


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as listings: event_type is the venue, the end is value minutes on, unknown for every third id."""
    end = F.when(F.col("event_id") % 3 != 0, F.timestamp_micros(F.unix_micros("ts") + (F.col("value") * 60).cast("long") * 1_000_000))
    return load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("venue"), "user_id", "value", F.col("ts").alias("start"), end.alias("end"))


#: Pieces of SQL that the oracles share.
SQL = {
    "now": f"TIMESTAMP '{NOW_TEXT}'",
    "listed": "(SELECT event_id, event_type AS venue, user_id, value, ts AS start, CASE WHEN event_id % 3 <> 0 THEN ts + to_seconds(CAST(trunc(value * 60) AS BIGINT)) END AS \"end\" FROM events)",
    "local": "timezone('Europe/Copenhagen', timezone('UTC', start))",
    "night": "CAST(timezone('Europe/Copenhagen', timezone('UTC', start)) - INTERVAL 6 HOUR AS DATE)",
    "effend": "CASE WHEN \"end\" > start THEN \"end\" ELSE timezone('UTC', timezone('Europe/Copenhagen', CAST(CAST(timezone('Europe/Copenhagen', timezone('UTC', start)) - INTERVAL 6 HOUR AS DATE) + 1 AS TIMESTAMP) + INTERVAL 6 HOUR)) END",
}
