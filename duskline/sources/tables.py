"""Tables of a folder, with time-zone-free stamps taken as UTC, and contracts for their columns."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; TIMESTAMP_NTZ columns become UTC timestamps (the session zone is UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    stamps = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(stamps) if stamps else df


def require(df: DataFrame, contract: T.StructType) -> DataFrame:
    """df in the contract's columns and order; a missing or differently typed column is an error, further ones are dropped."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {have.get(f.name)} instead of {f.dataType}" for f in contract if have.get(f.name) != f.dataType]
    if wrong:
        raise TypeError("; ".join(wrong))
    return df.select(*contract.names)


def by_keys(df: DataFrame, column: str, keys: list) -> DataFrame:
    """Rows whose column is one of a few keys; no keys give no rows without a scan."""
    return df.where(F.col(column).isin(*keys)) if keys else df.limit(0)


def by_key(df: DataFrame, column: str, key) -> DataFrame:
    """The row of a unique key."""
    return df.where(F.col(column) == key).limit(1)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, which a cluster must name; in local mode, where it is unset, a new temporary one."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='duskline-')}")
    return spark.conf.get("spark.checkpoint.dir").rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the shared folder, so that it is the same rows in the same partitions whenever it is read again."""
    df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
