"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
#: Rows that a Python function works on at a time; Spark bounds the bytes of the batches that it sends.
BATCH_ROWS = 256
#: Keys with more than one in HUBS of all rows are fewer than HUBS, so they can be broadcast.
HUBS, HUB_ROWS = 10_000, 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, which a cluster must name; in local mode, where it is unset, a new temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='duskline-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/duskline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._duskline_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what written() wrote and nothing reads any more."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._duskline_path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def joined_spread(rows: DataFrame, named: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined to named (one row a key; n: how many of rows have the key), both written tables, without a task that gets all rows of a hot key.

    Hot keys (see HUBS) stay where they are and meet a broadcast of a bounded
    number of rows; the others are shuffled.
    """
    total, most = named.agg(F.sum(n), F.max(n)).first()
    limit = max((total or 0) // HUBS, HUB_ROWS)
    if (most or 0) <= limit:
        return rows.join(named, key)
    hot = F.col(n) > limit
    hubs = F.broadcast(named.where(hot))
    rest = rows.join(hubs.select(key), key, "left_anti").join(named.where(~hot), key)
    return rows.join(hubs, key).unionByName(rest)


def pieces(batches: Iterator[pd.Series], rows: int = BATCH_ROWS) -> Iterator[pd.Series]:
    """Arrow batches in shorter pieces, which bounds what a worker makes of them at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows].reset_index(drop=True)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, mod folds; a null id is in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def computed_once(column: Column) -> Column:
    """column, tied to the partition id (a condition that always holds).

    Filters and projections are not moved below a column that isn't
    deterministic. Without that, a filter on a result would be rewritten in
    terms of the text, and what a lambda refers to computed for every element.
    """
    return F.when(F.spark_partition_id() >= 0, column)


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters other than SPACES; null has none."""
    spaced = F.coalesce(text, F.lit(""))
    for c in SPACES[1:]:
        # byte searches, several times as fast as translate() or a regular expression
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
