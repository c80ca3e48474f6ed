"""Delta-maintained token totals by source, language and tokenizer version.

A batch of changes (inserts, deletes, revised counts) becomes signed deltas of
documents and tokens, summed by key before they are shuffled, and is committed
as one folder named after the batch. Totals are the sums over all committed
batches. A batch is committed if its folder has Spark's success mark: a batch
given again changes nothing, one that was cut short is written anew. compact()
folds committed batches into a base, which names them, so that they stay known,
and removes their folders; the driver lists only what was committed since.

One writer at a time is assumed. Null source, language and tokenizer are keys of
their own; a null count is 0; repeated change rows each count. An empty batch is
committed too, and so is one of an empty table. Columns other than the named ones are left out. Keys whose documents and tokens are all gone keep a row of zeros
out of totals().
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, documents long, tokens long"


def inserts(counted: DataFrame) -> DataFrame:
    """Signed deltas of new documents: source, lang, tokenizer, n_tokens."""
    return counted.select(*KEYS, F.lit(1).cast("long").alias("documents"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("tokens"))


def deletes(counted: DataFrame) -> DataFrame:
    """Signed deltas of documents that go, with the counts that they were inserted with."""
    return counted.select(*KEYS, F.lit(-1).cast("long").alias("documents"), (-F.coalesce(F.col("n_tokens"), F.lit(0))).cast("long").alias("tokens"))


def revisions(changed: DataFrame) -> DataFrame:
    """Signed deltas of recounted documents: the old key loses old_tokens, (source, lang, new_tokenizer) gains new_tokens."""
    old = changed.select(*KEYS, F.col("old_tokens").alias("n_tokens"))
    new = changed.select("source", "lang", F.col("new_tokenizer").alias("tokenizer"), F.col("new_tokens").alias("n_tokens"))
    return deletes(old).unionByName(inserts(new))


class TokenRollup:
    """Totals kept in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        files, at = self._files(path)
        return files.exists(at)

    def _finished(self, parent: str) -> list[str]:
        """Names of the finished folders below a folder, by one listing."""
        files, at = self._files(f"{parent}/*/_SUCCESS")
        return sorted(x.getPath().getParent().getName() for x in files.globStatus(at) or [])

    def _base(self) -> str | None:
        """The newest finished base."""
        return max(self._finished(f"{self.path}/base"), default=None)

    def _batches(self, base: str) -> DataFrame:
        """The names of all batches that a base holds."""
        return self.spark.read.schema("batch string").parquet(f"{self.path}/batches/{base}")

    def committed(self, batch: str) -> bool:
        if self._exists(f"{self.path}/delta/{self._name(batch)}/_SUCCESS"):
            return True
        base = self._base()
        return base is not None and not self._batches(base).where(F.col("batch") == self._name(batch)).isEmpty()

    @staticmethod
    def _name(batch: str) -> str:
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"a batch name is made of letters, digits, _, . and -: {batch!r}")
        return f"batch-{batch}"

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Applies a batch once; False if it had been committed before."""
        if self.committed(batch):
            return False
        summed = deltas.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        summed.write.mode("overwrite").parquet(f"{self.path}/delta/{self._name(batch)}")
        return True

    def _open(self, base: str | None) -> list[str]:
        """Committed batches that the base does not hold. compact() removes those it folds; if it was cut short, the base still tells."""
        names = self._finished(f"{self.path}/delta")
        if not base or not names:
            return names
        held = {r[0] for r in self._batches(base).where(F.col("batch").isin(*names)).collect()}
        return [n for n in names if n not in held]

    def _all(self) -> DataFrame:
        base = self._base()
        paths = [f"{self.path}/delta/{n}" for n in self._open(base)] + ([f"{self.path}/base/{base}"] if base else [])
        return self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens of all keys that have any."""
        summed = self._all().groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return summed.where("documents <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Writes a new base of all committed batches, then removes the folders that it holds; a reader sees the old base until the new one is whole."""
        before = self._base()
        names = self._open(before)
        base = f"v{int(before[1:]) + 1 if before else 1:08d}"
        batches = self.spark.createDataFrame([(n,) for n in names], "batch string")
        batches = batches.unionByName(self._batches(before)) if before else batches
        batches.coalesce(8).write.mode("overwrite").parquet(f"{self.path}/batches/{base}")
        self._all().groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(f"{self.path}/base/{base}")
        for name in self._finished(f"{self.path}/delta"):
            if name in set(names):
                files, at = self._files(f"{self.path}/delta/{name}")
                files.delete(at, True)
