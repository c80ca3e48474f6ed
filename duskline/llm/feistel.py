"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered from 0 in the order of their key columns. A keyed Feistel
network permutes the numbers below the least even power of two that holds
them; numbers that leave the range are permuted again until they come back
(cycle walking), so the result is a permutation of exactly the rows. Position p
is in shard p mod k, slot p div k: shard sizes differ by one row at most, slots
have no gaps, and either is computed from a row number alone, both ways.

Rows that agree in all key columns are interchangeable, so the outcome does not
depend on how the input is split. Nulls sort first; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

ROUNDS = 6
#: Odd multipliers under 2^31, so that products stay within 63 bits.
MULTIPLIERS = (1597334677, 1540483477)
MODULUS = 1 << 32


def round_keys(seed: int) -> list[int]:
    return [(seed * MULTIPLIERS[0] + (i + 1) * MULTIPLIERS[1]) % (1 << 31) for i in range(ROUNDS)]


def half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


class FeistelShuffle:
    """Permutation of 0 .. n-1 that a seed determines."""

    def __init__(self, n: int, seed: int = 0):
        self.n, self.half, self.keys = n, half_bits(n), round_keys(seed)

    def _mix(self, x: np.ndarray, key: int) -> np.ndarray:
        y = (x * MULTIPLIERS[0] + key) % MODULUS
        y = ((y ^ (y >> 15)) * MULTIPLIERS[1]) % MODULUS
        return (y ^ (y >> 13)) & ((1 << self.half) - 1)

    def _once(self, x: np.ndarray, keys: list[int]) -> np.ndarray:
        left, right = x >> self.half, x & ((1 << self.half) - 1)
        for key in keys:
            left, right = right, left ^ self._mix(right, key)
        return (right << self.half) | left

    def _walk(self, x: np.ndarray, keys: list[int]) -> np.ndarray:
        y = self._once(np.asarray(x, np.int64), keys)
        while (out := np.flatnonzero(y >= self.n)).size:
            y[out] = self._once(y[out], keys)
        return y

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys)

    def inverse(self, y: np.ndarray) -> np.ndarray:
        return self._walk(y, self.keys[::-1])


def numbered(df: DataFrame, keys: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """df with rows numbered from 0 in the order of keys, and how many there are.

    Range partitions are sorted on their own, and a row's number is its place
    in its partition plus the rows of the partitions before; one count for each
    partition goes to the driver. The input's own row position breaks ties, so
    that a key repeated without end spreads over partitions too.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(k).asc_nulls_first() for k in keys] + [F.col("_tie")]
    spread = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = written(spread.drop("_tie").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    counts = placed.groupBy("_part").count().collect()
    starts, total = [], 0
    for part, count in sorted(counts):
        starts.append((part, total))
        total += count
    before = spark.createDataFrame(starts, "_part int, _before long")
    out = placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at"))
    return out.drop("_part", "_at", "_before"), total


def feistel_shards(df: DataFrame, keys: list[str], shards: int = 16, seed: int = 0) -> DataFrame:
    """Adds row_number, shard (int) and slot (long) to df."""
    rows, total = numbered(df, keys)
    shuffle = FeistelShuffle(total, seed)

    @F.pandas_udf(T.LongType())
    def position(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(shuffle.forward(x.to_numpy()))

    placed = rows.withColumn("_position", position("row_number"))
    return placed.withColumns({"shard": (F.col("_position") % shards).cast("int"), "slot": F.expr(f"_position div {shards}")}).drop("_position")


def oracle(shards: int = 16, seed: int = 0) -> str:
    """DuckDB SQL for the query over documents: the same network as integer arithmetic, CRC-32 byte by byte."""
    mix = lambda x, key: f"(xor(((xor((({x}) * {MULTIPLIERS[0]} + {key}) % {MODULUS}, ((({x}) * {MULTIPLIERS[0]} + {key}) % {MODULUS}) >> 15)) * {MULTIPLIERS[1]}) % {MODULUS}, (((xor((({x}) * {MULTIPLIERS[0]} + {key}) % {MODULUS}, ((({x}) * {MULTIPLIERS[0]} + {key}) % {MODULUS}) >> 15)) * {MULTIPLIERS[1]}) % {MODULUS}) >> 13) & ((1::BIGINT << half) - 1))"
    rounds = ",\n".join(f"r{i + 1} AS MATERIALIZED (SELECT * EXCLUDE (l, r), r AS l, xor(l, {mix('r', key)}) AS r FROM r{i})" for i, key in enumerate(round_keys(seed)))
    return f"""
WITH RECURSIVE
crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i::BIGINT], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) x(i))),
bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
  SELECT doc_id, length(h) // 2 + 1 AS size,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM bytes, crc_table),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS x, count(*) OVER () AS n FROM sized),
halved AS (SELECT *, greatest(1, (length(bin(greatest(n - 1, 1))) + 1) // 2) AS half FROM numbered),
walk AS (
  SELECT doc_id, size, text_crc32, n, half, x AS p, 0 AS hop FROM halved
  UNION ALL
  SELECT doc_id, size, text_crc32, n, half, (r << half) | l AS p, hop + 1 FROM (
    WITH r0 AS (SELECT doc_id, size, text_crc32, n, half, hop, p >> half AS l, p & ((1::BIGINT << half) - 1) AS r FROM walk WHERE hop = 0 OR p >= n),
    {rounds.replace(" AS MATERIALIZED", " AS")}
    SELECT * FROM r{ROUNDS}))
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p % {shards} AS INTEGER) AS shard, p // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM walk WHERE hop > 0 AND p < n
"""
